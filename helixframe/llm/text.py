"""Vectorised text kernels for Arrow batches, and the mapping of a table through them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Characters worked on at once, unless a single text is longer.
SLAB_CHARS = 1 << 17
#: Rows of an Arrow batch turned into Python values at once.
SLICE_ROWS = 512

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def slabs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about SLAB_CHARS characters each."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        if n and n + len(t) > SLAB_CHARS:
            yield i, j
            i, n = j, 0
        n += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def to_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, each followed by a space, and where each begins (one more at the end)."""
    joined = " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.cumsum([0] + [len(t) + 1 for t in texts])


@lru_cache(maxsize=4)
def _table(kind: str) -> np.ndarray:
    test = {"letter": str.isalpha, "word": str.isalnum, "space": str.isspace, "upper": str.isupper}[kind]
    return np.array([test(chr(c)) for c in range(0x10000)])


def is_kind(codes: np.ndarray, kind: str) -> np.ndarray:
    """Which code points are letters, word characters (letters and digits), white space or capitals."""
    out = _table(kind)[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        test = {"letter": str.isalpha, "word": str.isalnum, "space": str.isspace, "upper": str.isupper}[kind]
        out[far] = [test(chr(c)) for c in codes[far]]
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class SpanHash:
    """Hashes of any spans of an array of code points: a prefix polynomial modulo 2^64, then mixed with the length."""

    def __init__(self, codes: np.ndarray):
        up, self._down = _POWERS.get(len(codes) + 1)
        self._sum = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=self._sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sum[ends] - self._sum[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _BASE)


def sequence_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out * _BASE + values[i : i + m] + np.uint64(1))
    return out


def per_text(bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Offsets into sorted places where each text's begin, one more at the end."""
    return np.searchsorted(places, bounds)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; 0 for empty parts."""
    c = np.concatenate((np.zeros(1, np.result_type(values.dtype, np.float64 if values.dtype.kind == "f" else np.int64)), np.cumsum(values)))
    return c[offsets[1:]] - c[offsets[:-1]]


def annotate(df: DataFrame, columns: list[str], f: Callable[..., list[pa.Array]], added: str) -> DataFrame:
    """`row` (a struct of all columns of df, untouched) and what f makes of the named columns.

    f gets one Python list for each column, at most SLICE_ROWS values long, and returns arrays for `added`, a DDL list of
    columns. Only the named columns go through Python; the others, whatever their names, stay where they are, and those
    that are never used are not read.
    """
    kind = StructType.fromDDL(added)
    arrow = to_arrow_type(kind)

    def run(packed: pa.Array) -> pa.Array:
        parts = [pa.array([], arrow)]
        for i in range(0, len(packed), SLICE_ROWS):
            made = f(*[c.to_pylist() for c in packed.slice(i, SLICE_ROWS).flatten()])
            parts.append(pa.StructArray.from_arrays([m.cast(t.type) for m, t in zip(made, arrow)], fields=list(arrow)))
        return pa.concat_arrays(parts)

    # Not deterministic for the optimiser, so that it neither repeats the work nor moves it.
    made = F.arrow_udf(run, kind).asNondeterministic()
    work = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.struct(*[df[c].alias(f"in{i}") for i, c in enumerate(columns)]).alias("given"))
    out = work.select("row", made("given").alias("made"))
    return out.select("row", *[F.col("made")[c].alias(c) for c in kind.names])
