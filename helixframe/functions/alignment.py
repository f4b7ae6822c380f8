"""Needleman-Wunsch and Smith-Waterman scores.

Three independent code paths: a numpy kernel by rows inside a pandas UDF (default), one by anti-diagonals that serves as the
validator at any size, and a pure SQL form of nested higher-order functions, which costs milliseconds a pair.

The kernel takes many pairs at once and loops over rows of the score matrix only. It holds H[j] - gap * j in place of H[j]:
a left move then adds nothing, so a row is the running maximum of its diagonal and upper moves, and the shift is undone
where a score is read. Slabs of pairs are small enough to stay in cache, in 16-bit integers where the scores fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.sequences import chars
from helixframe.schemas import Scoring

#: Names that select a code path; the physical variants all give the same integers.
IMPLEMENTATIONS = {
    "rolling": "kernel", "full": "diagonals", "baseline": "kernel", "wavefront": "kernel",
    "global_matrix": "diagonals", "rolling_diagonal": "kernel", "tiled_wavefront": "kernel", "sql": "sql",
}
#: Cells of one score-matrix row over all pairs of a slab, at most (a single longer pair is a slab of its own).
KERNEL_CELLS = 1 << 16


def _codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    out = np.full((len(texts), int(lengths.max(initial=0))), pad, dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out, lengths


def align_batch(a: list[str], b: list[str], local: bool, scoring: Scoring = Scoring()) -> np.ndarray:
    """Scores of many pairs of any lengths. Rows past a pair's own end are computed and ignored."""
    if not a:
        return np.zeros(0, dtype=np.int64)
    xs, la = _codes(a, -1)
    ys, lb = _codes(b, -2)
    n, m, g = len(a), ys.shape[1], scoring.gap
    reach = (xs.shape[1] + m + 2) * 2 * max(map(abs, (scoring.match, scoring.mismatch, scoring.gap)))
    kind = np.int16 if reach < 2**15 and max(xs.max(initial=0), ys.max(initial=0)) < 2**15 else np.int32 if reach < 2**31 else np.int64
    code = np.int16 if kind is np.int16 else np.int32
    xs, ys = np.ascontiguousarray(xs.T.astype(code)), ys.astype(code)
    step = (np.arange(m + 1) * g).astype(kind)
    same, other, up = kind(scoring.match - g), kind(scoring.mismatch - g), kind(g)
    prev = np.broadcast_to(-step if local else np.zeros(m + 1, kind), (n, m + 1)).copy()
    cur, eq, own = np.empty_like(prev), np.empty((n, m), bool), np.arange(n)
    score = np.where(la == 0, 0 if local else lb * g, 0).astype(np.int64)
    best = np.zeros((n, m + 1), kind)
    ends = np.bincount(la, minlength=len(xs) + 1)
    past = np.arange(m + 1)[None, :] > lb[:, None]
    for i in range(1, len(xs) + 1):
        np.equal(ys, xs[i - 1][:, None], out=eq)
        inner = cur[:, 1:]
        np.multiply(eq, same - other, out=inner)
        inner += other
        inner += prev[:, :-1]
        prev += up
        np.maximum(inner, prev[:, 1:], out=inner)
        cur[:, 0] = 0 if local else i * g
        if local:
            np.maximum(cur, -step, out=cur)
        np.maximum.accumulate(cur, axis=1, out=cur)
        prev, cur = cur, prev
        if local:
            np.maximum(best, prev + step, out=best)
        if ends[i]:
            done = la == i
            if local:
                score[done] = np.where(past[done], 0, best[done]).max(axis=1)
            else:
                score[done] = (prev[own, lb].astype(np.int64) + lb * g)[done]
    return score


def diagonal_batch(a: list[str], b: list[str], local: bool, scoring: Scoring = Scoring()) -> np.ndarray:
    """As align_batch, cell by cell from the three cells before it, over all cells of an anti-diagonal at once.

    Place i of diagonal k is cell (i, k - i). Cells past a pair's own end are computed and ignored.
    """
    if not a:
        return np.zeros(0, dtype=np.int64)
    xs, la = _codes(a, -1)
    ys, lb = _codes(b, -2)
    n, m, s, own = xs.shape[1], ys.shape[1], scoring, np.arange(len(a))
    reach = (n + m + 2) * max(map(abs, (s.match, s.mismatch, s.gap)))
    kind = np.int16 if reach < 2**15 and max(xs.max(initial=0), ys.max(initial=0)) < 2**15 else np.int32 if reach < 2**31 else np.int64
    code = np.int16 if kind is np.int16 else np.int32
    xs, ys = np.ascontiguousarray(xs.T.astype(code)), np.ascontiguousarray(ys.T[::-1].astype(code))
    before, last, cur = (np.zeros((n + 1, len(a)), kind) for _ in range(3))
    score, top = np.zeros(len(a), np.int64), np.zeros(len(a), kind)
    beyond = max(s.mismatch, s.gap) > 0  # only then can a cell past the end exceed all before it
    ends = np.bincount(la + lb, minlength=n + m + 1)
    for k in range(1, n + m + 1):
        before, last, cur = last, cur, before
        low, high = max(1, k - m), min(n, k - 1) + 1
        if low < high:
            inner = cur[low:high]
            inner[:] = np.where(xs[low - 1 : high - 1] == ys[m - k + low : m - k + high], kind(s.match), kind(s.mismatch))
            inner += before[low - 1 : high - 1]
            np.maximum(inner, np.maximum(last[low - 1 : high - 1], last[low:high]) + kind(s.gap), out=inner)
            if local:
                np.maximum(inner, 0, out=inner)
                i = np.arange(low, high)[:, None]
                np.maximum(top, (np.where((i <= la) & (k - i <= lb), inner, 0) if beyond else inner).max(axis=0), out=top)
        if k <= m:
            cur[0] = 0 if local else k * s.gap
        if k <= n:
            cur[k] = 0 if local else k * s.gap
        if ends[k] and not local:
            done = np.flatnonzero(la + lb == k)
            score[done] = cur[la[done], own[done]]
    return top.astype(np.int64) if local else score


def align_series(a: pd.Series, b: pd.Series, local: bool, scoring, batch=align_batch) -> pd.Series:
    """Scores with nulls kept; pairs go in order of length so that a slab holds pairs of like size. `batch` scores a slab."""
    ok = (a.notna() & b.notna()).to_numpy()
    out = np.zeros(len(a), np.int64)
    rows = np.flatnonzero(ok)
    size = np.array([len(b.iloc[i]) + 1 for i in rows], dtype=np.int64)
    order = rows[np.lexsort((np.array([len(a.iloc[i]) for i in rows], dtype=np.int64), size))] if len(rows) else rows
    i = 0
    while i < len(order):
        width = len(b.iloc[order[i]]) + 1
        j = i + 1
        while j < len(order) and (j - i + 1) * (len(b.iloc[order[j]]) + 1) <= KERNEL_CELLS and len(b.iloc[order[j]]) + 1 <= 2 * width + 16:
            j += 1
        take = order[i:j]
        out[take] = batch([a.iloc[k] for k in take], [b.iloc[k] for k in take], local, scoring)
        i = j
    return pd.Series(out).where(pd.Series(ok), None).astype("Int64")


def _udf(local: bool, scoring: Scoring):
    @F.pandas_udf("bigint")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return align_series(a, b, local, scoring)

    return score


def _diagonal_udf(local: bool, scoring: Scoring):
    @F.pandas_udf("bigint")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        swap = np.array([x is not None and y is not None and len(x) > len(y) for x, y in zip(a, b)], bool)  # scores are symmetric; diagonals are as long as the shorter side
        return align_series(b.where(swap, a), a.where(swap, b), local, scoring, diagonal_batch)

    return score


def _sql_form(a: Column, b: Column, local: bool, s: Scoring) -> Column:
    """By anti-diagonals: a cell needs only the two before, so that a diagonal is one transform. Place i of diagonal k is cell (i, k - i)."""
    low, n, m = F.lit(-(1 << 30)), F.length(a), F.length(b)
    xs, ys = chars(a), chars(b)
    rows = F.sequence(F.lit(0), n)
    blank = F.transform(rows, lambda i: low)
    zero = F.struct(blank.alias("before"), F.transform(rows, lambda i: F.when(i == 0, 0).otherwise(low)).alias("last"), F.lit(0).alias("best"))

    def diagonal(state: Column, k: Column) -> Column:
        def cell(i: Column) -> Column:
            j = k - i
            hit = F.when(F.element_at(xs, i) == F.element_at(ys, j), F.lit(s.match)).otherwise(F.lit(s.mismatch))
            moves = [F.element_at(state["before"], i) + hit, F.element_at(state["last"], i) + s.gap, F.element_at(state["last"], i + 1) + s.gap]
            inner = F.greatest(*moves, *([F.lit(0)] if local else []))
            return F.when((j < 0) | (j > m), low).when((i == 0) | (j == 0), F.lit(0) if local else k * s.gap).otherwise(inner)

        made = F.transform(rows, cell)
        return F.struct(state["last"].alias("before"), made.alias("last"), F.greatest(state["best"], F.array_max(made)).alias("best"))

    steps = F.when(n + m > 0, F.sequence(F.lit(1), n + m)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, zero, diagonal, lambda st: st["best"] if local else F.element_at(st["last"], -1)).cast("bigint")
    return F.when(a.isNotNull() & b.isNotNull(), total)


def _score(a: Column, b: Column, local: bool, scoring: Scoring | None, implementation: str) -> Column:
    if implementation not in IMPLEMENTATIONS:
        raise ValueError(f"unknown implementation: {implementation}; one of {', '.join(IMPLEMENTATIONS)}")
    s = scoring or Scoring()
    path = IMPLEMENTATIONS[implementation]
    return _sql_form(a, b, local, s) if path == "sql" else (_udf if path == "kernel" else _diagonal_udf)(local, s)(a, b)


def needleman_wunsch(a: Column, b: Column, scoring: Scoring | None = None, implementation: str = "rolling") -> Column:
    """Global alignment score. Any characters and lengths, empty included."""
    return _score(a, b, False, scoring, implementation)


def smith_waterman(a: Column, b: Column, scoring: Scoring | None = None, implementation: str = "rolling") -> Column:
    """Best local alignment score, at least 0."""
    return _score(a, b, True, scoring, implementation)


def register_sql(spark) -> None:
    """nw_score, sw_score (pandas) and hamming (SQL) for spark.sql."""
    spark.udf.register("nw_score", _udf(False, Scoring()))
    spark.udf.register("sw_score", _udf(True, Scoring()))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming(a STRING, b STRING) RETURNS INT RETURN aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> if(x = y, 0, 1)), 0, (s, v) -> s + v)")
