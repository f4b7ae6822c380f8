"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch is the k smallest distinct 48-bit hashes of a text's 5-word shingles (words are runs without white space; a text
of 1 to 4 words is one shingle), with a flag for "these are all". Sketches of parts merge into the sketch of the whole.
From two sketches follow estimates of resemblance (Jaccard), containment and the number of distinct shingles, all exact
while no sketch is full.

Defined results: null and white space have no shingles; two such texts have likeness 1, one such text and any other 0.
Equal texts have equal sketches. Documents are followed by descending id of any type that can be ordered, null ids last, ties
by a hash of the text; rows equal in id and text follow one another. An empty table gives an empty one, a table of one row
follows itself. Very long texts are sketched whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.llm.rows import row_key
from helixframe.llm.store import Store
from helixframe.llm.text import SpanHash, annotate, is_kind, mix, runs, sequence_hash, slabs, to_codes

K = 64
WORDS = 5
BITS = 48


def sketches(texts: list[str | None], k: int = K, width: int = WORDS) -> list[np.ndarray]:
    """Sorted bottom-k hashes of each text."""
    out: list[np.ndarray] = []
    for i, j in slabs([t or "" for t in texts]):
        codes, bounds = to_codes([t or "" for t in texts[i:j]])
        starts, ends = runs(~is_kind(codes, "space"))
        words = SpanHash(codes)(starts, ends)
        grams = sequence_hash(words, width) >> np.uint64(64 - BITS)
        at = np.searchsorted(starts, bounds)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if a == b:
                out.append(np.zeros(0, np.uint64))
                continue
            mine = grams[a : b - width + 1] if b - a >= width else _short(words[a:b]) >> np.uint64(64 - BITS)
            if len(mine) > 4 * k:
                mine = _smallest(mine, k)
            out.append(np.unique(mine)[:k])
    return out


def _short(words: np.ndarray) -> np.ndarray:
    return mix(sequence_hash(words, len(words)) + np.uint64(len(words)))


def _smallest(x: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, with a few more."""
    m = 2 * k
    while m < len(x):
        low = np.unique(np.partition(x, m)[: m + 1])
        if len(low) > k:
            return low
        m *= 4
    return x


def encode(s: np.ndarray) -> str:
    """Six bytes a hash, big-endian, in base64."""
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(x: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(x), np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 2:] = raw
    return full.reshape(-1).view(">u8").astype(np.uint64)


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def distinct_count(s: np.ndarray, k: int = K) -> float:
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / 2**BITS)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    u = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(u, both, assume_unique=True).sum()) / len(u)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    union = distinct_count(merge([a, b], k), k)
    return min(1.0, r * union / max(distinct_count(a, k), 1e-9))


def fingerprint_documents(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """`row`, fingerprint, distinct_shingles."""

    def f(texts: list) -> list[pa.Array]:
        s = sketches(texts, k)
        return [pa.array([encode(x) for x in s], pa.string()), pa.array([distinct_count(x, k) for x in s], pa.float64())]

    return annotate(docs, [text], f, "fingerprint string, distinct_shingles double")


def merge_by_key(sketched: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint) of the union of a key's documents. Tasks merge what they read first, so a hot key moves one
    sketch a task."""

    def partial(batches):
        held: dict = {}
        for b in batches:
            for name, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[name] = merge([held[name], decode(f)], k) if name in held else decode(f)
            if len(held) > 50_000:
                yield _table(held)
                held = {}
        yield _table(held)

    def _table(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([encode(v) for v in held.values()], pa.string())], names=["key", "fingerprint"])

    def final(t: pa.Table) -> pa.Table:
        return pa.table({"key": t.column("key").slice(0, 1), "fingerprint": [encode(merge([decode(x) for x in t.column("fingerprint").to_pylist()], k))]})

    schema = f"key {sketched.schema[key].dataType.simpleString()}, fingerprint string"
    kind = to_arrow_type(sketched.schema[key].dataType)
    parts = sketched.select(F.col(key).alias("key"), F.col(fingerprint).alias("fingerprint")).mapInArrow(partial, schema)
    return parts.groupBy("key").applyInArrow(final, schema)


def edited_text(own: str, following: str) -> str:
    """The last floor(n/2) characters give way to the first as many (or all) of the following text."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


#: Rows drawn a bucket to find the bucket bounds.
DRAWN = 32


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, text, ghost, bucket) dealt and sorted so that each row's follower by descending id is the next row of its
    bucket. Buckets are ranges of id and text hash, so many rows without an id, or of one id, are parted too; a copy ("ghost")
    of the row that comes first after each bucket ends it, so no task sees more than its own range. After the last row comes
    the first.

    The bounds come from DRAWN rows a bucket; besides those only one id and key a bucket reach the driver.
    """
    spark = docs.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.count()
    drawn = rows.filter(F.rand(10) < min(1.0, DRAWN * n / max(total, 1))).select("doc_id", "k1").collect() if n > 1 else []
    drawn = sorted({(r["doc_id"] is not None, r["doc_id"], r["k1"]) for r in drawn}, key=lambda x: (x[0], x[1] if x[0] else 0, x[2]))
    bounds = sorted({len(drawn) * i // n for i in range(1, n)} - {0}) if drawn else []
    bounds = [drawn[i][1:] for i in bounds]
    rows = rows.withColumn("bucket", F.lit(len(bounds)) - _reached(F.col("doc_id"), F.col("k1"), bounds, 0))  # bucket 0 has the largest ids
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("z"), "doc_id", "k1", "k2"))
    firsts = rows.groupBy("bucket").agg(first.alias("f")).orderBy("bucket").collect()  # one row a bucket
    if not firsts:
        return rows.withColumn("ghost", F.lit(False))
    used = [r["bucket"] for r in firsts]
    ends = [(r["f"]["k1"], r["f"]["k2"], used[i - 1]) for i, r in enumerate(firsts)]  # used[-1]: after the last, the first
    ghosts = spark.createDataFrame(ends, "k1 bigint, k2 bigint, to int")
    copies = rows.join(F.broadcast(ghosts), ["k1", "k2"]).dropDuplicates(["k1", "k2", "to"]).select("doc_id", "k1", "k2", "text", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    both = rows.select("doc_id", "k1", "k2", "text", "bucket", F.lit(False).alias("ghost")).unionByName(copies)
    dealt = both.repartitionById(len(bounds) + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), F.desc("k1"), F.desc("k2"))


def _reached(doc_id: Column, k1: Column, bounds: list[tuple], base: int) -> Column:
    """How many bounds (id, hash), in ascending order, a row has reached, by halving. Null ids come before all others."""
    if not bounds:
        return F.lit(base)
    m = len(bounds) // 2
    b, h = bounds[m]
    reached = doc_id.isNotNull() | (k1 >= h) if b is None else F.coalesce((doc_id > F.lit(b)) | ((doc_id == F.lit(b)) & (k1 >= h)), F.lit(False))
    return F.when(reached, _reached(doc_id, k1, bounds[m + 1 :], base + m + 1)).otherwise(_reached(doc_id, k1, bounds[:m], base))


def compare_edited(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles)."""
    kind = docs.schema[doc_id].dataType
    id_type = to_arrow_type(kind)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # id, bucket, text and sketch of the row whose follower comes with the next batch
        for batch in batches:
            ids, texts, bucket, ghost = (batch.column(i).to_pylist() for i in range(4))
            own = sketches(texts, k)
            if last is not None:
                ids, texts, bucket, ghost, own = [last[0], *ids], [last[2], *texts], [last[1], *bucket], [False, *ghost], [last[3], *own]
            rows = [i for i in range(len(ids) - 1) if not ghost[i]]
            new = [edited_text(texts[i], texts[i + 1]) for i in rows]
            es = sketches(new, k)
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in rows], id_type), pa.array([len(texts[i]) for i in rows], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new], pa.string()),
                pa.array([encode(own[i]) for i in rows], pa.string()), pa.array([encode(e) for e in es], pa.string()),
                pa.array([resemblance(own[i], e, k) for i, e in zip(rows, es)], pa.float64()),
                pa.array([resemblance(own[i], own[i + 1], k) for i in rows], pa.float64()), pa.array([distinct_count(own[i], k) for i in rows], pa.float64()),
            ], names=names)
            last = None if not ids or ghost[-1] else (ids[-1], bucket[-1], texts[-1], own[-1])

    schema = f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double"
    return with_next(docs, doc_id=doc_id, text=text).select("doc_id", "text", "bucket", "ghost").mapInArrow(run, schema)
