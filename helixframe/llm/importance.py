"""Importance resampling towards a target distribution over hashed n-grams.

DuckDB runs inside each partition: SQL takes the words of a slice of texts, unnests and windows them into n-grams, and hashes
each distinct n-gram once with a registered CRC function. A partition's output, a row of bucket counts for each document and
one row of its totals, is written to Parquet by Spark (executors share no other folder). Spark then merges the totals into the
gain of each bucket (as many as `buckets`, a parameter), and scores the stored counts without looking at a text again.
"""

from __future__ import annotations

import math
import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.llm.store import Store
from helixframe.operators.ordering import dense_positions

#: Words: runs of anything but control characters, ASCII punctuation, white space and capitals (texts are folded before).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest n-gram, buckets, least words of a document that can be drawn, percent drawn, rounding of logarithms.
MAX_N, BUCKETS, MIN_WORDS, PERCENT, UNIT = 1, 10_000, 20, 10, 1000
#: Characters given to DuckDB at once, unless one text is longer, and its memory; beyond, it spills to its own folder.
SLICE_CHARS, MEMORY = 1 << 21, "256MB"
#: Rows of a part of the ranking, about.
RANK_ROWS = 1_000_000


def grams_sql(max_n: int, buckets: int) -> str:
    """(i, n_words, n_features, b, c) of a table texts (i, text): a text's buckets in order, with counts."""
    words = f"select i, unnest(ws) as w, generate_subscripts(ws, 1) as pos from (select i, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as ws from texts)"
    one = "select i, w as g from words"
    more = [f"select i, g from (select i, w || {' || '.join(f''' ' ' || lead(w, {k}) over own''' for k in range(1, n))} as g from words window own as (partition by i order by pos)) where g is not null" for n in range(2, max_n + 1)]
    return (
        f"with words as materialized ({words}), grams as ({' union all '.join([one, *more])}), counted as materialized (select i, g, count(*) as c from grams group by i, g), "
        f"hashed as (select g, (crc(g) % {buckets})::int as b from (select distinct g from counted)), own as (select i, b, sum(c)::bigint as c from counted join hashed using (g) group by i, b), "
        "sizes as (select i, count(*) as n_words from words group by i) "
        "select i, any_value(n_words) as n_words, sum(c)::bigint as n_features, list(b order by b) as b, list(c order by b) as c from own join sizes using (i) group by i order by i"
    )


def _crc(words: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.int64())


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(np.array([0 if t is None else t for t in pc.utf8_length(texts).to_pylist()], np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_CHARS)))
        yield i, min(j, len(texts))
        i = j


def bucket_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(total, doc_id, n_words, n_features, b, c): a row for each document, and one with `total` set for each partition."""
    rows = docs.select(F.lit(False).alias("total"), F.col(doc_id).alias("doc_id"), F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_features"), F.col(text).cast("string").alias("text"))
    kind = rows.drop("text").schema.add("b", T.ArrayType(T.IntegerType())).add("c", T.ArrayType(T.LongType()))
    arrow, query = to_arrow_type(kind), grams_sql(max_n, buckets)
    names = [f.name for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb  # in the worker

        folder = tempfile.mkdtemp()
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
        con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        total, words = np.zeros(buckets, np.int64), 0
        try:
            for batch in batches:
                texts = batch.column(4).cast(pa.string())
                for lo, hi in _slices(texts):
                    con.register("texts", pa.table({"i": pa.array(np.arange(hi - lo)), "text": texts.slice(lo, hi - lo)}))
                    got = con.sql(query).to_arrow_table().combine_chunks()
                    con.unregister("texts")
                    at, n = got["i"].to_numpy(), hi - lo
                    lists = got["b"].combine_chunks(), got["c"].combine_chunks()
                    np.add.at(total, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy())
                    place = np.full(n, -1, np.int64)  # a text without words has no row yet
                    place[at] = np.arange(len(at))
                    take = pa.array(place, mask=place < 0)
                    counts = [pc.fill_null(got[k].take(take).cast(pa.int64()), 0).combine_chunks() for k in ("n_words", "n_features")]
                    words += int(np.sum(counts[0].to_numpy()))
                    none = [pa.array([[]] * 1, t) for t in (arrow.field("b").type, arrow.field("c").type)]
                    made = [pc.coalesce(x.cast(y.type).take(take), y[0]) for x, y in zip(lists, none)]
                    cells = [pa.array([False] * n), batch.column(1).slice(lo, n), *counts, *made]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, arrow)], names=names)
            some = np.flatnonzero(total)
            if len(some):
                last = [[True], [None], [words], [int(total.sum())], [some.tolist()], [total[some].tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(last, arrow)], names=names)
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    return rows.mapInArrow(run, kind)


def totals(counts: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket over a stored table of counts: at most `buckets` rows come to the driver."""
    each = counts.filter("total").select(F.inline(F.arrays_zip("b", "c")))
    out = [0] * buckets
    for r in each.groupBy("b").agg(F.sum("c").alias("c")).collect():
        out[r["b"]] = r["c"]
    return out


def gains(source: list[int], target: list[int], unit: int = UNIT) -> list[int]:
    """floor(unit * log of the ratio of add-one probabilities), target over source."""
    b, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(unit * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source, target)]


def noise(doc_id: Column, seed: str, unit: int = UNIT) -> Column:
    """floor(unit * Gumbel noise), by a hash of the id; a null id is the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-float(unit)) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = "2024"
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each document; `rank` is null where it is not drawn.

    A null or empty text has no words, no features and weight 0, and is never drawn while min_words is positive. A null id is
    hashed as the empty text, and comes last among equal scores. Repeated rows each have their row and rank. An empty target
    gives each bucket the gain of a target without features; an empty table of documents gives no rows. Long texts are
    read whole. Columns other than those named are not read, so their names cannot clash.
    """
    if min(max_n, buckets) < 1 or not 0 <= percent <= 100:
        raise ValueError("max_n and buckets must be positive, percent between 0 and 100")
    store = Store(docs.sparkSession)
    counts = store.put(bucket_counts(docs, doc_id=doc_id, text=text, max_n=max_n, buckets=buckets), "counts")
    wanted = store.put(bucket_counts(target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(target_text).alias("text")), max_n=max_n, buckets=buckets), "target")
    table = F.split(F.lit(",".join(map(str, gains(totals(counts, buckets), totals(wanted, buckets))))), ",").cast("array<bigint>")
    weight = F.aggregate(F.zip_with("b", "c", lambda b, c: F.get(table, b) * c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    weighed = counts.filter("not total").select("doc_id", "n_words", "n_features", weight.alias("weight"))
    scored = store.put(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    store.drop(counts)
    able = scored.filter(F.col("n_words") >= min_words)
    n = able.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // RANK_ROWS)
    ordered = able.repartitionByRange(parts, F.col("score").desc(), F.col("doc_id").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    place = store.put(ordered.withColumn("place", F.struct(-F.col("score"), F.col("doc_id").isNull(), "doc_id")), "ordered")
    ranked = dense_positions(place, "place", "before", F.col("part"))
    rank = F.when(F.col("before") < percent * n // 100, F.col("before") + 1)
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.withColumn("rank", rank).select(columns).unionByName(rest.select(columns))


def sql(buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = "2024") -> str:
    """The same rows for DuckDB at max_n = 1; CRC-32 is worked out over the bytes of each distinct word."""
    words = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'))"
    return (
        f"with recursive bits(n, k, x) as (select n, 0, n::bigint from range(256) r(n) union all select n, k + 1, xor(x >> 1, 3988292384 * (x & 1)) from bits where k < 8), "
        "tab as (select list(x order by n) as t from bits where k = 8), "
        f"dw as materialized (select doc_id, {words} as w from documents), bw as materialized (select {words} as w from benchmark), "
        "bytes as (select w, list_transform(range(0, (length(h) // 2)::bigint), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint) as v from (select w, hex(w) as h from (select w from dw union select w from bw))), "
        f"hashed as materialized (select w, xor(list_reduce(list_prepend(4294967295::bigint, v), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::bigint) % {buckets} as b from bytes, tab), "
        f"s as (select b, count(*) as s from dw join hashed using (w) group by b), t as (select b, count(*) as t from bw join hashed using (w) group by b), "
        f"g as (select b, floor({UNIT} * ln((coalesce(t, 0) + 1)::double * ((select count(*) from dw) + {buckets}) / ((coalesce(s, 0) + 1)::double * ((select count(*) from bw) + {buckets}))))::bigint as g from s full join t using (b)), "
        "sums as (select doc_id, count(*) as n, sum(g)::bigint as weight from dw join hashed using (w) join g using (b) group by doc_id), "
        f"e as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::bigint as h from documents left join sums using (doc_id)), "
        f"f as (select *, (weight + floor(-{UNIT} * ln(-ln((h + 0.5::double) / 4294967296::double))))::bigint as score from e), "
        f"r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from f where n_features >= {min_words} qualify rank <= {percent} * count(*) over () // 100) "
        "select doc_id, n_features::bigint as n_features, weight, score, rank::bigint as rank from f left join r using (doc_id)"
    )
