"""Dictionary form of a pair set: each distinct sequence once, pairs as ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import safe_divide
from helixframe.operators.ordering import dense_positions

#: Bytes of one index entry, for the footprint figures.
INDEX_BYTES = 4


def sequences(pairs: DataFrame, bucket_size: int = 100_000) -> DataFrame:
    """(seq_id, seq); ids are dense in order of first appearance over a0, b0, a1, b1, ..."""
    sides = pairs.select(F.inline(F.array(F.struct((2 * F.col("pair_id")).alias("pos"), F.col("seq_a").alias("seq")), F.struct((2 * F.col("pair_id") + 1).alias("pos"), F.col("seq_b").alias("seq")))))
    first = sides.groupBy("seq").agg(F.min("pos").alias("pos"))
    return dense_positions(first, "pos", "seq_id", F.floor(F.col("pos") / bucket_size)).select("seq_id", "seq")


def index_pairs(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """(pair_id, index_a, index_b)."""
    a = seqs.select(F.col("seq_id").alias("index_a"), F.col("seq").alias("seq_a"))
    b = seqs.select(F.col("seq_id").alias("index_b"), F.col("seq").alias("seq_b"))
    return pairs.join(a, "seq_a").join(b, "seq_b").select("pair_id", "index_a", "index_b")


def gather(index: DataFrame, seqs: DataFrame) -> DataFrame:
    """Pairs back from ids, by two equi-joins; Spark broadcasts the dictionary when its measured size allows."""
    a = seqs.select(F.col("seq_id").alias("index_a"), F.col("seq").alias("seq_a"))
    b = seqs.select(F.col("seq_id").alias("index_b"), F.col("seq").alias("seq_b"))
    return index.join(a, "index_a").join(b, "index_b").select("pair_id", "seq_a", "seq_b")


def cache_stats(pairs: DataFrame) -> DataFrame:
    """misses: distinct sequences; hits: the other lookups; rate 0 if there are none."""
    sides = pairs.select(F.explode(F.array("seq_a", "seq_b")).alias("seq"))
    counts = sides.groupBy("seq").count().agg(F.count("*").alias("cache_misses"), F.coalesce(F.sum("count"), F.lit(0)).alias("lookups"))
    return counts.select(
        (F.col("lookups") - F.col("cache_misses")).cast("bigint").alias("cache_hits"), "cache_misses",
        safe_divide(F.col("lookups") - F.col("cache_misses"), F.col("lookups")).alias("cache_hit_rate"),
    )


def footprint_stats(pairs: DataFrame) -> DataFrame:
    """Bytes of the flat and of the indexed form."""
    n = pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.length("seq_a") + F.length("seq_b")), F.lit(0)).cast("bigint").alias("flat_bytes"))
    uniq = pairs.select(F.explode(F.array("seq_a", "seq_b")).alias("seq")).distinct().agg(F.count("*").alias("unique_sequences"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("bigint").alias("unique_bytes"))
    both = n.join(uniq)  # one row each
    indexed = F.col("unique_bytes") + 2 * INDEX_BYTES * F.col("pairs")
    return both.select(
        "pairs", "unique_sequences", "flat_bytes", indexed.cast("bigint").alias("indexed_bytes"),
        F.greatest(F.lit(0).cast("bigint"), F.col("flat_bytes") - indexed).alias("bytes_avoided"), safe_divide(F.col("flat_bytes"), indexed).alias("transfer_reduction_ratio"),
    )


def encoding_footprint(pairs: DataFrame) -> DataFrame:
    """Pairs, longest sequence, raw and encoded bytes: one byte a base in either form."""
    raw = F.coalesce(F.sum(F.length("seq_a") + F.length("seq_b")), F.lit(0)).cast("bigint")
    return pairs.agg(F.count("*").alias("number_of_pairs"), F.max(F.length("seq_a")).alias("sequence_length"), raw.alias("raw_bytes"), raw.alias("encoded_bytes"))
