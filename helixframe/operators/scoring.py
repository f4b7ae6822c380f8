"""Scores of pair sets: Hamming, Needleman-Wunsch, Smith-Waterman."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import alignment as al
from helixframe.functions import gaps
from helixframe.functions import sequences as sq
from helixframe.schemas import AffineScoring, Scoring


def hamming(pairs: DataFrame, mode: str = "char") -> DataFrame:
    """(pair_id, distance, similarity). Modes: char, encoded, indexed (each distinct pair of sequences is scored once)."""
    if mode == "indexed":
        distinct = pairs.select("seq_a", "seq_b").distinct()
        scored = distinct.withColumns({"distance": sq.hamming_distance(F.col("seq_a"), F.col("seq_b"), "encoded"), "_n": F.length("seq_a")})
        out = pairs.join(scored, ["seq_a", "seq_b"])
    else:
        out = pairs.select("pair_id", sq.hamming_distance(F.col("seq_a"), F.col("seq_b"), mode).alias("distance"), F.length("seq_a").alias("_n"))
    return out.select("pair_id", "distance", sq.similarity(F.col("distance"), F.col("_n")).alias("similarity"))


def hamming_packed(pairs: DataFrame) -> DataFrame:
    """Hamming on two-bit words."""
    return pairs.select("pair_id", sq.packed_hamming(sq.pack_2bit(F.col("seq_a")), sq.pack_2bit(F.col("seq_b"))).alias("distance"))


SCORE_COLUMN = {"nw": "alignment_score", "sw": "max_local_alignment_score"}


def align(pairs: DataFrame, algorithm: str = "nw", scoring: Scoring | None = None, implementation: str = "rolling", batch_size: int | None = None, max_sequence_length: int | None = None) -> DataFrame:
    """(pair_id, sequence_length_a, sequence_length_b, score column).

    batch_size is accepted and changes nothing: Spark deals batches. A length cap is off unless asked for.
    """
    if algorithm not in SCORE_COLUMN:
        raise ValueError("algorithm is nw or sw")
    if max_sequence_length:
        long = F.greatest(F.length("seq_a"), F.length("seq_b")) > max_sequence_length
        pairs = pairs.filter(F.when(long, F.raise_error(F.lit("a sequence exceeds the length cap")).cast("boolean")).otherwise(F.lit(True)))
    f = al.needleman_wunsch if algorithm == "nw" else al.smith_waterman
    score = f(F.col("seq_a"), F.col("seq_b"), scoring, implementation)
    return pairs.select("pair_id", F.length("seq_a").alias("sequence_length_a"), F.length("seq_b").alias("sequence_length_b"), score.alias(SCORE_COLUMN[algorithm]))


def align_distinct(pairs: DataFrame, algorithm: str = "nw", scoring: Scoring | None = None) -> DataFrame:
    """As align, but equal pairs of sequences are scored once and joined back."""
    distinct = pairs.groupBy("seq_a", "seq_b").agg(F.min("pair_id").alias("pair_id"))
    scored = distinct.select("pair_id", "seq_a", "seq_b").join(align(distinct, algorithm, scoring), "pair_id").drop("pair_id")
    return pairs.join(scored, ["seq_a", "seq_b"]).select("pair_id", "sequence_length_a", "sequence_length_b", SCORE_COLUMN[algorithm])


def align_affine(pairs: DataFrame, algorithm: str = "nw", scoring: AffineScoring | None = None) -> DataFrame:
    """As align, with affine gaps."""
    if algorithm not in SCORE_COLUMN:
        raise ValueError("algorithm is nw or sw")
    s, local = scoring or AffineScoring(), algorithm == "sw"

    @F.pandas_udf("bigint")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return al.align_series(a, b, local, s, gaps.affine_batch)

    return pairs.select("pair_id", F.length("seq_a").alias("sequence_length_a"), F.length("seq_b").alias("sequence_length_b"), score("seq_a", "seq_b").alias(SCORE_COLUMN[algorithm]))


def align_banded(pairs: DataFrame, scoring: Scoring | None = None, width: int = 16) -> DataFrame:
    """(pair_id, alignment_score, cells_computed, band_width): global scores from the narrowest band that proves them."""
    if width < 1:
        raise ValueError("width must be positive")
    s = scoring or Scoring()

    @F.pandas_udf("alignment_score bigint, cells_computed bigint, band_width bigint")
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        ok = (a.notna() & b.notna()).to_numpy()
        made = gaps.banded_batch(a[ok].tolist(), b[ok].tolist(), s, width)
        return pd.DataFrame(dict(zip(["alignment_score", "cells_computed", "band_width"], made)), index=a.index[ok], dtype="Int64").reindex(a.index)

    return pairs.select("pair_id", score("seq_a", "seq_b").alias("r")).select("pair_id", "r.*")


def traceback(pairs: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """(pair_id, cigar): one best global alignment in runs of =, X, I (base of b alone) and D (base of a alone)."""
    s = scoring or Scoring()

    @F.pandas_udf("string")
    def trace(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = (a.notna() & b.notna()).to_numpy()
        return pd.Series(gaps.cigars(a[ok].tolist(), b[ok].tolist(), s), index=a.index[ok], dtype=object).reindex(a.index).replace({float("nan"): None})

    return pairs.select("pair_id", trace("seq_a", "seq_b").alias("cigar"))


def replay(seq_a: Column, seq_b: Column, cigar: Column, scoring: Scoring | None = None) -> Column:
    """The score that a cigar's operations add up to; null unless they use up both sequences and = and X say what is there."""
    s = scoring or Scoring()
    runs = F.transform(F.regexp_extract_all(cigar, F.lit("[0-9]+[=XID]"), F.lit(0)), lambda r: F.struct(r.alias("r")))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("bigint").alias("score"), F.lit(True).alias("ok"))

    def step(at: Column, run: Column) -> Column:
        n, op = F.regexp_replace(run["r"], "[=XID]", "").cast("int"), F.right(run["r"], F.lit(1))
        x, y = F.substring(seq_a, at["i"] + 1, n), F.substring(seq_b, at["j"] + 1, n)
        differ = F.aggregate(F.zip_with(sq.chars(x), sq.chars(y), lambda p, q: F.when(p == q, 0).otherwise(1)), F.lit(0), lambda acc, v: acc + v)
        ok = F.when(op == "=", x == y).when(op == "X", differ == n).otherwise(True)
        gain = F.when(op == "=", F.lit(s.match)).when(op == "X", F.lit(s.mismatch)).otherwise(F.lit(s.gap))
        return F.struct((at["i"] + F.when(op == "I", 0).otherwise(n)).alias("i"), (at["j"] + F.when(op == "D", 0).otherwise(n)).alias("j"), (at["score"] + n * gain).cast("bigint").alias("score"), (at["ok"] & ok).alias("ok"))

    whole = lambda at: F.when(at["ok"] & (at["i"] == F.length(seq_a)) & (at["j"] == F.length(seq_b)), at["score"])
    return F.aggregate(runs, start, step, whole)


def dp_memory_bytes(length_a, length_b, implementation: str = "rolling"):
    """Estimated bytes of a pair's score matrix: three diagonals, or the whole matrix."""
    a, b = length_a.cast("bigint"), length_b.cast("bigint")
    if implementation in ("rolling", "rolling_diagonal"):
        return 3 * (a + 1) * 4
    return (a + 1) * (b + 1) * 4


def cells(length_a, length_b):
    """Cells of the score matrix, borders counted."""
    return (length_a.cast("bigint") + 1) * (length_b.cast("bigint") + 1)


def batches(pairs: DataFrame, batch_size: int) -> DataFrame:
    """(batch_id, n_pairs, first_pair, last_pair) of fixed-size runs of pair ids."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    b = F.floor(F.col("pair_id") / batch_size).cast("bigint").alias("batch_id")
    return pairs.groupBy(b).agg(F.count("*").alias("n_pairs"), F.min("pair_id").alias("first_pair"), F.max("pair_id").alias("last_pair"))
