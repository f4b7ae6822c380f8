"""Row shapes shared by readers, operators and writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PAIR = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("seq_a", T.StringType()),
    T.StructField("seq_b", T.StringType()),
])
FASTA = T.StructType([T.StructField("header", T.StringType()), T.StructField("sequence", T.StringType())])
FRAGMENT = T.StructType([
    T.StructField("fragment_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("sequence", T.StringType()),
])
ALIGNMENT_BENCHMARK = T.StructType([
    T.StructField("algorithm", T.StringType()),
    T.StructField("num_pairs", T.LongType()),
    T.StructField("sequence_length", T.LongType()),
    T.StructField("total_cells_computed", T.LongType()),
    T.StructField("cpu_time_ms", T.DoubleType()),
    T.StructField("average_time_per_pair_ms", T.DoubleType()),
    T.StructField("cells_per_second", T.DoubleType()),
    T.StructField("match_score", T.IntegerType()),
    T.StructField("mismatch_penalty", T.IntegerType()),
    T.StructField("gap_penalty", T.IntegerType()),
    T.StructField("memory_mode", T.StringType()),
    T.StructField("validation_status", T.StringType()),
])


@dataclass(frozen=True)
class Scoring:
    """Alignment scores; penalties are added, so they are negative."""

    match: int = 2
    mismatch: int = -1
    gap: int = -2


@dataclass(frozen=True)
class AffineScoring:
    """Alignment scores with affine gaps: a gap of n bases adds gap_open + (n - 1) * gap_extend."""

    match: int = 2
    mismatch: int = -1
    gap_open: int = -4
    gap_extend: int = -1
