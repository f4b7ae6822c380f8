"""Agreement of two result sets on pair_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(left: DataFrame, right: DataFrame, column: str, right_column: str | None = None) -> DataFrame:
    """(pair_id, reference_score, score, match_status); a pair on one side only fails."""
    a = left.select("pair_id", F.col(column).cast("bigint").alias("reference_score"), F.lit(True).alias("_a"))
    b = right.select("pair_id", F.col(right_column or column).cast("bigint").alias("score"), F.lit(True).alias("_b"))
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("reference_score").eqNullSafe(F.col("score"))
    return a.join(b, "pair_id", "full_outer").select("pair_id", "reference_score", "score", F.when(same, "PASSED").otherwise("FAILED").alias("match_status"))


def skipped(left: DataFrame, column: str) -> DataFrame:
    """The same shape when validation is skipped: no reference, status SKIPPED."""
    return left.select("pair_id", F.lit(None).cast("bigint").alias("reference_score"), F.col(column).cast("bigint").alias("score"), F.lit("SKIPPED").alias("match_status"))


def validated(result: DataFrame, compared: DataFrame) -> DataFrame:
    """(pair_id, sequence_length_a, sequence_length_b, reference_score, score, match_status) of alignment results."""
    return result.select("pair_id", "sequence_length_a", "sequence_length_b").join(compared, "pair_id").select("pair_id", "sequence_length_a", "sequence_length_b", "reference_score", "score", "match_status")


def verdict(compared: DataFrame) -> DataFrame:
    """One row: pairs, mismatches, the lowest mismatching pair with both values, status."""
    bad = F.col("match_status") == "FAILED"
    pid = F.when(bad, F.col("pair_id"))
    return compared.agg(
        F.count("*").alias("n_pairs"), F.count_if(bad).alias("n_mismatches"), F.min(pid).alias("first_mismatch_pair"),
        F.min_by("reference_score", pid).alias("first_reference_score"), F.min_by("score", pid).alias("first_score"),
        F.when(F.count("*") == 0, "SKIPPED").when(F.count_if(bad) > 0, "FAILED").when(F.count_if(F.col("match_status") == "SKIPPED") > 0, "SKIPPED").otherwise("PASSED").alias("validation_status"),
    )


def with_sequences(compared: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mismatches with both input sequences."""
    return compared.filter(F.col("match_status") == "FAILED").join(pairs.select("pair_id", "seq_a", "seq_b"), "pair_id", "left")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equal as multisets, like two equal result files."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def combined_pass(exit_code: int, status: str, files_match: bool) -> bool:
    return exit_code == 0 and status == "PASSED" and files_match


#: Process exit codes.
EXIT_OK, EXIT_ERROR, EXIT_INVALID = 0, 1, 2


def exit_code(status: str) -> int:
    return EXIT_OK if status in ("PASSED", "SKIPPED") else EXIT_INVALID
