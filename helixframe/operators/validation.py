"""Checks on pairs and sequences: raise, filter or flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import is_valid

POLICIES = ("raise", "filter", "flag")


def check_pairs(pairs: DataFrame, *, alphabet: bool = True, equal_length: bool = True, fixed_length: bool = False, max_length: int | None = None, on_invalid: str = "raise") -> DataFrame:
    """Row rules in the plan; a rule on the whole set (fixed_length) is one aggregate before it.

    Nulls count as invalid. 'flag' adds the boolean `valid`.
    """
    if on_invalid not in POLICIES:
        raise ValueError(f"on_invalid is one of {POLICIES}")
    ok = F.col("seq_a").isNotNull() & F.col("seq_b").isNotNull()
    if alphabet:
        ok = ok & is_valid(F.col("seq_a")) & is_valid(F.col("seq_b"))
    if equal_length:
        ok = ok & (F.length("seq_a") == F.length("seq_b"))
    if max_length is not None:
        ok = ok & (F.greatest(F.length("seq_a"), F.length("seq_b")) <= max_length)
    ok = F.coalesce(ok, F.lit(False))
    if fixed_length:
        lengths = length_ranges(pairs).first()
        if lengths["min_a"] != lengths["max_a"] or lengths["min_b"] != lengths["max_b"]:
            raise ValueError("all sequences on one side must have one length")
    if on_invalid == "flag":
        return pairs.withColumn("valid", ok)
    if on_invalid == "filter":
        return pairs.filter(ok)
    return pairs.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid pair "), F.col("pair_id").cast("string"))).cast("boolean")))


def length_ranges(pairs: DataFrame) -> DataFrame:
    la, lb = F.length("seq_a"), F.length("seq_b")
    return pairs.agg(F.count("*").alias("n_pairs"), F.min(la).alias("min_a"), F.max(la).alias("max_a"), F.min(lb).alias("min_b"), F.max(lb).alias("max_b"))


def require_rows(df: DataFrame, what: str = "dataset") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"the {what} holds no sequence pairs")
    return df


def check_dictionary(sequences: DataFrame, column: str = "seq") -> None:
    """Rules of a dictionary, looked at once for each distinct sequence: some rows, one length, only ACGT in either case."""
    bad = F.count_if(~F.coalesce(is_valid(F.col(column)), F.lit(False))).alias("bad")
    r = sequences.agg(F.count("*").alias("n"), F.min(F.length(column)).alias("low"), F.max(F.length(column)).alias("high"), bad).first()
    if not r["n"] or not r["high"]:
        raise ValueError("the dataset holds no sequence pairs")
    if r["low"] != r["high"]:
        raise ValueError("dictionary sequences must have one length")
    if r["bad"]:
        raise ValueError("the dictionary holds an invalid DNA sequence")
