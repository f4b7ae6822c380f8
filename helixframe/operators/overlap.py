"""Overlap joins of intervals on a genome: bins, hot bins split, each pair once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of a bin, and left rows of a bin from which it is split.
BIN, HOT = 4096, 50_000


def _binned(df: DataFrame, prefix: str, on: str, width: int) -> DataFrame:
    """Rows as a struct, once for each bin that they touch; empty intervals and nulls touch none."""
    rows = df.filter(F.col("start") < F.col("end")).filter(F.col(on).isNotNull())
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    return rows.select(F.col(on).alias("_on"), F.struct(*[rows[c] for c in rows.columns]).alias(prefix), F.explode(bins).alias("_bin"))


def overlaps(left: DataFrame, right: DataFrame, *, on: str = "genome", width: int = BIN, hot: int = HOT) -> DataFrame:
    """(a, b): structs of a left and a right row on one genome whose half-open intervals [start, end) share a base.

    An equi-join by bin; a pair that meets in several bins is kept in the one where the later of the two begins. A bin of
    more than `hot` left rows is dealt into parts by a hash of the row, and its right rows go to every part.
    """
    if width <= 0 or hot <= 0:
        raise ValueError("width and hot must be positive")
    a, b = _binned(left, "a", on, width), _binned(right, "b", on, width)
    # Only hot bins are in this table, at most one for `hot` rows.
    parts = a.groupBy("_on", "_bin").count().filter(F.col("count") > hot).select("_on", "_bin", F.ceil(F.col("count") / hot).cast("int").alias("_parts"))
    several: Column = F.coalesce("_parts", F.lit(1))
    a = a.join(parts, ["_on", "_bin"], "left").withColumn("_part", F.pmod(F.xxhash64("a"), several).cast("int")).drop("_parts")
    b = b.join(parts, ["_on", "_bin"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), several - 1))).drop("_parts")
    both = a.join(b, ["_on", "_bin", "_part"])
    later = F.greatest("a.start", "b.start")
    return both.filter((F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.floor(later / width) == F.col("_bin"))).select("a", "b")
