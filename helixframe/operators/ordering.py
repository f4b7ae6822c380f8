"""Dense positions over a whole table without moving it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_positions(df: DataFrame, order: str, name: str, bucket: Column) -> DataFrame:
    """Adds 0-based dense positions by `order`, a column of distinct values.

    `bucket` must grow with `order`. Rows are numbered within buckets; the sums of earlier buckets come from an
    aggregate with one row a bucket, so its running sum is small and its join is a broadcast only when Spark finds it small.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1
    return tagged.withColumn("_place", place).join(offsets, "_bucket").withColumn(name, (F.col("_offset") + F.col("_place")).cast("bigint")).drop("_bucket", "_offset", "_place")


def prefix_sums(df: DataFrame, group: list[str], order: str, value: str, name: str, bucket: Column) -> DataFrame:
    """Adds the sum of `value` over the rows before, in order of `order` (distinct in a group), within a group.

    `bucket` must grow with `order`. Rows are summed within buckets, and one row a bucket within groups, so that a group of any
    size is never in one task. Nulls are a group like any other.
    """
    tagged = df.withColumn("_bucket", bucket)
    before = lambda own, by, v: F.coalesce(F.sum(v).over(Window.partitionBy(*own).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = tagged.groupBy(*group, "_bucket").agg(F.sum(value).alias("_n"))
    firsts = sizes.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_bucket").alias("_own"), before(group, "_bucket", "_n").alias("_first"))
    inner = tagged.withColumn("_within", before([*group, "_bucket"], order, value))
    same = F.col("_bucket") == F.col("_own")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return inner.join(firsts, same).withColumn(name, (F.col("_first") + F.col("_within")).cast("bigint")).select(*df.columns, name)
