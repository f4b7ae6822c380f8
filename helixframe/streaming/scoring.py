"""Streaming scores: each pair stands alone, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators import scoring
from helixframe.schemas import PAIR


def read_pair_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Pairs from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(PAIR).option("maxFilesPerTrigger", max_files).parquet(path)


def score_stream(pairs: DataFrame, algorithm: str = "hamming", **options) -> DataFrame:
    return scoring.hamming(pairs, options.get("mode", "char")) if algorithm == "hamming" else scoring.align(pairs, algorithm, **options)


def write_score_stream(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once Parquet output of all that is there, then stop."""
    return scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
