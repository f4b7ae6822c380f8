"""The dictionary of a growing pair set, kept by a stream.

State is one number a sequence, the first position at which it was seen: a streaming aggregate, so a batch is reduced before
it is shuffled. A batch puts out the sequences that it touched, each with its first position so far. Ids come from the
least position of each sequence over all output, by the same dense numbering as in batch: they depend neither on the order of
files nor on restarts. No row is late: nothing is dropped by event time, and state grows with the dictionary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators.ordering import dense_positions

FIRST = "seq string, pos bigint, batch bigint"


def first_positions(pairs: DataFrame) -> DataFrame:
    """(seq, pos) of a stream of pairs; 2 * pair_id and 2 * pair_id + 1 are a pair's positions. Null sequences have none."""
    sides = pairs.select(F.inline(F.array(F.struct((2 * F.col("pair_id")).alias("pos"), F.col("seq_a").alias("seq")), F.struct((2 * F.col("pair_id") + 1).alias("pos"), F.col("seq_b").alias("seq"))))).filter("seq is not null and pos is not null")
    return sides.groupBy("seq").agg(F.min("pos").alias("pos"))


def write_dictionary_stream(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes first positions for all input that is there to Parquet at `path`; run again for more.

    A batch has a folder of its own, which a repeated batch replaces, so that a failure leaves no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return first_positions(pairs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def read_dictionary(spark: SparkSession, path: str, bucket_size: int = 100_000) -> DataFrame:
    """(seq_id, seq) as `dictionary.sequences` gives it for all pairs that the stream has seen."""
    first = spark.read.schema(FIRST).parquet(path).groupBy("seq").agg(F.min("pos").alias("pos"))
    return dense_positions(first, "pos", "seq_id", F.floor(F.col("pos") / bucket_size)).select("seq_id", "seq")
