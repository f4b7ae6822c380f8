"""Sources: pair text and FASTA (byte ranges), synthetic pairs, run logs, benchmark CSV."""

from __future__ import annotations

import random
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from helixframe.schemas import PAIR
from helixframe.sources.ranges import scan_fasta, scan_pairs


def read_pairs(spark: SparkSession, path: str, mode: str = "token") -> DataFrame:
    """(pair_id, seq_a, seq_b) from a text file or a folder of them, of any size, pair_id in input order.

    'token': whitespace tokens in pairs across lines, a file's odd last token dropped. 'line': one pair a line; a line of one
    token has no second sequence, an empty one has an empty first. Files are read in byte ranges (see ranges.py).
    """
    if mode not in ("token", "line"):
        raise ValueError("mode is token or line")
    return scan_pairs(spark, path, by_line=mode == "line")


def read_fasta_chunks(spark: SparkSession, path: str, multi: bool = False) -> DataFrame:
    """(record, genome, offset, sequence): FASTA in chunks of bounded size. One record, unless multi (an extension) is set.

    A second record, or sequence text before a named header, raises.
    """
    return scan_fasta(spark, path, single=not multi)


def read_fasta(spark: SparkSession, path: str, multi: bool = False) -> DataFrame:
    """(header, sequence), upper case: the chunks put together, a row for each record in order. For genomes that fit a row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "sequence"))), lambda x: x["sequence"])
    return read_fasta_chunks(spark, path, multi).groupBy("record", F.col("genome").alias("header")).agg(F.array_join(ordered, "").alias("sequence")).filter("record >= 0 and (header <> '' or sequence <> '')").orderBy("record").select("header", "sequence")


def synthetic_pairs(spark: SparkSession, n: int, length: int, seed: int = 42, exact: bool = False) -> DataFrame:
    """Random pairs. exact: Python's generator on the driver, the same draws as the committed golden files (small n);
    otherwise bases from hashes, made where they are used."""
    if exact:
        r = random.Random(seed)
        draw = lambda: "".join(r.choice("ACGT") for _ in range(length))
        return spark.createDataFrame([(i, draw(), draw()) for i in range(n)], PAIR)
    blocks = -(-length // 32)

    def side(s: int):
        parts = [F.translate(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(s)), F.col("id").cast("string"), F.lit(str(b)))), "0123456789abcdef", "ACGT" * 4) for b in range(blocks)]
        return F.substring(F.concat(*parts), 1, length)

    return spark.range(n).select(F.col("id").alias("pair_id"), side(0).alias("seq_a"), side(1).alias("seq_b"))


def parse_run_log(lines: DataFrame) -> DataFrame:
    """(key, value) of KEY=value lines (columns line_no, value); the last write of a key wins."""
    eq = F.instr("value", "=")
    kv = lines.filter(eq > 0).select("line_no", F.trim(F.expr("substr(value, 1, instr(value, '=') - 1)")).alias("key"), F.trim(F.expr("substr(value, instr(value, '=') + 1)")).alias("v"))
    return kv.groupBy("key").agg(F.max_by("v", "line_no").alias("value"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return parse_run_log(text)


def read_benchmark_csv(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """CSV with a header. Tolerant: a missing file is an empty table with a warning. Strict: missing or empty raises."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    try:
        df = reader.csv(path)
    except AnalysisException:
        if strict:
            raise
        warnings.warn(f"no benchmark rows at {path}", stacklevel=2)
        return spark.createDataFrame([], schema)
    if strict and df.isEmpty():
        raise ValueError(f"no benchmark rows at {path}")
    return df


def read_single_row(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    df = read_benchmark_csv(spark, path, schema, strict=True)
    if len(df.take(2)) != 1:
        raise ValueError(f"expected one row at {path}")
    return df
