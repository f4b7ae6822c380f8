"""Sequence tables derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequences import hashed_dna, text_dna


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_dna(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, seq): bases of each document's letters."""
    return table(spark, d, "documents").select("doc_id", text_dna(F.col("text")).alias("seq"))


def doc_pairs(spark: SparkSession, d: str) -> DataFrame:
    """First and second half of each document's bases (an odd last one is left over); every other second half in lower case."""
    h = F.floor(F.length("seq") / 2).cast("int")
    s = doc_dna(spark, d).select(F.col("doc_id").alias("pair_id"), F.left("seq", h).alias("seq_a"), F.substring(F.col("seq"), h + 1, h).alias("seq_b"))
    return s.withColumn("seq_b", F.when(F.col("pair_id") % 2 == 0, F.col("seq_b")).otherwise(F.lower("seq_b")))


def key_pairs(spark: SparkSession, d: str, name: str = "part", key: str = "p_partkey") -> DataFrame:
    """32-base pairs from keys; all sequences differ."""
    k = F.col(key)
    return table(spark, d, name).select(k.alias("pair_id"), hashed_dna(k).alias("seq_a"), hashed_dna(F.concat(F.lit("b"), k.cast("string"))).alias("seq_b"))


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs dealt out by id over all cores: a table of keys is a small file, and so one task, but each pair is costly to align."""
    return pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "pair_id")


def repeated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """32-base pairs that share sequences, for the dictionary."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("pair_id"), hashed_dna(k * 7 % 300).alias("seq_a"), hashed_dna(k % 11 + 290).alias("seq_b"))


def key_fragments(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """32-base fragments with dense ids, and how many."""
    t = table(spark, d, "supplier")
    return t.select(F.col("s_suppkey").alias("fragment_id"), hashed_dna(F.col("s_suppkey")).alias("sequence")), t.count()


DNA = "translate(md5(({0})::varchar),'0123456789abcdef','ACGTACGTACGTACGT')"
CTE = {
    "doc_dna": "doc_dna as (select doc_id, translate(regexp_replace(text,'[^a-z]','','g'),'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC') as seq from documents)",
    "doc_pairs": "doc_pairs as (select doc_id as pair_id, substr(seq,1,(length(seq)//2)::int) as seq_a, case when doc_id % 2 = 0 then substr(seq,(length(seq)//2+1)::int,(length(seq)//2)::int) else lower(substr(seq,(length(seq)//2+1)::int,(length(seq)//2)::int)) end as seq_b from doc_dna)",
    "key_pairs": f"key_pairs as (select p_partkey as pair_id, {DNA.format('p_partkey')} as seq_a, {DNA.format(chr(39) + 'b' + chr(39) + '||p_partkey::varchar')} as seq_b from part)",
    "customer_pairs": f"customer_pairs as (select c_custkey as pair_id, {DNA.format('c_custkey')} as seq_a, {DNA.format(chr(39) + 'b' + chr(39) + '||c_custkey::varchar')} as seq_b from customer)",
    "repeated_pairs": f"repeated_pairs as (select p_partkey as pair_id, {DNA.format('p_partkey*7%300')} as seq_a, {DNA.format('p_partkey%11+290')} as seq_b from part)",
    "frags": f"frags as (select s_suppkey as fragment_id, {DNA.format('s_suppkey')} as sequence from supplier), n as (select count(*) as n from supplier)",
}


def with_ctes(*names: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ", ".join(CTE[n] for n in names) + " "


#: Workloads of the run table: each line item is a measured run of one of them, and its price in thousands the milliseconds.
ALGORITHMS, PAIRS, LENGTHS = ("nw", "sw"), (10, 100, 1000), (16, 32, 64, 128, 256)
MODES = ("adjacent", "all_vs_all", "sampled", "mutated_queries")


def timings(spark: SparkSession, d: str) -> DataFrame:
    """The slowest run of each workload, as a benchmark table."""
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))
    work = table(spark, d, "lineitem").select(pick(ALGORITHMS, "l_suppkey").alias("algorithm"), pick(PAIRS, "l_partkey").cast("bigint").alias("num_pairs"), pick(LENGTHS, "l_orderkey").cast("bigint").alias("sequence_length"), "l_extendedprice")
    rows = work.groupBy("algorithm", "num_pairs", "sequence_length").agg((F.max("l_extendedprice").cast("double") / 1000.0).alias("cpu_time_ms"))
    return rows.withColumn("total_cells_computed", F.col("num_pairs") * (F.col("sequence_length") + 1) * (F.col("sequence_length") + 1)).withColumn("validation_status", F.lit("PASSED"))


TIMINGS_SQL = (
    "(select algorithm, num_pairs, sequence_length, max(l_extendedprice)::double / 1000.0::double as cpu_time_ms, (num_pairs*(sequence_length+1)*(sequence_length+1))::bigint as total_cells_computed, 'PASSED' as validation_status "
    "from (select ['nw','sw'][(l_suppkey % 2 + 1)::int] as algorithm, [10,100,1000][(l_partkey % 3 + 1)::int]::bigint as num_pairs, [16,32,64,128,256][(l_orderkey % 5 + 1)::int]::bigint as sequence_length, l_extendedprice from lineitem) group by 1, 2, 3)"
)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Timings, and runs of a second implementation that failed at length 256 and could not run at 4096."""
    t = timings(spark, d)
    columns = ["algorithm", "implementation", "sequence_length", "num_pairs", "cpu_time_ms", "validation_status"]
    status = F.when(F.col("sequence_length") == 16, "UNSUPPORTED").when(F.col("algorithm") == "nw", "FAILED").otherwise("PASSED")
    length = F.when(F.col("sequence_length") == 16, 4096).otherwise(256).cast("bigint")
    other = t.filter("num_pairs = 10 and sequence_length in (16, 256)").select("algorithm", F.lit("full").alias("implementation"), length.alias("sequence_length"), "num_pairs", F.lit(0.0).alias("cpu_time_ms"), status.alias("validation_status"))
    return t.withColumn("implementation", F.lit("rolling")).select(columns).unionByName(other)


RUNS_SQL = (
    f"(select algorithm, 'rolling' as implementation, sequence_length, num_pairs, cpu_time_ms, validation_status from {TIMINGS_SQL} union all select algorithm, 'full', case when sequence_length = 16 then 4096 else 256 end::bigint, num_pairs, 0.0::double, "
    f"case when sequence_length = 16 then 'UNSUPPORTED' when algorithm = 'nw' then 'FAILED' else 'PASSED' end from {TIMINGS_SQL} where num_pairs = 10 and sequence_length in (16, 256))"
)


def modes(spark: SparkSession, d: str) -> DataFrame:
    """A row of results for each pairing mode, from the counts of line items by number."""
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    n = F.count("*")
    rows = table(spark, d, "lineitem").groupBy(mode.alias("pairing_mode")).agg(
        n.alias("number_of_pairs"), ((n % 10) / 10.0).alias("cache_hit_rate"), (n / 1000.0).alias("transfer_reduction_ratio"),
        (1 + (n % 7) * 4 / 10.0).alias("pipeline_speedup_indexed_vs_flat"), (1 + (n % 5) * 2 / 10.0).alias("end_to_end_speedup_indexed_vs_flat"),
    )
    graphs = F.when(F.col("pairing_mode").isin("adjacent", "all_vs_all"), "true").when(F.col("pairing_mode") == "sampled", "false")
    return rows.withColumns({"use_cuda_graphs": graphs, "validation_status": F.lit("PASSED")})


MODES_SQL = (
    "m as (select mode, n, (n % 10) / 10.0::double as hits, n / 1000.0::double as ratio, 1 + (n % 7) * 4 / 10.0::double as pipe, 1 + (n % 5) * 2 / 10.0::double as e2e, case when mode in ('adjacent','all_vs_all') then 'true' when mode = 'sampled' then 'false' end as graphs "
    "from (select ['adjacent','all_vs_all','sampled','mutated_queries'][(l_linenumber % 4 + 1)::int] as mode, count(*) as n from lineitem group by 1))"
)
