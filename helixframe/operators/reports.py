"""Derived metrics and report tables over result and benchmark rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import safe_divide

MODES = ("adjacent", "all_vs_all", "sampled", "mutated_queries")


def with_throughput(df: DataFrame) -> DataFrame:
    """pairs/s, bases/s, cells/s and ms per pair of alignment benchmark rows."""
    seconds = F.col("cpu_time_ms") / 1000
    return df.withColumns({
        "pairs_per_second": safe_divide(F.col("num_pairs"), seconds),
        "bases_per_second": safe_divide(F.col("num_pairs") * F.col("sequence_length"), seconds),
        "cells_per_second": safe_divide(F.col("total_cells_computed"), seconds),
        "ms_per_pair": safe_divide(F.col("cpu_time_ms"), F.col("num_pairs")),
    })


def with_speedups(df: DataFrame, baseline: str, others: dict[str, str]) -> DataFrame:
    """Adds name = baseline / column for each (name, column)."""
    return df.withColumns({name: safe_divide(F.col(baseline), F.col(c)) for name, c in others.items()})


def timing_breakdown(df: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Sum of stages and the rest of the total, at least 0."""
    known: Column = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    return df.withColumn("stage_sum_ms", known).withColumn("other_ms", F.greatest(F.lit(0.0), F.col(total) - known))


def repetitions(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(time).alias("average_time_ms"), F.min(time).alias("min_time_ms"))


def best_row(df: DataFrame, column: str, tie: str) -> DataFrame:
    """The row with the largest value; the smaller `tie` wins among equals. One partial and one final aggregate."""
    top = F.max(F.struct(F.col(column).alias("v"), (-F.col(tie)).alias("t"), F.struct(*df.columns).alias("r"))).alias("m")
    return df.agg(top).filter(F.col("m").isNotNull()).select("m.r.*")


#: Columns of a summary, by kind and default.
SUMMARY_LONGS = ("number_of_pairs", "sequence_length", "total_bases_compared", "unique_sequence_count", "flat_pair_bytes_equivalent", "indexed_representation_bytes", "flat_pair_bytes_avoided")
SUMMARY_DOUBLES = (
    "cache_hit_rate", "flat_optimized_gpu_pipeline_time_ms", "indexed_graphs_gpu_pipeline_time_ms", "pipeline_speedup_indexed_vs_flat", "flat_optimized_end_to_end_time_ms",
    "indexed_graphs_end_to_end_time_ms", "end_to_end_speedup_indexed_vs_flat", "transfer_reduction_ratio",
)
SUMMARY_FLAGS = ("cuda_graphs_supported", "use_cuda_graphs", "cuda_malloc_async_supported", "use_cuda_malloc_async")
#: What each pairing mode is recommended for, and what it shows.
ROLES = {
    "adjacent": "Baseline correctness mode",
    "sampled": "Recommended default benchmark mode",
    "all_vs_all": "Best scalability stress mode",
    "mutated_queries": "Controlled mutation experiment mode",
}
INTERPRETATIONS = {
    "adjacent": "Small workload used to validate real dataset integration and correctness.",
    "sampled": "Balanced workload with high fragment reuse; recommended for practical GPU benchmarking.",
    "all_vs_all": "Largest workload with strongest reuse; best mode to demonstrate GPU pipeline scalability.",
    "mutated_queries": "Controlled mutation workload useful for similarity experiments but lower cache reuse.",
}


def summary_rows(df: DataFrame) -> DataFrame:
    """Typed summary with defaults for what is missing: 0, 'false', 'UNKNOWN'; role and interpretation by mode."""
    have = set(df.columns)
    num = lambda c, t: (F.coalesce(F.col(c).cast("double").cast(t), F.lit(0).cast(t)) if c in have else F.lit(0).cast(t)).alias(c)
    txt = lambda c, d: (F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in have else F.lit(d)).alias(c)
    typed = df.select(txt("pairing_mode", "unknown"), *[num(c, "bigint") for c in SUMMARY_LONGS], *[num(c, "double") for c in SUMMARY_DOUBLES], *[txt(c, "false") for c in SUMMARY_FLAGS], txt("validation_status", "UNKNOWN"))
    of_mode = lambda names, d: F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("pairing_mode")], F.lit(d))
    return typed.withColumns({"recommended_role": of_mode(ROLES, "Unclassified mode"), "interpretation": of_mode(INTERPRETATIONS, "No interpretation available.")})


def findings(summary: DataFrame) -> DataFrame:
    """One row a finding with its evidence, computed from summary rows; aggregates only, so any number of rows will do.

    Where a mode has several rows, or several rows are best, the one with most pairs speaks."""
    mode, ok = F.col("pairing_mode"), F.upper("validation_status") == "PASSED"
    row = lambda m, c: F.max_by(F.when(mode == m, F.col(c)), F.when(mode == m, F.col("number_of_pairs")))
    active = lambda c: F.count_if(F.lower(c) == "true")
    best = F.max_by("pairing_mode", F.struct(F.col("transfer_reduction_ratio"), F.col("number_of_pairs")))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    agg = summary.agg(
        F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.concat_ws(", ", F.array_sort(F.collect_set(F.when(ok, mode)))).alias("names"),
        F.max("transfer_reduction_ratio").alias("ratio"), best.alias("best"), active("use_cuda_graphs").alias("graphs"), active("use_cuda_malloc_async").alias("async"),
        row("all_vs_all", "number_of_pairs").alias("all_pairs"), row("all_vs_all", "pipeline_speedup_indexed_vs_flat").alias("all_speedup"),
        row("sampled", "number_of_pairs").alias("some_pairs"), row("sampled", "cache_hit_rate").alias("hit_rate"),
        mean("pipeline_speedup_indexed_vs_flat").alias("pipeline"), mean("end_to_end_speedup_indexed_vs_flat").alias("end_to_end"),
    )
    say = F.format_string
    either = lambda cond, text, other: F.when(cond, text).otherwise(other)
    # Titles and wording of the evidence.
    rows = [
        ("F1", "Validation passed across pairing modes", say("%d/%d modes reported VALIDATION_STATUS=PASSED: %s.", "passed", "n", either(F.col("passed") > 0, F.col("names"), "none"))),
        ("F2", "Indexed representation reduced transfer footprint", either(F.col("n") > 0, say("Best transfer reduction ratio was %.3fx in %s mode.", "ratio", "best"), "No indexed benchmark rows were available.")),
        ("F3", "CUDA Graphs and cudaMallocAsync support was measured", say("CUDA Graphs active in %d/%d modes; cudaMallocAsync active in %d/%d modes.", "graphs", "n", "async", "n")),
        ("F4", "all_vs_all is the strongest scalability stress mode", either(F.col("all_pairs").isNotNull(), say("all_vs_all used %d pairs and %.3fx pipeline speedup.", "all_pairs", "all_speedup"), "all_vs_all results were not available.")),
        ("F5", "sampled is the recommended default benchmark mode", either(F.col("some_pairs").isNotNull(), say("sampled used %d pairs with %.3f cache hit rate.", "some_pairs", "hit_rate"), "sampled results were not available.")),
        ("F6", "End-to-end speedup is smaller than pipeline speedup", say("Average pipeline speedup was %.3fx, while average end-to-end speedup was %.3fx.", "pipeline", "end_to_end")),
        ("F7", "CPU-side preprocessing is the next bottleneck", F.lit("Remaining end-to-end work includes text parsing, unique sequence detection, encoding, index construction, CPU reference computation, and validation.")),
    ]
    items = F.array(*[F.struct(F.lit(i).alias("finding_id"), F.lit(t).alias("finding_title"), e.alias("evidence")) for i, t, e in rows])
    return agg.select(F.inline(items))


def scaling_series(df: DataFrame, value: str) -> DataFrame:
    """For each number of pairs, the values over sequence length, in order."""
    points = F.array_sort(F.collect_list(F.struct("sequence_length", F.col(value).alias("value"))))
    return df.groupBy("num_pairs").agg(points.alias("p")).select("num_pairs", F.concat_ws(",", F.transform("p.sequence_length", lambda x: x.cast("string"))).alias("lengths"), F.aggregate("p.value", F.lit(0.0), lambda a, v: a + v).alias("total"))


def supported(df: DataFrame, flag: str = "validation_status") -> DataFrame:
    """Whether a length could be run (a failed run could), for each algorithm, implementation and length."""
    return df.groupBy("algorithm", "implementation", "sequence_length").agg(F.max(F.when(F.upper(flag) == "UNSUPPORTED", 0).otherwise(1)).alias("supported"))


def by_workload(df: DataFrame) -> DataFrame:
    """Rows in the order of charts: sequence length, then number of pairs."""
    return df.orderBy("sequence_length", "num_pairs")


def only_supported(df: DataFrame, flag: str = "implementation_status") -> DataFrame:
    return df.filter(F.coalesce(F.upper(flag), F.lit("")) != "UNSUPPORTED")


def series(df: DataFrame, keys: list[str], x: str, value: str) -> DataFrame:
    """One row for each line of a chart (keys): its points (x, value) in order of x."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(value).alias("value")))).alias("points"))


def stream_series(df: DataFrame, value: str, transposed: bool = False) -> DataFrame:
    """Lines of (length, pairs, batch size) over the number of streams or, transposed, of (length, pairs, streams) over batch size."""
    line, x = ("num_streams", "batch_size") if transposed else ("batch_size", "num_streams")
    return series(df, ["sequence_length", "num_pairs", line], x, value)


def dense_pivot(df: DataFrame, row: str, col: str, values: list, value: str) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.max(value)).na.fill(0)


def union_modes(frames: dict[str, DataFrame]) -> DataFrame:
    """Per-mode rows in the fixed order of modes (column mode_order)."""
    out = None
    for i, m in enumerate(MODES):
        if m in frames:
            f = frames[m].withColumn("pairing_mode", F.lit(m)).withColumn("mode_order", F.lit(i))
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("no pairing mode given")
    return out


def with_unsupported(df: DataFrame, workloads: list[int] | list[dict], note: str) -> DataFrame:
    """Workloads that could not run stay as rows: status UNSUPPORTED, a note, and what is known of them (a dict by column, such as
    pairs, cells and CPU time); other numbers are 0. A plain number is a sequence length."""
    known = [{"sequence_length": w} if isinstance(w, int) else w for w in workloads]
    columns = sorted({c for w in known for c in w})
    types = dict(df.dtypes)
    rows = df.sparkSession.createDataFrame([tuple(str(w[c]) if c in w else None for c in columns) for w in known], ", ".join(f"{c} string" for c in columns))
    rows = rows.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in columns], F.lit("UNSUPPORTED").alias("implementation_status"), F.lit(note).alias("notes"))
    out = df.withColumn("implementation_status", F.lit("SUPPORTED")).withColumn("notes", F.lit("")).unionByName(rows, allowMissingColumns=True)
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double") and c != "sequence_length"]
    return out.na.fill(0, numeric)


def log_scale_ok(df: DataFrame, column: str) -> bool:
    return bool(df.agg(F.every(F.col(column) > 0)).first()[0])


def stage_series(df: DataFrame) -> DataFrame:
    """Implementations of each (length, pairs), sorted, as one row."""
    item = F.struct("implementation", "value")
    return df.groupBy("sequence_length", "num_pairs").agg(F.array_sort(F.collect_list(item)).alias("series"))


def metric_rows(pairs: DataFrame, status: str) -> DataFrame:
    """(metric, value), four rows: the summary-only result."""
    a = pairs.agg(F.count("*").cast("string").alias("n"), F.max(F.length("seq_a")).cast("string").alias("la"), F.max(F.length("seq_b")).cast("string").alias("lb"))
    return a.select(F.stack(F.lit(4), F.lit("number_of_pairs"), F.col("n"), F.lit("sequence_length_a"), F.col("la"), F.lit("sequence_length_b"), F.col("lb"), F.lit("validation_status"), F.lit(status)).alias("metric", "value"))
