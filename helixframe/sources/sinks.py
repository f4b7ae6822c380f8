"""Sinks: result CSV, pair and fragment text, KEY=value blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: CSV columns by kind of result, in order.
LAYOUTS = {
    "hamming": ["pair_id", "distance", "similarity"],
    "nw": ["pair_id", "sequence_length_a", "sequence_length_b", "alignment_score"],
    "sw": ["pair_id", "sequence_length_a", "sequence_length_b", "max_local_alignment_score"],
    "validated": ["pair_id", "sequence_length_a", "sequence_length_b", "reference_score", "score", "match_status"],
    "fragments": ["fragment_id", "start", "end", "sequence"],
}


def write_csv(df: DataFrame, path: str, layout: str) -> None:
    """Rows in order of their first column; part files are in range order, so no single task sees them all."""
    cols = LAYOUTS[layout]
    out = df.select(*[F.format_string("%.6f", c).alias(c) if c == "similarity" else c for c in cols])
    out.orderBy(cols[0]).write.mode("overwrite").option("header", True).csv(path)


def write_pairs_text(pairs: DataFrame, path: str) -> None:
    pairs.orderBy("pair_id").select(F.concat_ws(" ", "seq_a", "seq_b").alias("value")).write.mode("overwrite").text(path)


def write_fragments_text(fragments: DataFrame, path: str) -> None:
    fragments.orderBy("fragment_id").select(F.col("sequence").alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def key_values(metrics: dict) -> str:
    """KEY=value lines; booleans as true and false."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return "\n".join(f"{k.upper()}={show(v)}" for k, v in metrics.items())
