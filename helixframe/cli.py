"""Command line: score, fragment, generate, encode.

    python -m helixframe.cli hamming IN OUT [--mode char] [--summary-only] [--write-results] [--skip-validation] ...

Times are of Spark jobs: each phase reads the stored input and runs to its end.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helixframe.functions.sequences import encode_digits
from helixframe.operators import compare, dictionary, pairing, reports, scoring
from helixframe.operators import fragments as fr
from helixframe.operators import validation as va
from helixframe.schemas import Scoring
from helixframe.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("hamming", "nw", "sw"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("output")
        s.add_argument("--repetitions", type=int, default=5)
        s.add_argument("--input-mode", choices=["token", "line"], default="token")
        s.add_argument("--summary-only", action="store_true")
        s.add_argument("--write-results", action="store_true", help="write rows even with --summary-only")
        s.add_argument("--skip-validation", action="store_true")
        if name == "hamming":
            s.set_defaults(validated=False)
            s.add_argument("--mode", choices=["char", "encoded", "indexed"], default="char")
        else:
            s.add_argument("--validated", action="store_true", help="rows with the reference score and whether it matches")
            s.add_argument("--match", type=int, default=2)
            s.add_argument("--mismatch", type=int, default=-1)
            s.add_argument("--gap", type=int, default=-2)
            s.add_argument("--implementation", default="rolling")
            s.add_argument("--batch-size", type=int)
            s.add_argument("--max-sequence-length", type=int)
    s = sub.add_parser("fragment")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--fragments-output")
    s.add_argument("--window-size", type=int, default=128)
    s.add_argument("--stride", type=int, default=32)
    s.add_argument("--pairing-mode", choices=list(pairing.BUILDERS), default="adjacent")
    s.add_argument("--pairs-per-fragment", type=int)
    s.add_argument("--max-pairs", type=int, default=pairing.MAX_PAIRS)
    s.add_argument("--mutation-rate", type=float, default=0.05)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--skip-ambiguous", action="store_true")
    s = sub.add_parser("generate")
    s.add_argument("--num-pairs", type=int, required=True)
    s.add_argument("--sequence-length", type=int, required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--exact", action="store_true")
    sub.add_parser("encode").add_argument("input")
    return p


class _Clock:
    """Milliseconds of each phase; a phase that runs more than once keeps its mean and its least."""

    def __init__(self):
        self.began, self.ms = time.perf_counter(), {}

    def run(self, phase: str, action, times: int = 1):
        took = []
        for _ in range(times):
            t = time.perf_counter()
            out = action()
            took.append((time.perf_counter() - t) * 1000)
        self.ms[f"{phase}_time_ms"] = sum(took) / len(took)
        if times > 1:
            self.ms[f"{phase}_min_time_ms"] = min(took)
        return out


def _through(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _score(spark: SparkSession, a: argparse.Namespace) -> int:
    clock, hamming = _Clock(), a.command == "hamming"
    pairs = va.require_rows(readers.read_pairs(spark, a.input, a.input_mode)).persist()
    clock.run("file_read", lambda: _through(pairs))
    shape = clock.run("input_validation", lambda: va.length_ranges(va.check_pairs(pairs) if hamming else pairs).first())
    found = {"algorithm": a.command, "number_of_pairs": shape["n_pairs"]}
    if hamming:
        found |= {"sequence_length": shape["max_a"], "total_bases_compared": pairs.agg(F.sum(F.length("seq_a"))).first()[0] or 0}
        run = lambda: scoring.hamming(pairs, a.mode)
        column, other = "distance", (lambda: scoring.hamming(pairs, "char" if a.mode != "char" else "encoded"))
        if a.mode == "indexed":
            sides = pairs.select(F.explode(F.array("seq_a", "seq_b")).alias("seq")).distinct()
            clock.run("dictionary", lambda: va.check_dictionary(sides))
            cache, bytes_ = dictionary.cache_stats(pairs).first(), dictionary.footprint_stats(pairs).first()
            found |= {"unique_sequence_count": bytes_["unique_sequences"], "cache_hit_count": cache["cache_hits"], "cache_miss_count": cache["cache_misses"], "cache_hit_rate": cache["cache_hit_rate"]}
            index = 2 * dictionary.INDEX_BYTES * bytes_["pairs"]
            found |= {"unique_fragment_bytes": bytes_["indexed_bytes"] - index, "pair_index_bytes": index, "flat_pair_bytes": bytes_["flat_bytes"], "flat_pair_bytes_avoided": bytes_["bytes_avoided"]}
        elif a.mode == "encoded":
            clock.run("encoding", lambda: _through(pairs.select(encode_digits(F.col("seq_a")).alias("a"), encode_digits(F.col("seq_b")).alias("b"))))
    else:
        s = Scoring(a.match, a.mismatch, a.gap)
        found |= {"sequence_length_a": shape["max_a"], "sequence_length_b": shape["max_b"], "match_score": a.match, "mismatch_penalty": a.mismatch, "gap_penalty": a.gap, "implementation": a.implementation}
        found["total_cells_computed"] = pairs.agg(F.sum(scoring.cells(F.length("seq_a"), F.length("seq_b")))).first()[0] or 0
        run = lambda impl=a.implementation: scoring.align(pairs, a.command, s, impl, a.batch_size, a.max_sequence_length)
        column, other = scoring.SCORE_COLUMN[a.command], (lambda: scoring.align(pairs, a.command, s, "rolling" if a.implementation in ("full", "global_matrix") else "full"))
    clock.run("scoring", lambda: _through(run()), max(1, a.repetitions))
    result = run()
    compared = compare.skipped(result, column) if a.skip_validation else compare.paired(other(), result, column)
    if not a.skip_validation:
        clock.run("reference", lambda: _through(other()))
    told = clock.run("validation", lambda: compare.verdict(compared).first())
    status = told["validation_status"]
    write = a.write_results or not a.summary_only
    if write:
        table, layout = (compare.validated(result, compared), "validated") if a.validated else (result, a.command)
        clock.run("csv_write", lambda: sinks.write_csv(table, a.output, layout))
    elif not hamming:
        clock.run("csv_write", lambda: sinks.write_report(reports.metric_rows(pairs, status), a.output))
    found |= {"repetitions": max(1, a.repetitions), "summary_only": a.summary_only, "write_results": write, "validation_status": status}
    if status == "FAILED":
        found |= {"first_mismatch_pair_id": told["first_mismatch_pair"], "reference_score": told["first_reference_score"], "score": told["first_score"]}
    if write or not hamming:
        found["output_path"] = a.output
    clock.ms["end_to_end_time_ms"] = (time.perf_counter() - clock.began) * 1000
    if not hamming:
        found["cells_per_second"] = found["total_cells_computed"] / (clock.ms["scoring_time_ms"] / 1000)
    print(sinks.key_values(clock.ms | found))
    pairs.unpersist()
    return compare.exit_code(status)


def _fragment(spark: SparkSession, a: argparse.Namespace) -> int:
    genome = readers.read_fasta_chunks(spark, a.input)
    if genome.agg(F.max(F.col("offset") + F.length("sequence"))).first()[0] < a.window_size:
        raise ValueError("the genome is shorter than the window")
    rows = fr.fragment_chunks(genome, a.window_size, a.stride, skip_ambiguous=a.skip_ambiguous).cache()
    n = rows.count()
    if not n:
        raise ValueError("no fragments: check window, stride and ambiguous bases")
    made = pairing.build(a.pairing_mode, rows, n, pairs_per_fragment=a.pairs_per_fragment, max_pairs=a.max_pairs, mutation_rate=a.mutation_rate, seed=a.seed)
    sinks.write_pairs_text(made.pairs, a.output)
    if a.fragments_output:
        sinks.write_csv(rows, a.fragments_output, "fragments")
    print(sinks.key_values({"fragments": n, "pairs_expected": made.expected, "pairs_truncated": made.truncated, "pairing_mode": a.pairing_mode}))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    try:
        if a.command == "fragment":
            return _fragment(spark, a)
        if a.command == "generate":
            sinks.write_pairs_text(readers.synthetic_pairs(spark, a.num_pairs, a.sequence_length, a.seed, a.exact), a.output)
            return 0
        if a.command == "encode":
            pairs = va.check_pairs(va.require_rows(readers.read_pairs(spark, a.input)))
            print(sinks.key_values(dictionary.encoding_footprint(pairs).first().asDict()))
            return 0
        return _score(spark, a)
    except Exception as e:  # noqa: BLE001
        print(f"ERROR: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return compare.EXIT_ERROR


if __name__ == "__main__":
    sys.exit(main())
