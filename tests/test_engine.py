"""Known answers, golden sums, readers, sinks, policies, CLI and streaming."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe import cli
from helixframe.functions import alignment as al
from helixframe.functions import sequences as sq
from helixframe.operators import compare, dictionary, pairing, reports, scoring
from helixframe.operators import fragments as fr
from helixframe.operators import validation as va
from helixframe.schemas import ALIGNMENT_BENCHMARK, PAIR, Scoring
from helixframe.sources import readers, sinks
from helixframe.streaming import scoring as stream

NW = [("ACGT", "ACGT", 8), ("ACGT", "ACCT", 5), ("ACGT", "AGT", 4), ("", "ACGT", -8), ("GATTACA", "GCATGCU", 2), ("", "", 0)]
SW = [("ACGT", "ACGT", 8), ("ACGT", "TTACGTAA", 8), ("AAAA", "TTTT", 0), ("GATTACA", "TACA", 8), ("ACGT", "ACCT", 5), ("", "ACGT", 0)]
#: Sums of the scores of 1000 random pairs with seed 42, by length.
GOLDEN = {16: (1922, 9536), 32: (6841, 16679), 64: (18605, 30462), 128: (43813, 58892), 256: (97319, 114952)}


def plain_score(a, b, local, s):
    prev = [0 if local else j * s.gap for j in range(len(b) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        cur = [0 if local else i * s.gap]
        for j, y in enumerate(b, 1):
            v = max(prev[j - 1] + (s.match if x == y else s.mismatch), prev[j] + s.gap, cur[-1] + s.gap)
            cur.append(max(0, v) if local else v)
        prev, best = cur, max(best, *cur)
    return best if local else prev[-1]


@pytest.mark.parametrize("impl", ["rolling", "full"])
def test_known_scores(spark, impl):
    for f, cases in ((al.needleman_wunsch, NW), (al.smith_waterman, SW)):
        df = spark.createDataFrame(cases, "a string, b string, want int")
        assert all(r["got"] == r["want"] for r in df.select("want", f(F.col("a"), F.col("b"), None, impl).alias("got")).collect())
    with pytest.raises(ValueError):
        al.needleman_wunsch(F.col("a"), F.col("b"), None, "nope")


@pytest.mark.parametrize("length", list(GOLDEN))
def test_golden_sums(length):
    r = random.Random(42)
    draw = lambda: "".join(r.choice("ACGT") for _ in range(length))
    pairs = [(draw(), draw()) for _ in range(1000)]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert (al.align_batch(a, b, False).sum(), al.align_batch(a, b, True).sum()) == GOLDEN[length]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTé😀", max_size=12), st.text("ACGTé😀", max_size=12)), min_size=1, max_size=6), st.integers(0, 5), st.integers(-5, 2), st.integers(-4, 0))
def test_kernel_equals_plain(pairs, match, mismatch, gap):
    s = Scoring(match, mismatch, gap)
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    for local in (False, True):
        assert al.align_batch(a, b, local, s).tolist() == [plain_score(x, y, local, s) for x, y in pairs]


def test_kernel_wide_integers():
    s = Scoring(40_000, -1, -2)
    assert al.align_batch(["ACGT"], ["ACGT"], False, s).tolist() == [160_000]
    big = Scoring(2**31, -1, -2)
    assert al.align_batch(["AC"], ["AC"], True, big).tolist() == [2**32]


def test_hamming_rules(spark):
    df = spark.createDataFrame([(0, "acgt", "ACGT"), (1, "ACGTACGT", "ACGTTCGT"), (2, "", "")], PAIR)
    char = {r["pair_id"]: r for r in scoring.hamming(df).collect()}
    assert (char[0]["distance"], char[1]["distance"], char[1]["similarity"], char[2]["distance"]) == (4, 1, 87.5, 0)
    assert {r["pair_id"]: r["distance"] for r in scoring.hamming(df, "encoded").collect()} == {0: 0, 1: 1, 2: 0}
    with pytest.raises(Exception, match="equal length"):
        scoring.hamming(spark.createDataFrame([(0, "A", "AC")], PAIR)).collect()
    with pytest.raises(Exception, match="invalid DNA base"):
        spark.createDataFrame([("ACGN",)], "s string").select(sq.encode_bases(F.col("s"))).collect()
    assert spark.createDataFrame([("aCgT",)], "s string").select(sq.encode_bases(F.col("s")).alias("c")).first()["c"] == [0, 1, 2, 3]


def test_pair_policies(spark):
    df = spark.createDataFrame([(0, "AC", "AG"), (1, "AN", "AC"), (2, "A", "AC"), (3, None, "A")], PAIR)
    assert [r["valid"] for r in va.check_pairs(df, on_invalid="flag").orderBy("pair_id").collect()] == [True, False, False, False]
    assert va.check_pairs(df, on_invalid="filter").count() == 1
    with pytest.raises(Exception, match="invalid pair"):
        va.check_pairs(df).collect()
    with pytest.raises(ValueError):
        va.check_pairs(df, fixed_length=True)
    with pytest.raises(ValueError):
        va.require_rows(df.limit(0))


def test_readers(spark, tmp_path):
    p = tmp_path / "pairs.txt"
    p.write_text("AC GT\nAA\nCC TT GG\n")
    assert [tuple(r) for r in readers.read_pairs(spark, str(p)).orderBy("pair_id").collect()] == [(0, "AC", "GT"), (1, "AA", "CC"), (2, "TT", "GG")]
    p.write_text("AC GT\nAA TT\n")
    assert readers.read_pairs(spark, str(p), "line").orderBy("pair_id").collect() == readers.read_pairs(spark, str(p)).orderBy("pair_id").collect()
    fa = tmp_path / "g.fa"
    fa.write_text(">one genome\n\nacgt\n ACGT \n")
    assert tuple(readers.read_fasta(spark, str(fa)).first()) == ("one genome", "ACGTACGT")
    for bad in (">a\nAC\n>b\nGT\n", "AC\n>a\nGT\n", ">\nAC\n"):
        fa.write_text(bad)
        with pytest.raises(Exception, match="FASTA"):
            readers.read_fasta(spark, str(fa)).collect()
    fa.write_text(">a x\nac\ngt\n>b\nGT\n")
    assert [tuple(r) for r in readers.read_fasta(spark, str(fa), multi=True).collect()] == [("a x", "ACGT"), ("b", "GT")]
    log = tmp_path / "run.log"
    log.write_text("hello\nA=1\nB = x=y\nA=2\n")
    assert {r["key"]: r["value"] for r in readers.read_run_log(spark, str(log)).collect()} == {"A": "2", "B": "x=y"}
    with pytest.warns(UserWarning):
        assert readers.read_benchmark_csv(spark, str(tmp_path / "none.csv"), ALIGNMENT_BENCHMARK).count() == 0
    r = random.Random(42)
    want = ["".join(r.choice("ACGT") for _ in range(5)) for _ in range(4)]
    got = readers.synthetic_pairs(spark, 2, 5, exact=True).orderBy("pair_id").collect()
    assert [x for g in got for x in (g["seq_a"], g["seq_b"])] == want
    assert readers.synthetic_pairs(spark, 7, 50).filter("length(seq_a) = 50 and seq_a rlike '^[ACGT]*$'").count() == 7


def test_fragments_and_pairs(spark):
    g = spark.createDataFrame([("g", "ACGTNACGTACGTA")], "genome string, sequence string")
    got = fr.fragment(g, 4, 2, skip_ambiguous=True).orderBy("fragment_id").collect()
    assert [(r["fragment_id"], r["start"], r["end"]) for r in got] == [(0, 0, 4), (1, 6, 10), (2, 8, 12), (3, 10, 14)]
    with pytest.raises(Exception, match="unsupported"):
        fr.fragment(g, 4, 2).collect()
    f = spark.range(7).select(F.col("id").alias("fragment_id"), sq.hashed_dna(F.col("id")).alias("sequence"))
    for mode, n in (("adjacent", 6), ("all_vs_all", 42), ("sampled", 21), ("mutated_queries", 21)):
        made = pairing.build(mode, f, 7, pairs_per_fragment=3)
        ids = [r["pair_id"] for r in made.pairs.orderBy("pair_id").collect()]
        assert ids == list(range(n)) and made.expected == n and not made.truncated
        cut = pairing.build(mode, f, 7, pairs_per_fragment=3, max_pairs=4)
        assert [r["pair_id"] for r in cut.pairs.orderBy("pair_id").collect()] == [0, 1, 2, 3] and cut.truncated
        assert pairing.pair_stats(mode, 7, 3, 4) == (n, 4, True)
    assert pairing.sampled(f, 7, 100).pairs.groupBy("seq_a").agg(F.count_distinct("seq_b").alias("n")).filter("n = 6").count() == 7
    with pytest.raises(ValueError):
        pairing.build("x", f, 7)
    assert "Sort " not in pairing.all_vs_all(f, 7, 5).pairs._jdf.queryExecution().optimizedPlan().toString()


def test_reports(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 0, 4.0)], "m string, d int, n double")
    assert [r["x"] for r in rows.select(sq.safe_divide(F.col("n"), F.col("d")).alias("x")).collect()] == [2.0, 0.0]
    assert reports.log_scale_ok(rows, "n") and not reports.log_scale_ok(rows, "d")
    assert reports.timing_breakdown(rows, ["n"], "d").filter("other_ms = 0").count() == 2
    both = reports.union_modes({"sampled": rows, "adjacent": rows})
    assert [r["pairing_mode"] for r in both.orderBy("mode_order", "m").collect()] == ["adjacent"] * 2 + ["sampled"] * 2
    t = spark.createDataFrame([(16, 1.0)], "sequence_length bigint, ms double")
    more = reports.with_unsupported(t, [{"sequence_length": 4096, "ms": 2.5}], "too long")
    assert {r["implementation_status"]: r["ms"] for r in more.collect()} == {"SUPPORTED": 1.0, "UNSUPPORTED": 2.5}
    assert reports.only_supported(more).count() == 1
    assert {r["implementation_status"]: r["ms"] for r in reports.with_unsupported(t, [4096], "too long").collect()} == {"SUPPORTED": 1.0, "UNSUPPORTED": 0.0}
    assert compare.same_rows(rows, rows) and not compare.same_rows(rows, rows.limit(1))
    assert compare.combined_pass(0, "PASSED", True) and not compare.combined_pass(0, "SKIPPED", True)
    assert compare.verdict(compare.skipped(spark.createDataFrame([(0, 1)], "pair_id bigint, distance int"), "distance")).first()["validation_status"] == "SKIPPED"


def test_dictionary_round_trip(spark):
    p = spark.createDataFrame([(0, "B", "A"), (1, "A", "C"), (2, "B", "B")], PAIR)
    s = dictionary.sequences(p, bucket_size=2)
    assert {r["seq"]: r["seq_id"] for r in s.collect()} == {"B": 0, "A": 1, "C": 2}
    assert compare.same_rows(dictionary.gather(dictionary.index_pairs(p, s), s), p)
    assert tuple(dictionary.cache_stats(p).first()) == (3, 3, 0.5)


def test_cli(spark, tmp_path, capsys):
    pairs = tmp_path / "p.txt"
    assert cli.main(["generate", "--num-pairs", "20", "--sequence-length", "16", "--output", str(tmp_path / "gen"), "--exact"]) == 0
    pairs.write_text("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "gen")).collect()))
    for alg in ("hamming", "nw", "sw"):
        assert cli.main([alg, str(pairs), str(tmp_path / alg), "--repetitions", "1"]) == 0
        assert "VALIDATION_STATUS=PASSED" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(str(tmp_path / "hamming")).columns == sinks.LAYOUTS["hamming"]
    told = {}

    def run(*args):
        code = cli.main([*args, "--repetitions", "2"])
        told.clear()
        told.update(line.split("=", 1) for line in capsys.readouterr().out.splitlines() if "=" in line)
        return code

    rows = lambda name: spark.read.option("header", True).csv(str(tmp_path / name)).collect()
    assert run("nw", str(pairs), str(tmp_path / "v"), "--validated") == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).columns == sinks.LAYOUTS["validated"]
    assert {r["match_status"] for r in rows("v")} == {"PASSED"} and all(r["score"] == r["reference_score"] for r in rows("v")) and len(rows("v")) == 20
    assert told["TOTAL_CELLS_COMPUTED"] == str(20 * 17 * 17) and float(told["CELLS_PER_SECOND"]) > 0 and told["OUTPUT_PATH"] == str(tmp_path / "v")
    assert run("sw", str(pairs), str(tmp_path / "s"), "--summary-only", "--skip-validation") == 0
    assert {r["metric"]: r["value"] for r in rows("s")} == {"number_of_pairs": "20", "sequence_length_a": "16", "sequence_length_b": "16", "validation_status": "SKIPPED"}
    assert run("hamming", str(pairs), str(tmp_path / "h"), "--mode", "indexed", "--summary-only") == 0 and not (tmp_path / "h").exists()
    assert told["UNIQUE_SEQUENCE_COUNT"] == "40" and told["CACHE_HIT_COUNT"] == "0" and told["PAIR_INDEX_BYTES"] == "160" and told["FLAT_PAIR_BYTES"] == "640" and told["TOTAL_BASES_COMPARED"] == "320"
    assert {"FILE_READ_TIME_MS", "INPUT_VALIDATION_TIME_MS", "DICTIONARY_TIME_MS", "SCORING_TIME_MS", "SCORING_MIN_TIME_MS", "REFERENCE_TIME_MS", "VALIDATION_TIME_MS", "END_TO_END_TIME_MS", "WRITE_RESULTS", "REPETITIONS"} <= set(told)
    assert run("hamming", str(pairs), str(tmp_path / "h"), "--mode", "encoded", "--summary-only", "--write-results") == 0 and len(rows("h")) == 20 and "ENCODING_TIME_MS" in told
    lower = tmp_path / "lower.txt"
    lower.write_text("ACGT acgt\nAC AC\n")
    assert run("hamming", str(lower), str(tmp_path / "l")) == 2
    assert (told["VALIDATION_STATUS"], told["FIRST_MISMATCH_PAIR_ID"], told["REFERENCE_SCORE"], told["SCORE"]) == ("FAILED", "0", "0", "4")
    assert run("hamming", str(lower), str(tmp_path / "l"), "--mode", "indexed") == 1  # two lengths in the dictionary
    assert cli.main(["nw", str(tmp_path / "missing"), "x"]) == 1
    fa = tmp_path / "g.fa"
    fa.write_text(">g\n" + "ACGT" * 30)
    assert cli.main(["fragment", str(fa), str(tmp_path / "fp"), "--window-size", "16", "--stride", "8", "--fragments-output", str(tmp_path / "ff")]) == 0
    assert spark.read.text(str(tmp_path / "fp")).count() == 13
    assert cli.main(["encode", str(pairs)]) == 0


def test_stream(spark, tmp_path):
    p = spark.createDataFrame([(i, "ACGT", "ACCT") for i in range(5)], PAIR)
    p.write.parquet(str(tmp_path / "in"))
    q = stream.write_score_stream(stream.score_stream(stream.read_pair_stream(spark, str(tmp_path / "in")), "nw"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r["alignment_score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [5] * 5


def test_dictionary_rules(spark):
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "seq string")
    va.check_dictionary(make("ACGT", "acgt"))
    for bad, what in ((make("A", "AC"), "one length"), (make("AN"), "invalid"), (make("AC", "AC").limit(0), "no sequence"), (make(""), "no sequence")):
        with pytest.raises(ValueError, match=what):
            va.check_dictionary(bad)


def test_sampling_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 16, 17, 100, 997):
        wide, high = pairing.permutation_grid(n)
        assert n <= wide * high < n + max(wide, high)
        got = spark.range(3).select(pairing.permuted(F.sequence(F.lit(0).cast("bigint"), F.lit(wide * high - 1).cast("bigint")), wide, high, 42, F.col("id")).alias("p")).collect()
        assert all(sorted(r["p"]) == list(range(wide * high)) for r in got)
    f = spark.range(60).select(F.col("id").alias("fragment_id"), F.col("id").cast("string").alias("sequence"))
    every = pairing.sampled(f, 60, 59).pairs.select(F.col("seq_a").cast("int").alias("a"), F.col("seq_b").cast("int").alias("b"))
    assert every.distinct().count() == 60 * 59 and every.filter("a = b").count() == 0
    # Each of 59 others is drawn 5 times of 59: a chi-square statistic of 59 degrees of freedom stays under 100.
    g = spark.range(3000).select(F.col("id").alias("fragment_id"), F.col("id").cast("string").alias("sequence"))
    tens = pairing.sampled(g, 3000, 20).pairs.groupBy((F.col("seq_b").cast("int") / 50).cast("int").alias("part")).count().collect()
    assert sum((r["count"] - 1000) ** 2 / 1000 for r in tens) < 100
    first = pairing.sampled(g, 3000, 1).pairs.groupBy((F.col("seq_b").cast("int") / 50).cast("int").alias("part")).count().collect()
    assert sum((r["count"] - 50) ** 2 / 50 for r in first) < 100


def test_sql_functions(spark):
    al.register_sql(spark)
    r = spark.sql("select nw_score('ACGT','AGT') n, sw_score('ACGT','TTACGTAA') s, hamming('ACGT','ACCT') h").first()
    assert tuple(r) == (4, 8, 1)


def test_blocks_of_all_pairs(spark, monkeypatch):
    """A longer table has larger blocks, not more of them, until a block is as large as it may be; every pair is there in all cases."""
    assert all(-(-n // pairing.block_size(n, 32)) <= pairing.BLOCKS for n in (100, 6_000, 60_000, 360_000, 800_000))
    assert pairing.block_size(10**9, 32) * 80 <= pairing.BLOCK_BYTES and pairing.block_size(10**6, 10**6) == pairing.BLOCK
    monkeypatch.setattr(pairing, "BLOCK", 3)
    monkeypatch.setattr(pairing, "BLOCKS", 4)
    n = 31
    f = spark.range(n).select(F.col("id").alias("fragment_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("sequence"))
    want = [(f"s{i}", f"s{j}") for i in range(n) for j in range(n) if i != j]
    for cap in (10**6, 200, 1):
        assert sorted(map(tuple, pairing.all_vs_all(f, n, cap).pairs.collect())) == [(k, *x) for k, x in enumerate(want[:cap])]


def test_all_pairs_are_rows_of_a_join(spark, monkeypatch):
    """Spark keeps all rows that an explode makes of a row, so pairs of two blocks come of the join itself; its tasks follow the pairs, not the bytes."""
    n = 31
    f = spark.range(n).select(F.col("id").alias("fragment_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("sequence"))
    monkeypatch.setattr(pairing, "BLOCK", 3)
    monkeypatch.setattr(pairing, "BLOCKS", 4)
    monkeypatch.setattr(pairing, "TASK_PAIRS", 40, raising=False)
    want = [(f"s{i}", f"s{j}") for i in range(n) for j in range(n) if i != j]
    for cap, tasks in ((10**6, 16), (500, 12)):
        made = pairing.all_vs_all(f, n, cap).pairs
        above, join, _ = made._jdf.queryExecution().optimizedPlan().toString().partition("Join Inner")
        assert join and "Generate" not in above
        assert made.rdd.getNumPartitions() == tasks
        assert sorted(map(tuple, made.collect())) == [(k, *x) for k, x in enumerate(want[:cap])]


def test_fragments_are_spread_before_they_are_sent(spark, monkeypatch):
    """Each fragment is sent to every block; those of a small file, one task, are dealt out first, or that task would send them all."""
    n = 31
    f = spark.range(0, n, 1, 1).select(F.col("id").alias("fragment_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("sequence"))
    monkeypatch.setattr(pairing, "BLOCK", 3)
    monkeypatch.setattr(pairing, "BLOCKS", 4)
    monkeypatch.setattr(pairing, "TASK_BYTES", 2000, raising=False)
    made = pairing.all_vs_all(f, n, 10**6).pairs
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert [part.count("RepartitionByExpression") for part in plan.split("Generate explode")[1:]] == [1, 1]
    want = [(f"s{i}", f"s{j}") for i in range(n) for j in range(n) if i != j]
    assert sorted(map(tuple, made.collect())) == [(k, *x) for k, x in enumerate(want)]
