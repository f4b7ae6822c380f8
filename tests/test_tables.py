"""Overlap joins and table functions."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions.tables import register_table_functions
from helixframe.operators import fragments as fr
from helixframe.operators import pairing
from helixframe.operators.overlap import overlaps


@pytest.mark.parametrize("width,hot", [(1, 3), (7, 1), (64, 1000), (10_000, 5)])
def test_overlaps_equal_brute_force(spark, width, hot):
    r = random.Random(width)

    def rows(n):
        out = []
        for i in range(n):
            s = r.choice([5, 5, 5, r.randint(-20, 300)])  # a hot place
            out.append((i, r.choice(["a", "b", None]), s, s + r.choice([0, 1, 3, 40, 200, -2])))
        return out + [(n, "a", None, 5), (n + 1, "a", 1, None)]

    a, b = rows(60), rows(50)
    make = lambda x: spark.createDataFrame(x, "id int, genome string, start bigint, end bigint")
    got = overlaps(make(a), make(b), width=width, hot=hot)
    pairs = sorted((x["a"]["id"], x["b"]["id"]) for x in got.collect())
    real = lambda x: None not in x[1:] and x[2] < x[3]
    assert pairs == sorted((x[0], y[0]) for x in a for y in b if real(x) and real(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_table_functions(spark):
    register_table_functions(spark)
    g = spark.createDataFrame([(1, "x", "ACGTNACGTACGTA"), (2, None, "acgtacgt"), (3, "z", None), (4, "w", "AC")], "id bigint, name string, seq string")
    g.createOrReplaceTempView("genomes")
    for window, stride in ((4, 2), (3, 5)):
        got = spark.sql(f"select * from fragments(TABLE(genomes), sequence_column => 'seq', window => {window}, stride => {stride}, skip_ambiguous => true)")
        assert got.columns == ["id", "name", "fragment_id", "start", "end", "fragment"]
        want = fr.fragment(g.withColumn("genome", F.col("id")), window, stride, genome="id", sequence="seq", skip_ambiguous=True)
        assert sorted(tuple(x)[:1] + tuple(x)[2:] for x in got.collect()) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="unsupported"):
        spark.sql("select * from fragments(TABLE(genomes), sequence_column => 'seq', window => 4, stride => 2)").collect()
    for bad, what in (("sequence_column => 'no', window => 4, stride => 2", "no text column"), ("sequence_column => 'seq', window => 0, stride => 2", "positive")):
        with pytest.raises(Exception, match=what):
            spark.sql(f"select * from fragments(TABLE(genomes), {bad})")
    f = spark.range(5).select(F.col("id").alias("fragment_id"), F.lit("ACGTTGCAACGGT").alias("sequence"))
    f.createOrReplaceTempView("frags")
    got = spark.sql("select f.fragment_id * 2 + m.copy as pair_id, f.sequence as seq_a, m.mutant as seq_b from frags f, lateral mutants(f.sequence, f.fragment_id, 2, 0.3, 42) m")
    want = pairing.mutated_queries(f, 5, k=2, rate=0.3).pairs
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
