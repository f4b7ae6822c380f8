import pytest

from helixframe.operators import pairing
from helixframe.plans.queries import QUERIES, SQL
from oracle import compare


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), SQL[name], sf) == ""


@pytest.mark.parametrize("name", ["pairs_adjacent", "pairs_sampled", "pairs_mutated", "mutation_stats", "hamming_similarity"])
def test_default_cap_cuts_no_query(spark, sf, monkeypatch, name):
    for f in (pairing.adjacent, pairing.sampled, pairing.mutated_queries):
        monkeypatch.setattr(f, "__defaults__", tuple(7 if x == pairing.MAX_PAIRS else x for x in f.__defaults__))
    assert compare(QUERIES[name](spark, sf), SQL[name], sf) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
