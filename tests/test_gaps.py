"""Affine gaps, bands, tiles and traceback against plain recursion."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import alignment as al
from helixframe.functions import gaps
from helixframe.operators import longpair, scoring
from helixframe.schemas import PAIR, AffineScoring, Scoring

TEXT = st.text("ACGTé😀", max_size=14)
SCORES = st.builds(Scoring, st.integers(-2, 5), st.integers(-5, 3), st.integers(-4, 1))


def plain_affine(a, b, local, s):
    """Three tables, one for each way a cell can end."""
    low, n, m = -(10**9), len(a), len(b)
    best = [[low] * (m + 1) for _ in range(n + 1)]
    down, along = [r[:] for r in best], [r[:] for r in best]
    top = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                down[i][j] = max(best[i - 1][j] + s.gap_open, down[i - 1][j] + s.gap_extend)
            if j:
                along[i][j] = max(best[i][j - 1] + s.gap_open, along[i][j - 1] + s.gap_extend)
            v = max(down[i][j], along[i][j])
            if i and j:
                v = max(v, best[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch))
            if not i and not j:
                v = 0
            best[i][j] = max(v, 0) if local else v
            top = max(top, best[i][j])
    return top if local else best[n][m]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5), st.integers(0, 5), st.integers(-5, 2), st.integers(-6, 0), st.integers(0, 4))
def test_affine_equals_plain(pairs, match, mismatch, extend, more):
    s = AffineScoring(match, mismatch, extend - more, extend)
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    for local in (False, True):
        assert gaps.affine_batch(a, b, local, s).tolist() == [plain_affine(x, y, local, s) for x, y in pairs]
        linear = AffineScoring(match, mismatch, extend, extend)
        assert gaps.affine_batch(a, b, local, linear).tolist() == al.align_batch(a, b, local, Scoring(match, mismatch, extend)).tolist()


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, SCORES, st.integers(1, 6))
def test_bands_prove_the_score(a, b, s, width):
    score, cells, band = gaps.banded(a, b, s, width)
    assert score == al.align_batch([a], [b], False, s)[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=8), SCORES, st.integers(1, 6))
def test_bands_of_many_pairs(pairs, s, width):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    made = gaps.banded_batch(a, b, s, width)
    assert made[0].tolist() == al.align_batch(a, b, False, s).tolist()
    assert list(zip(*(v.tolist() for v in made))) == [gaps.banded(x, y, s, width) for x, y in pairs]


def test_bands_take_many_pairs_at_once(monkeypatch):
    """Steps of numpy are as many as rows of a slab, not of all pairs."""
    calls, kernel = [], gaps._band_scores
    monkeypatch.setattr(gaps, "_band_scores", lambda a, *rest: calls.append(len(a)) or kernel(a, *rest))
    r = random.Random(8)
    a, b = (["".join(r.choice("ACGT") for _ in range(32)) for _ in range(4000)] for _ in range(2))
    assert gaps.banded_batch(a, b, Scoring(), 4)[0].tolist() == al.align_batch(a, b, False).tolist()
    assert len(calls) < 40 and sum(calls) >= 4000


def test_bands_save_cells():
    r = random.Random(2)
    a = "".join(r.choice("ACGT") for _ in range(2000))
    b = a[:700] + "ACG" + a[700:1500] + a[1503:]
    score, cells, band = gaps.banded(a, b, Scoring())
    assert score == al.align_batch([a], [b], False)[0] and cells < 0.05 * 2001 * 2001 and band == 16


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=6), SCORES)
def test_diagonals_equal_rows(pairs, s):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    for local in (False, True):
        assert al.diagonal_batch(a, b, local, s).tolist() == al.align_batch(a, b, local, s).tolist()


def test_three_forms_agree(spark):
    r = random.Random(5)
    draw = lambda: "".join(r.choice("ACGT") for _ in range(r.randint(0, 40)))
    rows = [(i, draw(), draw()) for i in range(200)] + [(200, None, "A"), (201, "A", None), (202, "ACGT" * 3, "é😀")]
    df = spark.createDataFrame(rows, PAIR)
    for alg in ("nw", "sw"):
        got = [sorted(map(tuple, scoring.align(df, alg, implementation=i).collect())) for i in ("rolling", "full", "sql")]
        assert got[0] == got[1] == got[2]
    assert scoring.align(df.limit(0), implementation="full").count() == 0
    assert "lambda" not in scoring.align(df, implementation="full")._jdf.queryExecution().optimizedPlan().toString()  # so it costs microseconds a pair


def replayed(a, b, runs, s):
    i = j = score = 0
    for op, n in runs:
        for _ in range(n):
            if op in "=X":
                assert (a[i] == b[j]) == (op == "=")
                score += s.match if op == "=" else s.mismatch
                i, j = i + 1, j + 1
            else:
                score += s.gap
                i, j = i + (op == "D"), j + (op == "I")
    assert (i, j) == (len(a), len(b))
    return score


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, SCORES)
def test_traceback_replays(a, b, s):
    runs = gaps.operations(gaps.codes(a), gaps.codes(b), s)
    assert replayed(a, b, runs, s) == al.align_batch([a], [b], False, s)[0]
    assert all(x[0] != y[0] for x, y in zip(runs, runs[1:])) and all(n > 0 for _, n in runs)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=8), SCORES)
def test_traceback_of_many_pairs(pairs, s):
    assert gaps.cigars([x for x, _ in pairs], [y for _, y in pairs], s) == [gaps.cigar(x, y, s) for x, y in pairs]


def test_traceback_halves_many_pairs_at_once(monkeypatch):
    calls, kernel = [], gaps._last_rows
    monkeypatch.setattr(gaps, "_last_rows", lambda *rest: calls.append(1) or kernel(*rest))
    r = random.Random(9)
    a, b = (["".join(r.choice("ACGT") for _ in range(r.randint(0, 300))) for _ in range(300)] for _ in range(2))
    assert gaps.cigars(a, b, Scoring()) == [gaps.cigar(x, y, Scoring()) for x, y in zip(a, b)]
    assert 0 < len(calls) < 1500 and gaps.cigars([], [], Scoring()) == []


def test_traceback_of_long_sequences():
    r = random.Random(4)
    a = "".join(r.choice("ACGT") for _ in range(3000))
    b = "".join(c for c in a if r.random() > 0.05)
    assert replayed(a, b, gaps.operations(gaps.codes(a), gaps.codes(b), Scoring()), Scoring()) == al.align_batch([a], [b], False)[0]


def test_replay_refuses_what_does_not_fit(spark):
    rows = [("ACGT", "ACCT", "2=1X1=", 5), ("ACGT", "ACCT", "4=", None), ("ACGT", "ACCT", "2=1X", None), ("", "", "", 0), ("AC", "", "2D", -4), ("AC", "AC", "1I1=1D", None), (None, "A", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, want bigint")
    assert all(r["got"] == r["want"] for r in df.select("want", scoring.replay(F.col("a"), F.col("b"), F.col("c")).alias("got")).collect())


@settings(max_examples=200, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=20), st.text("ACGT", min_size=1, max_size=20), SCORES, st.integers(1, 20), st.integers(1, 20), st.booleans())
def test_tiles_join_up(a, b, s, i, j, local):
    """Four tiles with handed-on borders give the matrix's last row and highest cell."""
    x, y = gaps.codes(a), gaps.codes(b)
    top = np.zeros(len(y) + 1, np.int64) if local else np.arange(len(y) + 1) * s.gap
    left = np.zeros(len(x), np.int64) if local else np.arange(1, len(x) + 1) * s.gap
    i, j = min(i, len(x)), min(j, len(y))
    bottom1, right1, best1 = gaps.tile(x[:i], y[:j], top[: j + 1], left[:i], s, local)
    bottom2, right2, best2 = gaps.tile(x[:i], y[j:], top[j:], right1, s, local)
    bottom3, right3, best3 = gaps.tile(x[i:], y[:j], bottom1, left[i:], s, local)
    bottom4, right4, best4 = gaps.tile(x[i:], y[j:], bottom2, right3, s, local)
    want = al.align_batch([a], [b], local, s)[0]
    assert (max(best1, best2, best3, best4) if local else bottom4[-1]) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ACGT", min_size=1, max_size=9), st.text("ACGT", min_size=1, max_size=9), st.integers(-9, 9)), min_size=1, max_size=6), SCORES, st.booleans())
def test_tiles_of_many_pairs(rows, s, local):
    a, b = [gaps.codes(x) for x, _, _ in rows], [gaps.codes(y) for _, y, _ in rows]
    tops = [np.arange(len(y) + 1) * v for _, y, v in rows]
    lefts = [np.arange(len(x)) * -v for x, _, v in rows]
    bottom, right, best = gaps.tile_batch(a, b, tops, lefts, s, local)
    for k in range(len(rows)):
        u, v, w = gaps.tile(a[k], b[k], tops[k], lefts[k], s, local)
        assert (bottom[k].tolist(), right[k].tolist(), best[k]) == (u.tolist(), v.tolist(), w)


def test_long_pairs_by_tiles(spark):
    r = random.Random(6)
    draw = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    rows = [(0, draw(50), draw(33)), (1, draw(7), draw(64)), (2, "", "ACG"), (3, "", ""), (4, None, "A"), (5, "Aé😀C", "é😀"), (6, draw(16), draw(16))]
    df = spark.createDataFrame(rows, PAIR)
    for alg in ("nw", "sw"):
        want = {x["pair_id"]: tuple(x) for x in scoring.align(df, alg).collect()}
        assert {x["pair_id"]: tuple(x) for x in longpair.align_long(df, alg, size=16).collect()} == want
    a, b = draw(4096), draw(4096)
    long = spark.createDataFrame([(1, a, b)], PAIR)
    assert longpair.align_long(long, "nw", size=1024).first()["alignment_score"] == al.align_batch([a], [b], False)[0]
    assert longpair.align_long(df.limit(0)).count() == 0


def test_columns(spark):
    rows = [(0, "ACGT", "AGT"), (1, "", ""), (2, None, "A"), (3, "ACGT" * 30, "ACGT" * 29)]
    df = spark.createDataFrame(rows, PAIR)
    nw = {r["pair_id"]: r["alignment_score"] for r in scoring.align(df).collect()}
    assert {r["pair_id"]: r["alignment_score"] for r in scoring.align(df, implementation="full").collect()} == nw
    assert {r["pair_id"]: r["alignment_score"] for r in scoring.align_banded(df).collect()} == nw
    assert {r["pair_id"]: r["alignment_score"] for r in scoring.align_affine(df, "nw", AffineScoring(2, -1, -2, -2)).collect()} == nw
    assert {r["pair_id"]: r["cigar"] for r in scoring.traceback(df).collect()}[0] == "1=1D2="
    sw = {r["pair_id"]: r["max_local_alignment_score"] for r in scoring.align(df, "sw").collect()}
    assert {r["pair_id"]: r["max_local_alignment_score"] for r in scoring.align(df, "sw", implementation="full").collect()} == sw


def test_lengths_beyond_32_bits(spark):
    df = spark.range(1).select(F.repeat(F.lit("A"), F.lit(100_000)).alias("s"))
    n = F.length("s")
    assert tuple(df.select(scoring.cells(n, n), scoring.dp_memory_bytes(n, n, "full"), scoring.dp_memory_bytes(n, n)).first()) == (100_001**2, 4 * 100_001**2, 12 * 100_001)
