"""Clustering, importance resampling and the permutation index against brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import clustering, importance, permutation, registry
from oracle import compare

VECTORS = "vec_id bigint, embedding array<float>, cluster int, score string, row int, x string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", 2, "x") for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, zero, non-finite and short vectors, nulls inside, repeated rows, a null id, clashing names."""
    r = np.random.default_rng(0)
    good = [(i, [float(x) for x in r.normal(size=64)]) for i in range(60)]
    bad = [(100, None), (101, []), (102, [0.0] * 64), (103, [math.nan] + [1.0] * 63), (104, [math.inf] + [1.0] * 63), (105, [None] + [1.0] * 63), (106, [1.0] * 63), (None, good[5][1]), good[7], good[7], (200, good[7][1]), (7, good[8][1])]
    return vectors(spark, good + bad), good + bad


# Centroid clustering --------------------------------------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, dim, scale, salt):
    """In Python integers, a vector at a time."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"{salt}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda p: (mark(p[0]), p[1]))[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [near(v)[0] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, c, d in got if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in got), key=str)


@pytest.mark.parametrize("k,rounds", [(8, 10), (1, 1), (100, 3), (5, 0)])
def test_lloyd_equals_plain(odd, k, rounds):
    df, rows = odd
    got = clustering.lloyd(df.repartition(7), k=k, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=str) == plain_lloyd(rows, k, rounds, 64, 1024, "3")


def test_lloyd_sql(spark, sf):
    assert compare(registry.op11_lloyd(spark, sf), clustering.sql(), sf) == ""


def test_lloyd_ties_empty_and_extremes(spark, odd):
    same = vectors(spark, [(i, [0.5] * 64) for i in range(20)])
    assert {(r["cluster"], r["distance"]) for r in clustering.lloyd(same).collect()} == {(0, 0)}
    none = clustering.lloyd(odd[0].limit(0))
    assert none.count() == 0 and none.columns == clustering.lloyd(same).columns
    far = clustering.lloyd(vectors(spark, [(0, [3e38] * 64), (1, [-3e38] * 64), (2, [0.0] * 64)]), k=2, rounds=2).collect()
    assert len(far) == 3 and all(r["distance"] >= 0 for r in far)
    text = odd[0].withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    assert {r["vec_id"] for r in clustering.lloyd(text).collect()} >= {"v1", None}
    # Floors of negative means go down.
    low = spark.createDataFrame([(0, [-1.0]), (1, [-2.0])], "vec_id bigint, embedding array<double>")
    assert clustering.step(clustering.integers(low, dim=1, scale=1), np.array([[0]])).tolist() == [[-2]]
    with pytest.raises(ValueError):
        clustering.lloyd(low, k=0)


# Importance resampling ------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_grams(text, max_n):
    w = WORD.findall("".join(c.lower() if c in importance.UPPER else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, max_n, buckets, min_words, percent, seed):
    b = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, out in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for g in plain_grams(x, max_n)[1]:
                out[b(g)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for i, x in docs:
        n, grams = plain_grams(x, max_n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b(g)] for g in grams)
        rows.append([i, len(grams), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = "alpha Beta gamma, delta. É epsilon's 42 日本 zeta-eta 😀x a\x00b _under_ the".split(" ")
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 19, 20, 60])))) for i in range(80)]
    return docs + [(90, None), (91, ""), (92, "... !"), (93, "x" * 200_000), (94, "the cat " * 100_000), (None, "alpha beta " * 20), docs[3], docs[3], (95, docs[3][1])], [" ".join(r.choice(words[:5]) for _ in range(30)) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("max_n,buckets,percent", [(1, 10_000, 10), (3, 50, 35), (2, 1, 100), (1, 7, 0)])
def test_resample_equals_plain(spark, texts, max_n, buckets, percent):
    docs, target = texts
    df = spark.createDataFrame([(i, t, 0, 1, "b", True) for i, t in docs], "doc_id bigint, text string, rank int, n_words int, b string, total boolean").repartition(5)
    want = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, want, max_n=max_n, buckets=buckets, percent=percent, seed="7")
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target, max_n, buckets, 20, percent, "7")


def test_resample_sql(spark, sf):
    assert compare(registry.op12_importance(spark, sf), importance.sql(), sf) == ""


def test_resample_empty(spark, texts):
    docs = spark.createDataFrame(texts[0], "doc_id bigint, text string")
    none = docs.select("text").limit(0)
    assert importance.resample(docs.limit(0), none).count() == 0
    assert sorted(map(tuple, importance.resample(docs, none).collect()), key=str) == plain_resample(texts[0], [], 1, 10_000, 20, 10, "2024")


# Permutation index ----------------------------------------------------------------------------------------------------


def plain_neighbours(rows, picks, k):
    a = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if picks(i):
            s = a @ np.array(v, np.float64)
            order = np.lexsort((ids, -np.round(s, 9)))
            out[i] = [(int(ids[j]), s[j]) for j in order if ids[j] != i][:k]
    return out


def recall(spark, rows, k=20, every=5, **options):
    got = permutation.neighbours(vectors(spark, rows).repartition(6), F.col("vec_id") % every == 0, k, **options).collect()
    want = plain_neighbours(rows, lambda i: i % every == 0, k)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(by) == {q for q, near in want.items() if near}
    vec = dict(rows)
    for q, found in by.items():
        assert [x[2] for x in found] == list(range(1, len(found) + 1)) and len(found) == len(want[q]) and q not in [x[0] for x in found]
        assert all(abs(s - np.dot(np.array(vec[q], float), np.array(vec[i], float))) < 1e-6 * (1 + abs(s)) for i, s, _ in found)
        assert [(-s, i) for i, s, _ in found] == sorted((-s, i) for i, s, _ in found)
    return np.mean([len({x[0] for x in by[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in by])


def f32(a):
    return [float(x) for x in a.astype(np.float32)]


@pytest.mark.parametrize("kind", ["random", "copies", "norms", "shifted"])
def test_recall(spark, kind):
    r = np.random.default_rng(1)
    a = r.normal(size=(9000, 48))
    if kind == "copies":
        a[1000:5000] = a[999] + 0.05 * r.normal(size=(4000, 48))  # a hot group of near copies
    if kind == "norms":
        a *= np.exp(0.5 * r.normal(size=(9000, 1)))
    if kind == "shifted":
        a += 1.5
    assert recall(spark, [(i, f32(v)) for i, v in enumerate(a)], every=100) >= 0.9


def test_exact_on_small_and_odd_tables(spark, odd, sf):
    df, _ = odd
    few = permutation.neighbours(df, F.col("vec_id") % 10 == 0, 20).collect()
    ids = {r["query_id"] for r in few}
    assert {0, 10, 50} <= ids and 200 in ids and not ids & {100, None} and len(few) == 20 * len(ids)
    assert not {r["vec_id"] for r in few} & {100, 101, 102, 103, 104, 105, 106, None}
    twins = [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"]) if r["query_id"] == 200]
    assert twins[0] == 7  # the same vector under another id
    own = permutation.neighbours(df, F.col("vec_id") == 7, 3).collect()
    assert all(r["vec_id"] != 7 for r in own)
    assert permutation.neighbours(df.limit(0), F.col("vec_id") >= 0).count() == 0
    one = vectors(spark, [(1, [1.0] * 4)])
    assert permutation.neighbours(one, F.col("vec_id") == 1).count() == 0
    same = [(i, [1.0, 2.0]) for i in range(300)]
    assert recall(spark, same, k=7, every=50) == 1.0  # ties: the smaller id
    huge = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [1e-30, 0.0]), (3, [-1e30, 5.0])]
    assert len(permutation.neighbours(vectors(spark, huge), F.col("vec_id") == 0, 20).collect()) == 3
    with pytest.raises(ValueError):
        permutation.neighbours(one, F.lit(True), 0)
    assert registry.op13_permutation_index(spark, sf).groupBy("query_id").count().filter("count <> 20").count() == 0


def test_cells_and_chunks_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, f32(v)) for i, v in enumerate(r.normal(size=(400, 16)))]
    monkeypatch.setattr(permutation, "HELD", 7)  # twelve sets of queries
    assert recall(spark, rows, k=5, every=5) >= 0.99


def test_footrule_by_inverted_files():
    """A cell's sums rank rows as the footrule distance of prefixes does."""
    r = np.random.default_rng(3)
    pivots, width = 12, 5
    prefix = np.array([r.permutation(pivots)[:width] for _ in range(30)], np.int16)
    cell = permutation.Cell(3, pivots, width)
    row, place, start = cell.files(prefix)
    for p in range(pivots):
        got = {(int(i), int(w)) for i, w in zip(row[start[p] : start[p + 1]], place[start[p] : start[p + 1]])}
        assert got == {(i, list(prefix[i]).index(p)) for i in range(30) if p in prefix[i]}

    def footrule(x, y):
        at = lambda v, p: list(v).index(p) if p in v else width
        return sum(abs(at(x, p) - at(y, p)) for p in range(pivots))

    near = lambda x, y: sum(width - max(list(x).index(p), list(y).index(p)) for p in set(x) & set(y))
    assert all(footrule(x, y) == width * (width + 1) - 2 * near(x, y) for x in prefix for y in prefix)
