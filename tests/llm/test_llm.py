"""Operators against brute force, round trips and edge cases."""

import hashlib
import json
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import chat, decontaminate, features, langid, learn, lines, mixing, quality, registry, sentences, simhash, sketch, toxicity
from helixframe.llm.components import components
from helixframe.llm.store import Store
from oracle import compare

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, row int, key string, text2 string"


def sentence(r, n):
    return " ".join(r.choice(WORDS) + r.choice("abcdefg") for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    r = random.Random(1)
    base = [sentence(r, 40) for _ in range(12)]
    texts = [(i, t) for i, t in enumerate(base)] + [(20, None), (21, ""), (22, "  \n "), (None, base[0]), (None, None), (3, base[3]), (3, base[3]), (23, base[3]), (24, "x" * 300_000), (25, sentence(r, 60_000)), (26, "123 !?")]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", None]), None, "s", 1, "k", None) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Components -----------------------------------------------------------------------------------------------------------


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(80)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a bigint, b bigint"), Store(spark)).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == groups(real, {n for p in real for n in p})


# SimHash --------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_one_spark_would_make(spark):
    assert simhash.fingerprint("One TWO three") == xxhash.xxh64_intdigest(b"one two three", 42)
    assert spark.sql("select xxhash64('one two three') h").first()[0] % 2**64 == simhash.fingerprint("one  two\tthree")
    for t in ("", None, "a", "Äb c d e f", "a b c a b c a b c d"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("rows", [20, 200, 8192])
def test_links_join_every_pair_within_the_radius(spark, rows):
    r = random.Random(rows)
    fps = {r.getrandbits(64) for _ in range(300)} | {0}
    for f in list(fps)[:60]:
        for _ in range(r.randrange(1, 6)):
            g = f
            for _ in range(r.randrange(1, 5)):
                g ^= 1 << r.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {x["node"]: x["component"] for x in components(simhash.links(df, shard_rows=rows), Store(spark)).collect()}
    near = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    want = groups(near, signed)
    assert {n: got.get(n, n) for n in signed} == want


def test_large_shards_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 50)
    r = random.Random(3)
    x = {r.getrandbits(64) for _ in range(400)}
    x |= {f ^ (1 << r.randrange(64)) for f in list(x)[:150]}
    x = np.array(sorted(x), np.uint64)
    a, b = simhash.shard_links(x)
    got = groups(list(zip(a.tolist(), b.tolist())), x.tolist())
    near = [(int(p), int(q)) for i, p in enumerate(x) for q in x[:i] if bin(int(p) ^ int(q)).count("1") <= 3]
    assert got == groups(near, x.tolist())


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in registry.op8_simhash(spark, sf).collect()}
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}
    ids = sorted(fps)
    want = groups([(a, b) for i, a in enumerate(ids) for b in ids[:i] if bin(fps[a] ^ fps[b]).count("1") <= 3], ids)
    assert {i: (f"{fps[i]:016x}", want[i]) for i in ids} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}


def test_simhash_edges(edge, empty):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    zero = {r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {20}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in [*range(12), 20, 24, 25, 26]]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# Decontamination ------------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    w = decontaminate.words_of(text)
    hit, names = set(), set()
    for name, t in items:
        iw = decontaminate.words_of(t)
        k = min(13, len(iw))
        for win in {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else ():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == win:
                    hit |= set(range(i, i + k))
                    names.add(name)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("shard", [10, 1_000_000])
def test_decontamination_equals_brute_force(spark, shard):
    r = random.Random(9)
    w = WORDS[:6]
    items = [(str(i), " ".join(r.choice(w) for _ in range(r.choice([1, 2, 3, 12, 13, 14, 30])))) for i in range(25)] + [("e", ""), ("n", None), ("10", "Alpha! BETA-gamma")]
    items = [x for x in items if x[1] is None or len(x[1].split()) != 1 or x[0] < "5"]
    docs = [(i, " ".join(r.choice([*w, "other", "More"]) for _ in range(r.choice([0, 1, 5, 200])))) for i in range(30)]
    docs += [(100 + i, f"zz {t} yy {t}") for i, (_, t) in enumerate(items) if t] + [(200, None)]
    b = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.digest(decontaminate.scan_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), b, shard_words=shard)).collect()
    for row in got:
        n, h, k, sha = brute_hits(dict(docs)[row["doc_id"]], items)
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"], row["contaminated"]) == (n, h, k, sha, h > 0 and 20 * h >= n)


def test_decontamination_query(spark, sf):
    assert compare(registry.op5_decontaminate(spark, sf), registry.LLM_SQL["op5_decontaminate"], sf) == ""


def test_decontamination_cleans(spark, edge, empty):
    item = sentence(random.Random(77), 20)
    r = random.Random(78)
    long = sentence(r, 500)
    docs = spark.createDataFrame([(1, f"{long} {item} tail"), (2, item), (3, "clean text")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {x["doc_id"]: x["text"] for x in decontaminate.clean_documents(decontaminate.scan_documents(docs, b)).collect()}
    assert set(got) == {1, 3} and item not in got[1] and got[1].startswith(long) and got[1].endswith("tail")
    out = decontaminate.clean_documents(decontaminate.scan_documents(edge, b))
    assert out.columns == edge.columns and out.count() == edge.count()
    assert decontaminate.scan_documents(empty, b).count() == 0
    assert decontaminate.digest(decontaminate.scan_documents(docs, b.limit(0))).filter("n_hit > 0").count() == 0


# Language -------------------------------------------------------------------------------------------------------------


def test_language_accuracy_and_edges(spark, sf, edge, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = registry.op6_language_id(spark, sf).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.9 * len(got)
    model = langid.train(docs)
    marked = langid.predict(edge, model).select("row.doc_id", "row.text", "lang_pred", "score").collect()
    for r in marked:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1
    none = langid.train(empty)
    assert {r["lang_pred"] for r in langid.predict(edge, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_grams_do_not_cross_texts():
    texts = ["ab  cd!", "", "Ä", None]
    of = lambda g, i: sorted(int(n) for number, doc in g.orders(langid.DIMS) for n in number[doc == i])
    both = langid.Grams(texts)
    for i, t in enumerate(texts):
        alone = langid.Grams([t])
        assert of(both, i) == of(alone, 0) and both.letters[i] == alone.letters[0] == sum(map(str.isalpha, t or ""))


def test_language_model_equals_counts(spark, monkeypatch):
    """Naive Bayes by hand: n-grams as text, one counter each, on a model wide enough for no collisions."""
    rows = [(i, "aab ab" if i % 2 else "xyx  yy!", "aa" if i % 2 else "xx") for i in range(10)] + [(20, "aab ab", None), (21, None, "aa")]
    [(langs, log_p)] = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), dims=1 << 18).blocks()

    def grams(t):
        sym, out = [], []
        for c in t.lower():
            if c.isalpha() or not sym or sym[-1] != " ":
                sym.append(c if c.isalpha() else " ")
        if sym[-1] != " ":
            sym.append(" ")  # what ends a text
        for k in range(1, 5):
            out += [tuple(sym[i : i + k]) for i in range(len(sym) - k + 1)]
        return out

    count = {k: {} for k in ("aa", "xx")}
    for _, t, k in rows[:10]:
        for g in grams(t):
            count[k][g] = count[k].get(g, 0) + 1
    assert langs == ["aa", "xx"]
    for k, row in zip(langs, log_p):
        n = sum(count[k].values())
        want = sorted(np.log((c + 0.5) / (n + 0.5 * (1 << 18))) for c in count[k].values())
        assert np.allclose(sorted(row[row > row.min()]), want, atol=1e-4)


def test_blocks_of_languages_change_nothing(spark, edge, empty, monkeypatch):
    """Blocks of few languages against one matrix, whose predictions are worked out here once more from the model's rows."""
    r = random.Random(23)
    alphabet = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    styles = {f"l{k:02}": [r.choice(alphabet) for _ in range(9)] for k in range(23)}
    write = lambda g, n: " ".join("".join(r.choice(styles[g]) for _ in range(r.randrange(2, 7))) for _ in range(n))
    rows = [(10 * i + j, write(g, 30), g) for i, g in enumerate(styles) for j in range(4)] + [(900, "", "l99")]  # of l99 nothing is learned
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts = [write(r.choice(sorted(styles)), r.randrange(1, 6)) for _ in range(40)] + ["a", "a a", "7 !", "", None, write("l03", 9000)]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"name": F.lit("x"), "top": F.lit(1), "row": F.lit(2), "lang_pred": F.lit("y")})
    of = lambda df: {x["doc_id"]: (x["p"], x["score"], x["top"]) for x in df.select("row.doc_id", F.col("lang_pred").alias("p"), "score", "row.top").collect()}
    model = langid.train(labelled)
    [(langs, log_p)] = model.blocks()
    assert langs == sorted([*styles, "l99"])
    one = of(langid.predict(asked, model))
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert one[i] == ("und", 0.0, 1)
            continue
        places = np.concatenate([number for number, _ in langid.Grams([t]).orders(langid.DIMS)])
        logs = log_p[:, places].astype(float).sum(axis=1)
        z = (logs - logs.max()) * min(0.25, 400 / len(places))
        assert one[i][0] == langs[int(logs.argmax())] and one[i][1] == pytest.approx(1 / np.exp(z).sum(), rel=1e-6)
    monkeypatch.setattr(langid, "BLOCK", 7)
    model = langid.train(labelled)
    assert len(list(model.blocks())) > 1 and sorted(g for gs, _ in model.blocks() for g in gs) == langs
    many = of(langid.predict(asked, model))
    assert {i: v[0] for i, v in many.items()} == {i: v[0] for i, v in one.items()}
    assert all(many[i][1] == pytest.approx(one[i][1], rel=1e-9) and many[i][2] == 1 for i in one)
    assert langid.predict(edge, model).count() == edge.count() and langid.predict(empty, model).count() == 0


# Lines ----------------------------------------------------------------------------------------------------------------


def brute_lines(rows, threshold=0.8):
    import re

    pat = re.compile(lines._PATTERN)
    sh = lambda t: {m.group(1) for m in pat.finditer(t)}
    places = sorted((i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if re.search(r"\S", x))
    distinct = sorted({x for _, _, x in places})
    sets = {x: sh(x) for x in distinct}
    near = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    comp = groups(near, distinct)
    seen, gone = set(), {}
    for i, n, x in places:
        if comp[x] in seen:
            gone.setdefault(i, set()).add(n)
        seen.add(comp[x])
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in rows}


def test_lines_equal_brute_force(spark):
    r = random.Random(4)
    base = [sentence(r, r.choice([3, 10, 30, 60])) for _ in range(40)]

    def near(t):
        w = t.split()
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        return " ".join(w)

    docs = [(i, "\n".join(r.choice([r.choice(base), near(r.choice(base)), near(base[0]), sentence(r, 12), "", "same"]) for _ in range(6))) for i in range(80)] + [(90, None), (91, "")]
    got = lines.marked_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    found = {x["doc_id"]: x["t"] for x in got.select("row.doc_id", F.col("deduplicated").alias("t")).collect()}
    want = brute_lines(docs)
    assert sum(found[k] != want[k] for k in want) == 0


def test_insertion_in_an_unspaced_line_shifts_nothing(spark):
    r = random.Random(41)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    base = [draw([chr(0x4E00 + i) for i in range(800)], 300), "https://example.org/" + draw("abcdefghij0123456789/-_=&", 180), ",".join(str(r.randrange(100, 1000)) for _ in range(74)), draw("ABCDEFabcdef0123456789+/", 160), sentence(r, 30)]
    rows = list(base)
    for t in base:
        for at in (0, 10, len(t) // 2, len(t)):
            rows += [t[:at] + "Z" + t[at:], t[:at] + t[at + 1 :]]
    rows += [t[:80] + draw("vwxyz", len(t) - 80) for t in base] + ["short", "shor", "1234567", "12345678", "123456789"]
    sh = {t: {t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in rows}
    distinct = sorted(set(rows))
    comp = groups([(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])], distinct)
    want = {comp[t]: i for i, t in reversed(list(enumerate(rows)))}
    got = lines.dedup_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"))
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(want.values())
    assert len(want) == len(base) * 2 + 5


def test_lines_are_native_and_survive_edges(spark, edge, empty):
    plan = lines.signatures(edge, "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    out = lines.dedup_documents(edge)
    assert out.columns == edge.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == [*range(4), 3, 3, *range(4, 12), 20, 21, 22, 24, 25, 26][0:0] + sorted([*range(12), 3, 3, 20, 21, 22, 24, 25, 26])
    assert lines.dedup_documents(empty).count() == 0


def test_signatures_take_every_shingle_of_a_line(spark):
    r = random.Random(17)
    texts = [sentence(r, 40), "short", "12345678", "123456789", "".join(chr(r.choice([0x4E00, 0x1F600, 0xE9, 0x61]) + r.randrange(20)) for _ in range(95))]
    texts += ["".join(r.choice("abcdef ") for _ in range(n)) for n in (lines.SHINGLE + lines.GROUP - 1, lines.SHINGLE + lines.GROUP, lines.SHINGLE + 2 * lines.GROUP)]
    got = {tuple(x["bands"]) for x in lines.signatures(spark.createDataFrame([("\n".join(texts),)], "text string"), "text").collect()}
    shingled = [(k, t[i : i + 8]) for k, t in enumerate(texts) for i in range(max(1, len(t) - 7))]
    hashed = spark.createDataFrame(shingled, "k int, s string").withColumn("h", F.xxhash64(F.encode("s", "UTF-32"))).collect()
    want = set()
    for k in range(len(texts)):
        least = [min(x["h"] ^ lines.permutation(i) for x in hashed if x["k"] == k) for i in range(lines.BANDS * lines.ROWS)]
        bands = spark.createDataFrame([(b, *least[b * lines.ROWS : (b + 1) * lines.ROWS]) for b in range(lines.BANDS)], "b int, " + ", ".join(f"m{i} bigint" for i in range(lines.ROWS)))
        want.add(tuple(x["v"] for x in bands.orderBy("b").select(F.xxhash64("b", *[f"m{i}" for i in range(lines.ROWS)]).alias("v")).collect()))
    assert got == want and len(got) == len(texts)
    assert lines.signatures(spark.createDataFrame([(texts[0] * 4_000,)], "text string"), "text").count() == 1  # a line of a million characters


def test_equal_lines_are_cut_once_and_minima_do_not_move(spark):
    docs = spark.createDataFrame([(f"same line in all\nown line {i}\n \t\x0b\f\r\n\u00a0",) for i in range(20)], "text string")
    signed = lines.signatures(docs, "text")
    assert sorted(x["n"] for x in signed.collect()) == [1] * 20 + [20, 20]
    plan = signed._jdf.queryExecution().sparkPlan().toString()  # from the last step down to the first
    cut = plan.index("explode(sequence")
    assert "count(1)" in plan[cut:] and "count(1)" not in plan[:cut]  # lines are distinct before they are cut
    plan = signed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("explode(sequence") < plan.index("Exchange hashpartitioning")


def test_shingles_and_blanks_are_what_the_patterns_say(spark):
    r = random.Random(23)
    texts = ["", "\n", "a", *[c * 9 for c in " \t\x0b\f\r\u00a0\u3000\x1c\x85\u2028"], " \t x", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    texts += ["".join(r.choice("ab \u4e00\U0001f600\u00e9\r") for _ in range(n)) for n in range(1, 40)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", lines.shingles(F.col("t")).alias("s"), lines.blank(F.col("t")).alias("b"), (~F.col("t").rlike(r"\S")).alias("w")).collect()
    for x in got:
        t = x["t"]
        assert sorted(x["s"]) == sorted(t[i : i + 8] for i in range(max(1, len(t) - 7)) if t) and x["b"] == x["w"]


def test_bitmaps_never_rule_out_a_pair(spark):
    r = random.Random(8)
    texts = [sentence(r, r.choice([1, 2, 10, 60, 200])) for _ in range(25)]
    texts += [t[: max(1, int(len(t) * cut))] for t in texts for cut in (0.9, 0.82, 0.78)]
    texts = sorted(set(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "key bigint, line string")
    maps = lines.bitmaps(rows)
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in texts]
    assert {x["key"]: x["n"] for x in maps.collect()} == {i: len(s) for i, s in enumerate(sets)}
    members = rows.join(maps, "key").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("band"), F.array(F.lit(1), F.lit(2)).alias("bands"), F.col("key").alias("c"), *maps.columns)
    near = lines.close_pairs(members, 0.8)
    found = [(x["a"], x["b"]) for x in near.collect()]
    assert len(found) == len(set(found))  # of two shared bands, one gives the pair
    want = {(j, i) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x & y) >= 0.8 * len(x | y)}
    assert want and want <= set(found)
    assert {(x["a"], x["b"]) for x in lines.resembling(near, rows, 0.8).collect()} == want
    every = spark.createDataFrame([(j, i) for i in range(len(sets)) for j in range(i)], "a bigint, b bigint")
    assert {(x["a"], x["b"]) for x in lines.verified(every, rows, maps, 0.8).collect()} == want


# Sketches -------------------------------------------------------------------------------------------------------------


def test_sketch_query_equals_brute_force(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in registry.op10_sketch(spark, sf).collect()}
    assert len(got) == len(docs)
    own = sketch.sketches([d["text"] for d in docs])
    for i, d in enumerate(docs):
        follow = docs[(i + 1) % len(docs)]
        t, h = d["text"], len(d["text"]) // 2
        new = t[: len(t) - h] + follow["text"][:h]
        r = got[d["doc_id"]]
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and r["n_chars"] == len(t)
        e = sketch.sketches([new])[0]
        assert r["fingerprint"] == sketch.encode(own[i]) and r["edited_fingerprint"] == sketch.encode(e)
        assert r["near_edited"] == sketch.resemblance(own[i], e) and r["near_next"] == sketch.resemblance(own[i], own[(i + 1) % len(docs)])


def test_sketch_estimates_and_merge(spark):
    r = random.Random(6)
    a, b = sentence(r, 3000), sentence(r, 2000)
    sh = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    both = a + " " + b
    sa, sc = sketch.sketches([a, both], 512)
    assert abs(sketch.resemblance(sa, sc, 512) - len(sh(a) & sh(both)) / len(sh(a) | sh(both))) < 0.07
    assert abs(sketch.containment(sa, sc, 512) - 1) < 0.1
    assert abs(sketch.distinct_count(sa, 512) / len(sh(a)) - 1) < 0.15
    x, y = sketch.sketches([a, b])
    assert (sketch.decode(sketch.encode(x)) == x).all()
    docs = spark.createDataFrame([(1, a), (1, b), (2, "a b"), (2, None)], "k bigint, text string")
    merged = sketch.fingerprint_documents(docs).select("row.k", "fingerprint")
    got = {q["key"]: q["fingerprint"] for q in sketch.merge_by_key(merged, "k").collect()}
    assert got[1] == sketch.encode(sketch.merge([x, y]))
    assert sketch.resemblance(*sketch.sketches(["", " "])) == 1.0 and sketch.resemblance(*sketch.sketches(["", "a"])) == 0.0
    assert len(sketch.sketches(["one two"])[0]) == 1


def spark_rows(like, rows, schema):
    return like.sparkSession.createDataFrame(rows, schema)


def test_sketch_edges(edge, empty):
    got = sketch.compare_edited(edge)
    assert got.count() == edge.count()
    assert got.filter("n_chars = 0").count() == 3
    assert sketch.compare_edited(empty).count() == 0
    far = spark_rows(edge, [(-(2**63), "a b c"), (5, "d"), (None, "x"), (None, "y"), (None, "y"), (2**63 - 1, None)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in sketch.compare_edited(far).collect()] == [2**63 - 1, 5, -(2**63), None, None, None]
    assert [r["doc_id"] for r in sketch.compare_edited(spark_rows(edge, [("k1", "a"), (None, "c"), ("k2", "b")], "doc_id string, text string")).collect()] == ["k2", "k1", None]
    none = edge.sparkSession.range(3000).selectExpr("cast(null as bigint) doc_id", "cast(id as string) text")
    sizes = [r["count"] for r in sketch.with_next(none).groupBy("bucket").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1500
    assert sketch.compare_edited(edge.limit(1)).count() == 1


# Mixing ---------------------------------------------------------------------------------------------------------------


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    codes = [c.ravel() for c in np.meshgrid(range(4), range(3), range(5), indexing="ij")]
    t = rng.integers(1, 1000, 60).astype(float)
    targets = [v / v.sum() for v in (rng.random(4) + 0.1, rng.random(3) + 0.1, rng.random(5) + 0.1)]
    w, residual = mixing.rake(t, codes, targets)
    assert residual < 1e-9
    for c, v in zip(codes, targets):
        assert np.allclose(np.bincount(c, w), v, atol=1e-7)
    for budget in (0.01, 0.3, 0.9):
        c = mixing.scale(t, w, budget * t.sum())
        assert abs((np.minimum(t, c * w)).sum() / t.sum() - budget) < 1e-9
    # Marginals that conflict on empty cells.
    w, residual = mixing.rake(np.array([1.0, 1.0]), [np.array([0, 1]), np.array([0, 1])], [np.array([0.9, 0.1]), np.array([0.2, 0.8])])
    assert residual > 0.1


def brute_mix(rows, targets, budget):
    """Cell weights and probabilities in plain dictionaries: 3,000 sweeps, c by bisection."""
    cells = {}
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] = cells.get((r["source"], r["lang"], r["topic"]), 0) + r["n_tokens"]
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(3000):
        for d, name in enumerate(("source", "lang", "topic")):
            sums, have = {}, {}
            for k in w:
                sums[k[d]] = sums.get(k[d], 0) + cells[k]
                have[k[d]] = have.get(k[d], 0) + w[k]
            given = {v: (1.0 if targets[name] == "equal" else targets[name].get(v, 0.0)) if n else 0.0 for v, n in sums.items()}
            total = sum(given.values())
            w = {k: x * given[k[d]] / total / have[k[d]] if have[k[d]] else 0.0 for k, x in w.items()}
    lo, hi, goal = 0.0, 1e12, budget * sum(cells.values())
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(min(t, c * w[k]) for k, t in cells.items()) < goal else (lo, c)
    return {k: (w[k], min(1.0, lo * w[k] / t) if t and w[k] else 0.0 if t else budget) for k, t in cells.items()}


def test_mixing_query_equals_brute_force(spark, sf):
    got = registry.op2_source_mixing(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"] for r in got} == set(docs) and all(r["n_tokens"] == len((docs[r["doc_id"]]["text"] or "").split()) for r in got)
    assert all(r["source"] == docs[r["doc_id"]]["source"] and r["lang"] == docs[r["doc_id"]]["lang"] for r in got)
    want = brute_mix(got, registry.MIX_TARGETS, mixing.BUDGET)
    loose = 1e-6 + 20 * got[0]["residual"]  # where the marginals conflict, sweeps end at different places
    for r in got:
        weight, p = want[r["source"], r["lang"], r["topic"]]
        assert abs(r["weight"] - weight) < loose and (r["probability"] == 0) == (p == 0)
    assert abs(sum(r["probability"] * r["n_tokens"] for r in got) / sum(r["n_tokens"] for r in got) - mixing.BUDGET) < 1e-6


def test_mixing_paths_agree(spark, edge, empty):
    rows = [(i, "a b c d " * (1 + i % 7), ["en", "de"][i % 2], f"s{i % 3}", None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kw = {"targets": {"lang": {"en": 1.0, "de": 3.0, "zz": 5.0}, "source": "equal"}}
    a = {r["doc_id"]: r["probability"] for r in mixing.mix(docs, **kw).select("row.doc_id", "probability").collect()}
    b = {r["doc_id"]: r["probability"] for r in mixing.mix(docs, max_cells=0, **kw).select("row.doc_id", "probability").collect()}
    assert len(a) == len(b) == 60 and max(abs(a[k] - b[k]) for k in a) < 1e-9
    out = mixing.sample(edge)
    assert out.columns == edge.columns and mixing.mix(edge).count() == edge.count()
    assert mixing.mix(empty).count() == 0


# Chat -----------------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.one_of(st.text(), st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "x", "<", ">"])).map("".join))), max_size=5))
def test_chat_round_trip(turns):
    made = [chat.format_turn(r, t) for r, t in turns]
    assert chat.parse("".join(m[0] for m in made)) == turns
    for (r, t), (seg, i, j) in zip(turns, made):
        assert chat.unescape(seg[i:j]) == (t if r == "assistant" else "")
        body = seg[seg.index("\n") + 1 :] if "\n" not in r else None
        assert body is None or not any(c in body[: -len("\n</turn>\n")] for c in chat.CONTROL)


def test_chat_layouts():
    want = [("user", "q"), ("assistant", "a")]
    for rec in ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "completion": "a"},
                {"instruction": "q", "input": "", "output": "a"}, {"question": "q", "answer": "a", "id": {"x": 1}}):
        assert chat.canonical_turns(rec) == want
    assert chat.canonical_turns({"foo": 1}) is None and chat.canonical_turns({}) is None
    assert chat.fingerprint(chat.field_paths({"b": 1, "a": [{"c": 2}]})) == chat.fingerprint(["a[].c", "b"])


def test_chat_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    conv = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        conv.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    conv[-7] = [("user", registry.ESCAPE_CASE), ("assistant", registry.ESCAPE_CASE)]
    got = {r["conv_id"]: r for r in registry.op3_chat_format(spark, sf).collect()}
    assert set(got) == set(conv)
    for k, turns in conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns) and got[k]["loss_chars"] == len(loss)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[k]["formatted_chars"] == sum(len(chat.format_turn(*t)[0]) for t in turns)


def test_chat_query_equals_sql(spark, sf):
    assert compare(registry.op3_chat_format(spark, sf), registry.LLM_SQL["op3_chat_format"], sf) == ""


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (1, 0, "user", None), (2, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segment", F.lit("clash"))
    records = df.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    for turns in (chat.table_turns(df), chat.to_turns(records)):
        got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(turns)).collect()}
        assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 200_000
    bad = [(1, 0, None), (2, 0, "{bad"), (3, 0, json.dumps({"foo": 1})), (4, 0, json.dumps({"messages": []})), (5, 0, json.dumps({"prompt": "q", "completion": "a"})), (5, 1, None), (None, 0, "[1]")]
    odd = spark.createDataFrame(bad, "conv_id bigint, turn bigint, record string")
    got = {r["conv_id"]: (r["n_turns"], r["formatted_chars"] > 0) for r in chat.digests(chat.format_conversations(chat.to_turns(odd))).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (0, False), 4: (0, False), 5: (2, True), None: (0, False)}
    typed = spark.createDataFrame([("a", 0, [("human", "q"), ("gpt", "r")]), ("b", 0, []), ("c", 0, None)], "conv_id string, turn int, conversations array<struct<from:string,value:string>>")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.format_conversations(chat.table_turns(typed))).collect()}
    assert got == {"a": (2, 1), "b": (0, 0), "c": (0, 0)}
    assert chat.digests(chat.format_conversations(chat.table_turns(df.limit(0)))).count() == 0


# Toxicity and quality -------------------------------------------------------------------------------------------------


def test_learners():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = learn.BoostedTrees().fit(x[:1000], y[:1000]).margin(x[1000:])
    assert learn.auc(m, y[1000:]) > 0.95
    p = learn.Isotonic().fit(m, y[1000:])(np.sort(m))
    assert (np.diff(p) >= -1e-12).all() and 0 <= p.min() and p.max() <= 1
    assert learn.auc(np.array([1, 2, 2, 3.0]), np.array([0, 0, 1, 1])) == 0.875


def test_features_do_not_depend_on_the_batch():
    r = random.Random(2)
    texts = [sentence(r, n) + "\nSAME!\nSAME!" for n in (1, 5, 50)] + [None, "", "ümlaut 1d10t aaa"]
    assert np.allclose(features.dense(texts), np.concatenate([features.dense([t]) for t in texts]))


def test_isotonic_pools_ties():
    m = learn.Isotonic().fit(np.zeros(4), np.array([0, 0, 1, 0.0]))
    assert m(np.array([0.0]))[0] == 0.25


def test_trees_follow_a_brute_force_split():
    """One tree of depth 1: the cut is the one that a search over all cuts of all features finds."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    y[x[:, 1] > 2] = 1
    m = learn.BoostedTrees(rounds=1, depth=1).fit(x, y)
    p = 1 / (1 + np.exp(-m.start))
    g, h = p - y, np.full(200, p * (1 - p))
    part = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1.0)
    best = max(((part(x[:, j] <= c) + part(x[:, j] > c), j, c) for j in range(3) for c in range(5)), key=lambda b: b[0])
    low, high = m.margin(x)[x[:, best[1]] <= best[2]], m.margin(x)[x[:, best[1]] > best[2]]
    assert len(set(low.tolist())) == 1 == len(set(high.tolist())) and low[0] < high[0]


def test_toxicity_held_out(spark, edge, empty):
    d = "/root/testdata/sf0.1"
    got = registry.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert learn.auc(got["score"].to_numpy(), got["toxic"].to_numpy()) > 0.97
    assert (got["predicted"] == got["toxic"]).mean() > 0.97
    ids = edge.select("doc_id")
    none = toxicity.train(edge, ids.withColumn("toxic", F.lit(0)))
    assert {r["score"] for r in toxicity.score(edge, none).collect()} == {0.0}
    known = ids.withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
    assert toxicity.score(edge, toxicity.train(edge, known)).filter("score between 0 and 1").count() == edge.count()
    assert toxicity.score(empty, toxicity.train(empty, empty.select("doc_id", F.lit(1).alias("toxic")))).count() == 0


def test_toxicity_of_repeated_rows(spark):
    docs = spark.createDataFrame([(i, "you are vile scum rotten" if i < 100 else f"nice day number {i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(400)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels, max_train=100)).select("row.doc_id", "score", "predicted").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["doc_id"] < 100) for r in got)
    same = docs.withColumn("text", F.lit("one text"))
    got = toxicity.score(same, toxicity.train(same, labels)).collect()
    assert all(abs(r["score"] - 0.25) < 1e-6 for r in got)


def test_quality(spark, edge, empty):
    d = "/root/testdata/sf0.1"
    got = registry.op1_quality(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert got.count() == docs.count()
    x = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert learn.auc(x["score"].to_numpy(), x["quality"].to_numpy()) > 0.97
    labels = edge.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality.classify(edge, labels).filter("score between 0 and 1").count() == edge.count()
    assert quality.classify(empty, labels.limit(0)).count() == 0


# Sentences ------------------------------------------------------------------------------------------------------------


def test_sentence_spans_equal_brute_force(spark, edge, empty):
    r = random.Random(12)
    s = [sentence(r, r.choice([2, 8, 15, 45])) + r.choice(".!?") for _ in range(15)]
    docs = [(i, r.choice([" ", "\n"]).join(r.choice([r.choice(s), sentence(r, 7) + "."]) for _ in range(12))) for i in range(20)]
    passage = " ".join(sentence(r, 9) + "." for _ in range(7))
    docs += [(50, "Before it. " + passage + " After it."), (51, passage), (52, None), (53, "")]
    seen, gone = set(), {}
    for i, t in sorted(docs):
        for a, b, h in sentences.spans(t):
            if h in seen:
                gone.setdefault(i, []).append({"start": a, "end": b})
            seen.add(h)
    got = {x["doc_id"]: x["t"] for x in sentences.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).select("row.doc_id", F.col("deduplicated").alias("t")).collect()}
    assert got == {i: sentences.remove(t, gone.get(i))[0] for i, t in docs}
    assert passage in got[50] and got[51] == ""
    assert sentences.dedup(edge).count() == edge.count() and sentences.dedup(empty).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"min_words": 20}, {"long_words": None}, {"least": 2, "min_words": 12, "long_words": 25}])
def test_no_sentence_of_a_repeated_run_stays(spark, bounds):
    least, fewest, long = (bounds.get(k, v) for k, v in (("least", 3), ("min_words", 0), ("long_words", 40)))
    r = random.Random(17)
    docs = []
    lengths = [[41, 30], [40, 39], [25, 25, 5], [5, 25, 25], [30, 41], [6, 7, 8, 2, 39], [1, 1, 1], [2, 1, 1, 1]] + [[r.randrange(1, 31) for _ in range(r.randrange(2, 7))] for _ in range(40)]
    for k, ns in enumerate(lengths):
        run = [sentence(r, n) + "." for n in ns]
        for i in (2 * k, 2 * k + 1):
            docs.append((i, " ".join([sentence(r, 3) + ".", *run, sentence(r, 4) + "."])))
    own = {i: [tuple(x.split()) for x in t.split(".") if x.strip()] for i, t in docs}
    seen, want = {}, {i: set() for i, _ in docs}
    for i, s in sorted(own.items()):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                words = sum(map(len, s[a:b]))
                if (b - a >= least and words >= fewest) or (long is not None and words >= long):
                    if seen.setdefault(tuple(s[a:b]), (i, a)) != (i, a):
                        want[i] |= set(range(a, b))
    got = {x["doc_id"]: x["t"] for x in sentences.dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), **bounds).select("row.doc_id", F.col("deduplicated").alias("t")).collect()}
    assert {i: [tuple(x.split()) for x in t.split(".") if x.strip()] for i, t in got.items()} == {i: [x for n, x in enumerate(s) if n not in want[i]] for i, s in own.items()}


# Pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    store = Store(spark)
    counts = [docs.count()]
    at = docs
    for name, stage in cp.STAGES:
        at = store.put(stage(spark, at, sf), name)
        assert at.columns == docs.columns
        counts.append(at.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] >= counts[4] > counts[5] > 0
    assert sorted(r["doc_id"] for r in cp.run(spark, sf).collect()) == sorted(r["doc_id"] for r in at.collect())


def test_pipeline_stages_on_edges(spark, sf, edge, empty):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        out, none = stage(spark, edge, sf), stage(spark, empty, sf)
        assert out.columns == edge.columns == none.columns and none.count() == 0
        ids = [r["doc_id"] for r in out.collect()]
        assert set(ids) <= {None, *range(12), *range(20, 27)}
        if name in ("line_dedup", "near_duplicates", "decontamination"):
            assert set(range(12)) <= set(ids)  # clean documents stay
