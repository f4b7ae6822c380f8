"""Co-training's exchange between views, and records of hostile JSON."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat, quality
from helixframe.llm.store import Store

GOOD = "the committee published a careful report about rivers and the history of several towns in the region".split()
BAD = "CLICK HERE!!! buy now $$$ free free win >>> subscribe NOW http://x.y/z 100% !!!".split()


def corpus(spark, source, n=1500, seed=3):
    """Documents whose text tells the quality, and whose source does as far as `source` makes it so."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.5
        text = " ".join(r.choice(GOOD if r.random() < (0.8 if good else 0.2) else BAD) for _ in range(r.randint(15, 80)))
        docs.append((i, text, source(good, r), "en"))
        if i % 3 == 0:
            labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_both_views_speak(spark):
    docs, labels = corpus(spark, lambda good, r: ("a" if good else "b") if r.random() < 0.9 else r.choice("ab"))
    store = Store(spark)
    table = quality.featured(docs, store)
    model = quality.train(table, labels, store)
    assert len(model["exchange"]) == quality.ROUNDS and model["informs"] == (True, True)
    assert all(x["from_text"] > 0 and x["from_meta"] > 0 and x["text_informs"] and x["meta_informs"] for x in model["exchange"])
    got = quality.score(table, model).toPandas()
    assert len(got) == 1500 and got["meta_informs"].all() and got["text_informs"].all()


def test_a_view_without_evidence_is_silent_and_said_so(spark):
    docs, labels = corpus(spark, lambda good, r: r.choice("abcdef"))
    store = Store(spark)
    table = quality.featured(docs, store)
    model = quality.train(table, labels, store)
    assert all(x["from_meta"] == 0 and x["from_text"] > 0 for x in model["exchange"]) and model["informs"] == (True, False)
    assert not quality.score(table, model).filter("meta_informs").count()


def test_exchange_equals_plain_ranking(spark):
    """What goes over is what a sort in Python of each view's own evidence gives."""
    docs, labels = corpus(spark, lambda good, r: ("a" if good else "b") if r.random() < 0.8 else None, n=600)
    store = Store(spark)
    table = quality.featured(docs, store)
    rows = table.toArrow()
    a, b = quality._views(rows)
    t = rows.column("t").to_pylist()
    y = np.array([i % 2 for i in range(60)], float)
    va, vb = quality.Logistic(ridge=5.0).fit(a[:60], y), quality.Logistic(ridge=5.0).fit(b[:60], y)
    p, q = quality._evidence(va.margin(a), 0.4), quality._evidence(vb.margin(b), 0.6)
    mark = {r["t"]: r["h"] for r in table.select("t", F.xxhash64("t").alias("h")).collect()}
    taken = t[:5]

    def plain(own, other):
        out = {}
        for label, n in ((1.0, 17), (0.0, 9)):
            side = lambda v: v if label else 1 - v  # noqa: B023, E731
            able = {(-side(x), mark[k], k) for k, x, z in zip(t, own, other) if k not in taken and side(x) > 0.5 and side(z) >= quality.AGREE}
            out |= {k: label for _, _, k in sorted(able)[:n]}
        return out

    want = [plain(p, q), plain(q, p)]
    unlike = {k for k in want[0].keys() & want[1].keys() if want[0][k] != want[1][k]}
    want = tuple({k: v for k, v in w.items() if k not in unlike} for w in want)
    none = table.select("id").limit(0)
    assert quality._handed(table, none, store, va, vb, (0.4, 0.6), (17, 9), (True, True), taken) == want and want[0] and want[1]
    assert quality._handed(table, none, store, va, vb, (0.4, 0.6), (17, 9), (True, False), taken)[1] == {}
    every = quality._handed(table, table.select("id").distinct(), store, va, vb, (0.4, 0.6), (17, 9), (True, True), [])
    assert every == ({}, {})


HOSTILE = [
    (1, json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "X"}]}).replace("X", "\\ud800 b \\udc00"), 2, "� b �"),
    (2, "[" * 100_000 + "]" * 100_000, 0, ""),
    (3, '{"a":' * 100_000 + "1" + "}" * 100_000, 0, ""),
    (4, '{"prompt": "p", "completion": "first", "completion": "last"}', 2, "last"),
    (5, '{"prompt": "p", "completion": "\\ud83d\\ude00"}', 2, "😀"),
    (6, '{"prompt": ', 0, ""),
    (7, '{"prompt": "p", "completion": NaN}', 2, "NaN"),
    (8, '{"prompt": "p", "completion": ' + '[' * 600 + ']' * 600 + "}", None, None),
    (9, "null", 0, ""),
    (10, '"text"', 0, ""),
    (11, json.dumps({"role": "\ud800", "text": "t"}), 1, ""),
    (12, '{"messages": [1, null, "x", {"role": "assistant", "content": {"\\ud801": 1}}]}', None, None),
]


def test_hostile_records(spark):
    df = spark.createDataFrame([(i, 0, r) for i, r, _, _ in HOSTILE], "conv_id bigint, turn bigint, record string")
    turns = chat.to_turns(df)
    made = chat.format_conversations(turns)
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(made).collect()}
    assert set(got) == {i for i, *_ in HOSTILE}
    said = {r["conv_id"]: r["text"] for r in turns.filter("role = 'assistant'").collect()}
    for i, _, n, text in HOSTILE:
        assert n is None or (got[i] == n and said.get(i, "") == text), i


@pytest.mark.parametrize("text", ["", "plain", "é😀", "\ud800", "\udc00\ud800", "a😀b"])
def test_sound_text_can_be_written(text):
    made = chat.sound(text)
    made.encode()
    assert made == text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
