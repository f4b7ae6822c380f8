"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled training rows: beginnings of words (4 to 8 characters, and whole words, lower-cased,
look-alike digits and signs read as letters) that toxic texts hold more often than others. Features: densities and
strengths of lexicon words, how many stand near a second-person pronoun, and rates of capitals, punctuation, symbols
inside words, stretched letters and the like. Lexicon features of training rows come from the other folds, so trees see
what they will see on new text. Isotonic calibration uses predictions on the fold a model was not fitted on.

Training takes about MAX_TRAIN labelled rows, drawn by a hash of the id and, where ids repeat, thinned to that number; the
drawn rows are stored once. Every text is scored whole.

Defined results: null and empty texts score like a text of no words, never an error. With no training rows, or rows of
one class only, every score is the share of toxic labels (0 with none). Repeated rows score alike, and equal texts fall
into one fold; a repeated pair of id and label counts once; null labels and ids are left out; a very long text is scored
like any other. Other columns, whatever their names, pass through in `row`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm import features
from helixframe.llm.learn import BoostedTrees, Isotonic
from helixframe.llm.store import Store
from helixframe.llm.text import SpanHash, annotate, is_kind, per_text, runs, segment_sum, slabs, to_codes

MAX_TRAIN = 12_000
FOLDS = 3
PREFIXES = (4, 5, 6, 7, 8)
#: How surely a word beginning must tell toxic rows apart (in standard errors) to enter the lexicon.
CERTAIN = 2.5
NEAR = 6
#: Second-person forms in English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta vous votre tú ti tus usted ustedes vosotros su".split()
#: Signs read as letters.
LOOK_ALIKE = str.maketrans("013457@$!", "oieastasi")

_PRONOUNS = np.unique(np.concatenate([SpanHash(c)(np.array([0]), np.array([len(c)])) for c in (np.array([ord(x) for x in w], np.uint32) for w in SECOND_PERSON)]))


def word_stems(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hashes of its beginnings as columns, offsets of texts). A word shorter than a beginning has the
    whole word there."""
    codes, bounds = to_codes([t.lower().translate(LOOK_ALIKE) for t in texts])
    start, end = runs(is_kind(codes, "word"))
    h = SpanHash(codes)
    whole = h(start, end)
    stems = np.stack([whole, *[h(start, np.minimum(start + k, end)) for k in PREFIXES]], axis=1) if len(start) else np.zeros((0, len(PREFIXES) + 1), np.uint64)
    return whole, stems, per_text(bounds, start)


def _strength(stems: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The largest log odds among a word's beginnings, 0 if none is in the lexicon."""
    keys, odds = lexicon
    if not len(keys) or not len(stems):
        return np.zeros(len(stems))
    at = np.minimum(np.searchsorted(keys, stems), len(keys) - 1)
    return np.where(keys[at] == stems, odds[at], 0.0).max(axis=1)


def lexicon_features(texts: list[str | None], lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = []
    for i, j in slabs([t or "" for t in texts]):
        whole, stems, at = word_stems([t or "" for t in texts[i:j]])
        s = _strength(stems, lexicon)
        n = np.maximum(np.diff(at), 1).astype(float)
        own = np.repeat(np.arange(j - i), np.diff(at))
        top = np.zeros(j - i)
        np.maximum.at(top, own, s)
        strong, clear = s >= 2.5, s >= 4.0
        place = np.flatnonzero(np.isin(whole, _PRONOUNS))
        hits = np.flatnonzero(strong)
        near = np.zeros(len(s), bool)
        if len(place) and len(hits):
            k = np.searchsorted(place, hits)
            for p in (place[np.minimum(k, len(place) - 1)], place[np.maximum(k - 1, 0)]):
                near[hits[(np.abs(p - hits) <= NEAR) & (own[p] == own[hits])]] = True
        total = lambda v: segment_sum(v.astype(float), at)
        out.append(np.stack([top, total(s), total(s) / n, total(strong), total(strong) / n, total(clear), total(clear) / n, total(near), total(np.isin(whole, _PRONOUNS)) / n], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 9))


def _lexicon(keys: np.ndarray, pos: np.ndarray, neg: np.ndarray, p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The word beginnings that tell toxic rows apart, sorted, and their log odds."""
    odds = np.log((pos + 0.5) / (p - pos + 0.5)) - np.log((neg + 0.5) / (n - neg + 0.5))
    good = np.flatnonzero((pos >= 2) & (odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) >= CERTAIN))
    good = good[np.argsort(keys[good])]
    return keys[good], odds[good]


def _drawn(docs: DataFrame, labels: DataFrame, store: Store, doc_id: str, text: str, label: str, most: int) -> tuple[DataFrame | None, float]:
    """(text, y, fold) of the training rows, stored, or None with fewer than two classes; the share of toxic labels."""
    marks = labels.select(F.col(doc_id).alias("id"), (F.col(label).cast("int") > 0).cast("int").alias("y")).filter("y is not null and id is not null").distinct()
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return None, share
    # Each class gets half of the bound, or what the other leaves.
    room = {1: max(most // 2, most - sizes[0]), 0: max(most - most // 2, most - sizes[1])}
    by_class = lambda rate: F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])
    u = F.pmod(F.xxhash64("id", "y", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    ids = store.put(marks.filter(u < by_class({k: min(1.0, room[k] / sizes[k]) for k in sizes})), "drawn")
    ids = F.broadcast(ids)  # about `most` rows, by the draw
    found = docs.select(F.col(doc_id).alias("id")).join(ids, "id").groupBy("y").agg(F.count("*").alias("n")).collect()
    found = {0: 0, 1: 0} | {r["y"]: r["n"] for r in found}
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(ids, "id")
    thin = {k: min(1.0, room[k] / max(found[k], 1)) for k in found}
    if min(thin.values()) < 0.9:  # an id of many rows: by the row, and equal rows by their number, whatever the partitions
        nth = F.row_number().over(Window.partitionBy("id", "y", F.xxhash64("text")).orderBy("text"))
        rows = rows.withColumn("nth", nth).filter(F.pmod(F.xxhash64("id", "y", "text", "nth", F.lit(4)), F.lit(1 << 30)) / float(1 << 30) < by_class(thin))
    rows = store.put(rows.select("text", "y", F.pmod(F.xxhash64("text", F.lit(4)), F.lit(FOLDS)).cast("int").alias("fold")), "training")
    return (rows if rows.select("y").distinct().count() == 2 else None), share


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN) -> dict:
    """A model from the labels one may learn from (columns doc_id, label) and the documents they name."""
    store = Store(docs.sparkSession)
    sample, share = _drawn(docs, labels, store, doc_id, text, label, max_train)
    if sample is None:
        return {"constant": share}

    def stems(batches):
        for b in batches:
            texts, y, fold = b.column("text").to_pylist(), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for i, j in slabs(texts):
                _, s, at = word_stems(texts[i:j])
                own = np.repeat(np.arange(j - i), np.diff(at))
                pair = np.unique(np.rec.fromarrays([np.repeat(own, s.shape[1]), s.ravel()], names="d,s")) if len(s) else np.rec.fromarrays([np.zeros(0, int), np.zeros(0, np.uint64)], names="d,s")
                key, inv = np.unique(pair["s"], return_inverse=True)
                kind = (fold[i:j] * 2 + y[i:j])[pair["d"]]
                c = np.stack([np.bincount(inv[kind == k], minlength=len(key)) for k in range(2 * FOLDS)], axis=1) if len(key) else np.zeros((0, 2 * FOLDS), int)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[pa.array(c[:, k].astype(np.int64)) for k in range(2 * FOLDS)]], names=["s", *[f"c{k}" for k in range(2 * FOLDS)]])

    names = [f"c{k}" for k in range(2 * FOLDS)]
    counts = sample.mapInArrow(stems, "s bigint, " + ", ".join(f"{c} bigint" for c in names)).groupBy("s").agg(*[F.sum(c).alias(c) for c in names])
    pos, neg = sum(F.col(f"c{2 * k + 1}") for k in range(FOLDS)), sum(F.col(f"c{2 * k}") for k in range(FOLDS))
    size = np.zeros((FOLDS, 2), np.int64)
    for r in sample.groupBy("fold", "y").count().collect():
        size[r["fold"], r["y"]] = r["count"]
    p, n = float(size[:, 1].sum()), float(size[:, 0].sum())
    odds = F.log((pos + 0.5) / (F.lit(p) - pos + 0.5)) - F.log((neg + 0.5) / (F.lit(n) - neg + 0.5))
    certain = counts.filter((pos >= 2) & (odds / F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) >= CERTAIN)).toPandas()  # of the bounded sample
    keys = certain["s"].to_numpy(np.int64).view(np.uint64)
    c = certain[names].to_numpy(np.float64).reshape(len(keys), FOLDS, 2)
    whole = _lexicon(keys, c[:, :, 1].sum(1), c[:, :, 0].sum(1), size[:, 1].sum(), size[:, 0].sum())
    folds = []
    for k in range(FOLDS):
        rest = [i for i in range(FOLDS) if i != k]
        folds.append(_lexicon(keys, c[:, rest, 1].sum(1), c[:, rest, 0].sum(1), size[rest, 1].sum(), size[rest, 0].sum()))
    held = docs.sparkSession.sparkContext.broadcast(folds)

    def rows_of(batches):
        for b in batches:
            texts, y, fold = b.column("text").to_pylist(), b.column("y"), b.column("fold").to_numpy()
            x = features.dense(texts)
            lex = np.zeros((len(texts), 9))
            for k in range(FOLDS):
                mine = np.flatnonzero(fold == k)
                lex[mine] = lexicon_features([texts[i] for i in mine], held.value[k])
            yield pa.RecordBatch.from_arrays([y, b.column("fold"), pa.array(list(np.c_[x, lex]), pa.list_(pa.float64()))], names=["y", "fold", "x"])

    got = sample.mapInArrow(rows_of, "y int, fold int, x array<double>").toPandas()
    x, y, fold = np.stack(got["x"].to_numpy()), got["y"].to_numpy(np.float64), got["fold"].to_numpy()
    order = np.lexsort((*x.T, y))  # the rows' order must not depend on the cluster
    x, y, fold = x[order], y[order], fold[order]
    trees, out, done = BoostedTrees().fit(x, y), np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(FOLDS):
        if (fold == k).any() and 0 < y[fold != k].sum() < (fold != k).sum():
            out[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
            done |= fold == k
    if not 0 < y[done].sum() < done.sum():  # so few different texts that no fold can be left out
        out, done = trees.margin(x), np.ones(len(y), bool)
    # Classes were drawn at different rates: weigh the calibrated odds back.
    weight = share / (1 - share) / (y.mean() / (1 - y.mean()))
    return {"trees": trees, "isotonic": Isotonic().fit(out[done], y[done]), "lexicon": whole, "odds": float(weight)}


def score_batch(texts: list[str | None], model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    x = np.c_[features.dense(texts), lexicon_features(texts, model["lexicon"])]
    p = np.clip(model["isotonic"](model["trees"].margin(x)), 1e-6, 1 - 1e-6)
    odds = p / (1 - p) * model["odds"]
    return odds / (1 + odds)


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """`row`, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def f(texts: list) -> list[pa.Array]:
        s = score_batch(texts, held.value)
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return annotate(docs, [text], f, "score double, predicted int")
