"""Quality by co-training: a text classifier and a metadata classifier teach each other, then are calibrated and combined.

The text view has dense text features and hashed words; the metadata view has source, language and size and never sees
the text. Features of all documents are computed once and stored. In each round both views score every unlabelled document,
and each hands those it ranks highest and lowest, of the whole table, to the other as pseudo-labels: HANDED times the labelled
rows, both classes at the labelled ratio, equal texts once, ties by a hash. A text goes over only if the other view does not
speak against its label (AGREE). A view that does not rank labelled rows kept from training better than LEAST_AUC has no evidence to
give: it hands nothing over, and the result says so (`text_informs`, `meta_informs`). The model counts what each view gave in
each round (`exchange`). Afterwards each view is calibrated (isotonic) on the rows kept from training, and a document's
score is the mean of the two calibrated log odds, weighted by how well each view ranks those rows.

Training takes a bounded sample of about MAX_LABELLED labelled rows, by a hash of id and text; nothing else is sampled.

Defined results: null and empty texts have features of zero; null source or language is a value of its own. With no
labels, or one class only, every score is the share of good rows (0.5 with none). Repeated rows score alike; a repeated pair
of id and label counts once, null ids and labels are left out. Very long texts are scored whole; other columns, whatever
their names, are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm import features
from helixframe.llm.learn import Isotonic, Logistic, auc
from helixframe.llm.store import Store
from helixframe.llm.text import annotate

MAX_LABELLED = 6_000
ROUNDS = 3
#: Pseudo-labels that a view hands over in a round, as a share of the labelled rows it learns from; the least evidence for a label
#: that the other view must show; the ranking of rows kept from training from which a view counts as informed.
HANDED, AGREE, LEAST_AUC = 0.15, 0.3, 0.6
WORD_DIMS = 128
META_DIMS = 64
TEXT_DIMS = len(features.NAMES) + WORD_DIMS


def text_view(texts: list) -> np.ndarray:
    return np.c_[features.dense(texts), features.hashed_words(texts, WORD_DIMS)]


def meta_view(sources: list, langs: list, sizes: list) -> np.ndarray:
    import zlib

    out = np.zeros((len(sources), META_DIMS + 2))
    for i, (s, g, n) in enumerate(zip(sources, langs, sizes)):
        out[i, zlib.crc32(f"s{s}".encode("utf-8", "surrogatepass")) % META_DIMS] += 1
        out[i, zlib.crc32(f"l{g}".encode("utf-8", "surrogatepass")) % META_DIMS] += 1
        out[i, -2:] = np.log1p(max(n or 0, 0)), (n or 0) < 200
    return out


def featured(docs: DataFrame, store: Store, doc_id: str = "doc_id") -> DataFrame:
    """(id, t, source, lang, n_chars, a) of every document, stored: t is a hash of the text, a the text view."""
    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64("text").alias("t"), "text", "source", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))

    def f(texts: list) -> list[pa.Array]:
        return [pa.FixedSizeListArray.from_arrays(pa.array(text_view(texts).astype(np.float32).ravel()), TEXT_DIMS).cast(pa.list_(pa.float32()))]

    return store.put(annotate(own, ["text"], f, "a array<float>").select("row.id", "row.t", "row.source", "row.lang", "row.n_chars", "a"), "features")


def _matrix(a: pa.Array) -> np.ndarray:
    return a.flatten().to_numpy().astype(np.float64).reshape(len(a), -1) if len(a) else np.zeros((0, TEXT_DIMS))


def _views(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    a = t.column("a")
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return _matrix(a), meta_view(*[t.column(c).to_pylist() for c in ("source", "lang", "n_chars")])


def _mapped(table: DataFrame, keep: list[str], f, added: str) -> DataFrame:
    """The columns `keep` and what f makes of both views; arrays move without passing through Python values."""
    names = [c.split()[0] for c in added.split(", ")]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(v, pa.float64()) for v in f(*_views(b))]], names=[*keep, *names])

    kept = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in keep)
    return table.select(*dict.fromkeys([*keep, "source", "lang", "n_chars", "a"])).mapInArrow(run, f"{kept}, {added}")


def _evidence(margin: np.ndarray, prior: float) -> np.ndarray:
    """Chance of label 1 by the view's evidence alone, were both labels as frequent: a view that knows nothing is never sure."""
    return 1 / (1 + np.exp(-np.clip(margin - np.log(prior / (1 - prior)), -30, 30)))


def _handed(table: DataFrame, marked: DataFrame, store: Store, va: Logistic, vb: Logistic, priors: tuple[float, float], counts: tuple[int, int], speaks: tuple[bool, bool], taken: list[int]) -> tuple[dict[int, float], dict[int, float]]:
    """Text hashes and labels that view a, and view b, rank first among all documents whose id is not in `marked`. counts: of
    labels 1 and 0. Labelled rows go out after scoring, so that features are never shuffled. A text that both views give with different labels goes to neither."""
    held = table.sparkSession.sparkContext.broadcast((va, vb))
    scored = _mapped(table, ["id", "t"], lambda a, b: [_evidence(v.margin(x), p) for v, x, p in zip(held.value, (a, b), priors)], "p double, q double").join(marked, "id", "left_anti")
    stored = store.put(scored.groupBy("t").agg(F.max("p").alias("p"), F.max("q").alias("q")), "scored")  # equal texts once
    scored = stored.filter(~F.col("t").isin(taken)) if taken else stored
    out: list[dict[int, float]] = []
    for own, other, may in (("p", "q", speaks[0]), ("q", "p", speaks[1])):
        got: dict[int, float] = {}
        for label, n in zip((1.0, 0.0), counts):
            side = lambda c: F.col(c) if label else 1 - F.col(c)  # noqa: B023, E731
            if may and n:
                first = scored.filter((side(own) > 0.5) & (side(other) >= AGREE)).orderBy(side(own).desc(), F.xxhash64("t"))
                got |= {r["t"]: label for r in first.select("t").limit(n).collect()}  # a bounded share of the labelled rows
        out.append(got)
    store.drop(stored)
    unlike = {k for k in out[0].keys() & out[1].keys() if out[0][k] != out[1][k]}
    return tuple({k: v for k, v in g.items() if k not in unlike} for g in out)


def train(table: DataFrame, labels: DataFrame, store: Store, *, doc_id: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> dict:
    """A model from the features of all documents (see `featured`) and the labels one may learn from."""
    marks = labels.select(F.col(doc_id).alias("id"), (F.col(label).cast("int") > 0).cast("int").alias("y")).filter("y is not null and id is not null").distinct()
    n = marks.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n[0] or not 0 < n[1] < n[0]:
        return {"constant": float(n[1] / n[0]) if n[0] else 0.5}
    u = lambda seed, *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.broadcast(store.put(marks.filter(u(11, "id", "y") < min(1.0, max_labelled / n[0])), "drawn"))  # about max_labelled rows, by the draw
    known = table.join(drawn, "id")
    found = known.count()
    if found > 1.2 * max_labelled:  # an id of many rows: by the row, and equal rows by their number, whatever the partitions
        nth = F.row_number().over(Window.partitionBy("id", "t", "source", "lang", "y").orderBy(F.lit(0)))
        known = known.withColumn("nth", nth).filter(u(13, "id", "t", "source", "lang", "y", "nth") < max_labelled / found).drop("nth")
    got = known.select("id", "t", "y", "source", "lang", "n_chars", "a").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return {"constant": float(n[1] / n[0])}
    a, b = _views(got)
    order = np.lexsort((y, got.column("t").to_numpy()))  # must not depend on the cluster
    a, b, y = a[order], b[order], y[order]
    held = np.arange(len(y)) % 4 == 3
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    fit = lambda x, t: Logistic(ridge=5.0).fit(x, t)
    share = float(y.mean())
    xa, xb, ya, yb = a[~held], b[~held], y[~held], y[~held]
    va, vb = fit(xa, ya), fit(xb, yb)
    marked = marks.select("id").distinct()
    c = held if 0 < y[held].sum() < held.sum() else ~held
    informs = lambda: (auc(va.margin(a[c]), y[c]) >= LEAST_AUC, auc(vb.margin(b[c]), y[c]) >= LEAST_AUC)
    pairs = round(HANDED * len(ya) * share), round(HANDED * len(ya) * (1 - share))
    taken: list[int] = []
    exchange: list[dict] = []
    for _ in range(rounds):
        speaks = informs()
        from_a, from_b = _handed(table, marked, store, va, vb, (float(ya.mean()), float(yb.mean())), pairs, speaks, taken)
        exchange.append({"from_text": len(from_a), "from_meta": len(from_b), "text_informs": speaks[0], "meta_informs": speaks[1]})
        if not from_a and not from_b:
            break
        both = from_a | from_b
        taken += sorted(both)
        wanted = F.broadcast(table.sparkSession.createDataFrame([(k,) for k in sorted(both)], "t bigint"))
        given = store.put(table.join(wanted, "t"), "given")  # stored, or the anti join would move below and shuffle all features
        rows = given.join(marked, "id", "left_anti").groupBy("t").agg(*[F.min_by(x, F.struct("source", "lang", "n_chars")).alias(x) for x in ("source", "lang", "n_chars", "a")]).toArrow()
        pa_, pb_ = _views(rows)
        t = rows.column("t").to_pylist()
        for mine, giver in ((True, from_a), (False, from_b)):
            at = sorted((k for k in range(len(t)) if t[k] in giver), key=t.__getitem__)
            label = np.array([giver[t[k]] for k in at])
            if mine and at:  # what view a is sure of teaches view b
                xb, yb = np.r_[xb, pb_[at]], np.r_[yb, label]
            elif at:
                xa, ya = np.r_[xa, pa_[at]], np.r_[ya, label]
        va, vb = fit(xa, ya), fit(xb, yb)
    ma, mb = va.margin(a[c]), vb.margin(b[c])
    wa, wb = max(auc(ma, y[c]) - 0.5, 0.01) ** 2, max(auc(mb, y[c]) - 0.5, 0.01) ** 2
    return {"a": va, "b": vb, "ia": Isotonic().fit(ma, y[c]), "ib": Isotonic().fit(mb, y[c]), "w": wa / (wa + wb), "handed": len(taken), "exchange": exchange, "informs": informs()}


def combine(a: np.ndarray, b: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated scores of both views, and both together."""
    if "constant" in model:
        c = np.full(len(a), model["constant"])
        return c, c, c
    p = np.clip(model["ia"](model["a"].margin(a)), 0.005, 0.995)
    q = np.clip(model["ib"](model["b"].margin(b)), 0.005, 0.995)
    return p, q, 1 / (1 + np.exp(-(model["w"] * np.log(p / (1 - p)) + (1 - model["w"]) * np.log(q / (1 - q)))))


def score(table: DataFrame, model: dict) -> DataFrame:
    """(id, text_score, meta_score, score, keep, text_informs, meta_informs) of every row of features."""
    held = table.sparkSession.sparkContext.broadcast(model)
    out = _mapped(table, ["id"], lambda a, b: combine(a, b, held.value), "text_score double, meta_score double, score double")
    text, meta = model.get("informs", (False, False))
    return out.withColumns({"keep": F.col("score") >= 0.5, "text_informs": F.lit(bool(text)), "meta_informs": F.lit(bool(meta))})


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", **options) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep, text_informs, meta_informs) of every document: features, co-training and scores."""
    store = Store(docs.sparkSession)
    table = featured(docs, store, doc_id)
    return score(table, train(table, labels, store, doc_id=doc_id, label=label, **options)).withColumnRenamed("id", doc_id)
