"""Mixing sources to target weights: iterative proportional fitting over (source, language, topic) cells.

Tokens are summed by cell; cell weights are then scaled in turn to the target marginals of source, language and topic
until all three hold. A document's probability is min(1, c * weight / tokens of its cell), with c such that the expected
tokens are the budget; the draw is a hash of the row, so a rerun picks the same documents.

Fitting works on the table of cells. While that table is small (MAX_CELLS rows and MAX_NAME_BYTES of names, both counted
first) it is fitted on the driver and broadcast; beyond, fitting is aggregates and joins with every sweep written to the
store, and documents are joined with their cell by plain exchanges, whose hot keys Spark can split. Both ways do the same
sums: sweeps go on until every marginal is met within TOLERANCE or no longer comes closer, and c is solved exactly, by
setting aside cells that reach probability 1 until no more do.

A target is a table of weights by value, or "equal" (every value that has tokens weighs the same), or None (tokens **
temper). Weights are scaled to sum to 1 over the values that have tokens, so a value without a target gets none and a
target without tokens is left out. When marginals conflict on empty cells no weights meet them all; `residual` then says
by how much the worst marginal share is off.

Topic is any column expression; the default sorts texts by form. Null source or language count as the empty string.
Empty and null texts have 0 tokens; they weigh nothing but belong to a cell and share its probability, or, in a cell
without tokens, the budget's share. Rows equal in id and text are drawn alike, ties have no meaning, very long texts only
count more, and an empty table gives an empty one. Other columns, whatever their names, pass through in `row`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.rows import row_key
from helixframe.llm.store import Store

DIMS = ("source", "lang", "topic")
TEMPER = 0.7
BUDGET = 0.5
TOLERANCE = 1e-9
MAX_CELLS = 200_000
MAX_NAME_BYTES = 16 << 20
#: Sweeps without progress after which marginals are taken to conflict.
STALLED = 20


def form_topic(text: Column) -> Column:
    """table, symbolic, numeric, or short, article, long prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    bars = n - F.length(F.replace(t, F.lit("|"), F.lit("")))
    symbols = n - F.length(F.translate(t, "#$%&*@^~<>{}[]=+_", ""))
    digits = n - F.length(F.translate(t, "0123456789", ""))
    return (
        F.when(bars * 50 > n, "table").when(symbols * 50 > n, "symbolic").when(digits * 50 > n, "numeric")
        .when(n < 1000, "short").when(n < 20000, "article").otherwise("long")
    )


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def cells_of(docs: DataFrame, source: str, lang: str, text: str, topic: Column | None) -> list[Column]:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [name(source).alias("source"), name(lang).alias("lang"), (form_topic(F.col(text)) if topic is None else topic).alias("topic")]


class _Progress:
    """Whether sweeps should go on: not once the gap is closed, nor when it has not shrunk by a tenth for STALLED sweeps."""

    def __init__(self):
        self.best, self.since, self.gap = np.inf, 0, np.inf

    def more(self, gap: float) -> bool:
        self.gap = gap
        self.since = 0 if gap < 0.9 * self.best else self.since + 1
        self.best = min(self.best, gap) if self.since == 0 else self.best
        return gap >= TOLERANCE and self.since < STALLED


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Cell weights that sum to 1 and meet the target shares of each dimension, and how far the worst share is off."""
    w, progress = tokens / tokens.sum(), _Progress()
    while True:
        gap = 0.0
        for code, target in zip(codes, targets):
            have = np.bincount(code, weights=w, minlength=len(target))
            gap = max(gap, float(np.abs(have - target).max(initial=0)))
            w = w * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code]
        if not progress.more(gap):
            return w, progress.gap


def scale(tokens: np.ndarray, w: np.ndarray, budget: float) -> float:
    """c for which the sum of tokens * min(1, c * w / tokens) is the budget, or infinity if all must be taken."""
    live = (w > 0) & (tokens > 0)
    t, w = tokens[live], w[live]
    if budget >= t.sum():
        return np.inf
    full = np.zeros(len(t), bool)
    while True:
        c = (budget - t[full].sum()) / w[~full].sum()
        more = ~full & (c * w >= t)
        if not more.any():
            return float(c)
        full |= more


def _shares(values: dict[str, float], given: dict[str, float] | str | None, temper: float) -> dict[str, float]:
    raw = {k: 0.0 if v <= 0 else 1.0 if given == "equal" else v**temper if given is None else float(given.get(k, 0.0)) for k, v in values.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def _small(cells: DataFrame, max_cells: int) -> bool:
    n = cells.agg(F.count("*"), F.coalesce(F.sum(sum(F.octet_length(d) for d in DIMS)), F.lit(0))).first()
    return n[0] <= max_cells and n[1] <= MAX_NAME_BYTES


def cell_rates(cells: DataFrame, store: Store, targets: dict, budget: float, temper: float, small: bool) -> DataFrame:
    """(source, lang, topic, weight, probability, residual) from (source, lang, topic, tokens)."""
    if not small:
        return _distributed(cells, store, targets, budget, temper)
    rows = cells.orderBy(*DIMS).collect()
    tokens = np.array([float(r["tokens"]) for r in rows])
    w, residual = np.zeros(len(rows)), 0.0
    if tokens.sum():
        codes, wanted = [], []
        for d in DIMS:
            names, code = np.unique([r[d] for r in rows], return_inverse=True)
            share = _shares(dict(zip(names.tolist(), np.bincount(code, weights=tokens).tolist())), targets.get(d), temper)
            codes.append(code)
            wanted.append(np.array([share[k] for k in names.tolist()]))
        w, residual = rake(tokens, codes, wanted)
    c = scale(tokens, w, budget * tokens.sum())
    p = [min(1.0, c * a / t) if t and a else 0.0 if t else min(1.0, budget) for a, t in zip(w, tokens)]
    schema = "source string, lang string, topic string, weight double, probability double, residual double"
    return cells.sparkSession.createDataFrame([(*(r[d] for d in DIMS), float(a), float(b), residual) for r, a, b in zip(rows, w, p)], schema)


def _distributed(cells: DataFrame, store: Store, targets: dict, budget: float, temper: float) -> DataFrame:
    """The same fit as aggregates and joins: for more cells than the driver may hold."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    work = store.put(cells.withColumn("weight", F.col("tokens") / F.lit(total) if total else F.lit(0.0)), "weights")
    shares = {}
    for d in DIMS:
        sums, given = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("t")), targets.get(d)
        if isinstance(given, dict):
            raw = sums.join(spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{d} string, s double"), d, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        else:
            raw = sums.withColumn("s", F.lit(1.0) if given == "equal" else F.pow("t", temper))
        raw = raw.select(d, F.when(F.col("t") > 0, F.col("s")).otherwise(0.0).alias("s"))
        shares[d] = store.put(raw.select(d, (F.col("s") / F.lit(raw.agg(F.sum("s")).first()[0] or 1.0)).alias("target")), "target")
    progress = _Progress()
    more = total > 0
    while more:
        gap = 0.0
        for d in DIMS:
            have = work.groupBy(d).agg(F.sum("weight").alias("have")).join(shares[d], d)
            have = store.put(have.select(d, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0).alias("f"), F.abs(F.col("have") - F.col("target")).alias("off")), "have")
            gap = max(gap, have.agg(F.max("off")).first()[0])
            after = store.put(work.join(have, d).select(*DIMS, "tokens", (F.col("weight") * F.col("f")).alias("weight")), "weights")
            for old in (work, have):
                store.drop(old)
            work = after
        more = progress.more(gap)
    t, w = F.col("tokens").cast("double"), F.col("weight")
    live = work.filter((w > 0) & (t > 0))
    goal, c = budget * total, 0.0
    if total and goal >= (live.agg(F.sum(t)).first()[0] or 0.0):
        c = np.inf
    while total and c < np.inf:  # c only grows, and with it the set of cells at probability 1
        full = F.lit(c) * w >= t
        got = live.agg(F.coalesce(F.sum(F.when(full, t)), F.lit(0.0)), F.sum(F.when(~full, w))).first()
        after = (goal - got[0]) / got[1]
        if after <= c:
            break
        c = after
    p = F.when((t > 0) & (w > 0), F.least(F.lit(1.0), F.lit(float(c)) * w / t)).when(t > 0, 0.0).otherwise(min(1.0, budget))
    return work.select(*DIMS, "weight", p.alias("probability"), F.lit(float(progress.gap) if total else 0.0).alias("residual"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, targets: dict | None = None,
        budget: float = BUDGET, temper: float = TEMPER, seed: int = 2, max_cells: int = MAX_CELLS) -> DataFrame:
    """`row`, source, lang, topic, n_tokens, weight (of the cell), probability, residual, selected. Texts are never shuffled
    while the table of cells is small."""
    store = Store(docs.sparkSession)
    dims = cells_of(docs, source, lang, text, topic)
    cells = store.put(docs.select(*dims, token_count(F.col(text)).alias("n")).groupBy(*DIMS).agg(F.sum("n").alias("tokens")), "cells")
    small = _small(cells, max_cells)
    rates = cell_rates(cells, store, targets or {}, budget, temper, small)
    rates = F.broadcast(rates) if small else store.put(rates, "rates")
    k1, k2 = row_key(doc_id, text)
    draw = F.shiftrightunsigned(F.xxhash64(k1, k2, F.lit(seed)), 11) / float(1 << 53)
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *dims, token_count(F.col(text)).alias("n_tokens"), draw.alias("_u"))
    return tagged.join(rates, list(DIMS)).select("row", *DIMS, "n_tokens", "weight", "probability", "residual", (F.col("_u") < F.col("probability")).alias("selected"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """Documents of the same columns, drawn by their probabilities."""
    return mix(docs, **options).filter("selected").select("row.*")
