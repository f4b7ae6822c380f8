"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a word boundary. N-grams of 1 to 4 characters of the words with their
boundaries are hashed to `dims` counters. Training sums counters by language in each task, then over tasks; the log
probabilities (languages by counters) are stored and broadcast a block of about BLOCK languages at a time, blocks dealt by a
hash of the name. Scoring is a gather of that matrix at a slab's n-gram numbers and a sum by text. Each block is a scan that
carries the best language so far and the sum of the posterior over those seen, so any number of languages gives what one
matrix of them all would.

Training rows are a bounded sample: about `max_train` a language, by a hash of id and text. Every text is scored whole.

Defined results: a null text, or one without letters, is `und` with score 0; with nothing to learn from, every text is
`und` with score 0. Rows that repeat, or have null ids, are scored like any other and count in training as often as they
stand there. Ties go to the first language in order of name. A very long text is one slab of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.store import Store
from helixframe.llm.text import annotate, is_kind, mix, slabs, to_codes

DIMS = 1 << 15
ORDERS = (1, 2, 3, 4)
MAX_TRAIN = 20_000
#: Languages broadcast at once, on average: this many of DIMS floats are 67 MB.
BLOCK = 512
UNDETERMINED = "und"


class Grams:
    """N-grams of a slab of texts, one order after another."""

    def __init__(self, texts: list[str | None]):
        codes, bounds = to_codes([(t or "").lower() for t in texts])
        letter = is_kind(codes, "letter")
        # A boundary is one symbol however long: drop non-letters that follow a non-letter inside a text.
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[bounds[:-1]] = True
        where = np.concatenate(([0], np.cumsum(keep)))
        letter, self.bounds = letter[keep], where[bounds]
        self.symbols = np.where(letter, codes[keep].astype(np.uint64) + np.uint64(2), np.uint64(1))
        self.letters = np.diff(np.concatenate(([0], np.cumsum(letter)))[self.bounds])
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.bounds))

    def orders(self, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(counter number at each place, text of each place) of the places whose n-gram lies within one text."""
        h = np.zeros(len(self.symbols), np.uint64)
        for k in range(min(max(ORDERS), len(self.symbols))):
            m = len(self.symbols) - k
            h = h[:m] * np.uint64(0x100000001B3) + self.symbols[k:]
            if k + 1 in ORDERS:
                inside = self.text[:m] == self.text[k:]
                yield (mix(h[inside] + np.uint64(k)) & np.uint64(dims - 1)).astype(np.int32), self.text[:m][inside]


@dataclass
class Model:
    """Log probabilities of each language, stored as (lang, block, p), where blocks are 0 to n_blocks - 1."""

    logs: DataFrame | None
    n_blocks: int

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """(languages in order of name, log probabilities) of each block that holds any."""
        for k in range(self.n_blocks):
            got = {r["lang"]: np.array(r["p"], np.float32) for r in self.logs.filter(F.col("block") == k).collect()}
            if got:
                yield sorted(got), np.stack([got[g] for g in sorted(got)])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", dims: int = DIMS, max_train: int = MAX_TRAIN) -> Model:
    """`labelled` holds the rows one may learn from; null languages are left out."""
    store = Store(labelled.sparkSession)
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = store.put(rows.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    n_blocks = -(-sizes.count() // BLOCK)
    if not n_blocks:
        return Model(None, 0)
    draw = F.pmod(F.xxhash64("id", "text", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(sizes, "lang").filter(draw < F.least(F.lit(1.0), F.lit(float(max_train)) / F.col("n"))).select("text", "lang")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, names = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for i, j in slabs(texts):
                grams = Grams(texts[i:j])
                own, code = np.unique(np.array(names[i:j], dtype=object), return_inverse=True)
                for number, doc in grams.orders(dims):
                    c = np.bincount(code[doc] * dims + number, minlength=len(own) * dims).reshape(len(own), dims)
                    for k, v in zip(own, c):
                        total[k] = total.get(k, 0) + v
        for k, v in total.items():
            nz = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(nz), pa.string()), pa.array(nz.astype(np.int32)), pa.array(v[nz].astype(np.int64))], names=["lang", "g", "n"])

    def logs(t: pa.Table) -> pa.Table:
        counts, g = np.zeros(dims), t.column("g").to_numpy()
        counts[g[g >= 0]] = t.column("n").to_numpy()[g >= 0]
        p = np.log((counts + 0.5) / (counts.sum() + 0.5 * dims)).astype(np.float32)
        return pa.table({"lang": t.column("lang").slice(0, 1), "p": pa.array([p], pa.list_(pa.float32()))})

    drawn = sample.mapInArrow(count, "lang string, g int, n bigint")
    every = sizes.select("lang", F.lit(-1).alias("g"), F.lit(0).cast("bigint").alias("n"))  # a language of which no row was drawn has even chances
    sums = drawn.unionByName(every).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    block = F.pmod(F.xxhash64("lang"), F.lit(n_blocks)).cast("int").alias("block")
    return Model(store.put(sums.groupBy("lang").applyInArrow(logs, "lang string, p array<float>").select("lang", block, "p"), "languages"), n_blocks)


def predict_batch(texts: list[str | None], langs: list[str], log_p: np.ndarray) -> list[tuple[str, float, float, float]]:
    """Of each text: the best of these languages, its log probability, the weight of the evidence, and the sum of the tempered
    posterior of these languages over that of the best."""
    out: list[tuple[str, float, float, float]] = []
    for i, j in slabs([t or "" for t in texts]):
        grams = Grams(texts[i:j])
        total, size = np.zeros((len(langs), j - i)), np.zeros(j - i)
        for number, doc in grams.orders(log_p.shape[1]):
            size += np.bincount(doc, minlength=j - i)
            for k, row in enumerate(log_p):
                total[k] += np.bincount(doc, row[number], j - i)
        best, top = total.argmax(axis=0), total.max(axis=0)
        # Tempered posterior: neighbouring n-grams overlap, so evidence counts as that of a quarter of them, 400 at most.
        weight = np.minimum(1 / len(ORDERS), 400 / np.maximum(size, 1))
        rest = np.exp((total - top) * weight).sum(axis=0)
        names = [langs[b] if n else UNDETERMINED for b, n in zip(best, grams.letters)]
        out += zip(names, top.tolist(), weight.tolist(), rest.tolist())
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`row`, lang_pred, score."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    store, seen = Store(docs.sparkSession), None
    state = "name string, top double, weight double, rest double"
    for block in model.blocks():
        held = docs.sparkSession.sparkContext.broadcast(block)

        def f(texts: list, held=held) -> list[pa.Array]:
            got = predict_batch(texts, *held.value)
            return [pa.array([x[c] for x in got], pa.string() if c == 0 else pa.float64()) for c in range(4)]

        if seen is None:
            seen = annotate(docs, [text], f, state)
            continue
        before = store.put(seen, "block")  # so that a worker holds one block only
        given = before.withColumn("in", F.col(f"row.`{text}`"))
        both = annotate(given, ["in"], f, state)
        old = lambda c: F.col(f"row.{c}")
        top = F.greatest(old("top"), "top")
        ahead = (F.col("top") > old("top")) | ((F.col("top") == old("top")) & (F.col("name") < old("name")))
        rest = old("rest") * F.exp((old("top") - top) * F.col("weight")) + F.col("rest") * F.exp((F.col("top") - top) * F.col("weight"))
        seen = both.select(old("row").alias("row"), F.when(ahead, F.col("name")).otherwise(old("name")).alias("name"), top.alias("top"), "weight", rest.alias("rest"))
    if seen is None:
        return docs.select(row, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return seen.select("row", F.col("name").alias("lang_pred"), F.when(F.col("name") == UNDETERMINED, 0.0).otherwise(1 / F.col("rest")).alias("score"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls on `part` of `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part
