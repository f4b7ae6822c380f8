"""Substring deduplication by sliding sentence spans.

Sentences end at . ! ? or a line break. Every run of SENTENCES sentences or more counts, however short they are; so does one of
LONG_WORDS words in fewer (None: it does not). A caller may ask for MIN_WORDS words in a run besides. Spans are the shortest such
runs from every sentence on and up to every sentence; each longer run is covered by them, and repeats where they do. Spans are hashed (128 bits, over lower-cased words), and a span that occurs
more than once anywhere repeats. Every sentence that lies in an occurrence other than the first one goes.

First: smallest doc_id, null ids last, then row key and place. Null and empty texts have no sentences and stay. Rows
equal in id and text are treated alike; a text may become empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.rows import packed, row_key
from helixframe.llm.store import Store
from helixframe.llm.text import annotate

SENTENCES = 3
MIN_WORDS = 0
LONG_WORDS = 40
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Character ranges of sentences that hold a word."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if not m.group().isspace()]


def spans(text: str | None, least: int = SENTENCES, min_words: int = MIN_WORDS, long_words: int | None = LONG_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, one past the last, 128-bit digest)."""
    words = [text[a:b].lower().split() for a, b in sentences(text)]
    digest = [xxhash.xxh3_64_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words]
    total = np.concatenate(([0], np.cumsum([len(w) for w in words]))).tolist()
    n = len(words)
    enough = lambda i, e: (e - i >= least and total[e] - total[i] >= min_words) or (long_words is not None and total[e] - total[i] >= long_words)
    forward = []  # shortest run from each sentence, as far as there is one
    j = 0
    for i in range(n):
        j = max(j, i + 1)
        while j < n and not enough(i, j):
            j += 1
        if not enough(i, j):
            break
        forward.append(j)
    i = 0
    for e in range(1, n + 1):  # shortest run up to each sentence; one from i = e on would be empty
        while i + 1 < e and enough(i + 1, e):
            i += 1
        if enough(i, e) and forward[i] != e:
            yield i, e, xxhash.xxh3_128_digest(b"".join(digest[i:e]))
    for i, j in enumerate(forward):
        yield i, j, xxhash.xxh3_128_digest(b"".join(digest[i:j]))


def repeated_spans(docs: DataFrame, store: Store, *, doc_id: str = "doc_id", text: str = "text", **bounds: int | None) -> DataFrame:
    """(k1, k2, spans): sentence ranges of each row that are non-first occurrences. `bounds`: of a run, see `spans`."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.col(text).alias("text"))
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("row", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end, raw = [], [], [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                for s, e, d in spans(t, **bounds):
                    row.append(i)
                    start.append(s)
                    end.append(e)
                    raw.append(d)
            h = np.frombuffer(b"".join(raw), ">i8").astype(np.int64).reshape(-1, 2)
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *[b.column(c).take(take) for c in range(3)], pa.array(start, schema.field("start").type), pa.array(end, schema.field("end").type)], names=["h1", "h2", "doc_id", "k1", "k2", "start", "end"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    found = store.put(keyed.mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {kind}, k1 bigint, k2 bigint, start int, end int"), "spans")  # texts are parsed once
    # Written first, so that both sides of the join are plain exchanges, whose hot keys Spark can split.
    many = store.put(found.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "many")
    repeated = store.put(found.join(many, ["h1", "h2"]).withColumn("z", F.col("doc_id").isNull()), "repeated")
    first = repeated.groupBy("h1", "h2").agg(F.min(F.struct("z", "doc_id", "k1", "k2", "start")).alias("f"))
    first = store.put(first.select("h1", "h2", F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2"), F.col("f.start").alias("fs")), "first")
    later = repeated.join(first, ["h1", "h2"]).filter((F.col("k1") != F.col("f1")) | (F.col("k2") != F.col("f2")) | (F.col("start") != F.col("fs")))
    return store.put(later.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "removed")


def remove(text: str | None, gone: list | None) -> tuple[str | None, int, int]:
    """(text without the sentences of the spans, sentences, removed)."""
    own = sentences(text)
    if not gone:
        return text, len(own), 0
    mark = np.zeros(len(own) + 1, np.int64)
    for s in gone:
        mark[s["start"]] += 1
        mark[s["end"]] -= 1
    hit = np.cumsum(mark)[:-1] > 0
    out, at = [], 0
    for (a, b), h in zip(own, hit.tolist()):
        if h:
            out.append(text[at:a])
            at = b
    out.append(text[at:])
    return "".join(out).strip(), len(own), int(hit.sum())


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **bounds: int | None) -> DataFrame:
    """`row` (the document), deduplicated, n_sentences, n_removed. `bounds`: least, min_words, long_words of a run, see `spans`."""
    store = Store(docs.sparkSession)
    gone = repeated_spans(docs, store, doc_id=doc_id, text=text, **bounds)
    joined = packed(docs, doc_id, text).join(gone, ["k1", "k2"], "left").select("row", F.col(f"row.{text}").alias("t"), "spans")

    def f(texts: list, removed: list) -> list[pa.Array]:
        got = [remove(t, r) for t, r in zip(texts, removed)]
        return [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int32()), pa.array([x[2] for x in got], pa.int32())]

    out = annotate(joined, ["t", "spans"], f, "deduplicated string, n_sentences int, n_removed int")
    return out.select(F.col("row.row").alias("row"), "deduplicated", "n_sentences", "n_removed")
