"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

Words are runs of a-z, 0-9 and code points past ASCII, after A-Z are lower-cased. The automaton knows every run of words
of every item. Documents are streamed through it a word at a time; it keeps the length of the longest run ending there
that some item holds. A length of `window` or more marks the last `window` words; items shorter than the window count as
one window of their own length.

Memory is bounded by one automaton: items are dealt into shards of at most `shard_words` words (or one item). A benchmark of one
shard, the usual case, is one scan without a shuffle. With more, shards are taken one after another: each is broadcast, the
documents are scanned, the hits (no texts) are stored and the broadcast is dropped; then hits are joined to the documents.
Both ways give the same rows.

Nulls: a null text has no words, is never contaminated and stays as it is; an empty or null item has no window, and an empty
benchmark or table hits nothing. Rows that repeat are scored alike; a null item_id counts as the empty string, items that
share an id count once. A very long text is streamed like any other. Other columns, whatever their names, pass through in `row`.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.rows import packed, row_key
from helixframe.llm.store import Store
from helixframe.llm.text import annotate

WINDOW = 13
#: A document is contaminated when this many times its hit words reach its words.
COVERAGE = 20
SHARD_WORDS = 500_000

_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Builder:
    """A suffix automaton under construction: transitions in dicts, dropped once it is laid out flat."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy


class Automaton:
    """Generalised suffix automaton over word numbers, in flat arrays: some 100 bytes for each word of the items.

    Transitions are sorted by state and word and found by bisection. `own` holds the windows of items, by the state that
    stands for them; `near` leads from a state to the closest of its suffixes (itself included) that has any.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.shortest = window
        built, known = _Builder(), set()
        for _, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            self.shortest = min(self.shortest, len(ids)) if ids else self.shortest
            known.update(a << 32 | b for a, b in zip(ids, ids[1:]))
            last = 0
            for w in ids:
                last = built.extend(last, w)
        #: Pairs of neighbouring words that items hold, sorted.
        self.pairs = np.array(sorted(known), dtype=np.int64)
        count = sum(map(len, built.next))
        keys = np.fromiter((s << 32 | w for s, t in enumerate(built.next) for w in t), np.int64, count)
        to = np.fromiter((v for t in built.next for v in t.values()), np.int32, count)
        order = keys.argsort()
        self.keys, self.to = array("q", keys[order].tobytes()), array("i", to[order].tobytes())
        self.link, self.length = array("i", built.link), array("i", built.length)
        del built
        found: dict[tuple[int, int, int], None] = {}
        for number, (_, words) in enumerate(items):
            need = min(window, len(words))
            state = length = 0
            for w in words:
                state, length = self.step(state, length, self.vocabulary[w])
                if length >= need > 0:
                    found[self._ancestor(state, need), need, number] = None
        flat = np.array(sorted(found), np.int32).reshape(-1, 3)
        self.first = array("i", np.searchsorted(flat[:, 0], np.arange(len(self.link) + 1)).astype(np.int32).tobytes())
        self.need, self.number = array("i", flat[:, 1].tobytes()), array("i", flat[:, 2].tobytes())
        self.names = [name for name, _ in items]
        self.near = array("i", bytes(4 * len(self.link)))
        for state in np.argsort(np.array(self.length), kind="stable").tolist()[1:]:
            self.near[state] = state if self.first[state] < self.first[state + 1] else self.near[self.link[state]]

    def _ancestor(self, state: int, need: int) -> int:
        while self.length[self.link[state]] >= need if state else False:
            state = self.link[state]
        return state

    def target(self, state: int, w: int) -> int:
        """The state after word w; -1 if no item goes on so."""
        key = state << 32 | w
        at = bisect_left(self.keys, key)
        return self.to[at] if at < len(self.keys) and self.keys[at] == key else -1

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        to = self.target(state, w) if w >= 0 else -1
        while to < 0 and state and w >= 0:
            state = self.link[state]
            length = self.length[state]
            to = self.target(state, w)
        return (to, length + 1) if to >= 0 else (0, 0)

    def stream(self, ids: list[int], at: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) of words from place `at`, and items with an occurring window."""
        state = length = 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for k, w in enumerate(ids):
            state, length = self.step(state, length, w)
            own = self.near[state]
            while own:
                for i in range(self.first[own], self.first[own + 1]):
                    need = self.need[i]
                    if length < need:
                        continue
                    items.add(self.number[i])
                    start, end = at + k + 1 - need, at + k + 1
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((start, end))
                own = self.near[self.link[own]]
        return spans, items

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """As stream over a whole text. Only runs of words whose neighbours also stand side by side in an item can hold a
        window, so the rest is passed over; the automaton decides in every run that is long enough."""
        ids = np.fromiter(map(self.vocabulary.get, words, _MINUS), dtype=np.int64, count=len(words))
        if not len(ids) or not self.names:
            return [], set()
        inside = ids >= 0
        if self.shortest > 1:
            key = ids[:-1] << 32 | ids[1:]
            both = inside[:-1] & inside[1:]
            ok = np.zeros(len(key), bool)
            some = np.flatnonzero(both)
            if not len(some):
                return [], set()
            where = np.searchsorted(self.pairs, key[some])
            ok[some] = self.pairs[np.minimum(where, len(self.pairs) - 1)] == key[some] if len(self.pairs) else False
            edge = np.diff(np.concatenate(([0], ok.view(np.int8), [0])))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        else:
            edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = ends - starts >= self.shortest
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
            a, b = self.stream(ids[s:e].tolist(), s)
            spans += a
            items |= b
        return spans, items


class _Minus:
    """-1 without end: the default for words outside the vocabulary."""

    def __iter__(self):
        return self

    def __next__(self):
        return -1


_MINUS = _Minus()


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def item_shards(benchmark: DataFrame, item: str, text: str, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in shards of bounded size, read one partition at a time. An item with no words has no window."""
    shard: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(r["t"])
        if size and size + len(words) > shard_words:
            yield shard
            shard, size = [], 0
        if words:
            shard.append((r["i"], words))
            size += len(words)
    if shard:
        yield shard


_SCANNED = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(docs: DataFrame, held, text: str) -> DataFrame:
    """`row`, n_words, spans and items, by one broadcast automaton."""

    def scan(texts: list) -> list[pa.Array]:
        n_words, spans, items = [], [], []
        for t in texts:
            words = words_of(t)
            found, numbers = held.value.scan(words)
            n_words.append(len(words))
            spans.append([{"start": s, "end": e} for s, e in union(found)])
            items.append(sorted({held.value.names[k] for k in numbers}))
        return [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]

    return annotate(docs, [text], scan, _SCANNED)


def scan_documents(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`row` (the document), n_words, spans (hit word ranges) and items (ids with occurring windows)."""
    sc = docs.sparkSession.sparkContext
    shards = item_shards(benchmark, item, item_text, shard_words)
    first, second = next(shards, []), next(shards, None)
    if second is None:
        return _scan(docs, sc.broadcast(Automaton(first, window)), text)
    store = Store(docs.sparkSession)
    keyed = docs.select(*row_key(doc_id, text), F.col(text).alias("text"))
    hits = []
    for shard in chain([first, second], shards):
        held = sc.broadcast(Automaton(shard, window))
        hits.append(store.put(_scan(keyed, held, "text").filter(F.size("items") > 0).select("row.k1", "row.k2", "spans", "items"), "hits"))
        held.destroy()
    flat = lambda c: F.flatten(F.collect_set(c)).alias(c)
    merged = reduce(DataFrame.unionByName, hits).groupBy("k1", "k2").agg(flat("spans"), flat("items"))
    joined = packed(docs, doc_id, text).join(merged, ["k1", "k2"], "left")
    none = F.array()
    counted = joined.select("row", n_words(F.col(f"row.`{text}`")).alias("n_words"), F.coalesce("spans", none.cast(_SCANNED.split(", ")[1].split(" ", 1)[1])).alias("spans"), F.array_sort(F.array_distinct(F.coalesce("items", none.cast("array<string>")))).alias("items"))

    def merge(spans: list) -> list[pa.Array]:
        return [pa.array([[{"start": s, "end": e} for s, e in union([(x["start"], x["end"]) for x in p])] for p in spans], _SPANS)]

    out = annotate(counted, ["spans"], merge, "merged array<struct<start:int,end:int>>")
    return out.select(F.col("row.row").alias("row"), F.col("row.n_words").alias("n_words"), F.col("merged").alias("spans"), F.col("row.items").alias("items"))


def n_words(text: Column) -> Column:
    """How many words words_of finds."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("bigint")


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))
    return scanned.select(F.col(f"row.{doc_id}").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words")))


def clean_documents(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Documents of the same columns: contaminated ones go, hit spans leave the others."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))
    kept = scanned.filter(~((hit > 0) & (COVERAGE * hit >= F.col("n_words"))))

    def cut(texts: list, spans: list) -> list[pa.Array]:
        return [pa.array([remove_spans(t, [(s["start"], s["end"]) for s in p]) if p else t for t, p in zip(texts, spans)], pa.string())]

    fields = kept.schema["row"].dataType.names
    out = annotate(kept.select(F.col("row"), F.col(f"row.{text}").alias("_t"), "spans"), ["_t", "spans"], cut, "cleaned string")
    return out.select(*[F.col("cleaned").alias(c) if c == text else F.col(f"row.row.`{c}`").alias(c) for c in fields])


def sha_items(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


#: The contract's result in SQL.
SQL = """
with w as (select doc_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id::varchar as item_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(13, len(w)) as k, unnest(list_transform(range(1, greatest(len(w)-12, 1)+1), lambda i: array_to_string(w[i:i+least(13,len(w))-1], ' '))) as g from b where len(w) > 0),
ks as (select distinct k from bw),
dw as (select doc_id, k, unnest(range(1, len(w)-k+2)) as i, unnest(list_transform(range(1, len(w)-k+2), lambda i: array_to_string(w[i:i+k-1], ' '))) as g from w, ks where len(w) >= k),
hits as (select doc_id, i, dw.k, item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
places as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i+k)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct doc_id, item_id from hits) group by doc_id)
select w.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20*coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
from w left join places using (doc_id) left join its using (doc_id)
"""
