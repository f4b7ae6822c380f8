"""SimHash near-duplicates found with vantage-point trees.

Fingerprint: 64 bits, each set if over half the XXH64 values (seed 42) of the 3-word shingles have it. Two fingerprints
link at `radius` (3) or fewer differing bits.

Search over distinct fingerprints. Two within the radius differ in at most radius // HALVES = 1 bit in one of the two halves of
32 bits, so each half has a vantage-point tree in Hamming space at that smaller radius r, built from a bounded sample: a node
holds a vantage half p and a distance mu; halves within mu of p lie inside, the others outside, and the leaves are shards.
Every fingerprint lives, in each tree, in the shard its own distances lead to. By the triangle inequality, one that lies
outside can only have neighbours inside if its distance to p is at most mu + r: it is then also sent, as a query, to the inner
side, and so on down, to every shard whose boundary it overlaps. Two halves within r therefore meet in some shard: if either is
inside, the other is at most mu + r away and is sent inside too; if none is, both are outside. All other branches are pruned.
Inside its task a shard goes on as a tree over all 64 bits at the full radius, so work does not grow with the square of a
shard, and the leaves are compared exactly.

The sample (MAX_SAMPLE distinct fingerprints) shapes the shards and not the result. Of random halves about 0.14
are sent across a boundary, so copies grow as the number of shards to the power 0.2 (one tree over all 64 bits sends 0.27, power
0.35; measured with it: 2.8 copies of 46 k fingerprints, 7.6 of 228 k). A cut that would send too many rows both ways is not
made: 15,294 fingerprints around one centre have 3.5 copies (15.5 without that bound). Fingerprints that no vantage point parts (a dense ball of near copies) are compared in blocks of bounded memory.

Links inside a shard are reduced to a union-find there, so a group of any size leaves one link a member, not all pairs.

Defined results: null and empty texts have fingerprint zero and link to each other and to what is within the radius. Rows of
one fingerprint are one component whatever their ids; a null id is never the smallest unless all are null, and then
component_id is null. Repeated rows and ties change nothing. A very long text is hashed in chunks. An empty table gives an
empty one; other columns are never read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.components import components
from helixframe.llm.rows import keep_rows, row_key
from helixframe.llm.store import Store
from helixframe.llm.text import annotate

RADIUS = 3
HALVES = 2
SHINGLE = 3
SEED = 42
MAX_SAMPLE = 200_000
#: Fingerprints a shard should hold, and the largest set compared without another cut.
SHARD_ROWS = 8_192
LEAF_ROWS = 1_024
#: Rows of both sides of a cut between shards, times those before it. Inside a task a copy costs little, so up to IN_TASK.
SPREAD, IN_TASK = 1.3, 2.0
_CHUNK = 100_000


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    s, e = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(s), _CHUNK):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(s[i : i + _CHUNK], e[i : i + _CHUNK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(s)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row` and fp, the fingerprint as a signed long."""

    def f(texts: list) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))]

    return annotate(docs, [text], f, "fp bigint")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def cut(x: np.ndarray, radius: int, most: float = SPREAD) -> tuple[np.uint64, int] | None:
    """The vantage point and distance, of a few, with the least work left (squares of both sides, with what overlaps).

    None if both sides together would have over `most` times the rows, or little work is saved."""
    best = None
    for p in x[np.linspace(0, len(x) - 1, 16).astype(int)]:
        n = np.cumsum(np.bincount(distance(x, p), minlength=65 + radius)).astype(float)
        inner, outer = n[radius : 65 + radius], len(x) - n[:65]
        work = np.where(inner + outer > most * len(x), np.inf, inner**2 + outer**2)
        mu = int(work.argmin())
        if best is None or work[mu] < best[2]:
            best = (p, mu, work[mu])
    return best[:2] if best and best[2] < 0.9 * len(x) ** 2 else None


def sides(x: np.ndarray, p: np.uint64, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprints go inside (their own place, or as queries across the boundary) and which outside."""
    d = distance(x, p)
    return d <= mu + radius, d > mu


class Tree:
    """Vantage-point tree over the bits of a mask, whose leaves are numbered shards."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int, mask: int = 2**64 - 1):
        self.radius, self.mask = radius, np.uint64(mask)
        self.nodes: list[tuple[np.uint64, int, int, int] | None] = []  # vantage, distance, inner, outer; ~shard for a leaf
        self.shards = 0
        self.root = self._build(sample & self.mask, max(1, leaf))

    def _build(self, x: np.ndarray, leaf: int) -> int:
        found = cut(x, self.radius) if len(x) > leaf else None
        if found is None:
            self.shards += 1
            return ~(self.shards - 1)
        p, mu = found
        node = len(self.nodes)
        self.nodes.append(None)
        inner, outer = sides(x, p, mu, self.radius)  # with the overlap, since a shard holds its visitors too
        self.nodes[node] = (p, mu, self._build(x[inner], leaf), self._build(x[outer], leaf))
        return node

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home) of every shard a fingerprint is sent to; home is the one it lives in."""
        x = x & self.mask
        rows, shards, homes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
        stack = [(self.root, np.arange(len(x)), np.ones(len(x), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                shards.append(np.full(len(at), ~node, np.int32))
                homes.append(home)
                continue
            p, mu, inner, outer = self.nodes[node]
            near, far = sides(x[at], p, mu, self.radius)
            stack.append((inner, at[near], home[near] & ~far[near]))
            stack.append((outer, at[far], home[far]))
        return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def shard_links(x: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that join all distinct values of x within the radius, transitively."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [np.unique(x)]
    while stack:
        part = stack.pop()
        split = cut(part, radius, IN_TASK) if len(part) > LEAF_ROWS else None
        if split is not None:
            inner, outer = sides(part, *split, radius)
            stack += [part[inner], part[outer]]
            continue
        label = np.arange(len(part))
        for i in range(0, len(part), 128):
            near = distance(part[i : i + 128, None], part[None, i:]) <= radius
            for r in np.flatnonzero(near.sum(axis=1) > 1):
                own = np.unique(label[i:][near[r]])
                if len(own) > 1:
                    label[np.isin(label, own[1:])] = own[0]
        moved = np.flatnonzero(label != np.arange(len(part)))
        if len(moved):
            found.append((part[moved], part[label[moved]]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def half_masks(halves: int = HALVES) -> list[int]:
    edges = [round(64 * i / halves) for i in range(halves + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def build_trees(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> list[Tree]:
    """A tree for each half over a bounded sample of `distinct` (one column, fp), drawn by a hash."""
    n = distinct.count()
    rate = min(1.0, MAX_SAMPLE / max(n, 1))
    drawn = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1)
    sample = np.sort(drawn.toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
    return [Tree(sample, int(len(sample) * shard_rows / max(n, 1)), radius // HALVES, m) for m in half_masks()]


def links(distinct: DataFrame, *, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): enough pairs of fingerprints within the radius to join every group. `distinct` has one column, fp."""
    trees = build_trees(distinct, radius, shard_rows)
    held = distinct.sparkSession.sparkContext.broadcast(trees)
    first = np.cumsum([0] + [t.shards for t in trees])

    def route(batches):
        for batch in batches:
            x = np.asarray(batch.column(0)).view(np.uint64)
            for tree, at in zip(held.value, first):
                rows, shard, _ = tree.route(x)
                yield pa.RecordBatch.from_arrays([pa.array((shard + at).astype(np.int32)), pa.array(x[rows].view(np.int64))], names=["shard", "fp"])

    def search(table: pa.Table) -> pa.Table:
        a, b = shard_links(table.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    sent = distinct.select("fp").mapInArrow(route, "shard int, fp bigint")
    return sent.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each document."""
    store = Store(docs.sparkSession)
    marked = store.put(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("row.doc_id", "fp"), "fingerprints")
    distinct = store.put(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    joined = components(links(distinct.select("fp"), radius=radius, shard_rows=shard_rows), store)
    classes = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = classes.join(lowest, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents, the same columns: of each component the row with the smallest id stays (null ids last, then by row key)."""
    store = Store(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.col(text).alias("text"))
    marked = store.put(fingerprints(keyed, "text").select("row.doc_id", "row.k1", "row.k2", "fp"), "fingerprints")
    distinct = store.put(marked.select("fp").distinct(), "distinct")
    joined = components(links(distinct, **options), store)
    classes = marked.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")
    keep = store.put(classes.groupBy("component").agg(F.min(order).alias("m")).select("m.k1", "m.k2"), "keep")
    return keep_rows(docs, keep, doc_id, text)
