"""Nearest neighbours by inner product through a permutation index.

Every vector is represented by the order of the pivots nearest to it. The index holds the first PREFIX pivots of each vector.
A search deals index rows and queries onto a grid of cells; a cell keeps its queries and streams its rows past them in
blocks. In a block each pivot has an inverted file, the rows that have it in their prefix and where; a query walks the files
of its own prefix, which adds up the footrule distance to each row; what ranks best is compared on the original vectors.
The best of each cell are merged by a window of k rows for each query and cell.

Inner product becomes nearness of direction by one more component (Bachrach et al. 2014): a vector x of the greatest norm M
or less is (x / M, sqrt(1 - |x / M|^2)), a query (q / |q|, 0). Vectors of equal norm are not changed by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.store import Store

#: Pivots; those of a prefix; rows that pivots are taken from; the greatest cosine of two pivots.
PIVOTS, PREFIX, SAMPLE, APART = 256, 32, 4096, 0.9
#: Rows of a block. Rows reranked in a block, for each neighbour wanted. Footrule similarity, as a share of the greatest
#: possible, from which a row is reranked whatever its rank, so that groups of copies are never cut.
BLOCK, OVERSAMPLE, ALIKE = 4096, 50, 0.4
#: Queries held by a cell, and at a time; most cells for each set of queries.
HELD, CHUNK, CELLS = 32_768, 512, 256


def usable(vector: Column) -> Column:
    """Whether a vector has components, none null or non-finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows as directions of one more component. Scaled before squared, so that no finite component overflows."""
    y = x / most
    return np.c_[y, np.sqrt(np.maximum(1 - (y * y).sum(axis=1), 0))]


def choose_pivots(sample: np.ndarray, most: float, pivots: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Up to `pivots` rows of the sample, none nearly alike to an earlier one; at least one."""
    unit = lifted(sample, most)
    taken = np.zeros((0, unit.shape[1]))
    for u in unit:
        if len(taken) == pivots:
            break
        if not len(taken) or (taken @ u).max() < apart:
            taken = np.r_[taken, u[None]]
    return taken


def prefixes(directions: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first; ties to the lower number."""
    near = directions @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def build(vectors: DataFrame, store: Store, *, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, sample: int = SAMPLE) -> DataFrame | None:
    """The stored index (vec_id, row_key, x, prefix, as_query): every usable vector, with its prefix as an object and as a query.

    None if no vector is usable. Pivots come from about `sample` rows drawn by hash; all rows are indexed. Of vectors of
    several lengths those of the most frequent length (the smaller, if several) take part.
    """
    x = F.col(vector).cast("array<double>")
    rows = vectors.filter(usable(x) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("bigint").alias("vec_id"), x.alias("x")).distinct()
    rows = store.put(rows.withColumn("row_key", F.xxhash64("vec_id", "x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).alias("norm"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest"))
    best = lengths.orderBy(F.col("rows").desc(), "n").first()
    if best is None:
        return None
    # The norm itself can overflow; then the largest component bounds it.
    most = best["norm"] if np.isfinite(best["norm"]) and best["norm"] > 0 else best["largest"] * best["n"] ** 0.5
    rows = rows.filter(F.size("x") == best["n"])
    share = min(1.0, sample / best["rows"])
    drawn = rows.filter(F.pmod("row_key", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("row_key").select("x").limit(2 * sample).toArrow()
    chosen = choose_pivots(_matrix(drawn["x"].combine_chunks()), most, pivots)
    held = rows.sparkSession.sparkContext.broadcast(chosen)  # at most `pivots` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                v = _matrix(part["x"])
                whole = lifted(v, most)
                size = np.abs(v).max(axis=1, keepdims=True)
                q = v / size
                ask = np.c_[q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros(len(v))]
                lists = [pa.array(list(prefixes(d, held.value, prefix)), pa.list_(pa.int16())) for d in (whole, ask)]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["row_key"], part["x"], *lists], names=["vec_id", "row_key", "x", "prefix", "as_query"])

    index = store.put(rows.select("vec_id", "row_key", "x").mapInArrow(run, "vec_id bigint, row_key bigint, x array<double>, prefix array<smallint>, as_query array<smallint>"), "index")
    index._rows = best["rows"]
    return index


class Cell:
    """Queries of a cell and the best neighbours found for them so far."""

    def __init__(self, k: int, pivots: int, width: int):
        self.k, self.pivots, self.width = k, pivots, width
        self.batches: list[pa.RecordBatch] = []

    def settle(self) -> None:
        both = pa.Table.from_batches(self.batches).combine_chunks()
        self.ids, self.keys = both["vec_id"].to_numpy(), both["row_key"].to_numpy()
        self.x, self.prefix = _matrix(both["x"].combine_chunks()), _matrix(both["prefix"].combine_chunks()).astype(np.int16)
        n = len(self.ids)
        self.score, self.found = np.full((n, self.k), -np.inf), np.full((n, self.k), np.iinfo(np.int64).max)
        self.batches = []

    def files(self, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inverted files: rows in order of pivot, their places in the prefix, and where each pivot's begin."""
        order = np.argsort(prefix, axis=None, kind="stable")
        row, place = np.divmod(order, prefix.shape[1])
        return row, place.astype(np.int16), np.searchsorted(prefix.ravel()[order], np.arange(self.pivots + 1))

    def block(self, ids: np.ndarray, x: np.ndarray, prefix: np.ndarray) -> None:
        row, place, start = self.files(prefix)
        w = prefix.shape[1]
        want = OVERSAMPLE * self.k
        alike = ALIKE * w * (w + 1) / 2
        for lo in range(0, len(self.ids), CHUNK):
            own = slice(lo, lo + CHUNK)
            asked, at, begin = self.files(self.prefix[own])
            n = len(self.ids[own])
            # Footrule distance, a pivot outside a prefix counting as place w, is w (w + 1) less twice this sum.
            near = np.zeros((n, len(ids)), np.int16)
            for p in range(self.pivots):
                q, r = slice(begin[p], begin[p + 1]), slice(start[p], start[p + 1])
                if q.stop > q.start and r.stop > r.start:
                    near[np.ix_(asked[q], row[r])] += w - np.maximum(at[q][:, None], place[r][None, :])
            if len(ids) > want:
                cut = np.minimum(np.partition(near, len(ids) - want, axis=1)[:, len(ids) - want], alike)
            else:
                cut = np.zeros(n)
            for i in range(n):
                self.rerank(lo + i, ids, x, np.flatnonzero(near[i] >= cut[i]))

    def rerank(self, i: int, ids: np.ndarray, x: np.ndarray, rows: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.nan_to_num((x[rows] * self.x[i]).sum(axis=1), nan=0.0, posinf=np.inf, neginf=-np.inf)
        ok = (score >= self.score[i, -1]) & (ids[rows] != self.ids[i])
        s, d = np.r_[self.score[i], score[ok]], np.r_[self.found[i], ids[rows[ok]]]
        first = np.lexsort((d, -s))[: self.k]
        self.score[i], self.found[i] = s[first], d[first]

    def result(self) -> pa.RecordBatch:
        real = self.found.ravel() < np.iinfo(np.int64).max
        each = lambda v: pa.array(np.repeat(v, self.k)[real])
        return pa.RecordBatch.from_arrays([each(self.ids), each(self.keys), pa.array(self.found.ravel()[real]), pa.array(self.score.ravel()[real])], names=["query_id", "row_key", "vec_id", "score"])


def _walk(k: int, pivots: int, block: int):
    """Streams rows (cell, is_row, vec_id, row_key, x, prefix) that come by cell, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, settled, waiting, count = None, None, False, [], 0

        def drain() -> None:
            nonlocal waiting, count
            if count and cell.batches:
                cell.settle()
            if count and hasattr(cell, "ids"):
                t = pa.Table.from_batches(waiting).combine_chunks()
                cell.block(t["vec_id"].to_numpy(), _matrix(t["x"].combine_chunks()), _matrix(t["prefix"].combine_chunks()).astype(np.int16))
            waiting, count = [], 0

        for batch in batches:
            code = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(code)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi == lo:
                    continue
                c, is_row = divmod(int(code[lo]), 2)
                if c != number:
                    if cell is not None:
                        drain()
                        if hasattr(cell, "ids"):
                            yield cell.result()
                    number, cell = c, Cell(k, pivots, 0)
                part = batch.slice(lo, hi - lo)
                if not is_row:
                    cell.batches.append(part)
                    continue
                while len(part):
                    take = part.slice(0, block - count)
                    waiting.append(take)
                    count += len(take)
                    part = part.slice(len(take))
                    if count == block:
                        drain()
        if cell is not None:
            drain()
            if hasattr(cell, "ids"):
                yield cell.result()

    return run


def search(index: DataFrame, queries: Column, k: int = 20, *, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each index row that `queries` (over vec_id) picks."""
    asked = index.filter(queries)
    n, rows = asked.count(), index._rows
    sets, cells = max(1, -(-n // HELD)), max(1, min(CELLS, -(-rows // block)))
    key = F.xxhash64("row_key")  # row_key again, or all rows of a set would meet in a few cells
    own_set, own_cell = F.pmod(key, F.lit(sets)), F.pmod(F.shiftrightunsigned(key, 24), F.lit(cells))
    to = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    q = asked.withColumn("other", to(cells)).select((own_set * cells + F.col("other")).cast("int").alias("cell"), F.lit(0).alias("is_row"), "vec_id", "row_key", "x", F.col("as_query").alias("prefix"))
    r = index.withColumn("other", to(sets)).select((F.col("other") * cells + own_cell).cast("int").alias("cell"), F.lit(1).alias("is_row"), "vec_id", "row_key", "x", "prefix")
    dealt = q.unionByName(r).repartition(sets * cells, "cell").sortWithinPartitions("cell", "is_row", "row_key")
    found = dealt.mapInArrow(_walk(k, pivots, block), "query_id bigint, row_key bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "row_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, queries: Column, k: int = 20, *, vec_id: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score) over the usable vectors; `queries` is a condition on vec_id.

    Null, empty and zero vectors, vectors with a null or non-finite component, those of a rarer length and those without an
    id take no part. Of rows that repeat an id and a vector one takes part; rows of one id with different vectors all do, but
    none is a neighbour of another. Fewer than k others: all of them. Equal scores: the smaller id first. An empty table
    gives no rows. Only the two named columns are read, so that names cannot clash. Recall is a matter of OVERSAMPLE;
    the README has measured figures.
    """
    if k < 1:
        raise ValueError("k must be positive")
    index = build(vectors, Store(vectors.sparkSession), vec_id=vec_id, vector=vector, **options)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return search(index, queries, k, pivots=options.get("pivots", PIVOTS))
