"""Scores of pairs too long for one task: the score matrix in tiles, a wave of anti-diagonals, borders as rows.

Tile (i, j) needs the last row of tile (i - 1, j) and the last column of tile (i, j - 1). All tiles with i + j = d are
scored at once, over all pairs; their borders are written to the shared folder and joined with the blocks of both sequences for
d + 1. Small tiles are scored many at a time, large ones singly, so a task's memory is in proportion to the tile's side. A lost executor costs
the tiles of one wave. A million bases a side in tiles of 16,384 are 123 waves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.gaps import codes, slabs, tile_batch
from helixframe.operators.scoring import SCORE_COLUMN
from helixframe.schemas import Scoring
from helixframe.storage import Store

#: Letters of a tile's side.
TILE = 8192

_WAVE = "pair_id bigint, i bigint, j bigint, top array<bigint>, left array<bigint>, best bigint, score bigint"


def blocks(pairs: DataFrame, side: str, size: int) -> DataFrame:
    """(pair_id, block, text): one side of pairs, cut into blocks of `size` characters."""
    data = F.encode(F.col(side), "UTF-32")  # four bytes a character, so that cutting is by place
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((length(data) - 1) div {4 * size} as int)")), lambda g: F.struct(g.cast("bigint").alias("block"), F.decode(F.substring(F.col("data"), g * 4 * size + 1, F.lit(4 * size)), "UTF-32").alias("text")))
    return pairs.select("pair_id", data.alias("data")).filter(F.length("data") > 0).select("pair_id", F.inline(cut))


def align_blocks(a: DataFrame, b: DataFrame, algorithm: str = "nw", scoring: Scoring | None = None, size: int = TILE, store: Store | None = None) -> DataFrame:
    """(pair_id, score) of pairs in blocks (pair_id, block, text), all of `size` letters but the last, numbered from 0.

    Pairs without a block on either side have no row.
    """
    if algorithm not in SCORE_COLUMN:
        raise ValueError("algorithm is nw or sw")
    s, local, spark = scoring or Scoring(), algorithm == "sw", a.sparkSession
    store = store or Store(spark)
    count = lambda t, n: t.groupBy("pair_id").agg((F.max("block") + 1).alias(n))
    sizes = store.put(count(a, "na").join(count(b, "nb"), "pair_id"), "sizes")
    ends = {r["d"]: r["pairs"] for r in sizes.groupBy((F.col("na") + F.col("nb") - 2).alias("d")).agg(F.count("*").alias("pairs")).collect()}  # a row for each wave at most
    empty = spark.createDataFrame([], _WAVE).select("pair_id", "score")
    if not ends:
        return empty
    a = store.put(a.join(sizes, "pair_id").select("pair_id", F.col("block").alias("i"), F.col("text").alias("text_a"), "na", "nb"), "a")
    b = store.put(b.select("pair_id", F.col("block").alias("j"), F.col("text").alias("text_b")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, i, j, na, nb, best = (batch[n].to_numpy(zero_copy_only=False) for n in ("pair_id", "i", "j", "na", "nb", "best"))
            best = np.nan_to_num(best.astype(float)).astype(np.int64) if batch["best"].null_count else best
            x, y = ([codes(t) for t in batch[n].to_pylist()] for n in ("text_a", "text_b"))
            line = lambda n, k, first: np.zeros(n, np.int64) if local else (np.arange(n, dtype=np.int64) + k * size + first) * s.gap
            tops, lefts = _borders(batch["top"]), _borders(batch["left"])
            tops = [line(len(y[r]) + 1, j[r], 0) if t is None else t for r, t in enumerate(tops)]
            lefts = [line(len(x[r]), i[r], 1) if t is None else t for r, t in enumerate(lefts)]
            for take in slabs(np.array([len(t) for t in y]), np.array([len(t) for t in x])):
                bottom, right, high = tile_batch(*([side[r] for r in take] for side in (x, y, tops, lefts)), s, local)
                yield _wave_rows(take, p, i, j, na, nb, bottom, right, np.maximum(best[take], high), local)

    wave, done = None, []
    most = max(1, 4 * spark.sparkContext.defaultParallelism)
    for d in range(max(ends) + 1):
        ready = a.withColumn("j", F.lit(d) - F.col("i")).filter((F.col("j") >= 0) & (F.col("j") < F.col("nb"))).join(b, ["pair_id", "j"])
        if wave is None:
            ready = ready.selectExpr("*", "cast(null as array<bigint>) as top", "cast(null as array<bigint>) as left", "cast(null as bigint) as best")
        else:
            borders = wave.filter("score is null").groupBy("pair_id", "i", "j").agg(F.first("top", True).alias("top"), F.first("left", True).alias("left"), F.max("best").alias("best"))
            ready = ready.join(borders, ["pair_id", "i", "j"], "left")
        ready = ready.select("pair_id", "i", "j", "na", "nb", "text_a", "text_b", "top", "left", "best")
        after = store.put(ready.repartition(most, "pair_id", "i").mapInArrow(work, _WAVE), "wave")
        if wave is not None and d - 1 not in ends:
            store.drop(wave)
        wave = after
        if d in ends:
            done.append(wave.filter("score is not null").select("pair_id", "score"))
    for more in done:
        empty = empty.unionByName(more)
    return empty


def _borders(column: pa.ListArray) -> list[np.ndarray | None]:
    values, at, ok = column.values.to_numpy(), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return [values[u:v] if there else None for u, v, there in zip(at, at[1:], ok)]


def _wave_rows(take: np.ndarray, p, i, j, na, nb, bottom: list[np.ndarray], right: list[np.ndarray], best: np.ndarray, local: bool) -> pa.RecordBatch:
    """Rows of the tiles at `take`: a border for the tile below, one for the tile to the right, and the score of a last tile."""
    p, i, j = p[take], i[take], j[take]
    down, across = np.flatnonzero(i < na[take] - 1), np.flatnonzero(j < nb[take] - 1)
    last = np.flatnonzero((i == na[take] - 1) & (j == nb[take] - 1))
    rows = np.concatenate((down, across, last))
    n = (len(down), len(across), len(last))
    score = best if local else np.array([x[-1] for x in bottom])
    lists = lambda own, given: [None] * sum(n[:own]) + [given[r] for r in (down, across)[own]] + [None] * sum(n[own + 1 :])
    made = [p[rows], i[rows] + np.repeat([1, 0, 0], n), j[rows] + np.repeat([0, 1, 0], n)]
    columns = [pa.array(c, pa.int64()) for c in made] + [pa.array(lists(own, given), pa.list_(pa.int64())) for own, given in enumerate((bottom, right))]
    columns += [pa.array(best[rows], pa.int64()), pa.array(score[rows], pa.int64(), mask=np.arange(len(rows)) < n[0] + n[1])]
    return pa.RecordBatch.from_arrays(columns, names=_WAVE.replace(",", "").split()[::2])


def align_long(pairs: DataFrame, algorithm: str = "nw", scoring: Scoring | None = None, size: int = TILE) -> DataFrame:
    """(pair_id, sequence_length_a, sequence_length_b, score column) as scoring.align gives, by tiles.

    Ids are distinct. An empty side scores as all gaps (nw) or 0 (sw); a null side gives a null score.
    """
    s, column = scoring or Scoring(), SCORE_COLUMN[algorithm]
    la, lb = F.length("seq_a"), F.length("seq_b")
    scored = align_blocks(blocks(pairs, "seq_a", size), blocks(pairs, "seq_b", size), algorithm, s, size)
    sizes = pairs.select("pair_id", la.alias("sequence_length_a"), lb.alias("sequence_length_b"))
    plain = (F.col("sequence_length_a") + F.col("sequence_length_b")).cast("bigint") * s.gap if algorithm == "nw" else F.when(F.col("sequence_length_a").isNotNull() & F.col("sequence_length_b").isNotNull(), F.lit(0).cast("bigint"))
    out = sizes.join(scored, "pair_id", "left")
    return out.select("pair_id", "sequence_length_a", "sequence_length_b", F.coalesce("score", plain).alias(column))
