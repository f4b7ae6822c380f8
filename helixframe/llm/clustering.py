"""Centroid clustering: plain Lloyd rounds over integer vectors.

Components become integers once; from then on every figure is exact, so the result depends neither on partitions nor on
the order of rows. The centroids (k x dim integers, both parameters) are broadcast; each partition sends back one row of
counts and sums for each centroid, and a groupBy merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.store import Store

#: Integer steps to 1.0, components of a vector, centroids, rounds.
SCALE, DIM, K, ROUNDS = 1024, 64, 8, 10
#: Integers are held to this size either way, so that a squared distance of up to 128 components fits 64 bits.
LIMIT = 1 << 27
#: Vectors of a batch worked on at once.
SLICE = 4096


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has exactly `dim` components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, finite), F.lit(False))


def integers(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors as floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    held = lambda y: F.least(F.greatest(y, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
    whole = F.transform(x, lambda y: F.floor(held(y * F.lit(float(scale)))).cast("int"))
    return vectors.filter(usable(x, dim)).select(F.col(vec_id).alias("vec_id"), whole.alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (the lowest, if several) and the squared distance to it."""
    apart = np.empty((len(centroids), len(v)), np.int64)
    for j, c in enumerate(centroids):
        d = v - c
        apart[j] = np.einsum("ij,ij->i", d, d)
    own = apart.argmin(axis=0)
    return own, apart[own, np.arange(len(v))]


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for i in range(0, len(batch), SLICE):
            part = batch.iloc[i : i + SLICE]
            yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of smallest sha256 of `salt:vec_id`, in that order. Null ids cannot be seeds while others can."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    got = rows.orderBy(mark.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in got], np.int64)


def step(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors; those without vectors stay."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for _, v in _slices(batches):
            own, _ = nearest(v, c)
            for j in np.unique(own):
                mine = v[own == j]
                n[j] += len(mine)
                total[j] += mine.sum(axis=0)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "s": list(total[some])})

    parts = rows.select("v").mapInPandas(sums, "cluster int, n bigint, s array<bigint>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(centroids.shape[1])]).alias("s"))
    out = centroids.copy()
    for r in merged.collect():  # k rows
        out[r["cluster"]] = [x // r["n"] for x in r["s"]]
    held.destroy()
    return out


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance). Ids travel as text, which pandas leaves alone where some are null."""
    kind = rows.schema["vec_id"].dataType
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, v in _slices(batches):
            own, d = nearest(v, held.value)
            yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "cluster": own.astype(np.int32), "distance": d})

    out = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "v").mapInPandas(mark, "vec_id string, cluster int, distance bigint")
    return out.withColumn("vec_id", F.col("vec_id").cast(kind))


def lloyd(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each usable vector.

    Null vectors, vectors of another length and vectors with a null or non-finite component give no row. Fewer than k usable
    vectors give fewer centroids, none an empty result. Repeated rows count each time and share a cluster. A null id is kept,
    and can seed a centroid only if ids run out. Ties go to the lower centroid. Components beyond +-LIMIT after scaling are
    held there. An inertia beyond 64 bits is null. Columns other than the two named are not read, so their names cannot clash.
    """
    if min(k, rounds + 1, dim, scale) <= 0:
        raise ValueError("k, dim and scale must be positive, rounds not negative")
    store = Store(vectors.sparkSession)
    rows = store.put(integers(vectors, vec_id=vec_id, vector=vector, dim=dim, scale=scale), "integers")
    centroids = seeds(rows, k, salt)
    if not len(centroids):
        nothing = rows.limit(0)
        return nothing.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        after = step(rows, centroids)
        if (after == centroids).all():
            break  # nothing moves any more, so no later round can change it
        centroids = after
    own = store.put(assign(rows, centroids), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    fits = lambda x: F.lit(x if abs(x) < 1 << 63 else None).cast("bigint")
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    at = lambda values: F.get(F.array(*values), F.col("cluster"))
    return own.select(
        "vec_id", "cluster", "distance", at([fits(sums.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"), fits(sum(sums.values())).alias("inertia"), at([F.lit(x) for x in digest]).alias("centroid_sha256")
    )


def sql(rounds: int = ROUNDS, k: int = K, dim: int = DIM, scale: int = SCALE, salt: str = "3") -> str:
    """The same rows for DuckDB, a pair of relations for each round."""
    whole = f"list_transform(embedding, lambda x: floor({scale} * x::double)::bigint)"
    parts = [
        f"kept as materialized (select row_number() over () as r, vec_id, {whole} as v from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"flat as materialized (select r, unnest(v) as x, generate_subscripts(v, 1) as i from kept)",
        f"c0 as materialized (select j, unnest(v) as y, generate_subscripts(v, 1) as i from (select row_number() over (order by sha256('{salt}:' || vec_id), v) - 1 as j, v from kept qualify j < {k}))",
    ]
    near = "select r, j, d from (select r, j, sum((x - y) * (x - y))::bigint as d from flat join {} using (i) group by r, j) qualify row_number() over (partition by r order by d, j) = 1"
    for n in range(rounds):
        parts.append(f"a{n} as materialized ({near.format(f'c{n}')})")
        parts.append(f"m{n} as materialized (select j, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as y from a{n} join flat using (r) group by j, i)")
        parts.append(f"c{n + 1} as materialized (select c.j, c.i, coalesce(m.y, c.y) as y from c{n} c left join m{n} m using (j, i))")
    parts.append(f"own as materialized ({near.format(f'c{rounds}')})")
    parts.append(f"names as (select j, sha256(string_agg(y::varchar, ',' order by i)) as h from c{rounds} group by j)")
    return "with " + ", ".join(parts) + " select vec_id, j::int as cluster, d as distance, (sum(d) over (partition by j))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256 from own join kept using (r) join names using (j)"
