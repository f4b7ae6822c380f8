"""Connected components of a link table, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.store import Store


def components(links: DataFrame, store: Store, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another.

    Alternating star operations: each node hands its larger neighbours to its smallest neighbour, then its smaller
    neighbours to the smallest of them, until only stars are left. A node's neighbours are never gathered into a list: its
    minimum is an aggregate with partial minima, written and joined back, so that the join is of plain exchanges and Spark
    can split a node that holds a large share of all links. Every round is written to the store. Null ends and self-links
    are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") > F.col("v")).distinct()
    edges = store.put(edges, "edges")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store.put(both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")), "low")
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") > F.col("v")).distinct()
        mid = store.put(large, "large")
        store.drop(low)
        low = store.put(mid.groupBy("u").agg(F.min("v").alias("m")), "low")
        near = mid.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") > F.col("v"))
        small = near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = store.put(small, "edges")
        for old in (low, mid, edges):
            store.drop(old)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return store.put(members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "members")


def _settled(edges: DataFrame) -> bool:
    """Whether the links (u, v), u > v, are stars: each u has one link, and no v is a u. Then v is the smallest of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").count() == 0
