"""Connected components by alternating star contractions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, met

def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of each node of edges (u, v); component is the smallest node reachable.

    Each round points the larger neighbours of a node at its smallest neighbour (large star), then
    does so for the smaller ones (small star); logarithmically many rounds suffice in practice.
    The minimum of a node is pre-aggregated before its shuffle and joined back in salted parts, so a node
    with very many links is never a group in one task. Nulls and self-links are ignored.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _print(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        # An edge's larger end goes to the smallest neighbour of its smaller end, or to that end if it has none.
        low = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = cut(met(e, low, "v", how="left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met(large, low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _print(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
