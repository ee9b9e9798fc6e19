"""Connected components of an edge list, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .exchange import Store


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One large-star or small-star step on edges (u, v): neighbours of u are linked to the
    smallest vertex among them and u."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if larger:
        near = edges.unionByName(flipped)
    else:
        near = edges.filter("u > v").unionByName(flipped.filter("u > v"))
    least = near.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u"), F.least("u", "least").alias("least"))
    joined = near.join(least, "u")       # AQE splits a vertex that has very many neighbours
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("least").alias("v")) \
            .unionByName(least.select("u", F.col("least").alias("v")))
    return out.filter("u <> v").distinct()


def components(store: Store, edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest vertex of u's component, for every vertex but those
    smallest ones.  Alternates the two steps until the edges stay the same; each round is
    written to the store, so that lineage stays short and survives lost executors."""
    now, seen, turn = store.write(edges.filter("u <> v").select("u", "v").distinct(), "edges0"), None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now
        turn, seen, last = turn + 1, mark, now
        now = store.write(_star(_star(last, True), False), f"edges{turn}")
        store.drop(f"edges{turn - 1}")
