"""Connected components of a link table, by alternating large and small stars.

Each round is a few joins and aggregates on node identifiers; nothing is gathered on the driver but a count and a checksum.
The number of rounds grows with the logarithm of the longest path. Nodes next to more than ``HUB`` others are joined by a
broadcast: there are at most 2 / HUB as many of them as edges, so the hub of a class doesn't gather its edges in one task. An
empty table has no components; repeated links and links of a node with itself count once and not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60
HUB = 1 << 16


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, hub: int = HUB) -> DataFrame:
    """``links``: u, v (long). Returns u, v: v is the smallest node reachable from u, for each u that isn't its own root."""
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            return edges
        # Large star: neighbours above a node are linked to the least node next to it.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "n")
        hubs = near.where(F.col("n") > hub).select("v", F.col("m").alias("h"))
        marked = edges.join(F.broadcast(hubs), "v", "left")
        rest = marked.where("h is null").select("u", "v").join(near.where(F.col("n") <= hub), "v").select("u", F.col("m").alias("v"))
        large = rest.union(marked.where("h is not null").select("u", F.col("h").alias("v"))).distinct()
        # Small star: a node and its neighbours below it are linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(down.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
