"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import tidy, written


#: A node with more than this share of all edges is a hub. There are at most 2 / HUB_SHARE of them.
HUB_SHARE = 1 / 1024


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """Edges u, v with m, the least v of their u. Hubs are few by their definition and broadcast, so that no task gets a hub's edges."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "star_least")
    hubs = least.where(F.col("degree") > max(2, n * HUB_SHARE)).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    rest = marked.where("hub is null").select("u", "v").join(least.select("u", "m"), "u")
    return rest.select("u", "v", "m").unionByName(marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    found = _with_least(edges, n)
    moved = found.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).distinct()


@tidy
def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that links reach, for every node of `links` (columns a and b) but the least ones.

    Each round is written to the shared folder. A round that changes nothing ends it; the number of rounds grows with
    the logarithm of the longest chain. Nulls and links of a node to itself are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        if before:
            edges = written(_large_star(edges, before[0]), "large_stars")
            edges = _small_star(edges, before[0])
        edges = written(edges, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
