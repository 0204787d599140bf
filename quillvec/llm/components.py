"""Connected components by alternating large-star and small-star.

Large-star links every larger neighbour of a node to the node's least neighbour; small-star links the
node and its smaller neighbours to the least of them.  Alternating both ends with stars whose
centre is the least node of each component.  Neighbours are never gathered in a list: each
step is a grouped minimum and a join.  Where a node has very many links, those of such hubs, which are few, are joined in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import materialize

#: A node is a hub with more links than this, and with more than one in HUBS of all links; so there are 2 * HUBS hubs at most.
MANY, HUBS = 128, 1000


def connected_components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, comp): comp is the least node reachable, for every node of links (a, b).

    Null ends and loops are ignored; repeated and reversed links count once; no links, no rows.  Rounds grow with the logarithm of the nodes;
    if `limit` of them were not enough it raises, rather than give groups that are not whole.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(limit):
        n, most, astray = _shape(edges)
        if not astray:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        cut = max(MANY, n // HUBS)
        edges = materialize(_small_star(_large_star(edges, cut, most > cut), cut, most > cut), "links")
    raise RuntimeError(f"components did not settle in {limit} rounds")


def _shape(edges: DataFrame) -> tuple[int, int, int]:
    """Links; those of the node with most; and how many nodes are neither a centre nor have one lesser neighbour alone: none if all links are stars."""
    end = lambda c, up: edges.select(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    nodes = end("u", 1).unionByName(end("v", 0)).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    astray = F.col("up") + F.least("down", F.lit(1)) > 1
    return tuple(nodes.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("up"), F.max(F.col("up") + F.col("down")), F.count(F.when(astray, 1))))).first())


def _with_least(edges: DataFrame, cut: int, hubs: bool) -> DataFrame:
    """edges (u, v) with m, the least v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    least = least.withColumn("parts", F.ceil(F.col("c") / cut).cast("int"))
    many = F.broadcast(least.where("parts > 1").select("u", "parts"))  # 2 * HUBS rows at most
    dealt = edges.join(many, "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return dealt.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["u", "part"])


def _large_star(edges: DataFrame, cut: int, hubs: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, cut, hubs).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, cut: int, hubs: bool) -> DataFrame:
    met = _with_least(edges, cut, hubs)
    moved = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(met.select("u", F.col("m").alias("v"))).distinct()
