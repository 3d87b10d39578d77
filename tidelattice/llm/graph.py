"""Connected components by alternating star contractions, with no node gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _pairs(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """Rows (u, v) for each of `ends`; the input is passed once, where a union would read it for each."""
    made = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])
    return rows.select(F.explode(made).alias("e")).select("e.*")


def _toward_smallest(links: DataFrame, both_ways: bool) -> DataFrame:
    """Point neighbours of each node at the smallest of the node and its neighbours.

    With `both_ways` (large star) each larger neighbour moves; otherwise (small star)
    the node and its smaller neighbours move. A hub is a join key, never a list, so
    a skewed hub is split like any skewed join.
    """
    if both_ways:
        links = _pairs(links, ("u", "v"), ("v", "u"))
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = links.join(least, "u")
    if both_ways:
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = _pairs(met, ("u", "m"), ("v", "m"))
    return moved.where("u != v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node that points (u at v) points at one node, and that one points nowhere."""
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(out).alias("out")) for c, out in (("u", 1), ("v", 0))])
    nodes = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return nodes.where("out > 1 or (out = 1 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node reachable.

    Rounds are cut with a checkpoint. They end when all edges are stars: edges lead to
    smaller nodes, so the middle of a star is its smallest node and nothing can move.
    """
    edges = keep(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        edges = keep(_toward_smallest(_toward_smallest(edges, True), False))
        if _is_stars(edges):
            break
    # Grouped by node, so that a join on nodes needs no further shuffle.
    return _pairs(edges, ("u", "v"), ("v", "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
