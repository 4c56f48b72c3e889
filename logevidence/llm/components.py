"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logevidence.llm.common import written


def _contract(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    return edges.join(lowest, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _contract(both.where("v > u"), lowest).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = _contract(down, lowest)
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(lowest.select("u", F.col("m").alias("v")))
        .where("u != v")
        .distinct()
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, or only edges to larger ones: nothing is left to contract."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("end"))
    return ends.groupBy("end.node").agg(F.sum("end.down").alias("down"), F.count(F.lit(1)).alias("n")).where("down > 0 and n > 1").count() == 0


def stars(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) -> (u, v): every node but the smallest of its component, with that smallest one.

    Minima are aggregated before the shuffle and joined back, so no task
    collects a component. Each round's edges are written to the shared folder;
    the rounds end when the edges are stars around smallest nodes. Nodes without an edge to
    another node aren't returned; an empty table gives an empty result.
    ``edges`` is read several times: pass a table, or a union of tables.
    """
    edges = edges.select("u", "v").where("u != v")
    while True:
        edges = written(small_star(large_star(edges)), "edges")
        if _is_star_forest(edges):
            return edges


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) -> (node, root): root is the smallest node that node reaches; see stars()."""
    edges = stars(written(edges.select("u", "v").where("u != v").distinct(), "edges"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
