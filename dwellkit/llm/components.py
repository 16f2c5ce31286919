"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellkit.llm.store import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each node's larger neighbours to its smallest one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that can be reached, for nodes with an edge to another.

    Alternates two steps, each a grouped minimum and a join, until no edge changes. A
    node with very many edges is a grouped minimum with partial sums and a join side that
    Spark can split; its edges never meet in one place. Every round is a table in the
    shared folder. Edges with a null end and loops are left out.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = stored(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before:
        now = stored(_small_star(_large_star(now)).distinct(), "edges")
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
