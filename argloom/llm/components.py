"""Connected components by alternating stars: every round is two aggregations and joins, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _with_least(rows: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the least of u and all its v; a node with many rows is split by the skew join."""
    least = rows.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m")).withColumnRenamed("u", "w")
    return rows.join(least, F.col("u") == F.col("w")).drop("w")


def _round(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, after a large-star and a small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _with_least(large)
    return small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) of every node that has an edge to another; null ends and loops are left out."""
    edges = edges.where(f"{a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    seen = None
    while True:
        edges = written(edges, "components")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == seen or not now[0]:
            break
        seen, edges = now, _round(edges)
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
