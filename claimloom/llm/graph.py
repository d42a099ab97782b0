"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex either is a root or points to one root."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")), F.struct(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    seen = edges.select(F.inline(ends)).groupBy("x").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return seen.filter((F.col("child") > 1) | (F.col("child") > 0) & (F.col("root") > 0)).isEmpty()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(v, component) for every vertex with an edge; the component is its least vertex.

    ``edges`` has columns u and v. Each step is written to the shared folder;
    nothing but whether it has settled comes to the driver.
    """
    edges = edges.select("u", "v").filter("u != v")
    for _ in range(limit):
        new = util.stored(_small(_large(edges)), "stars")
        util.discard(edges)
        edges = new
        if _settled(edges):
            roots = edges.select(F.col("v").alias("u"), "v").distinct()
            return edges.unionByName(roots).toDF("v", "component")
    raise RuntimeError("components did not settle")
