"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def _direct(least: DataFrame) -> DataFrame:
    """The least neighbours with an exchange of their own. Without it they would be joined where they were
    aggregated, and AQE only splits a hub's rows where both sides of a join come straight from a shuffle."""
    return least.repartition(int(least.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its greater neighbours to its least neighbour or itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(_direct(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its lesser neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(_direct(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(`node`, `component`) of every node of the undirected `edges`; the component is its least node.

    Rows with a null end and loops are ignored, repeated edges count once; no edges give no rows.
    Every round is written by `checkpoint`, so lost executors cost no more than that round. The
    rounds end when the edges no longer change, after about the square of the logarithm of the
    size; passing `max_rounds` is an error rather than a partial result.
    """
    current = checkpoint(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        current = checkpoint(_small_star(_large_star(current)))
        found = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = found
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
