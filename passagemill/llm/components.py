"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, stage


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """u and every smaller neighbour of u are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges(a long, b long) as (a, b): every node but the least of its component, with that one.

    Each round is written to the shared folder, which cuts its lineage. A node that is both a parent
    and a child shows that the stars are not final yet; the count of such nodes ends the loop.
    """
    spark = edges.sparkSession
    now = stage(_small(edges), "stars")
    for _ in range(most_rounds):
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 or up = 1 and down = 1").take(1):
            return now
        now = stage(_small(_large(now)), "stars")
        release(spark)
    raise RuntimeError("the stars did not settle")
