"""Connected components of an edge table, by alternating large and small
stars: every round is a few joins and map-side combined minima, and no
component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.common import discard, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star of ``(high, low)`` edges."""
    both = edges.unionAll(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.join(least, "u").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low"))
             .where("high <> low").distinct())
    least = large.groupBy("high").agg(F.min("low").alias("m"))
    at = large.join(least, "high")
    return (at.select(F.col("low").alias("high"), F.col("m").alias("low")).unionAll(at.select("high", F.col("m").alias("low")))
            .where("high <> low").distinct())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another one; ``root`` is
    the smallest node that it reaches."""
    spark = edges.sparkSession
    stars, at = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
    shape = None
    while True:
        now = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == shape or now.n == 0:
            break
        shape = (now.n, now.h)
        stars, after = materialise(_stars(stars), "stars")
        discard(spark, at)
        at = after
    return stars.select(F.col("high").alias("node"), F.col("low").alias("root")).unionAll(
        stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
