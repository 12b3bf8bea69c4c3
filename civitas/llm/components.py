"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitas.session import materialize_table


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")) \
        .select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).where("b > a") \
        .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = down.join(least, down["a"] == least["u"])
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")) \
        .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))) \
        .where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of
    ``edges`` (a, b: longs) other than the roots.

    Every round is written to the shared folder, so a lost executor repeats one
    round at most; rounds grow with the logarithm of the longest path.  Keys are
    joined after a partial minimum, hot nodes are split by the join.
    """
    e = materialize_table(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        e = materialize_table(_small_star(_large_star(e)), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
