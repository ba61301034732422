"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import compact, cut

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, comp): the least node of each node's component.

    Alternating large-star and small-star steps; rounds grow with the logarithm of a
    component's size, and a step keeps at most as many edges as it had. Raises if the
    labels have not settled after MOST_ROUNDS, rather than return some."""
    pairs = cut(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low <> high").distinct())
    most = pairs.count()
    pairs = compact(pairs, most)
    for _ in range(MOST_ROUNDS):
        both = pairs.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(pairs.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low <> high").distinct()
        down = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(down, "high").select("m", "low", "high").select(
            F.explode(F.array(F.struct(F.col("m").alias("low"), F.col("low").alias("high")), F.struct(F.col("m").alias("low"), F.col("high").alias("high")))).alias("e")
        ).select("e.low", "e.high").where("low <> high").distinct()
        after = cut(compact(small, most))
        # settled: every node hangs on one root, and no root hangs on another
        heads = after.groupBy("high").agg(F.count(F.lit(1)).alias("n"))
        roots = after.select("low").distinct()
        if heads.where("n > 1").isEmpty() and roots.join(heads, F.col("low") == F.col("high"), "left_semi").isEmpty():
            stars = after
            return stars.select(F.col("high").alias("node"), F.col("low").alias("comp")).unionAll(stars.select(F.col("low").alias("node"), F.col("low").alias("comp")).distinct())
        pairs = after
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
