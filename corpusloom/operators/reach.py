"""Bounded reverse reachability of many change sets at once, with chains.

Sets are numbered; 64 of them share a word, and a node's row holds the sets that have
reached it as bits. A level is one join and one OR, whatever the number of sets in a word,
and each reached node keeps a pointer to its parent in place of a chain. Chains are read
off the pointers by jumping: every round doubles the distance covered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from .lineage import cut


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """edges(src, dst), seeds(set_id long, node) -> set_id, node, depth, parent: for every
    set, the nodes from which a seed is reached in at most ``depth`` steps along edges, seeds
    included at depth 0 without a parent. ``parent`` is the least node one step nearer.

    Null sets, seeds and ends of edges reach nothing; repeated rows, loops and cycles change
    nothing."""
    if not isinstance(depth, int) or depth < 0:
        raise ValueError("depth must be a whole number")
    seeds = seeds.select(F.col("set_id").cast("long").alias("set_id"), "node").where("set_id is not null and node is not null").distinct()
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    front = seen = cut(seeds.select("node", bits.word(F.col("set_id")).alias("word"), bits.bit(F.col("set_id")).alias("mask")).groupBy("node", "word").agg(F.bit_or("mask").alias("mask")))
    levels = [seeds.select("set_id", "node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent"))]
    for level in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "word", "mask", F.col("dst").alias("parent"))
        known = seen.select("node", "word", F.col("mask").alias("known"))
        new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        step = cut(step.join(known, ["node", "word"], "left").select("node", "word", new.alias("mask"), "parent").where("mask <> 0"))
        reached = step.select("node", F.explode(bits.members(F.col("word"), F.col("mask"))).alias("set_id"), "parent")
        levels.append(reached.groupBy("set_id", "node").agg(F.min("parent").alias("parent")).select("set_id", "node", F.lit(level).cast("long").alias("depth"), "parent"))
        if level < depth:
            front = cut(step.groupBy("node", "word").agg(F.bit_or("mask").alias("mask")))
            seen = cut(seen.unionAll(front).groupBy("node", "word").agg(F.bit_or("mask").alias("mask")))
    return reduce(DataFrame.unionAll, levels)


def chains(found: DataFrame) -> DataFrame:
    """impact(...) -> set_id, node, depth, chain: the nodes from a seed to ``node``, as text.

    A row knows the nodes between itself and the one it points at; joining the table with
    itself hands it those of that one, which are as many again."""
    deepest = found.agg(F.max("depth")).first()[0] or 0
    rows = found.select("set_id", "node", "depth", F.col("parent").alias("to"), F.array(F.col("node").cast("string")).alias("tail"))
    covered = 1
    while covered <= deepest:
        ahead = rows.select("set_id", F.col("node").alias("to"), F.col("to").alias("next"), F.col("tail").alias("head"))
        longer = F.when(F.col("head").isNull(), F.col("tail")).otherwise(F.concat("head", "tail"))
        rows = cut(rows.join(ahead, ["set_id", "to"], "left").select("set_id", "node", "depth", F.col("next").alias("to"), longer.alias("tail")))
        covered *= 2
    return rows.select("set_id", "node", "depth", F.array_join("tail", " > ").alias("chain"))
