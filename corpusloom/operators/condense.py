"""Closures of many seeds over a graph with cycles, from one condensed index.

Nodes of a cycle reach the same nodes, so the index keeps one node for each strongly
connected component and the edges between components. Components come from trimming and
colouring: nodes that no cycle can hold go first; then every node takes the least node that
reaches it as its colour, and those that reach the node their colour names are a component.
A component lies within a colour, so only edges within colours are met again.

All loops are joins of a changed front with the edges, and every front is a table in
the shared folder; their number follows the longest shortest path, not the rows. Left to
itself the planner broadcasts a table of up to 10 MB of files in every round, all through the
driver; here only fronts of a bounded number of rows are, and other joins deal out both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from .lineage import stored

# trimming goes on while a round takes away so much of the edges; colouring does the rest
PACE = 0.1
# a front of up to so many rows goes to every task; a larger one is dealt out by its key
SMALL = 10_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    table = stored(df)
    return table, table.count()


def dealt(df: DataFrame, n: int | None = None) -> DataFrame:
    """``df``, of ``n`` rows if known, as a side of a join that sends no more than a small
    front through the driver."""
    return F.broadcast(df) if n is not None and n <= SMALL else df.hint("merge")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends both have an edge that comes in and one that goes out."""
    n = edges.count()
    while n:
        ins, outs = edges.select("dst").distinct(), edges.select("src").distinct()
        before = n
        edges, n = counted(edges.join(dealt(ins.withColumnRenamed("dst", "src")), "src", "left_semi").join(dealt(outs.withColumnRenamed("src", "dst")), "dst", "left_semi").select("src", "dst"))
        if before - n < PACE * before:
            break
    return edges


def colours(edges: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches a node, itself included."""
    front, n = counted(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
    seen = front
    while True:
        told = dealt(front, n).join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("better"))
        front, n = counted(told.join(dealt(seen), "node").where("better < colour").select("node", F.col("better").alias("colour")))
        if not n:
            return seen
        seen = stored(seen.join(dealt(front.withColumnRenamed("colour", "better"), n), "node", "left").select("node", F.coalesce("better", "colour").alias("colour")))


def components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> node, comp: the least node of its strongly connected component, for
    the nodes that are not that node themselves. Edges with a null end count for nothing."""
    rest = trimmed(stored(edges.select("src", "dst").where("src <> dst").distinct()))
    labels = edges.select(F.col("src").alias("node"), F.col("src").alias("comp")).limit(0)
    while not rest.isEmpty():
        colour = colours(rest)
        ends = lambda end: dealt(colour.select(F.col("node").alias(end), F.col("colour").alias(f"of_{end}")))
        inner = stored(rest.join(ends("src"), "src").join(ends("dst"), "dst").where("of_src = of_dst").select("src", "dst"))
        front, n = counted(colour.where("node = colour").select("node", F.col("colour").alias("comp")))
        found = front
        while n:
            front, n = counted(dealt(front, n).join(inner, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "comp").distinct().join(dealt(found), "node", "left_anti"))
            found = stored(found.unionAll(front))
        labels = stored(labels.unionAll(found.where("node <> comp")))
        done = found.select("node")
        rest = trimmed(stored(inner.join(dealt(done.withColumnRenamed("node", "src")), "src", "left_anti").join(dealt(done.withColumnRenamed("node", "dst")), "dst", "left_anti").select("src", "dst")))
    return labels


@dataclass
class Condensed:
    """members(node, comp) of components of several nodes; edges(src, dst) between components."""

    members: DataFrame
    edges: DataFrame

    def head(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with the nodes of ``column`` replaced by their components."""
        comp = self.members.select(F.col("node").alias(column), "comp")
        return rows.join(dealt(comp), column, "left").withColumn(column, F.coalesce("comp", column)).drop("comp")


def condense(edges: DataFrame) -> Condensed:
    """edges(src, dst) -> the index; it can be stored and serve any number of seeds."""
    index = Condensed(components(edges), edges)
    between = index.head(index.head(edges.select("src", "dst").where("src <> dst"), "src"), "dst")
    index.edges = stored(between.where("src <> dst").select("src", "dst").distinct())
    return index


def closures(index: Condensed, seeds: DataFrame) -> DataFrame:
    """seeds(set_id long, node) -> set_id, node: for every set, all nodes that reach one of its
    seeds along edges, the seeds included, whether the graph knows them or not.

    64 sets share a word; a round passes on only the bits that are new to a component. Null
    sets and nodes reach nothing; repeated rows change nothing."""
    wanted = seeds.select(F.col("set_id").cast("long").alias("set_id"), "node").where("set_id is not null and node is not null").distinct()
    start = index.head(wanted, "node").select("node", bits.word(F.col("set_id")).alias("word"), bits.bit(F.col("set_id")).alias("mask"))
    front, n = counted(start.groupBy("node", "word").agg(F.bit_or("mask").alias("mask")))
    seen = front
    while True:
        step = dealt(front, n).join(index.edges, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "word", "mask")
        known = dealt(seen.select("node", "word", F.col("mask").alias("known")))
        new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        step = step.groupBy("node", "word").agg(F.bit_or("mask").alias("mask")).join(known, ["node", "word"], "left")
        front, n = counted(step.select("node", "word", new.alias("mask")).where("mask <> 0"))
        if not n:
            break
        seen = stored(seen.unionAll(front).groupBy("node", "word").agg(F.bit_or("mask").alias("mask")))
    inside = index.members.select(F.col("comp").alias("node"), F.col("node").alias("member"))
    whole = seen.unionAll(seen.join(dealt(inside), "node").select(F.col("member").alias("node"), "word", "mask"))
    return whole.select(F.explode(bits.members(F.col("word"), F.col("mask"))).alias("set_id"), "node")
