"""The incremental plan: which documents to write again after sources changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import graph
from ..operators.lineage import cut


@dataclass
class Plan:
    """affected(doc_path, reason, triggers, strength), deleted(doc_path), preserved(doc_path)."""

    affected: DataFrame
    deleted: DataFrame
    preserved: DataFrame


def by_name(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (doc_path, source_path) of sources and the existing document their name implies."""
    rows = sources.select(F.col("path").alias("source_path"), paths.infer_doc_path(F.col("path")).alias("doc_path")).where("doc_path is not null")
    return rows.join(docs.select("doc_path").distinct(), "doc_path", "left_semi").select("doc_path", "source_path")


def enriched(index: DataFrame, sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs by name for the sources that the index does not know."""
    unknown = sources.join(index.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")
    return by_name(unknown, docs)


def plan(changes: DataFrame, edges: DataFrame, index: DataFrame, links: DataFrame, docs: DataFrame, depth: int = 3, link_depth: int = 1) -> Plan:
    """changes(path, status), edges(src, dst), index(doc_path, source_path),
    links(src, dst) of documents, docs(doc_path)."""
    changed = changes.where("status in ('added', 'modified')").select("path")
    gone = changes.where("status = 'deleted'").select("path")
    pairs = index.select("doc_path", "source_path")
    direct = pairs.join(changed, F.col("source_path") == F.col("path")).select("doc_path", F.lit(1).alias("stage"), "source_path")
    implied = by_name(changed, docs).join(pairs, ["doc_path", "source_path"], "left_anti").select("doc_path", F.lit(2).alias("stage"), "source_path")
    reached = graph.impact(edges, changed.select(F.col("path").alias("node")), depth).select("node")
    through = pairs.join(reached, F.col("source_path") == F.col("node")).select("doc_path", F.lit(3).alias("stage"), "source_path")
    first = cut(direct.unionAll(implied).unionAll(through))  # read by the links and by the ranking
    linked = graph.impact(links, first.select(F.col("doc_path").alias("node")), link_depth)
    fourth = linked.select(F.col("node").alias("doc_path"), F.lit(4).alias("stage"), F.element_at("chain", 1).alias("source_path"))
    affected = cut(ranked(first.unionAll(fourth)))  # read by the preserved documents too
    deleted = pairs.join(gone, F.col("source_path") == F.col("path"), "left_semi").select("doc_path").distinct()
    touched = affected.select("doc_path").unionAll(deleted)
    return Plan(affected, deleted, docs.select("doc_path").distinct().join(touched, "doc_path", "left_anti"))


def ranked(registered: DataFrame) -> DataFrame:
    """(doc_path, stage, source_path) -> one row a document: the earliest stage gives reason
    and strength, all stages add triggers."""
    reason = F.when(F.col("s") == 1, "source_changed").when(F.col("s") == 2, "inferred").when(F.col("s") == 3, "dep_changed").otherwise("doc_dep_changed")
    rows = registered.groupBy("doc_path").agg(F.min("stage").alias("s"), F.array_join(F.array_sort(F.collect_set("source_path")), ",").alias("triggers"))
    return rows.select("doc_path", reason.alias("reason"), "triggers", F.when(F.col("s") == 1, "full").otherwise("incremental").alias("strength"))


def by_reason(affected: DataFrame) -> DataFrame:
    return affected.groupBy("reason").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_path").alias("first_doc"))
