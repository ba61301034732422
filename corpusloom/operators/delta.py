"""Keeping the document index and the import graph up to date by changes.

Both are kept as rows that name the file they come from, so a change replaces the rows of
the changed files only, and only their contents are read. An import's target also depends on
which files exist: the paths that an import would accept are kept with it, and an added or
deleted file decides again the imports that name its path. Edges count the imports that
support them, and go with the last one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import documents, graph
from .lineage import cut


@dataclass
class Rows:
    """Rows to add and rows to take out."""

    plus: DataFrame
    minus: DataFrame

    def applied(self, table: DataFrame) -> DataFrame:
        return table.join(self.minus, table.columns, "left_anti").unionByName(self.plus.select(*table.columns))


def replaced(before: DataFrame, after: DataFrame) -> Rows:
    """What differs between two sets of rows without repeats."""
    names = before.columns
    return Rows(after.join(before, names, "left_anti").select(*names), before.join(after, names, "left_anti").select(*names))


def index_delta(index: DataFrame, changed: DataFrame, gone: DataFrame) -> Rows:
    """index(doc_path, source_path), changed(doc_path, content), gone(doc_path) -> the rows
    of the index that differ. Reads the changed documents only."""
    touched = changed.select("doc_path").unionAll(gone.select("doc_path")).distinct()
    return replaced(index.select("doc_path", "source_path").join(touched, "doc_path", "left_semi"), documents.doc_index(documents.source_refs(changed)))


@dataclass
class Deps:
    """candidates(path, specifier, rank, dst): what each import would accept, in order;
    links(path, specifier, dst): what it gets; edges(src, dst, support): the imports of src
    that get dst."""

    candidates: DataFrame
    links: DataFrame
    edges: DataFrame


def supported(links: DataFrame, sign: int = 1) -> DataFrame:
    return links.groupBy(F.col("path").alias("src"), "dst").agg(F.sum(F.lit(sign)).alias("support"))


def deps(files: DataFrame) -> Deps:
    """The whole state of files(path, content)."""
    candidates = cut(graph.candidates(graph.imports(files)))
    links = cut(graph.chosen(candidates, files.select("path")))
    return Deps(candidates, links, supported(links))


def deps_delta(state: Deps, changed: DataFrame, added: DataFrame, gone: DataFrame, known: DataFrame) -> tuple[Deps, DataFrame]:
    """(new state, changes of edges (src, dst, support)).

    changed(path, content): added and modified files, which are all that is parsed;
    added(path), gone(path): files that came and went; known(path): the files there now."""
    touched = changed.select("path").unionAll(gone.select("path")).distinct()
    fresh = cut(graph.candidates(graph.imports(changed)))
    kept = state.candidates.join(touched, "path", "left_anti")
    moved = added.select(F.col("path").alias("dst")).unionAll(gone.select(F.col("path").alias("dst"))).distinct()
    # imports of other files that name a path that came or went are decided again
    again = cut(kept.join(moved, "dst", "left_semi").select("path", "specifier").distinct())
    undecided = fresh.unionByName(kept.join(again, ["path", "specifier"], "left_semi").select(*fresh.columns))
    plus = cut(graph.chosen(undecided, known))
    minus = cut(state.links.join(touched, "path", "left_semi").unionByName(state.links.join(again, ["path", "specifier"], "left_semi").select(*state.links.columns)))
    links = state.links.join(touched, "path", "left_anti").join(again, ["path", "specifier"], "left_anti").select(*plus.columns).unionByName(plus)
    change = supported(plus).unionAll(supported(minus, -1)).groupBy("src", "dst").agg(F.sum("support").alias("support")).where("support <> 0")
    edges = state.edges.unionByName(change).groupBy("src", "dst").agg(F.sum("support").alias("support")).where("support > 0")
    return Deps(kept.unionByName(fresh.select(*kept.columns)), links, edges), change
