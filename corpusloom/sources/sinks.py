"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .writer import write_files


def save(df: DataFrame, path: str) -> None:
    """A derived table in the store: Parquet, replaced as a whole."""
    df.write.mode("overwrite").parquet(path)


def load(spark, path: str, schema: str, required: bool = False) -> DataFrame:
    """A stored table, or an empty one of ``schema`` where there is none yet; a ``required``
    table that is missing is an error."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if required or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, in column ``json``."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def save_json(df: DataFrame, path: str, root: str) -> int:
    """A pretty JSON file a row, at the path that column ``path`` holds, which is not part of it."""
    cells = F.struct(*(c for c in df.columns if c != path))
    return write_files(df.select(F.col(path).alias("path"), F.to_json(cells, {"pretty": "true"}).alias("text")), root)


def rewrite(docs: DataFrame, root: str) -> int:
    """docs(doc_path, content, n_replaced): writes those with a replacement, and no others."""
    return write_files(docs.where("n_replaced > 0").select(F.col("doc_path").alias("path"), F.col("content").alias("text")), root)


def audit_report(levels: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_path, json: a document's report with its issues."""
    found = issues.groupBy("doc_path").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    named = {"n_lines": "lineCount", "n_sections": "sectionCount", "n_diagrams": "diagramCount", "n_examples": "codeExampleCount", "n_tables": "tableCount", "n_links": "crossLinkCount", "traced": "hasSourceTracing", "level": "qualityLevel"}
    cells = [F.col("doc_path").alias("filePath"), *(F.col(a).alias(b) for a, b in named.items()), F.coalesce("issues", F.array().cast("array<string>")).alias("issues")]
    return levels.join(found, "doc_path", "left").select("doc_path", F.to_json(F.struct(*cells)).alias("json"))
