"""Content fingerprints, snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fingerprint(content: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256; empty where there is no content."""
    return F.coalesce(F.substring(F.sha2(content, 256), 1, 16), F.lit(""))


def snapshot(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, hash."""
    return files.select("path", fingerprint(F.col("content")).alias("hash"))


def diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Snapshots (path, hash) -> path, status (added, modified, deleted, unchanged), hash.

    One full outer join on path; both sides shuffle only paths and hashes."""
    status = (
        F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "deleted").when(F.col("n.hash") == F.col("o.hash"), "unchanged").otherwise("modified")
    )
    return new.alias("n").join(old.alias("o"), F.col("n.path") == F.col("o.path"), "full").select(
        F.coalesce("n.path", "o.path").alias("path"), status.alias("status"), F.coalesce("n.hash", "o.hash").alias("hash")
    )


def summary(changes: DataFrame) -> DataFrame:
    """One row: counts by status and a sentence."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = changes.agg(*map(n, ("added", "modified", "deleted", "unchanged")))
    part = lambda s: F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}")))
    text = F.concat_ws(", ", part("added"), part("modified"), part("deleted"))
    return rows.select("*", F.when(text == "", "No changes").otherwise(text).alias("summary"))


def listing(changes: DataFrame, most: int = 10) -> DataFrame:
    """changes(path, status) -> status, paths, n_more: the first ``most`` paths of each
    status, in order, and how many follow."""
    place = F.row_number().over(Window.partitionBy("status").orderBy("path"))
    first = changes.withColumn("place", place).where(F.col("place") <= most).groupBy("status").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    counts = changes.groupBy("status").count()
    return first.join(counts, "status").select("status", "paths", F.greatest(F.col("count") - most, F.lit(0)).alias("n_more"))


def commit(new: DataFrame, old: DataFrame, now: Column) -> DataFrame:
    """The snapshot to store: deleted paths drop out, first times stay, every row is touched now."""
    kept = old.select("path", "created_at")
    return new.join(kept, "path", "left").select("path", "hash", F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at"))
