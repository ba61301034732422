"""Translation state: configuration, status, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def short_hash(text: Column) -> Column:
    """The first 12 hexadecimal digits of SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(text, 256), 1, 12)


def languages(configs: DataFrame) -> DataFrame:
    """configs(language) such as "zh/en" -> language, the primary one and the secondary ones."""
    parts = F.split("language", "/")
    return configs.select("language", F.trim(F.get(parts, F.lit(0))).alias("first"), F.size(parts).cast("long").alias("n"), F.concat_ws(",", F.slice(parts, 2, 100)).alias("others"))


def available(configs: DataFrame, folders: DataFrame) -> DataFrame:
    """configs(project, language), folders(project, folder) -> project, lang, folder: the
    configured languages that have a folder, wiki for the first and wiki_xx for others."""
    wanted = configs.select("project", F.posexplode(F.split("language", "/")).alias("place", "lang"))
    wanted = wanted.withColumn("folder", F.when(F.col("place") == 0, "wiki").otherwise(F.concat(F.lit("wiki_"), "lang")))
    return wanted.join(folders, ["project", "folder"], "left_semi").select("project", "lang", "folder")


def language_of_dir(folder: Column) -> Column:
    """wiki_xx -> xx where xx is a supported language, else en."""
    code = F.regexp_extract(folder, r"wiki_([a-z]{2})$", 1)
    return F.when(code.isin(*rules.LABELS), code).otherwise("en")


def status(sources: DataFrame, targets: DataFrame, memory: DataFrame) -> DataFrame:
    """sources(lang, file, hash), targets(lang, file), memory(lang, file, hash) ->
    lang, file, status: synced, outdated or missing."""
    rows = sources.alias("s").join(targets.withColumn("there", F.lit(True)), ["lang", "file"], "left")
    rows = rows.join(memory.withColumnRenamed("hash", "known"), ["lang", "file"], "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("known") == F.col("hash"), "synced").otherwise("outdated")
    return rows.select("lang", "file", state.alias("status"), "hash")


def counts(states: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return states.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), n("synced"), n("outdated"), n("missing"))


def sync(memory: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The memory after a run: pairs with a target take their source's hash, others stay."""
    fresh = sources.join(targets, ["lang", "file"], "left_semi").select("lang", "file", F.col("hash").alias("new"))
    return memory.join(fresh, ["lang", "file"], "full").select("lang", "file", F.coalesce("new", "hash").alias("hash"))
