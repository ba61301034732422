"""Mixing sources to target weights along a time-varying curriculum.

Sources, by code point with null last, weigh 5, 2, 1 and so on again. Together they
receive 150 % of all words; no source more than twice its size, the excess being shared
out again by weight (water filling, solved in closed form over the sorted sources).

A source's weight is a linear ramp over training time t in [0, 1]: target * (1 + a(2t - 1))
with slope a. Its integral is the source's cumulative demand; the documents of a source,
in an order fixed by hash, supply it back to back, pass after pass, so inverting the
integral at a document's offset gives its training position. The last document taken
gives only the words still due. Positions order the mix by range partitioning.

Offsets are prefix sums in two levels (hash bucket totals, then within a bucket), so a
source with a third of all rows is never one task's work. Only DataFrame functions.

Defined results: a null text has size 0; a source of size 0 has target 0; a null source
is a source of its own, last. Repeated rows are documents of their own; equal rows are
interchangeable. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .io import unused

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
#: Slope of the ramp of a source, by its rank: later, evenly, earlier.
SLOPES = (0.5, 0.0, -0.5)
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame) -> DataFrame:
    """per_source(source, source_size) -> source, source_size, weight, slope, target.

    Its windows run over one row per source."""
    ranked = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(ranked) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))
    rows = per_source.select("source", "source_size", pick(WEIGHTS).alias("weight"), pick(SLOPES).alias("slope"))
    cap = F.col("source_size") * F.lit(MOST_REPEATS)
    rows = rows.withColumn("cap", cap).withColumn("full_at", cap / F.col("weight"))
    every, filled = Window.partitionBy(), Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(0, Window.unboundedFollowing)
    # the level at which all sources from this one on would stand, the earlier ones being full
    level = (F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "weight", "slope", "target")


def position(offset: Column, target: Column, slope: Column) -> Column:
    """The time t at which a source's integrated weight reaches ``offset`` words:
    t + slope * (t**2 - t) = offset / target."""
    share = F.least(F.lit(1.0), offset / target)
    ramp = ((slope - 1.0) + F.sqrt((F.lit(1.0) - slope) ** 2 + slope * share * 4.0)) / (slope * 2.0)
    return F.when(slope == 0.0, share).otherwise(ramp)


def schedule(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, the words of each
    pass (``first_words``, ``second_words``) and the training positions of both; and
    ``text_hash``, by which the documents of one id find their own row."""
    # the first 60 bits of MD5: a fixed order that other engines can follow
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("source"))), 1, 15), 16, 10).cast("long")
    rows = docs.select("doc_id", "source", sizes(F.col("text")).alias("size"), order.alias("draw"), F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    own = Window.partitionBy("source")
    before = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_source = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    starts = buckets.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("start"))
    starts = starts.join(per_source, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    first = F.col("start") + F.col("within")
    words = lambda offset: F.greatest(F.lit(0), F.least("size", F.floor("target") - offset))
    rows = rows.withColumn("first_words", words(first)).withColumn("second_words", words(first + F.col("source_size")))
    taken_at = lambda n, offset: F.when(F.col(n) > 0, position(offset.cast("double"), F.col("target"), F.col("slope")))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("first_words") + F.col("second_words")).alias("taken"),
        "first_words", "second_words",
        taken_at("first_words", first).alias("first_position"),
        taken_at("second_words", first + F.col("source_size")).alias("second_position"),
        "text_hash",
    )


def in_order(rows: DataFrame, at: str) -> DataFrame:
    """Range-sorts rows by position; those without one come last."""
    key = F.struct(F.coalesce(F.col(at), F.lit(2.0)), F.xxhash64("doc_id"))  # the hash spreads those without
    place = unused(rows, "at")
    return rows.withColumn(place, key).repartitionByRange(place).sortWithinPartitions(place).drop(place)


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with all their columns, in training order: a document
    once for each pass that takes it; a pass that takes only its first words cuts it there.

    Documents without words are no part of any demand and stay, once, at the end. Rows
    equal in doc_id, source and text are numbered, and each number takes one row of the
    schedule: such copies are interchangeable."""
    doc, source, text_hash, nth, size, take, at = (unused(docs, n) for n in ("doc", "from_source", "text_hash", "nth", "size", "take", "at"))
    key = ("doc_id", "source", "text_hash")
    numbered = F.row_number().over(Window.partitionBy(*key).orderBy("first_position", "first_words", "second_position"))
    plan = schedule(docs).select(
        F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("text_hash").alias(text_hash), numbered.alias(nth), F.col("size").alias(size),
        F.array(*(F.struct(F.col(f"{k}_position").alias("position"), F.col(f"{k}_words").alias("words")) for k in ("first", "second"))).alias(take),
    )
    copy, own_hash = unused(docs, "copy"), unused(docs, "own_hash")
    own = docs.withColumn(own_hash, F.xxhash64("text"))
    own = own.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", "source", own_hash).orderBy(own_hash)))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own_hash) == F.col(text_hash)) & (F.col(copy) == F.col(nth))
    once = F.array(F.struct(F.lit(2.0).alias("position"), F.lit(0).cast("long").alias("words")))
    takes = F.when(F.col(size) == 0, once).otherwise(F.filter(take, lambda t: t["words"] > 0))
    rows = own.join(plan, same).select(*(F.col(c) for c in docs.columns), size, F.explode(takes).alias(take))
    words = F.col(f"{take}.words")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("text", F.when(words < F.col(size), cut).otherwise(F.col("text"))).withColumn(at, F.struct(F.col(f"{take}.position"), F.xxhash64("doc_id")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(words < F.col(size), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    rows = rows.repartitionByRange(at).sortWithinPartitions(at)
    return rows.select(*docs.columns)
