"""Substring search over postings of character trigrams, for many terms at once.

A posting holds, as bits, which of 64 consecutive ids have a trigram in their title or body:
rows of one width, however common a trigram. A trigram is three code points of four bytes
each. Texts are padded with two NUL characters, and every position starts a trigram; a term
of one or two characters is then found by the trigrams that it begins. Texts are dealt out by
their word of ids, so that each task makes all postings of its words and no posting moves:
a file is a segment of some words, sorted by trigram and word, written without dictionaries
in Parquet's second format, which delta-codes the sorted trigrams and words, and read by
ranges of trigrams. Lists intersect by AND, word by word.

Null titles and bodies hold nothing; null and empty terms find nothing; ids are unique
(rows that share one are found by what any of them holds); rows without an id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from . import navigation
from .lineage import stored

#: lists intersected for a term, the shortest ones; longer terms are verified anyway
LISTS = 8
#: up to so many trigrams are named in the filter of the read
NAMED = 1000
#: terms verified side by side on one row
TERMS_A_ROW = 1000
#: candidates of a term that a search for its first hits verifies before all others
AHEAD = 1000
#: up to so many ids go to every task to pick their texts, which then move alone
NEAR = 100_000


def units(text: Column) -> Column:
    """The code points of a text, four bytes each."""
    return F.encode(text, "UTF-32")


def trigrams(text: Column) -> Column:
    """The different trigrams of a text of three characters at least."""
    starts = F.sequence(F.lit(0), F.length(text) - 3)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(units(text), i * 4 + 1, F.lit(12))))


def build(index: DataFrame) -> DataFrame:
    """index(doc_id long, title, body) -> gram, word, in_title, mask."""
    number = F.col("doc_id")
    rows = index.where("doc_id is not null").select(bits.word(number).alias("word"), bits.bit(number).alias("mask"), "title", "body").repartition("word")
    fields = F.inline(F.array(*(F.struct(F.lit(name == "title").alias("in_title"), F.col(name).alias("text")) for name in ("title", "body"))))
    rows = rows.select("word", "mask", fields).where("text <> ''")
    rows = rows.select("word", "mask", "in_title", units(F.concat(F.lower("text"), F.lit("\0\0"))).alias("units"))
    # a row for each position, whose trigram the aggregation takes: no arrays of trigrams
    starts = F.sequence(F.lit(0), (F.octet_length("units") / 4).cast("int") - 3)
    rows = rows.select("word", "mask", "in_title", "units", F.explode(starts).alias("at"))
    gram = F.substring("units", F.col("at") * 4 + 1, F.lit(12))
    return rows.groupBy(gram.alias("gram"), "word", "in_title").agg(F.bit_or("mask").alias("mask"))


def write(postings: DataFrame, path: str) -> DataFrame:
    """Writes postings in sorted, delta-coded segments; the table read again."""
    ordered = postings.sortWithinPartitions("gram", "word")
    ordered.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").parquet(path)
    return read(postings.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _narrowed(postings: DataFrame, grams: DataFrame) -> DataFrame:
    """Postings, without the ranges that cannot hold one of a few trigrams."""
    named = [r[0] for r in grams.limit(NAMED + 1).collect()]
    return postings.where(F.col("gram").isin(named)) if len(named) <= NAMED else postings


def lists(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """terms(term_id, low) -> term_id, word, titles, bodies: as bits, every document that may
    hold the term, and where; some of them may not."""
    # terms of three characters and more: the documents that all of their rarest lists share
    wanted = terms.where(F.length("low") >= 3).select("term_id", F.explode(trigrams(F.col("low"))).alias("gram"))
    some = _narrowed(postings, wanted.select("gram").distinct())
    sizes = some.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum(F.bit_count("mask")).alias("size"))
    of_term = Window.partitionBy("term_id")
    ranked = wanted.join(sizes, "gram", "left").withColumn("rank", F.row_number().over(of_term.orderBy(F.coalesce("size", F.lit(0)), "gram")))
    chosen = ranked.where(F.col("rank") <= LISTS).withColumn("n_lists", F.count(F.lit(1)).over(of_term)).select("term_id", "gram", "n_lists")
    title, body = F.when(F.col("in_title"), F.col("mask")), F.when(~F.col("in_title"), F.col("mask"))
    none = F.lit(0).cast("long")

    def shared(mask: Column) -> Column:
        return F.when(F.count(mask) == F.max("n_lists"), F.bit_and(mask)).otherwise(none)

    full = some.join(chosen, "gram").groupBy("term_id", "word").agg(shared(title).alias("titles"), shared(body).alias("bodies"))
    # shorter ones: the documents of every trigram that begins with the term
    short = terms.where(F.length("low").between(1, 2)).withColumn("start", units(F.col("low")))
    begun = postings.select("gram").distinct().join(short, F.substring("gram", 1, 4) == F.substring("start", 1, 4)).where(F.startswith("gram", "start"))
    prefix = postings.join(begun, "gram").groupBy("term_id", "word").agg(F.coalesce(F.bit_or(title), none).alias("titles"), F.coalesce(F.bit_or(body), none).alias("bodies"))
    return full.unionAll(prefix).where("titles <> 0 or bodies <> 0")


def unpacked(words: DataFrame) -> DataFrame:
    """Lists as rows: term_id, doc_id, in_title, in_body."""
    some_of = bits.members(F.col("word"), F.col("titles").bitwiseOR(F.col("bodies")))
    at = F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    rows = words.select("term_id", "titles", "bodies", F.explode(some_of).alias("doc_id"))
    return rows.select("term_id", "doc_id", (F.getbit("titles", at) == 1).alias("in_title"), (F.getbit("bodies", at) == 1).alias("in_body"))


def candidates(postings: DataFrame, terms: DataFrame) -> DataFrame:
    return unpacked(lists(postings, terms))


def head(words: DataFrame, n: int) -> DataFrame:
    """The first ``n`` candidates of every term, those by title first, then by id, with their
    rank. Words beyond them are left out before they are unpacked."""
    before = Window.partitionBy("term_id").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    others = F.col("bodies").bitwiseAND(F.bitwise_not(F.col("titles")))

    def early(mask: Column) -> Column:
        return F.when(F.coalesce(F.sum(F.bit_count(mask)).over(before), F.lit(0)) < n, mask).otherwise(F.lit(0).cast("long"))

    kept = words.select("term_id", "word", "titles", "bodies", early(F.col("titles")).bitwiseOR(early(others)).alias("kept"))
    kept = kept.where("kept <> 0").select("term_id", "word", F.col("titles").bitwiseAND(F.col("kept")).alias("titles"), F.col("bodies").bitwiseAND(F.col("kept")).alias("bodies"))
    order = Window.partitionBy("term_id").orderBy(F.desc("in_title"), "doc_id")
    return unpacked(kept).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def texts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, title, body of the wanted ids at least; of no others, if they are few."""
    ids, rows = stored(wanted.select("doc_id").distinct()), index.select("doc_id", "title", "body")
    return rows.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= NEAR else rows


def matches(index: DataFrame, postings: DataFrame, terms: DataFrame) -> DataFrame:
    """terms(term_id, term), ids unique -> term_id, doc_id, title_hit: every document whose
    title or body holds the term, in any case. Terms of up to three characters are settled by
    their trigrams; for others, each document's text meets all of its candidates at once."""
    terms = lowered(terms)
    return hits(index, candidates(postings, terms), terms)


def lowered(terms: DataFrame) -> DataFrame:
    return terms.select("term_id", F.lower("term").alias("low")).where("low <> ''")


def hits(index: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates of terms(term_id, low) that hold their term: term_id, doc_id, title_hit."""
    # padding looks like NUL in a trigram, and what is no UTF-8 like U+FFFD
    sure = (F.length("low") <= 3) & ~F.col("low").rlike("[\ufffd\0]")
    found = found.join(terms.withColumn("sure", sure), "term_id")
    slots = terms.count() // TERMS_A_ROW + 1
    slot = F.pmod(F.xxhash64("term_id"), F.lit(slots))
    asked = found.where("not sure").groupBy("doc_id", slot.alias("slot")).agg(F.collect_list(F.struct("term_id", "low", "in_title", "in_body")).alias("asked"))
    read = index.select("doc_id", "title", "body").join(asked, "doc_id")
    # the array of one struct binds the lowered texts, which every term would lower again
    low = F.array(F.struct(F.lower("title").alias("title"), F.lower("body").alias("body")))

    def settle(t: Column, a: Column) -> Column:
        in_title = F.when(a["in_title"], t["title"].contains(a["low"])).otherwise(False)
        in_body = F.when(a["in_body"], t["body"].contains(a["low"])).otherwise(False)
        return F.struct(a["term_id"].alias("term_id"), in_title.alias("title_hit"), in_body.alias("body_hit"))

    settled = F.flatten(F.transform(low, lambda t: F.transform("asked", lambda a: settle(t, a))))
    verified = read.select("doc_id", F.inline(settled)).where("title_hit or body_hit").select("term_id", "doc_id", "title_hit")
    return verified.unionAll(found.where("sure").select("term_id", "doc_id", F.col("in_title").alias("title_hit")))


def search(index: DataFrame, postings: DataFrame, terms: DataFrame, most: int = 20) -> DataFrame:
    """Each term's first ``most`` hits, title hits first, then by id: term_id, rank, doc_id,
    title, title_hit, excerpt.

    A hit never comes before its candidate's place, as only a title hit can turn out none. So
    the first candidates are verified, and all others only of the terms for which hits before
    the next candidate are fewer than ``most``."""
    asked = lowered(terms)
    words = stored(lists(postings, asked))
    ahead = max(AHEAD, most)
    first = stored(head(words, ahead + 1))
    now = first.where(F.col("place") <= ahead)
    found = stored(hits(texts(index, now), now, asked))
    following = first.where(F.col("place") > ahead).select("term_id", F.col("in_title").alias("next_title"), F.col("doc_id").alias("next_id"))
    certain = found.join(following, "term_id").where("(title_hit and not next_title) or (title_hit = next_title and doc_id < next_id)")
    settled = certain.groupBy("term_id").count().where(F.col("count") >= most)
    more = stored(following.select("term_id").join(settled, "term_id", "left_anti"))
    if not more.isEmpty():
        rest = hits(index, unpacked(words.join(more, "term_id", "left_semi")), asked)
        found = found.join(more, "term_id", "left_anti").unionAll(rest)
    order = Window.partitionBy("term_id").orderBy(F.desc("title_hit"), "doc_id")
    top = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most))
    top_texts, top = texts(index, top), top.join(terms.select("term_id", F.lower("term").alias("low")), "term_id")
    return top_texts.join(top, "doc_id").select("term_id", "rank", "doc_id", "title", "title_hit", navigation.excerpt(F.col("body"), F.col("low")).alias("excerpt"))
