"""Substring search over trigram postings, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings

DOCS = "doc_id long, title string, body string"
TERMS = "term_id long, term string"


def plain(docs, terms, most):
    rows = []
    for term_id, term in terms:
        low = (term or "").lower()
        hits = [(low not in (t or "").lower(), i) for i, t, b in docs if i is not None and low and (low in (t or "").lower() or low in (b or "").lower())]
        rows += [(term_id, rank, i, not miss) for rank, (miss, i) in enumerate(sorted(hits)[:most], 1)]
    return sorted(rows)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde ?\0é😀") for _ in range(rng.randint(0, 40)))
    ids = [-40000, -1, 0, 1, 32767, 32768, 1 << 40, *range(100, 180)]
    rows = [(i, word(), word()) for i in ids]
    return [*rows, (200, None, None), (201, "", "ab"), (202, "a", None), (203, "ABC", "x" * 30000 + "needle"), (204, "same", "same"), (205, "same", "same"), (None, "abc", "abc")]


def test_search(spark, docs, tmp_path):
    rng = random.Random(6)
    texts = [t for d in docs for t in d[1:] if t]
    terms = [(0, "a"), (1, "AB"), (2, "abc"), (3, None), (4, ""), (5, "zzz"), (6, "needle"), (7, "?"), (8, "\0"), (9, "?ab"), (10, "😀"), (11, "same"), (12, "x" * 100), (13, "a\0"), (14, "zneedle")]
    for k in range(60):
        text = rng.choice(texts)
        at = rng.randrange(len(text))
        terms.append((20 + k, text[at : at + rng.randint(1, 20)]))
    index = spark.createDataFrame(docs, DOCS)
    stored = postings.write(postings.build(index), str(tmp_path / "p"))
    asked = spark.createDataFrame(terms, TERMS)
    got = postings.search(index, stored, asked, most=7)
    assert sorted(map(tuple, got.select("term_id", "rank", "doc_id", "title_hit").collect())) == plain(docs, terms, 7)
    full = postings.matches(index, stored, asked).count()
    assert full == len(plain(docs, terms, 10**9))
    [hit] = got.where("term_id = 6").collect()
    assert hit.excerpt == "…" + "x" * 40 + "needle" and hit.title == "ABC"
    assert stored.groupBy("gram", "word", "in_title").count().where("count > 1").isEmpty()


def test_empty_tables(spark, docs, tmp_path):
    none, index = spark.createDataFrame([], DOCS), spark.createDataFrame(docs, DOCS)
    empty = postings.write(postings.build(none), str(tmp_path / "e"))
    asked = spark.createDataFrame([(1, "abc"), (2, "a")], TERMS)
    assert postings.search(none, empty, asked).isEmpty()
    assert postings.search(index, postings.build(index), spark.createDataFrame([], TERMS)).isEmpty()


def test_many_terms_and_clashing_columns(spark, monkeypatch, docs):
    """Terms are verified by slots, and trigrams beyond the named ones read all postings."""
    monkeypatch.setattr(postings, "TERMS_A_ROW", 2)
    monkeypatch.setattr(postings, "NAMED", 3)
    index = spark.createDataFrame(docs, DOCS)
    terms = [(k, t) for k, t in enumerate(["same", "needle", "abcd", "dead", "eb", "xxxxx", "Same"])]
    more = index.select("*", F.lit(1).alias("low"), F.lit(2).alias("gram"), F.lit(3).alias("rank"))
    got = postings.search(more, postings.build(more), spark.createDataFrame(terms, TERMS), most=50)
    assert sorted(map(tuple, got.select("term_id", "rank", "doc_id", "title_hit").collect())) == plain(docs, terms, 50)


def test_reads_few_ranges(spark, docs, tmp_path):
    """The filter of a search for one term reaches the scan of the postings."""
    index = spark.createDataFrame(docs, DOCS)
    stored = postings.write(postings.build(index), str(tmp_path / "p"))
    plan = postings.candidates(stored, spark.createDataFrame([(1, "need")], "term_id long, low string"))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan


def test_postings_stay_where_their_texts_are(spark, docs):
    """Texts are dealt out once by their word of ids; the postings made of them never move."""
    plan = postings.build(spark.createDataFrame(docs, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(word" in plan


def test_first_hits_verify_first_candidates(spark, monkeypatch, docs):
    """Few candidates are verified where they settle a term, all where they do not."""
    monkeypatch.setattr(postings, "AHEAD", 8)
    seen, hits = [], postings.hits

    def watched(index, found, terms):
        seen.append({r.term_id: r["count"] for r in found.groupBy("term_id").count().collect()})
        return hits(index, found, terms)

    monkeypatch.setattr(postings, "hits", watched)
    rng = random.Random(9)
    rows = [(2000 + k, rng.choice(["wxyz", "wxy xyz", ""]), rng.choice(["wxyz", "wxy xyz", "other"])) for k in range(400)]
    # the trigrams of pqrs are in all of these, the string in the last ones only
    rows += [(1000 + k, "", "pqr qrs" if k < 90 else "pqrs") for k in range(100)] + docs
    terms = [(1, "wxyz"), (2, "pqrs"), (3, "wx"), (4, "needle"), (5, "")]
    index = spark.createDataFrame(rows, DOCS)
    got = postings.search(index, postings.build(index), spark.createDataFrame(terms, TERMS), most=3)
    assert sorted(map(tuple, got.select("term_id", "rank", "doc_id", "title_hit").collect())) == plain(rows, terms, 3)
    assert seen[0] == {1: 8, 2: 8, 3: 8, 4: 1} and seen[1][2] == 100 and 3 not in seen[1]
