"""A corpus-preparation pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``documents``:

1. toxicity: documents that the model rejects (score >= 0.3) go; it learns from all of
   ``labels`` but the held-out rows;
2. near_duplicates: one document of each group stays, five-word shingles at Jaccard
   similarity 0.8 or more;
3. pii: private values get format-preserving pseudonyms;
4. mixing: documents are repeated, cut or left out as the mix's targets ask, in training
   order;
5. bpe: ids and decoded text of every document, as digests.

Null and empty texts pass every stage but are never linked, rewritten or counted as words;
extra columns pass the first four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, jaccard, mixing, pii, toxicity
from corpusloom.llm.io import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # labels name documents of the whole table
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, jaccard.Rule(words=5, percent=80))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii.session_key(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, bpe.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix),
    ("bpe", encode),
]

#: The trained model has no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each from the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
