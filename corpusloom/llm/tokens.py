"""Byte-level BPE over a public vocabulary file, and exact length statistics.

The tokenizer file is a parameter (default: the public 50k byte-level ranks). Each
Python worker builds the encoder once.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .io import cut

#: Block of lengths whose totals are summed before the suffix sums, so that no task
#: sorts more than one block of the histogram.
LENGTH_BLOCK = 4096


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_lengths(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and encoded length of every document; null and empty texts have length 0."""

    def rows(batches):
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = np.fromiter((len(encode(t)) if t else 0 for t in map(lambda v: v.as_py(), batch.column(1))), np.int64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes)], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Exact histogram of ``n_tokens`` with suffix sums.

    One row per distinct length L: ``n_docs`` of that length; ``docs_at_least`` and
    ``tokens_at_least`` over lengths >= L; ``truncated_total``, the corpus size if every
    document were cut to L tokens; ``total_tokens``; ``rank_low`` and ``rank_high``, the
    ranks (from 1) that these documents have by length. An empty table gives no row.
    """
    hist = cut(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / LENGTH_BLOCK))
    size = F.col("n_tokens") * F.col("n_docs")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(size).alias("block_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # one row per 4,096 lengths: the longest document bounds it, not the number of rows
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(every).alias("total_docs"),
        F.sum("block_tokens").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum(size).over(inside) + F.col("tokens_above")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    ).select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        "total_tokens",
        (F.col("total_docs") - F.col("docs_at_least") + 1).alias("rank_low"),
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("rank_high"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """Exact length quantiles: the length of the document of rank ceil(share * documents)."""
    total = F.col("rank_high") + F.col("docs_at_least") - F.col("n_docs")
    return hist.select(
        "n_tokens", "rank_low", "rank_high",
        F.explode(F.transform(F.array(*map(F.lit, shares)), lambda q: F.struct(q.alias("share"), F.greatest(F.lit(1), F.ceil(q * total)).alias("rank")))).alias("q"),
    ).where(F.col("q.rank").between(F.col("rank_low"), F.col("rank_high"))).select(F.col("q.share").alias("share"), "n_tokens")


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Corpus size for each context limit, sum(min(length, limit)), and the documents over it.

    A limit takes the suffix sums of the next longer length that occurs; one aggregation
    finds those of all limits. Of an empty histogram both are 0."""
    next_longer = lambda x: F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_at_least", "tokens_at_least")))
    found = hist.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"), F.array(*(F.struct(F.lit(x).cast("long").alias("context_limit"), next_longer(x).alias("next")) for x in limits)).alias("limits"))
    docs, in_docs = (F.coalesce(F.col(f"q.next.{c}"), F.lit(0)) for c in ("docs_at_least", "tokens_at_least"))
    rows = found.select("total", F.explode("limits").alias("q"))
    return rows.select(F.col("q.context_limit"), (F.col("total") - in_docs + docs * F.col("q.context_limit")).alias("truncated_total"), docs.alias("docs_over"))
