"""Nearest neighbours by largest inner product: a hash-prefix forest.

Vectors are dealt by hash to shards of about ``SHARD_ROWS``. A shard holds ``TREES``
trees; a tree is the sorted array of its vectors' hash strings. A string spells a vector's
``CHARS`` largest coordinates, with their signs, after a random rotation (cross-polytope
hashing) of the lift that turns inner products into angles. A query descends every tree to
its longest-prefix match, then ascends all trees in step, shortening the prefix by one
character, until the matching ranges hold enough candidates; candidates are then compared
exactly, in double precision, and the shards' best lists are merged.

The stated query set meets all rows in blocks (queries x shard), so no task holds more
than one shard and one block of queries, however vectors cluster; equal vectors share all
hash strings and are found together. A block has so many queries that a shard's forest is
built for few of them.

Recall depends on ``TREES``: a prefix of one character holds about 1 in 2 * dimensions of a
shard's isotropic vectors. The README gives recall and the share of a shard compared.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows without id. Queries meet candidates of their own length only. A row
that repeats (id and vector) counts once, and a query's candidates exclude its id. Fewer
than ``k`` candidates are all returned. Empty tables give no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 8192
QUERY_BLOCK = 4096
TREES, CHARS = 80, 3
#: Entries to collect from the trees' ranges, relative to a shard's rows.
SHARE = 0.3
#: Entries to collect at least, a neighbour asked for: small shards are compared nearly in full.
FLOOR = 32
SEED = 97
FOUND = "query_id long, vec_id long, score double"


class Forest:
    """Sorted hash strings of one shard's vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, chars: int = CHARS):
        n, dims = vectors.shape
        self.vectors, self.chars = vectors, min(chars, dims + 1)
        self.width = (2 * dims + 1).bit_length()  # bits of a character
        squares = np.einsum("ij,ij->i", vectors, vectors)
        random = np.random.default_rng(SEED)
        self.rotations = [np.linalg.qr(random.standard_normal((dims + 1, dims + 1)))[0] for _ in range(trees)]
        keys = self.strings(np.column_stack((vectors, np.sqrt(np.maximum(squares.max() - squares, 0.0)))))
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def strings(self, lifted: np.ndarray) -> np.ndarray:
        """Hash strings as integers, first character highest: trees x rows."""
        out = np.empty((len(self.rotations), len(lifted)), np.int64)
        for k, rotation in enumerate(self.rotations):
            turned = lifted @ rotation
            size, row = np.abs(turned), np.arange(len(turned))
            out[k] = 0
            for _ in range(self.chars):
                top = size.argmax(axis=1)
                out[k] = (out[k] << self.width) + 2 * top + (turned[row, top] > 0)
                size[row, top] = -1.0
        return out

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query, the distinct rows of its matching ranges."""
        n, trees = len(self.vectors), len(self.order)
        strings = self.strings(np.column_stack((queries, np.zeros(len(queries)))))
        low = np.zeros((trees, len(queries)), np.int64)
        high = np.full_like(low, n)
        open_ = np.ones(len(queries), bool)
        for less in range(self.chars + 1):  # prefixes of chars - less characters, longest first
            shed = less * self.width
            first = strings >> shed << shed
            at = np.flatnonzero(open_)
            lo = np.stack([np.searchsorted(k, f) for k, f in zip(self.keys, first[:, at], strict=True)])
            hi = np.stack([np.searchsorted(k, f + (1 << shed)) for k, f in zip(self.keys, first[:, at], strict=True)])
            low[:, at], high[:, at] = lo, hi
            open_[at] = (hi - lo).sum(0) < enough
            if not open_.any():
                break
        for q in range(len(queries)):
            seen = np.zeros(n, bool)
            for t in range(trees):
                seen[self.order[t, low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(seen)


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(points: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE) -> DataFrame:
    """points and queries (vec_id, embedding) -> query_id, rank, vec_id, score."""
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct().withColumn("dims", F.size("vector"))
    points, queries = clean(points), clean(queries)
    shards = max(1, -(-points.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.select("*", deal(shards).alias("shard"), every(blocks).alias("block"))
    right = queries.select("*", every(shards).alias("shard"), deal(blocks).alias("block"))

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        rows = rows.sort_values("vec_id", kind="stable")
        ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_list())
        wanted = np.stack(asked["vector"].to_list())
        forest = Forest(vectors)
        out = []
        for query, own, near in zip(asked["vec_id"], wanted, forest.candidates(wanted, max(int(share * len(ids)), FLOOR * k)), strict=True):
            near = near[ids[near] != query]
            scores = (vectors[near] * own).sum(axis=1)  # the same order of sums for every row
            if len(near) > k:  # keep ties with the k-th for the order by id
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                near, scores = near[scores >= least], scores[scores >= least]
            best = np.lexsort((ids[near], -scores))[:k]
            out.append((np.full(len(best), query), ids[near][best], scores[best]))
        q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    keys = ["dims", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def exact(points: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The same by comparing all pairs in blocks: the measure of recall, for tests."""
    return search(points, queries, k, share=float(TREES + 1))
