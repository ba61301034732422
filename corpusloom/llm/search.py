"""Ranked lexical search by windowed bucket scoring.

Documents become an index of segments. A segment holds the documents of one fixed window
of doc_ids (WINDOW of them) that a task meets: their ids and lengths, and postings, that is
for each query term the documents' places in the window with the term's occurrences there.
Document frequencies and the corpus totals are sums over segments.

A task traverses its segments for every query: each term's postings add the term's share of
the score to an array with a place for each document of the window, which fits the cache; a
set of occupied buckets, of BUCKET places each, says which of them to harvest and to clear.
Harvested scores enter a heap for each query, which the task carries from window to window,
so a task returns k rows a query. Spark ranks those, by task groups first.

A segment has all terms of its documents, so it is scored where it lies: only the k best
move. Terms are matched as whole strings (no hashing). Queries are taken in blocks of at
most BLOCK_TERMS different terms or one query: that bounds what is broadcast, whatever the
number of queries.

Defined results: documents without a term (null, empty) and queries without a term match
nothing; repeated documents and repeated queries are ranked each, equal scores by doc_id,
null last. Extra columns are ignored. Without documents or queries there is no row.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kern
from .io import cut

#: doc_ids of a window, places of a bucket.
WINDOW, BUCKET = 1 << 14, 64
#: Documents and bytes of text that one segment is made from, at most (or one document).
CHUNK_DOCS, CHUNK_BYTES = 1 << 14, 24 << 20
BLOCK_TERMS = 1 << 18
#: Task groups that are ranked before all are.
GROUPS = 64

TERM = kern.SPACE.copy()
TERM[:] = False
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SEGMENT = "low long, docs binary, lengths binary, terms binary, counts binary, places binary, tfs binary"


def terms_of(raw: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of some bytes, A-Z lower-cased, and where each starts."""
    own = TERM[raw]
    edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    at = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(kern.LOWER[raw[own]])]), start


@dataclass
class Queries:
    """A block of queries: ``names`` their ids, ``terms`` different terms, ``of`` for each
    query the numbers of its terms."""

    names: list
    terms: pa.Array
    of: list[np.ndarray]


def read_queries(queries: DataFrame):
    """Blocks of (item_id, text) rows, read row by row from the cluster."""
    names, texts, known = [], [], set()

    def block() -> Queries:
        order = pa.array(sorted(known), pa.binary())
        number = {t: i for i, t in enumerate(order.to_pylist())}
        return Queries(names, order, [np.array(sorted(number[t] for t in own), np.int64) for own in texts])

    for name, text in queries.select("item_id", "text").toLocalIterator():
        own = set(terms_of(np.frombuffer((text or "").encode(), np.uint8))[0].to_pylist())
        if texts and len(known | own) > BLOCK_TERMS:
            yield block()
            names, texts, known = [], [], set()
        names.append(name)
        texts.append(own)
        known |= own
    if texts:
        yield block()


def segments_of(ids: list, raws: list[np.ndarray], terms: pa.Array):
    """The segments of some documents."""
    raw = np.concatenate([x for r in raws for x in (r, np.array([32], np.uint8))])
    ends = np.cumsum([len(r) + 1 for r in raws])
    found, start = terms_of(raw)
    doc = np.searchsorted(ends, start, "right")
    length = np.bincount(doc, minlength=len(ids))
    number = pc.index_in(found, value_set=terms)
    hit = number.is_valid().to_numpy(zero_copy_only=False)
    doc, term = doc[hit], number.drop_null().to_numpy().astype(np.int64)
    # windows, then documents by id; null has a window of its own
    low = np.array([-1 if i is None else i // WINDOW for i in ids], np.int64)
    none = np.array([i is None for i in ids])
    order = np.lexsort((np.array([i or 0 for i in ids], np.int64), low, none))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    change = np.flatnonzero((np.diff(low[order], prepend=low[order][0] - 1) != 0) | (np.diff(none[order], prepend=False)))
    bounds = np.append(change, len(ids))
    key, tf = np.unique(rank[doc] * len(terms) + term, return_counts=True) if len(terms) else (doc[:0], doc[:0])
    place, term = np.divmod(key, max(1, len(terms)))
    part = np.searchsorted(place, bounds)
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        own = slice(part[k], part[k + 1])
        by = np.argsort(term[own], kind="stable")
        numbers, counts = np.unique(term[own], return_counts=True)
        docs = order[a:b]
        yield (
            None if none[docs[0]] else int(low[docs[0]]) * WINDOW, np.array([ids[i] or 0 for i in docs], "<i8").tobytes(), length[docs].astype("<i8").tobytes(),
            numbers.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), (place[own][by] - a).astype("<i4").tobytes(), tf[own][by].astype("<i4").tobytes(),
        )


def index(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """The segments of all documents, with postings of the given terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def made(ids, raws):
        columns = list(zip(*segments_of(ids, raws, shared.value), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], [c.split()[0] for c in SEGMENT.split(", ")])

    def rows(batches):
        ids, raws, held = [], [], 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), kern.byte_rows(batch.column(1)), strict=True):
                if ids and (len(ids) == CHUNK_DOCS or held + len(raw) > CHUNK_BYTES):
                    yield made(ids, raws)
                    ids, raws, held = [], [], 0
                ids.append(doc)
                raws.append(raw.copy())
                held += len(raw)
        if ids:
            yield made(ids, raws)

    return docs.select("doc_id", "text").mapInArrow(rows, SEGMENT)


def corpus_totals(segments: DataFrame) -> tuple[int, int, DataFrame]:
    """Documents with a term, all their terms, and (term, df) of the terms met."""

    def sums(batches):
        for batch in batches:
            sizes = [np.frombuffer(b, "<i8") for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int((s > 0).sum()) for s in sizes], pa.int64()), pa.array([int(s.sum()) for s in sizes], pa.int64())], ["n", "l"])

    def frequencies(batches):
        for batch in batches:
            numbers = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            counts = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4")
            own, at = np.unique(numbers, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.bincount(at, counts, len(own)).astype(np.int64))], ["term", "df"])

    n, total = segments.select("lengths").mapInArrow(sums, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return n or 0, total or 0, segments.select("terms", "counts").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def score_segments(batches, queries: Queries, weights: np.ndarray, n: int, total: int, k: int):
    """(query number, score, doc_id) of the k best of each query in these segments."""
    heaps: list[list] = [[] for _ in queries.of]
    room = 0
    for batch in batches:
        for low, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            docs, lengths = (np.frombuffer(x, "<i8") for x in raw[:2])
            terms, counts, places, tfs = (np.frombuffer(x, "<i4").astype(np.int64) for x in raw[2:])
            if len(docs) > room:
                room = -(-len(docs) // BUCKET) * BUCKET
                scores, occupied = np.zeros(room, np.int64), np.zeros(room // BUCKET, bool)
            # a share depends on term and document only: once for all queries
            m = 100 - 90 + (90 * lengths * n) // total
            shares = np.repeat(weights[terms], counts) * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[places]))
            bounds, buckets = np.concatenate(([0], np.cumsum(counts))), places // BUCKET
            table = scores.reshape(-1, BUCKET)
            for q, wanted in enumerate(queries.of):
                at = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
                at = at[terms[at] == wanted] if len(terms) else at[:0]
                if not len(at):
                    continue
                for t in at:
                    own = slice(bounds[t], bounds[t + 1])
                    scores[places[own]] += shares[own]
                    occupied[buckets[own]] = True
                touched = np.flatnonzero(occupied)
                held, heap = table[touched], heaps[q]
                least = heap[0][0] if len(heap) == k else 1
                rows, columns = np.nonzero(held >= max(1, least))
                values = held[rows, columns]
                if len(values) > k:  # places are in order of doc_id, so the first of equal scores stay
                    keep = np.argsort(-values, kind="stable")[:k]
                    rows, columns, values = rows[keep], columns[keep], values[keep]
                for place, value in zip((touched[rows] * BUCKET + columns).tolist(), values.tolist(), strict=True):
                    doc = None if low is None else int(docs[place])
                    entry = (value, 0 if doc is None else 1, 0 if doc is None else -doc, doc)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry[:3] > heap[0][:3]:
                        heapq.heapreplace(heap, entry)
                table[touched] = 0
                occupied[touched] = False
    for q, heap in enumerate(heaps):
        for value, _, _, doc in heap:
            yield q, value, doc


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    segments = cut(index(docs, queries.terms))
    n, total, frequencies = corpus_totals(segments)
    weights = np.zeros(len(queries.terms), np.int64)
    for term, df in frequencies.collect():  # at most BLOCK_TERMS rows, or one query's terms
        weights[term] = weight(n, df)
    shared = docs.sparkSession.sparkContext.broadcast((queries, weights))

    def rows(batches):
        from pyspark import TaskContext

        own, weights = shared.value
        found = list(zip(*score_segments(batches, own, weights, n, total, k), strict=True)) or [(), (), ()]
        group = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[0], pa.int64()), pa.array([own.names[q] for q in found[0]], pa.int64()), pa.array([group] * len(found[0]), pa.int32()), pa.array(found[2], pa.int64()), pa.array(found[1], pa.int64())],
            ["query", "item_id", "grp", "doc_id", "score"],
        )

    # a segment without a term of some document scores nothing, and there total may be 0
    scored = segments.where(F.octet_length("terms") > 0).mapInArrow(rows, "query long, item_id long, grp int, doc_id long, score long")
    return best(best(scored, ["query", "grp"], k).drop("rank"), ["query"], k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of each query row (item_id, text): item_id, rank from
    1, doc_id, score. Each block of queries reads the documents once."""
    found = None
    for block in read_queries(queries):
        rows = search_block(docs, block, k)
        found = rows if found is None else found.unionAll(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
