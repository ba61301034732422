"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Training: a bounded sample of labelled rows (``SAMPLE_ROWS``, the smallest by hash of
doc_id) is dealt to shards of at most about ``SHARD_ROWS`` rows. Each shard runs FTRL-proximal over its rows
with a rate per coordinate; then each coordinate is averaged over the shards that met it
(parameter mixing). L1 leaves few non-zero weights: the model is
a sparse table of at most 2**BITS rows, small enough to broadcast.

Features of a text: its lower-case words, word pairs, and pairs that skip one
word, each counted once, hashed to 2**BITS coordinates.

Defined results: null and empty texts have only the bias and are scored like any other.
Rows without label, with a null label or doc_id, train nothing. A doc_id labelled twice
trains once a distinct label. Without any training row every score is 0.5. Repeated rows
are scored each. Extra columns are ignored, never used as inputs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kern
from .io import cut

BITS = 20
SAMPLE_ROWS = 36_000
#: Rows of a shard at most, so that one task's features stay under 100 MB on usual texts.
SHARD_ROWS = 12_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 1.0
THRESHOLD = 0.3
_PAIR, _SKIP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
MODEL = "feature int, z double, n double"


def words(buf: np.ndarray) -> np.ndarray:
    """Fingerprints of the words: runs of ASCII letters, digits and non-ASCII bytes, with
    A-Z and the capitals of Latin-1 in lower case."""
    low = kern.LOWER[buf]
    if len(low) > 1:
        second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[second] += 32
    edge = np.zeros(len(low) + 2, np.int8)
    edge[1:-1] = _LETTER[low]
    step = np.diff(edge)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return kern.span_hash(kern.prefix_sums(low), start, end) if len(start) else np.zeros(0, np.uint64)


def features(buf: np.ndarray) -> np.ndarray:
    """Distinct coordinates of a text; coordinate 0 is the bias."""
    own = words(buf)
    grams = [own]
    if len(own) > 1:
        grams.append(kern.mix(own[:-1] * _PAIR + own[1:]))
    if len(own) > 2:
        grams.append(kern.mix(own[:-2] * _SKIP + own[2:]))
    found = np.concatenate(grams) % np.uint64((1 << BITS) - 1) + np.uint64(1)
    return np.concatenate(([0], np.unique(found).astype(np.int64)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed-form FTRL-proximal weights; zero wherever |z| <= L1. The bias, of
    coordinate 0, is penalised as the others are."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def probability(total: float | np.ndarray) -> float | np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def learn(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over (coordinates, label) rows; changes z and n."""
    for at, label in rows:
        zi, ni = z[at], n[at]
        w = weights(zi, ni)
        g = float(probability(w.sum()) - label)
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[at] = zi + g - sigma * w
        n[at] = ni + g * g


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """The bounded sample: doc_id, label, text, shard."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    order = F.xxhash64("doc_id")
    sample = known.orderBy(order, "doc_id", "label").limit(SAMPLE_ROWS)
    shards = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / SHARD_ROWS))
    sample = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), shards).cast("int"))
    # at most SAMPLE_ROWS rows of (id, label, shard), under 1 MB, meet the documents without moving a text
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """Rows (feature, z, n) of the model, in the shared checkpoint folder.

    Rows of ``docs`` that repeat an id and a text train once; an id with several texts
    trains each."""

    def featurise(batches):
        seen = set()  # of the sample's rows only
        for batch in batches:
            first, coords = [], []
            for k, (doc, label, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), kern.byte_rows(batch.column(3)), strict=True)):
                row = doc, label, hashlib.sha256(raw).digest()
                if row not in seen:
                    seen.add(row)
                    first.append(k)
                    coords.append(features(raw).astype(np.int32))
            kept = batch.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.array(coords, pa.list_(pa.int32()))], ["doc_id", "label", "shard", "coords"])

    rows = training_rows(docs, labels, usable).select(F.col("doc_id").cast("long").alias("doc_id"), "label", "shard", "text")
    rows = rows.mapInArrow(featurise, "doc_id long, label int, shard int, coords array<int>")

    def learn_shard(data: pd.DataFrame) -> pd.DataFrame:
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        own = {(d, y, np.asarray(c).tobytes()): (np.asarray(c), int(y)) for d, y, c in zip(data["doc_id"], data["label"], data["coords"], strict=True)}
        items = [own[key] for key in sorted(own)]
        for turn in range(EPOCHS):
            np.random.default_rng(turn).shuffle(items)
            learn(items, z, n)
        hit = np.flatnonzero(n)
        return pd.DataFrame({"feature": hit.astype(np.int32), "z": z[hit], "n": n[hit]})

    # a coordinate is averaged over the shards that met it
    shards = rows.groupBy("shard").applyInPandas(learn_shard, MODEL)
    return cut(shards.groupBy("feature").agg(F.avg("z").alias("z"), F.avg("n").alias("n")))


def compact(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero weights: at most 2**BITS pairs (12 MB), far fewer under L1."""
    rows = model.where(F.abs("z") > L1).orderBy("feature").toPandas()
    return rows["feature"].to_numpy(np.int64), weights(rows["z"].to_numpy(float), rows["n"].to_numpy(float))


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, score, predicted of every document. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(compact(model))

    def rows(batches):
        dense = _dense(shared)
        for batch in batches:
            p = _scores(batch.column(1), dense)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(compact(model))
    place = docs.columns.index("text")

    def rows(batches):
        dense = _dense(shared)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), dense) < THRESHOLD))

    return docs.mapInArrow(rows, docs.schema)


def _dense(shared) -> np.ndarray:
    at, w = shared.value
    dense = np.zeros(1 << BITS)
    dense[at] = w
    return dense


def _scores(column, dense: np.ndarray) -> np.ndarray:
    totals = np.fromiter((dense[features(b)].sum() for b in kern.byte_rows(column)), float, len(column))
    return probability(totals)


def held_out() -> Column:
    """Rows that train nothing: crc32 of doc_id as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2
