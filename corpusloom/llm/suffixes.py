"""Removal of repeated byte strings by distributed prefix doubling over sparse suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else as well.
Every start position p is represented by its anchor: the last minimum of a hash over the
``GRAM``-byte strings that start within ``SPREAD`` bytes from p. The anchor depends on the
LENGTH bytes at p alone, so equal strings have their anchors at equal distance, and the
positions of one anchor are one run. Doubling then works on anchors, not on all bytes:

* the first name of an anchor is a fingerprint of the LENGTH - SPREAD + 1 bytes from it on,
  which all strings of its run contain; Spark brings equal names together, and anchors whose
  name is unique are done: none of their strings repeats. This only filters;
* the others are ranked by 128-bit digests, paired with their distance, over the strings
  shared by their run and then by ever smaller ranges of distances (``CELLS``), until a
  range is unique, or its strings' union is itself repeated, which settles the whole range,
  or single positions have been ranked over the full LENGTH.

A rank is a cryptographic digest (BLAKE2b) of its string, so no global sort assigns it and
nothing goes because of a clash of fingerprints; counts per rank are pre-aggregated, and a
hot rank is split by the skew join. Texts that occur twice or more as a whole are settled
by their digest and enter once a partition. Ids of texts are the first 64 bits of SHA-256;
a clash is detected (the next 64) and stops the job.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing;
repeated rows repeat each other. Extra columns are ignored. Empty tables give no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kern
from .io import cut
from .jaccard import passes, wanted_filter

LENGTH = 400
GRAM, SPREAD = 32, 256
CELLS = (64, 8, 1)
ITEM = "core binary, whole binary, cls long, anchor long, near int, far int"
FIRST = "core long, cls long, anchor long, near int, far int"


def digest_id(raw: bytes) -> tuple[int, int, str]:
    sha = hashlib.sha256(raw)
    head = sha.digest()
    return int.from_bytes(head[:8], "little", signed=True), int.from_bytes(head[8:16], "little", signed=True), sha.hexdigest()


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every window of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text with their runs of start positions: anchor, nearest and farthest
    distance of a start before the anchor."""
    n = len(sums) - 1
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.arange(n - GRAM + 1)
    names = kern.span_hash(sums, at, at + GRAM)
    low = np.uint64(0xFFFFFFFF)
    least = sliding_min((names & ~low) | (low - at.astype(np.uint64)), SPREAD)[: n - LENGTH + 1]
    anchor = (low - (least & low)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    return anchor[first], anchor[first] - last, anchor[first] - first


def digest(raw: memoryview, near: int, far: int) -> bytes:
    """The rank of a string at a range of distances."""
    return hashlib.blake2b(raw, digest_size=16, salt=(near * SPREAD + far).to_bytes(4, "little")).digest()


def cells(anchor: np.ndarray, near: np.ndarray, far: np.ndarray, cell: int):
    """The ranges of distances cut at multiples of ``cell``: (lows, highs, anchor, near, far),
    the first two the bounds of the cell."""
    count = far // cell - near // cell + 1
    of = np.repeat(np.arange(len(anchor)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    low = (near[of] // cell + step) * cell
    high = low + cell - 1
    return low, high, anchor[of], np.maximum(low, near[of]), np.minimum(high, far[of])


def ranked(buf: np.ndarray, low, high, anchor, own_low, own_high) -> tuple[list, list]:
    """Ranks of the bytes that all strings at distances low..high from the anchor share, and
    of those that any of own_low..own_high covers (None beyond the text)."""
    raw, n = memoryview(buf), len(buf)
    core, whole = [], []
    for a, x, y, p, q in zip(*(v.tolist() for v in (anchor, low, high, own_low, own_high)), strict=True):
        core.append(digest(raw[a - x : a - y + LENGTH], x, y))
        whole.append(digest(raw[a - q : a - p + LENGTH], p, q) if a >= q and a - p + LENGTH <= n else None)
    return core, whole


def characters(raw: np.ndarray) -> int:
    """Bytes that start a character: the others are 10xxxxxx."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chars, cls, check, sha256 of every document."""

    def rows(batches):
        for batch in batches:
            found = [(len(b), characters(b), *digest_id(b)) for b in kern.byte_rows(batch.column(1))]
            columns = list(zip(*found, strict=True)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))],
                ["doc_id", "n_bytes", "n_chars", "cls", "check", "sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, n_chars long, cls long, check long, sha256 string")


def first_names(docs: DataFrame) -> DataFrame:
    """The anchors of every text, a text once a partition, with a fingerprint."""

    def rows(batches):
        seen = set()
        for batch in batches:
            out = []
            for buf in kern.byte_rows(batch.column(0)):
                if len(buf) < LENGTH:
                    continue
                cls, _, _ = digest_id(buf)
                if cls in seen:
                    continue
                seen.add(cls)
                sums = kern.prefix_sums(buf)
                a, near, far = anchors(sums)
                out.append((kern.signed(kern.span_hash(sums, a, a + LENGTH - SPREAD + 1)), np.full(len(a), cls), a, near.astype(np.int32), far.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], [c.split()[0] for c in FIRST.split(", ")])

    return docs.select("text").mapInArrow(rows, FIRST)


def repeated_names(items: DataFrame) -> DataFrame:
    """The items whose fingerprint is not unique."""
    twice = cut(items.groupBy("core").count().where("count > 1").select("core"))  # a written side leaves the join free to split a hot one
    return cut(items.join(twice, "core").drop("core"))


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, raw) of the wanted texts, once a partition; see ``jaccard.wanted_sets``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted))

    def rows(batches):
        (table, shift), seen = shared.value, set()
        for batch in batches:
            ids, raws = [], []
            for buf in kern.byte_rows(batch.column(0)):
                if len(buf) < LENGTH:
                    continue
                cls, _, _ = digest_id(buf)
                if cls not in seen and passes(table, shift, cls):
                    seen.add(cls)
                    ids.append(cls)
                    raws.append(buf.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], ["cls", "raw"])

    return docs.select("text").mapInArrow(rows, "cls long, raw binary")


def next_ranks(docs: DataFrame, items: DataFrame, cell: int | None) -> DataFrame:
    """The open items, cut into cells (None: as they are) and ranked over what these share."""
    spots = items.groupBy("cls").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("near").alias("nears"), F.collect_list("far").alias("fars"))
    texts = wanted_texts(docs, items.select("cls").distinct())

    def rows(batches):
        for batch in batches:
            for cls, buf, *lists in zip(batch.column(0).to_pylist(), kern.byte_rows(batch.column(1)), *(batch.column(i) for i in (2, 3, 4)), strict=True):
                a, near, far = (x.values.to_numpy().astype(np.int64) for x in lists)
                if cell is None:
                    core, whole = ranked(buf, np.zeros_like(a), np.full_like(a, SPREAD - 1), a, near, far)
                else:
                    low, high, a, near, far = cells(a, near, far, cell)
                    core, whole = ranked(buf, low, high, a, low, high)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core, pa.binary()), pa.array(whole, pa.binary()), pa.array(np.full(len(a), cls)), pa.array(a), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32))], [c.split()[0] for c in ITEM.split(", ")]
                )

    return texts.join(spots, "cls").select("cls", "raw", "anchors", "nears", "fars").mapInArrow(rows, ITEM)


def settle(items: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Repeated spans (cls, start, end) known from these ranks, and the items still open.

    Items of a unique rank drop out. A repeated union settles its range for all that share
    it; one of them stays as a partner while any item of the rank is open."""
    counts = items.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("c"))
    lone = F.col("whole").isNull() | (F.col("c") < 2)
    ranks = counts.groupBy("core").agg(F.sum("c").alias("n"), F.max(lone).alias("open")).where("n > 1").select("core", "open")
    ranks = cut(ranks)  # a written side leaves the join free to split a hot rank
    alive = cut(items.join(ranks, "core"))
    span = lambda rows: rows.select("cls", (F.col("anchor") - F.col("far")).alias("start"), (F.col("anchor") - F.col("near") + LENGTH).alias("end"))
    if last:
        return span(alive), alive.limit(0)
    place = ("cls", "anchor", "near", "far")
    twice = alive.where("whole is not null").groupBy("core", "whole").agg(F.count(F.lit(1)).alias("c"), F.max("open").alias("open"), F.min(F.struct(*place)).alias("one")).where("c > 1")
    twice = cut(twice)
    partners = twice.where("open").select("one.*")
    # written, so that both readings share one join, of as many rows as items
    told = cut(alive.join(twice.select("core", "whole", F.lit(True).alias("settled")), ["core", "whole"], "left").select(*place, "open", "settled"))
    return span(told.where("settled")), cut(told.where("open and settled is null").select(*place).unionAll(partners))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(cls, starts, ends): spans of each text whose LENGTH-byte strings occur again."""
    items, spans = repeated_names(first_names(docs)), None
    for cell in (None, *CELLS):
        # written first: both their counts and the join read them, and texts are read once
        more, items = settle(cut(next_ranks(docs, items, cell)), cell == 1)
        spans = more if spans is None else spans.unionAll(more)
    return spans.groupBy("cls").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def kept_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) == 0


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept_chars of every document;
    the last counts the characters that start in a byte that stays."""
    base = cut(described(docs))
    known = cut(base.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.max("n_bytes").alias("n")))
    if not known.where("lo <> hi").isEmpty():
        raise RuntimeError("two different texts share a 64-bit id")
    spans = cut(repeated_spans(docs).join(known.where("copies = 1").select("cls"), "cls", "left_semi"))

    def rows(batches):
        for batch in batches:
            out = []
            for buf, starts, ends in zip(kern.byte_rows(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                kept = kept_mask(len(buf), starts.values.to_numpy(), ends.values.to_numpy())
                runs = np.count_nonzero(np.diff(kept.astype(np.int8), prepend=1) == -1)
                rest = buf[kept]
                out.append((len(buf) - len(rest), int(runs), hashlib.sha256(rest.tobytes()).hexdigest(), characters(rest)))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True))], ["cls", "n_removed", "n_spans", "kept", "kept_chars"])

    texts = wanted_texts(docs, spans.select("cls"))
    cleaned = texts.join(spans, "cls").select("cls", "raw", "starts", "ends").mapInArrow(rows, "cls long, n_removed long, n_spans long, kept string, kept_chars long")
    # a text that occurs again as a whole goes as a whole
    again = known.where(f"copies > 1 and n >= {LENGTH}").select("cls", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"), F.lit(0).cast("long").alias("kept_chars"))
    changed = cleaned.unionAll(again)
    return base.join(changed, "cls", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"), F.coalesce("kept_chars", "n_chars").alias("n_kept_chars"),
    )
