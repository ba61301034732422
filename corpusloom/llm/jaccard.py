"""Jaccard join of shingle sets by parity sketches.

A set's parity sketch toggles one bit per element, so two sketches differ in at most as
many bits as the sets have elements apart: their Hamming distance bounds the symmetric
difference from below. Jaccard similarity >= t allows at most

    d = (a + b) (1 - t) / (1 + t)

elements apart for sizes a and b. Sets are joined per size band, that of a pair's smaller
set. A band's sketch has more blocks than any of its pairs has elements apart, so similar
sets agree on whole blocks (pigeonhole), and a block's bits are the join key.

Which blocks are keys: a set that can be d elements apart from partners in the band takes
its first d + m blocks by content (elements in the block, then the block's number; m:
``margin``). That loses no pair: of two similar sets take the one whose last chosen block
ranks higher; of its d + m blocks at least m have no difference, so the other set has the
same blocks with the same rank and, its own last one being lower, keys them too.
Near-empty blocks, which many sets share by chance, are thus left out; and a set that
shares fewer than m keys of a band with any others has no link in that band and drops out
before sets are compared.

Equal sets are one class. Classes that share keys are linked in rounds, and classes of one
component are not compared again:

* a pivot round compares every class with one pivot of its groups, which joins dense
  groups at a cost linear in their size;
* nearest rounds propose to every class the nearest class of another component in each of
  its groups, by Hamming distance of 1,024-bit sketches, until a round joins next to none;
* a last round proposes every pair of different components that the sketches leave open.

Every proposed pair is verified on the sets themselves. A pair that shares many keys is
proposed in one group only: each row carries its class's least keys, and a pair is left to
the group of a lesser key that both classes are known to have. A group beyond
``GROUP_ROWS`` is compared in tiles, so that a task holds two parts of a group at a time
and no pair is passed over. One beyond ``TILED_GROUPS`` times as many rows is first dealt
out by a second, independent sketch, under which similar sets must agree on a block as well.

Element fingerprints have 64 bits, class ids too; two different sets with one id are
detected (second fingerprint) and stop the job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kern
from .graphs import components
from .io import compact, cut, unused

BAND_RATIO = 1.5
BLOCKS_PER_DIFFERENCE = 1.5
MARGIN = 0.15
#: Low bits of a key that hold its band.
BAND_BITS = 7
GROUP_ROWS = 2048
#: Groups up to so many times GROUP_ROWS are not dealt out: in groups of near copies, which
#: agree on most blocks of any sketch, that only repeats the rows.
TILED_GROUPS = 8
#: Groups up to this size are compared together, row against row of a batch.
SMALL_GROUP = 32
#: Least keys that a row carries of its class and band, and what pads them.
LEAST_KEYS, NO_KEY = 8, (1 << 63) - 1
#: Rounds before the last, at most; fewer when one joins under 1 in LEAST_YIELD proposals.
MOST_ROUNDS, LEAST_YIELD = 3, 20
#: Rows of an output batch, about: bounds a worker's memory.
KEYS_AT_ONCE = 100_000
#: Whole sketches, and the fold of them by XOR that is compared first.
SKETCH_BITS, FOLD_BITS = 1024, 512
#: Bits of the filter that keeps rows nobody asks for from being shuffled: 16 for each id,
#: within these powers of two (8 MB at most).
FILTER_BITS = (16, 26)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked if 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    #: Of the fingerprints that stand for shingles; every rule has a random one.
    key: bytes = field(default_factory=kern.new_key, repr=False)


def shingle_set(buf: np.ndarray, rule: Rule) -> np.ndarray:
    """Sorted keyed fingerprints of the distinct shingles of a text (A-Z lower-cased).
    Fewer words than a shingle are one shingle; no words, no set."""
    hashes = kern.keyed(rule.key)
    own = hashes.words(kern.LOWER[buf])
    if not len(own):
        return own
    return np.unique(hashes.windows(own, min(rule.words, len(own))))


def identity(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a non-empty set, as signed integers.

    Items are mixed before they are summed: shingle fingerprints are nearly linear in their
    words, so that plain sums of texts with the same words in another order often agree."""
    one = kern.mix(np.array([kern.mix(items).sum(dtype=np.uint64) + np.uint64(len(items))], np.uint64))
    two = kern.mix(items ^ np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64)
    return int(one.view(np.int64)[0]), int(np.array([two], np.uint64).view(np.int64)[0])


def most_apart(a, b, percent: int):
    """Elements that linked sets of these sizes can be apart."""
    return (a + b) * (100 - percent) // (100 + percent)


@cache
def bands(most: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, blocks, margin) of the size bands up to sizes of
    ``most``. Linked sets share at least ``margin`` keys of their band."""
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * BAND_RATIO) - 1)
        least, largest = (most_apart(n, n * 100 // percent, percent) for n in (low, high))
        out.append((low, high, math.ceil(BLOCKS_PER_DIFFERENCE * (largest + 1)), max(1, int(MARGIN * (least + 1)))))
        low = high + 1
    return out


def sketch_keys(items: np.ndarray, percent: int, salt: int = 0, only: int | None = None) -> np.ndarray:
    """Join keys of a set: the bits of its chosen sketch blocks, hashed with band and
    block, in all bands that its partners can have (or one)."""
    n, keys = len(items), []
    table = bands(max(1024, 1 << n.bit_length()), percent)
    own = next(k for k, (low, high, *_) in enumerate(table) if low <= n <= high)
    for k in range(own, -1, -1):
        _, high, blocks, least = table[k]
        if n > high * 100 // percent:
            break
        d = most_apart(n, n * 100 // percent if k == own else high, percent)
        if not d or only not in (None, k):
            continue  # sets without differences are one class already
        seed = np.uint64((k * 2 + 1 + salt * 1_000_003) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        spread = kern.mix(items ^ seed)
        block = ((spread >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        content = np.bincount(block, minlength=blocks)
        parity = np.zeros(blocks, np.uint64)
        filled = np.flatnonzero(content)
        first = np.concatenate(([0], np.cumsum(content[filled])[:-1]))
        # toggling one of 2**64 bits per element, the bits coded by their index
        parity[filled] = np.bitwise_xor.reduceat(kern.mix(spread + np.uint64(1))[order], first)
        place = content * blocks + np.arange(blocks)
        take = min(d + least, blocks)
        chosen = np.argpartition(place, blocks - take)[blocks - take :]
        code = kern.mix(parity[chosen] + kern.mix(chosen.astype(np.uint64) ^ seed))
        keys.append(code >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.uint64(k))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def bit_sketch(items: np.ndarray) -> np.ndarray:
    """The parity sketch of SKETCH_BITS bits, as signed words."""
    count = np.bincount((kern.mix(items ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, cls, check of every document; cls is null for an empty set."""

    def rows(batches):
        for batch in batches:
            n, cls, check = [], [], []
            for buf in kern.byte_rows(batch.column(1)):
                items = shingle_set(buf, rule)
                one, two = identity(items) if len(items) else (None, None)
                n.append(len(items))
                cls.append(one)
                check.append(two)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(check, pa.int64())], ["doc_id", "n_shingles", "cls", "check"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, cls long, check long")


def keyed_classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """(key, cls), each class once per partition."""

    def table(keys, owners):
        owner = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        return pa.RecordBatch.from_arrays([pa.array(kern.signed(np.concatenate(keys))), pa.array(owner)], ["key", "cls"])

    def rows(batches):
        seen = set()
        for batch in batches:
            keys, owners, held = [], [], 0
            for buf in kern.byte_rows(batch.column(0)):
                items = shingle_set(buf, rule)
                if not len(items):
                    continue
                cls, _ = identity(items)
                if cls in seen:
                    continue
                seen.add(cls)
                keys.append(sketch_keys(items, rule.percent))
                owners.append(cls)
                held += len(keys[-1])
                if held > KEYS_AT_ONCE:
                    yield table(keys, owners)
                    keys, owners, held = [], [], 0
            if keys:
                yield table(keys, owners)

    return docs.select("text").mapInArrow(rows, "key long, cls long")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows (key, cls) of keys that several classes have, without repeats.

    The shuffle sorts rows by key; each partition is then one streaming pass."""

    def rows(batches):
        last_key = last_cls = None
        given = True  # whether the last row was given out
        for batch in batches:
            key, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            if len(key):
                new[0] = key[0] != last_key or cls[0] != last_cls
            key, cls = key[new], cls[new]
            if not len(key):
                continue
            after = np.empty(len(key), bool)
            after[1:] = key[1:] == key[:-1]
            after[0] = key[0] == last_key
            out = after.copy()
            out[:-1] |= after[1:]
            held = [(last_key, last_cls)] if after[0] and not given else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((np.array([k for k, _ in held], np.int64), key[out]))), pa.array(np.concatenate((np.array([c for _, c in held], np.int64), cls[out])))],
                ["key", "cls"],
            )
            last_key, last_cls, given = key[-1], cls[-1], out[-1]

    return keyed.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(rows, "key long, cls long")


def band_of(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")


def prune(shared: DataFrame, rule: Rule) -> DataFrame:
    """The rows of classes that share enough keys of a band to have a link there, on keys
    that several such classes have."""
    least = F.array(*(F.lit(m) for *_, m in bands(1 << 48, rule.percent)))
    rows = shared.withColumn("band", band_of("key"))
    enough = rows.groupBy("cls", "band").count().where(F.col("count") >= F.element_at(least, F.col("band") + 1)).select("cls", "band")
    rows = rows.join(enough, ["cls", "band"]).select("key", "cls")
    several = rows.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key")
    return rows.join(several, "key")


def wanted_filter(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """A one-hash Bloom filter of the ids in wanted(cls), and the shift that makes a place
    of an id. Its size follows their number within FILTER_BITS."""
    bits = min(max((16 * wanted.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    place = F.shiftrightunsigned("cls", 64 - bits)
    words = wanted.select((place / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(cls, {64 - bits}) % 32 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return table, 64 - bits


def passes(table: np.ndarray, shift: int, cls: int) -> bool:
    at = (cls & 0xFFFFFFFFFFFFFFFF) >> shift
    return bool(table[at >> 5] >> np.uint32(at & 31) & 1)


def wanted_sets(docs: DataFrame, rule: Rule, wanted: DataFrame) -> DataFrame:
    """(cls, n, items, sketch) of the wanted classes. The filter only spares shuffling the
    rest: a full filter costs time, never rows."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted))

    def made(out):
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["cls", "n", "items", "sketch"])

    def rows(batches):
        (table, shift), seen = shared.value, set()
        out, held = [], 0
        for batch in batches:
            for buf in kern.byte_rows(batch.column(0)):
                items = shingle_set(buf, rule)
                if not len(items):
                    continue
                cls, _ = identity(items)
                if cls not in seen and passes(table, shift, cls):
                    seen.add(cls)
                    out.append((cls, len(items), kern.signed(items), bit_sketch(items)))
                    held += len(items)
                if held > KEYS_AT_ONCE:
                    yield made(out)
                    out, held = [], 0
        yield made(out)

    found = docs.select("text").mapInArrow(rows, "cls long, n long, items array<long>, sketch array<long>")
    return found.join(wanted, "cls", "left_semi").groupBy("cls").agg(*(F.any_value(c).alias(c) for c in ("n", "items", "sketch")))


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes that are linked, each checked on its two sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    common = F.size(F.array_intersect("ia", "ib"))
    test = 100 * F.col("common") >= rule.percent * (F.col("na") + F.col("nb") - F.col("common"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", common.alias("common")).where(test).select("a", "b")


def open_groups(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, cls, comp) of groups that hold several components."""
    rows = shared.join(labels, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return rows.join(mixed, "key")


def pivot_pairs(rows: DataFrame) -> DataFrame:
    """One pair a class: with the least pivot of its groups that is not of its component.
    A group's pivot is its least class under a hash."""
    pivots = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("cls").alias("o"), F.col("cls").alias("pivot"), F.col("comp").alias("home"))).alias("p"))
    pairs = rows.join(pivots, "key").where(F.col("p.home") != F.col("comp"))
    return pairs.groupBy("cls").agg(F.min("p").alias("p")).select(F.col("p.pivot").alias("a"), F.col("cls").alias("b"))


def sketches_near(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sketches are no farther apart than linked sets can be."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(right, "b").join(left, "a")
    return both.where(apart * (100 + rule.percent) <= (F.col("na") + F.col("nb")) * (100 - rule.percent)).select("a", "b")


def described(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows(key, cls, comp) with size, sketch and least keys; ``part`` keeps all apart."""
    full = rows.withColumn("band", band_of("key")).join(marks, ["cls", "band"])
    return full.select("key", F.col("cls").alias("part"), "cls", "comp", "n", "sketch", F.col("key").alias("own"), "least")


class Group:
    """Rows of one or several groups, in order of their keys, and which pairs are near.

    ``levels`` are pairs of columns: the key that a row has and its class's least keys."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        self.key, self.part, self.cls, self.comp, self.n = (table[c].to_numpy() for c in ("key", "part", "cls", "comp", "n"))
        wide = lambda c, width: table[c].combine_chunks().flatten().to_numpy().reshape(-1, width)
        self.sketch = wide("sketch", SKETCH_BITS // 64).view(np.uint64)
        self.fold = np.bitwise_xor.reduce(self.sketch.reshape(len(self.n), SKETCH_BITS // FOLD_BITS, -1), axis=1)
        self.levels = [(table[own].to_numpy(), wide(least, LEAST_KEYS)) for own, least in (("own", "least"), ("own2", "least2")) if own in table.column_names]
        highs = np.array([high for _, high, *_ in bands(1 << 48, percent)])
        self.band, self.home = self.levels[0][0] & ((1 << BAND_BITS) - 1), np.searchsorted(highs, self.n)

    def chosen(self, i: np.ndarray, j: np.ndarray):
        """Of the pairs of rows (i, j) those to propose, with their distance."""
        near = (self.comp[i] != self.comp[j]) & (self.part[i] != self.part[j]) & (np.minimum(self.home[i], self.home[j]) == self.band[i])
        i, j = i[near], j[near]
        far = np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(axis=1, dtype=np.int64)
        near = far <= most_apart(self.n[i], self.n[j], self.percent)
        i, j, far = i[near], j[near], far[near]
        for own, least in self.levels:  # a lesser key of both proposes the pair
            a, b = least[i], least[j]
            known = ((a[:, :, None] == b[:, None, :]) & (a < own[i][:, None])[:, :, None]).any(axis=(1, 2))
            i, j, far = i[~known], j[~known], far[~known]
        return i, j, far

    def near(self):
        """Chosen pairs, in parts of bounded size."""
        first = np.flatnonzero(np.diff(self.key, prepend=self.key[0] ^ 1))
        size = np.diff(first, append=len(self.key))
        small = np.where(size <= SMALL_GROUP, size, 1)
        room = np.repeat(small, size) - 1 - (np.arange(len(self.key)) - np.repeat(first, size))
        for step in range(1, SMALL_GROUP):
            at = np.flatnonzero(room >= step)
            if not len(at):
                break
            for k in range(0, len(at), 1 << 14):
                yield self.chosen(at[k : k + (1 << 14)], at[k : k + (1 << 14)] + step)
        for start, end in zip(first[size > SMALL_GROUP], (first + size)[size > SMALL_GROUP], strict=True):
            fold, n, comp = (x[start:end] for x in (self.fold, self.n, self.comp))
            for at in range(0, end - start, 128):
                rows = slice(at, at + 128)
                far = np.bitwise_count(fold[rows, None, :] ^ fold[None, at:, :]).sum(axis=2, dtype=np.int64)
                close = (far <= most_apart(n[rows, None], n[None, at:], self.percent)) & (comp[rows, None] != comp[None, at:])
                i, j = np.nonzero(np.triu(close, 1))
                for k in range(0, len(i), 1 << 14):
                    yield self.chosen(start + at + i[k : k + (1 << 14)], start + at + j[k : k + (1 << 14)])

    def pairs(self, nearest: bool) -> pa.Table:
        found = [*self.near()]
        i, j, far = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        if nearest:  # of each row its nearest, of those the one of the least class
            row, other, twice = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((far, far))
            order = np.lexsort((self.cls[other], twice, row))
            row, other = row[order], other[order]
            first = np.diff(row, prepend=-1) != 0
            i, j = row[first], other[first]
        a, b = np.minimum(self.cls[i], self.cls[j]), np.maximum(self.cls[i], self.cls[j])
        return pa.table({"a": a, "b": b}).group_by(["a", "b"]).aggregate([])


def near_pairs(rows: DataFrame, rule: Rule, nearest: bool) -> DataFrame:
    """Distinct pairs (a, b) of described rows with one key, different components and near
    sketches: all, or the nearest of each row.

    The shuffle sorts rows by key; a partition is one streaming pass that holds a batch and
    the group at its end."""

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            key = table["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield from Group(table.slice(0, whole), rule.percent).pairs(nearest).to_batches()
            held = table.slice(whole)
        if held is not None and held.num_rows:
            yield from Group(held, rule.percent).pairs(nearest).to_batches()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def deal_again(rows: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Described rows of oversized groups under new keys: old key and a block of a second
    sketch."""
    names = ["key", "part", "cls", "comp", "n", "sketch", "own", "least"]

    def deal(batches):
        for batch in batches:
            old, keys, least = batch.column(0).to_numpy(), [], []
            for was, items in zip(old.tolist(), batch.column(len(names)), strict=True):
                made = sketch_keys(np.asarray(items.values).view(np.uint64), rule.percent, salt=1, only=was & ((1 << BAND_BITS) - 1))
                keys.append(np.sort(kern.signed(kern.mix(made + kern.mix(np.array([was], np.int64).view(np.uint64))))))
                least.append(np.concatenate((keys[-1], np.full(LEAST_KEYS, NO_KEY)))[:LEAST_KEYS])
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            new = np.concatenate([np.zeros(0, np.int64), *keys])
            rest = [batch.column(i).take(pa.array(at)) for i in range(1, len(names))]
            lists = pa.array([least[k] for k in at.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(new), *rest, pa.array(new), lists], [*names, "own2", "least2"])

    full = rows.join(sets.select("cls", "items"), "cls").select(*names, "items")
    return full.mapInArrow(deal, "key long, part long, cls long, comp long, n long, sketch array<long>, own long, least array<long>, own2 long, least2 array<long>")


def tiles(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of oversized groups, with their sizes(key, count), dealt to pairs of parts of
    the group."""
    parts = F.ceil(F.col("count") * 2 / GROUP_ROWS).cast("int")
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    cut_up = rows.join(sizes, "key").withColumn("parts", parts).withColumn("mine", part)
    cut_up = cut_up.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return cut_up.withColumns({"key": F.xxhash64("key", low, high), "part": F.when(low == high, F.col("cls")).otherwise(F.col("mine"))}).select(*rows.columns)


def by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of groups within GROUP_ROWS, and (key, count) of the others."""
    large = cut(rows.groupBy("key").count().where(F.col("count") > GROUP_ROWS))
    return rows.join(large.select("key"), "key", "left_anti"), large


def every_near_pair(rows: DataFrame, marks: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of rows(key, cls, comp) that verification must decide, each once."""
    within, large = by_size(rows)
    near = near_pairs(described(within, marks), rule, False)
    if large.isEmpty():
        return near
    most = TILED_GROUPS * GROUP_ROWS
    tiled, large = large.where(F.col("count") <= most), large.where(F.col("count") > most)
    near = near.unionAll(near_pairs(tiles(described(rows.join(tiled.select("key"), "key"), marks), tiled), rule, False))
    if large.isEmpty():
        return near.distinct()
    dealt = cut(deal_again(described(rows.join(large.select("key"), "key"), marks), sets, rule))
    within, large = by_size(dealt)
    near = near.unionAll(near_pairs(within, rule, False))
    if not large.isEmpty():
        near = near.unionAll(near_pairs(tiles(dealt, large), rule, False))
    return near.distinct()


def link_components(docs: DataFrame, rule: Rule) -> DataFrame:
    """(node, comp) for the classes that are linked with another class."""
    shared = cut(prune(cut(shared_keys(keyed_classes(docs, rule))), rule))
    sets = cut(wanted_sets(docs, rule, shared.select("cls").distinct()))
    least = F.slice(F.concat(F.sort_array(F.collect_list("key")), F.array_repeat(F.lit(NO_KEY), LEAST_KEYS)), 1, LEAST_KEYS)
    marks = shared.groupBy("cls", band_of("key").alias("band")).agg(least.alias("least"))
    marks = cut(marks.join(sets.select("cls", "n", "sketch"), "cls"))
    rows = shared.withColumn("comp", F.col("cls"))
    links = None
    for turn in range(MOST_ROUNDS):
        if turn:
            within, _ = by_size(rows)
            pairs = cut(near_pairs(described(within, marks), rule, True))
        else:
            pairs = cut(sketches_near(pivot_pairs(rows), sets, rule))
        proposed = pairs.count()
        found = cut(verified(compact(pairs, proposed), sets, rule))
        linked = found.count()
        found = compact(found, linked)
        links = found if links is None else links.unionAll(found)
        rows = cut(open_groups(rows.select("key", "cls"), components(links)))  # closed groups stay closed
        if turn and linked * LEAST_YIELD <= proposed:
            break
    near = every_near_pair(rows, marks, sets, rule)
    return components(links.unionAll(verified(near, sets, rule)))


def join(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, cls, comp (the component's own key), component_id of every document.

    component_id is the least doc_id that links reach, the document's own included. Null
    and empty texts and texts without words have n_shingles 0 and are linked with nothing.
    Repeated rows are documents of one class. Null doc_ids are passed over in the minimum;
    where a component has no other, component_id is null. Extra columns are ignored."""
    base = cut(classes(docs, rule))
    known = base.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    known = cut(known)
    if not known.where("lo <> hi").isEmpty():
        raise RuntimeError("two different shingle sets share a 64-bit id")
    labels = link_components(docs, rule)
    homes = known.select("cls", "least").join(labels, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp"))
    firsts = homes.groupBy("comp").agg(F.min("least").alias("component_id"))
    homes = homes.join(firsts, "comp").select(F.col("cls").alias("of"), "comp", "component_id")
    found = base.join(homes, F.col("cls") == F.col("of"), "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "cls", "comp", own.alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """One document of each component, the one with the least doc_id, with all its columns;
    of rows that repeat it, one. Documents without words all stay.

    Documents are matched with those that go, which are few in most corpora: Spark
    broadcasts them where its own size check allows, and no text is shuffled then."""
    members = join(docs, rule).where("cls is not null").groupBy("comp", "cls", "doc_id").count()
    members = cut(members)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cls"))
    chosen = members.groupBy("comp").agg(first.alias("m")).select("comp", F.col("m.cls").alias("one"), F.col("m.doc_id").alias("doc"))
    stays = (F.col("cls") == F.col("one")) & F.col("doc_id").eqNullSafe(F.col("doc"))
    tag, gone_cls, gone_doc, again = (unused(docs, n) for n in ("tag", "gone_cls", "gone_doc", "again"))
    decided = members.join(chosen, "comp").where(~stays | (F.col("count") > 1))
    decided = cut(decided.select(F.col("cls").alias(gone_cls), F.col("doc_id").alias(gone_doc), stays.alias(again)))
    place = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            cls = [identity(items)[0] if len(items) else None for items in (shingle_set(b, rule) for b in kern.byte_rows(batch.column(place)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls, pa.int64())], [*batch.schema.names, tag])

    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    tagged = docs.where(has_words).mapInArrow(rows, StructType([*docs.schema.fields, StructField(tag, LongType())]))
    same = (F.col(tag) == F.col(gone_cls)) & F.col("doc_id").cast("long").eqNullSafe(F.col(gone_doc))
    kept = docs.where(~has_words).unionAll(tagged.join(decided, same, "left_anti").select(*docs.columns))
    repeated = decided.where(again)
    if repeated.isEmpty():
        return kept
    return kept.unionAll(tagged.join(repeated, same, "left_semi").dropDuplicates([tag, "doc_id"]).select(*docs.columns))
