"""Packing documents into sequences by hierarchical best fit.

A document's ids, with an end id, are pieces of at most CAPACITY tokens; only longer ones
are cut, into whole pieces and one remainder. Pieces are dealt evenly to tasks, and each
packs its own by best fit in order of falling length (a segment tree over the room that is
left, ``packing.CapacityTree``). Bins with hardly any room are finished and leave; the
others become items themselves: groups of FAN tasks' bins meet in one task, which packs
them into each other by best fit again, and so on up a tree until one group is left.

Two bins that are half empty fit into one, so a task leaves at most one of these, and a
group of FAN tasks can join FAN bins at most. A task therefore passes on its CARRIED
roomiest bins and finishes the others: enough for every join on the way up, while what
meets in one task is bounded, however many pieces there are. Finished bins never move again.

Only the places of the pieces are shuffled, not their ids, unless ``ids`` asks for them.
Pieces are written before they are dealt, and each level's bins before the next level
reads them, so a lost executor's work is done again to the same bins.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each.
Extra columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import transducer
from .io import cut
from .packing import best_fit_decreasing

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs.
PIECES_A_TASK = 16_384
#: Tasks whose open bins meet in one task of the next level, and open bins that each passes on.
FAN, CARRIED = 8, 64
#: A bin with less room is finished at once.
NEARLY_FULL = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: ``grp``: the task that made the bin; ``bin``: its number; ``at``: a piece's place in it.
BINS = f"{PIECES}, ids binary, bin long, at long, fill long, grp long, open boolean"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """The pieces of every document; ``ids``: with their ids (little-endian 32-bit), else null."""

    def rows(batches):
        machine = transducer(path)
        for batch in batches:
            docs, own, out = batch.column(0).to_pylist(), [], []
            for number, part, _ in machine.encoded(t.as_py() for t in batch.column(1)):
                if part is not None:
                    own.append(bytes(part))
                    continue
                raw = b"".join([*own, end_id.to_bytes(4, "little")])
                own = []
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    piece = raw[at : at + 4 * capacity]
                    out.append((docs[number], k, at // 4, len(piece) // 4, zlib.crc32(piece), piece if ids else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"{PIECES}, ids binary")


def _placed(rows: pa.Table, group: int, inner: np.ndarray, sizes: np.ndarray, capacity: int, last: bool) -> pa.Table:
    """``rows`` with new bins for the items that ``inner`` numbers and ``sizes`` measures."""
    bins = best_fit_decreasing(sizes.tolist(), capacity)
    of, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill = np.zeros(len(bins), np.int64)
    for k, members in enumerate(bins):
        own = sizes[members]
        of[members], at[members] = k, np.cumsum(own) - own
        fill[k] = own.sum()
    open_ = fill <= capacity - NEARLY_FULL
    if last:
        open_[:] = False
    else:
        roomy = np.argsort(fill, kind="stable")[CARRIED:]
        open_[roomy] = False
    base = rows.column("at").to_numpy() if "at" in rows.column_names else 0
    made = {"bin": group * (1 << 32) + of[inner], "at": at[inner] + base, "fill": fill[of[inner]], "grp": np.full(len(inner), group), "open": open_[of[inner]]}
    kept = rows.select(["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    for name, values in made.items():
        kept = kept.append_column(name, pa.array(values))
    return kept


def joiner(stamp: int, capacity: int, last: bool):
    """Packs the open bins of one group into each other."""

    def join(key, rows):
        rows = rows.combine_chunks().sort_by([("bin", "ascending"), ("at", "ascending")])
        number = rows.column("bin").to_numpy()
        new = np.diff(number, prepend=-1) != 0
        sizes = rows.column("fill").to_numpy()[new]
        return _placed(rows, stamp + key[0].as_py(), np.cumsum(new) - 1, sizes, capacity, last).select([c.split()[0] for c in BINS.split(", ")])

    return join


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, their place in it; with ``ids``, their
    ids too. Sequences have no gaps."""
    items = cut(pieces(docs, path, capacity, end_id, ids))
    tasks = max(1, -(-items.count() // PIECES_A_TASK))

    def first(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            # in an order of their own, so that a task done again makes the same bins
            rows = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("doc_id", "piece", "length", "ids_crc32")])
            sizes = rows.column("length").to_numpy()
            group = TaskContext.get().partitionId()
            yield from _placed(rows, group, np.arange(len(sizes)), sizes, capacity, tasks == 1).to_batches()

    bins = cut(items.repartition(tasks).mapInArrow(first, BINS))
    done, level = bins.where("not open"), 0
    while tasks > 1:
        tasks, level = -(-tasks // FAN), level + 1
        up = bins.where("open").withColumn("up", F.expr(f"cast((grp & {(1 << 24) - 1}) div {FAN} as long)"))
        bins = cut(up.groupBy("up").applyInArrow(joiner(level << 24, capacity, tasks == 1), BINS))
        done = done.unionAll(bins.where("not open"))
    names = [c.split()[0] for c in PIECES.split(", ")]
    return done.select(*names, *(["ids"] if ids else []), F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence, from pieces packed with ids: ``ids``, ``cu_seqlens`` (where each
    piece ends, from 0) and ``doc_ids``. A group is one sequence, so it has a fixed bound."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("p"))
    return own.select(
        "sequence_id", F.expr("array_join(transform(p, x -> hex(x.ids)), '')").alias("hex"), F.expr("array_append(transform(p, x -> x.offset), element_at(p, -1).offset + element_at(p, -1).length)").alias("cu_seqlens"), F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"),
    ).select("sequence_id", F.unhex("hex").alias("ids"), "cu_seqlens", "doc_ids")
