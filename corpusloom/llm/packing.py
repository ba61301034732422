"""Packing token ids into fixed-length rows: best-fit-decreasing, lossless.

Documents are encoded and packed inside each partition, in blocks of bounded size, so
nothing is shuffled: a block's pieces are sorted by falling length and each goes to the
open row with the least room that still holds it, found by descending a segment tree
whose leaves are capacities. A document longer than a row is split into whole rows and
one remainder; nothing is cut off. Blocks follow the file splits, so a lost executor's
partition is packed again to the same rows.

Defined results: null and empty texts have no tokens and enter no row. Repeated rows are
packed each. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import encoder

ROW_LENGTH = 2048
#: A block is packed when it holds so many tokens: bounds a task's memory.
BLOCK_TOKENS = 1 << 21
#: What fills a row behind its tokens.
PAD_ID = 0

PACKED = (
    "block long, row long, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<long>, "
    "doc_offsets array<long>, resets array<int>"
)


class CapacityTree:
    """Rows by remaining capacity: ``best_fit`` finds the fullest row with enough room.

    Leaf c of the segment tree counts the open rows with exactly c tokens of room."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = self.size + room
        while node:
            self.count[node] += 1
            node >>= 1

    def best_fit(self, need: int) -> tuple[int, int] | None:
        """Takes out the row with the least room >= need, or None."""
        count, node = self.count, self.size + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], row_length: int) -> list[list[int]]:
    """Rows as lists of piece numbers. Ties keep the pieces' order."""
    tree, rows = CapacityTree(row_length), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.best_fit(lengths[piece])
        row, room = found or (len(rows), row_length)
        if found is None:
            rows.append([])
        rows[row].append(piece)
        if room > lengths[piece]:
            tree.put(row, room - lengths[piece])
    return rows


def _pack_block(block: int, pieces: list[tuple[int, int, np.ndarray]], row_length: int, pad: int) -> pa.RecordBatch:
    rows = best_fit_decreasing([len(p[2]) for p in pieces], row_length)
    out: dict[str, list] = {k: [] for k in ("n_tokens", "ids", "cu_seqlens", "doc_ids", "doc_offsets", "resets")}
    for members in rows:
        own = [pieces[i] for i in members]
        ends = np.cumsum([len(p[2]) for p in own]).tolist()
        out["n_tokens"].append(ends[-1])
        line = np.full(row_length, pad, own[0][2].dtype)
        line[: ends[-1]] = np.concatenate([p[2] for p in own])
        out["ids"].append(line.tobytes())
        out["cu_seqlens"].append([0, *ends])
        out["doc_ids"].append([p[0] for p in own])
        out["doc_offsets"].append([p[1] for p in own])
        out["resets"].append([0, *ends[:-1]])
    kinds = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))],
        ["block", "row", *out],
    )


def pack(docs: DataFrame, ranks: str, row_length: int = ROW_LENGTH, block_tokens: int = BLOCK_TOKENS, pad: int = PAD_ID) -> DataFrame:
    """Packed rows. ``ids`` is a row of the id matrix: ``row_length`` little-endian unsigned
    16-bit numbers (32-bit where the vocabulary needs it), those from ``n_tokens`` on being
    ``pad``; segment k of a row is ids[cu_seqlens[k] :
    cu_seqlens[k + 1]], tokens doc_offsets[k]... of document doc_ids[k]; ``resets`` are the
    positions at which position ids start again from 0. (block, row) is unique.
    Which pieces meet in a block follows the partitions of ``docs``: other file splits pack
    the same pieces into other rows."""

    def rows(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(ranks)
        kind = np.dtype("<u2") if coder.max_token_value < 1 << 16 else np.dtype("<u4")
        pieces, held, number = [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                ids = np.array(coder.encode_ordinary(text), kind)
                for at in range(0, len(ids), row_length):
                    pieces.append((doc, at, ids[at : at + row_length]))
                held += len(ids)
                if held >= block_tokens:
                    yield _pack_block((part << 32) + number, pieces, row_length, pad)
                    pieces, held, number = [], 0, number + 1
        if pieces:
            yield _pack_block((part << 32) + number, pieces, row_length, pad)

    return docs.select("doc_id", "text").mapInArrow(rows, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the packed rows as Parquet under ``path``."""
    packed.write.mode("overwrite").parquet(path)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Position ids of one row: they start again at every segment."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
