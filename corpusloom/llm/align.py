"""Alignment of two tokenizers by union-find, with corpus-wide pair counts.

Tokens of two encodings of one text overlap or not; overlapping ones are joined by an edge
of a bipartite graph, whose connected components are exactly the smallest groups that both
encodings cut at the same bytes. Components come from a union-find over all tokens of a
chunk at once: every edge hooks the larger root under the smaller one, paths are halved
until they are flat, and edges within a tree fall away.

Texts are read in chunks of bounded size. Neither tokenizer joins characters across a space
between two characters that are not white space, so a text is cut there into words; the
distinct words of a chunk are encoded and aligned once, and a document adds up its words.

Counting is distributed: a chunk sends each of its id pairs once, with the number of its
documents that hold it linked; Spark adds them up, and answers each chunk with the counts
of its own pairs, which the documents of the chunk then add up. So a pair that every
document holds travels once a chunk, no table of pairs is broadcast or collected, and no
key gathers more rows than there are chunks.

Defined results: null and empty texts, and texts that either encoding does not give back
byte by byte, have no tokens, and zeros. Repeated rows count each as a document. Extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kern
from .bpe import byte_symbols, spans
from .io import cut

#: Bytes of the texts that are aligned together; bounds a task's memory.
CHUNK_BYTES = 6 << 20
#: Bytes of distinct words that are encoded in one call.
BLOCK_BYTES = 1 << 12
#: The character that pieces have for a space.
MARK = "▁".encode()

LINKED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary, docs binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens:
    """A byte-level BPE file of the tokenizers library; special tokens are plain text.

    The file's merges stand in the order of their ids, so ids are the ranks of an encoder
    that works on bytes; a test compares it with the file's own library on every character."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        names = {i: t for t, i in spec["model"]["vocab"].items() if t not in special}
        made = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("this operator reads byte-level files whose merges stand in the order of their ids")
        entries = [bytes(back[c] for c in names.get(i, "")) for i in range(max(names) + 1 + len(special))]
        self.entries = pa.array(entries, pa.binary())
        self.coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks={entries[i]: i for i in names}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(t) for t in texts]


class PieceTokens:
    """A sentencepiece BPE file with byte fallback, which puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        coder, names = self.coder, []
        for i in range(coder.get_piece_size()):
            name = coder.id_to_piece(i)
            if coder.is_byte(i):
                names.append(bytes([int(name[3:5], 16)]))
            else:
                names.append(b"" if coder.is_control(i) else name.encode().replace(MARK, b" "))
        self.entries = pa.array(names, pa.binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode([t[1:] for t in texts], num_threads=1)


@functools.cache
def coders(a: str, b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a), PieceTokens(b)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by union-find over the edges (u, v)."""
    parent = np.arange(n)
    while len(u):
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
    return parent


def white(raw: np.ndarray) -> np.ndarray:
    """The bytes of white space characters, beyond ASCII too."""
    out = kern.SPACE[raw]
    if len(raw) and raw.max() >= 0x80:
        for name in _WIDE:
            first = np.flatnonzero(raw[: len(raw) - len(name) + 1] == name[0])
            for k in range(1, len(name)):
                first = first[raw[first + k] == name[k]]
            for k in range(len(name)):
                out[first + k] = True
    return out


# fixed values: white space beyond ASCII, as the splitting pattern has it
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def cuts(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of texts that lie one after the other, each behind a space, and
    the bytes that are white space."""
    space = white(raw)
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = (raw[1:-1] == 32) & ~space[:-2] & ~space[2:]
    inner[starts] = True
    last = starts[1:] - 1  # a space that ends a text is no start, whatever text follows
    inner[last[~np.isin(last, starts)]] = False
    return np.flatnonzero(inner), space


def data_of(column: pa.Array) -> np.ndarray:
    """The bytes of a binary array that starts at its buffers' start."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[: ends[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1]).astype(np.int64) if len(column) else np.zeros(0, np.int64)


def encode_words(words: pa.Array, joined: np.ndarray, coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids one after the other, how many each word has, whether they give the word back).
    ``joined``: the words that may be encoded together with the next one."""
    n = len(words)
    order = np.concatenate((np.flatnonzero(joined), np.flatnonzero(~joined)))
    words = words.take(pa.array(order))
    size = lengths(words)
    count, good, found = np.zeros(n, np.int64), np.zeros(n, bool), []
    entry = lengths(coder.entries)

    def take(raw: np.ndarray, first: np.ndarray) -> None:
        """Encodes words first[0] to first[1], first[1] to first[2], ... in one text each."""
        at = np.concatenate(([0], np.cumsum(size[first[0] : first[-1]])))[first - first[0]]
        text = raw.tobytes()
        lists = coder.encode([text[x:y].decode() for x, y in zip(at, at[1:])])
        many = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(many.sum()))
        if entry[ids].sum() == len(raw) and (data_of(coder.entries.take(pa.array(ids))) == raw).all():
            ends = np.cumsum(size[first[0] : first[-1]])
            own = order[first[0] : first[-1]]
            count[own] = np.bincount(np.searchsorted(ends, np.cumsum(entry[ids])), minlength=len(own))
            good[own] = True
            found.append((own, ids))
        elif len(first) > 2:  # some text is not given back: each on its own
            for x, y, a, b in zip(first, first[1:], at, at[1:]):
                take(raw[a:b], np.array([x, y]))
        elif first[1] - first[0] > 1:
            take(raw, np.arange(first[0], first[1] + 1))

    if n:
        block = (np.cumsum(size) - size) // BLOCK_BYTES
        first = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.arange(n) >= joined.sum()))
        take(data_of(words), np.append(first, n))
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for group, ids in found:
        out[spans(start[group], count[group])] = ids
    return out, count, good


class Words:
    """The distinct words of a chunk, encoded both ways and aligned."""

    def __init__(self, words: pa.Array, joined: np.ndarray, coder_a, coder_b):
        a, self.n_a, fine_a = encode_words(words, joined, coder_a)
        b, self.n_b, fine_b = encode_words(words, joined, coder_b)
        self.good = fine_a & fine_b
        a, b = a[np.repeat(self.good, self.n_a)], b[np.repeat(self.good, self.n_b)]
        self.n_a, self.n_b = self.n_a * self.good, self.n_b * self.good
        of_a = np.repeat(np.arange(len(words)), self.n_a)
        ends = [np.cumsum(lengths(c.entries)[ids]) for c, ids in ((coder_a, a), (coder_b, b))]
        # the bytes between two neighbouring ends lie in one token of each side: a link
        every = np.sort(np.concatenate(ends), kind="stable")
        every = every[np.diff(every, prepend=-1) != 0]
        at_a, at_b = (np.searchsorted(e, every) for e in ends)
        root = components(len(a) + len(b), at_a, at_b + len(a))
        head = root[: len(a)] == np.arange(len(a))
        number = np.cumsum(head) - 1  # groups from left to right
        group_a, group_b = number[root[: len(a)]], number[root[len(a) :]]
        self.n_groups = np.bincount(of_a[head], minlength=len(words))
        self.n_links = np.bincount(of_a[at_a], minlength=len(words))
        self.pair_a, self.pair_b = a[at_a], b[at_b]
        self.spelled = self._spell(a, b, group_a, group_b, len(coder_a.entries), len(coder_b.entries))

    def _spell(self, a, b, group_a, group_b, most_a: int, most_b: int) -> pa.Array:
        """The groups of each word as text: A ids, a bar, B ids, a semicolon."""
        groups = int(self.n_groups.sum())
        size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        line = np.zeros(len(a) + len(b), np.int64)
        last_a = np.append(np.diff(group_a) != 0, True)[: len(a)]
        last_b = np.append(np.diff(group_b) != 0, True)[: len(b)]
        line[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = a + most_a * last_a
        line[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = b + 2 * most_a + most_b * last_b
        said = _numerals(most_a, most_b).take(pa.array(line))
        at = np.frombuffer(said.buffers()[1], np.int32)[: len(line) + 1]
        ends = np.cumsum(self.n_a + self.n_b)
        offsets = at[np.concatenate(([0], ends))].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.n_a), [None, pa.py_buffer(offsets), said.buffers()[2] or pa.py_buffer(b"")])


@functools.cache
def _numerals(most_a: int, most_b: int) -> pa.Array:
    return pa.array([f"{i}{end}".encode() for most, ends in ((most_a, ",|"), (most_b, ",;")) for end in ends for i in range(most)], pa.binary())


def place_type(n: int) -> np.dtype:
    """Of the places in a list of n pairs."""
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def narrow(values: np.ndarray) -> np.ndarray:
    """As one byte each where they fit."""
    return values.astype("u1" if not len(values) or values.max() < 256 else "<u4")


def align_chunk(chunk: int, doc_ids: list, raws: list[bytes], coder_a, coder_b, digest: bool = True) -> pa.RecordBatch:
    """A row for each document, and one without counts for the chunk's pairs: ``pairs`` are
    sorted numbers a * (B's ids) + b, of the chunk, and in a document's row their places in
    that list; ``times`` how often a document has a pair linked; ``docs`` how many documents
    of the chunk have it. ``groups``: the documents' groups as text, or its SHA-256."""
    n = len(raws)
    width = len(coder_b.entries)
    held = np.flatnonzero([len(r) > 0 for r in raws])
    columns: dict[str, list] = {"n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "n_links": [0] * n}
    groups, pairs, times, known, docs = [""] * n, [b""] * n, [b""] * n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(held):
        raw = np.frombuffer(b"".join(b" " + raws[i] for i in held), np.uint8)
        starts = np.cumsum([0, *(len(raws[i]) + 1 for i in held[:-1])])
        first, space = cuts(raw, starts)
        ends = np.append(first[1:], len(raw))
        coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(raw)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        joined = np.zeros(len(coded.dictionary), bool)
        joined[word] = ~space[ends - 1]
        own = Words(coded.dictionary, joined, coder_a, coder_b)
        doc = np.searchsorted(starts, first, "right") - 1
        good = np.ones(len(held), bool)
        good[doc[~own.good[word]]] = False
        doc, word = doc[good[doc]], word[good[doc]]
        for key, values in (("n_a", own.n_a), ("n_b", own.n_b), ("n_groups", own.n_groups), ("n_links", own.n_links)):
            total = np.bincount(doc, values[word], len(held)).astype(np.int64)
            for i, v in zip(held, total.tolist(), strict=True):
                columns[key][i] = v
        said = own.spelled.take(pa.array(word))
        # texts of the groups, document by document
        at = np.frombuffer(said.buffers()[1], np.int32)[: len(said) + 1] if len(said) else np.zeros(1, np.int32)
        text, bound = memoryview(said.buffers()[2] or b""), at[np.searchsorted(doc, np.arange(len(held) + 1))]
        for k, i in enumerate(held):
            if good[k]:
                own_text = text[bound[k] : bound[k + 1] - 1]
                groups[i] = hashlib.sha256(own_text).hexdigest() if digest else own_text.tobytes().decode()
        known, place = np.unique(own.pair_a * width + own.pair_b, return_inverse=True)
        key, count = np.unique(doc * len(own.n_a) + word, return_counts=True)
        doc, word = np.divmod(key, len(own.n_a))
        links = own.n_links[word]
        key = np.repeat(doc, links) * len(known) + place[spans((np.cumsum(own.n_links) - own.n_links)[word], links)]
        count = np.repeat(count, links)
        order = np.argsort(key)
        key, count = key[order], count[order]
        lead = np.flatnonzero(np.diff(key, prepend=-1))
        times_ = np.add.reduceat(count, lead) if len(lead) else count
        doc, pair = np.divmod(key[lead], max(1, len(known)))
        docs = np.bincount(pair, minlength=len(known))
        # what only texts without tokens have linked is no pair
        pair, known, docs = (np.cumsum(docs > 0) - 1)[pair], known[docs > 0], docs[docs > 0]
        bound = np.searchsorted(doc, np.arange(len(held) + 1))
        pair = pair.astype(place_type(len(known)))
        for k, i in enumerate(held):
            pairs[i], times[i] = pair[bound[k] : bound[k + 1]].tobytes(), narrow(times_[bound[k] : bound[k + 1]]).tobytes()
    rows = {
        "chunk": pa.array([chunk] * (n + 1), pa.int64()), "doc_id": pa.array([*doc_ids, None], pa.int64()),
        **{k: pa.array([*v, None], pa.int64()) for k, v in columns.items()}, "groups": pa.array([*groups, None], pa.string()),
        "pairs": pa.array([*pairs, known.astype("<i8").tobytes()], pa.binary()), "times": pa.array([*times, None], pa.binary()),
        "docs": pa.array([None] * n + [docs.astype("<i4").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(rows.values()), list(rows))


def linked(docs: DataFrame, path_a: str, path_b: str, digest: bool = True) -> DataFrame:
    """The rows of ``align_chunk`` for all documents."""

    def rows(batches):
        from pyspark import TaskContext

        own = coders(path_a, path_b)
        chunk, ids, raws, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), kern.byte_rows(batch.column(1)), strict=True):
                ids.append(doc)
                raws.append(raw.tobytes())
                held += len(raws[-1])
                if held >= CHUNK_BYTES:
                    yield align_chunk(chunk, ids, raws, *own, digest)
                    chunk, ids, raws, held = chunk + 1, [], [], 0
        if ids:
            yield align_chunk(chunk, ids, raws, *own, digest)

    return docs.select("doc_id", "text").mapInArrow(rows, LINKED)


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """(chunk, place, pair, docs): the pairs of every chunk, one row each."""

    def spread(batches):
        for batch in batches:
            for chunk, pairs, docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pair = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), chunk)), pa.array(np.arange(len(pair), dtype=np.int32)), pa.array(pair), pa.array(np.frombuffer(docs, "<i4"))], ["chunk", "place", "pair", "docs"]
                )

    return rows.where("docs is not null").select("chunk", "pairs", "docs").mapInArrow(spread, "chunk long, place int, pair long, docs int")


def count_pairs(pairs: DataFrame) -> DataFrame:
    """(pair, count): in how many documents."""
    return pairs.groupBy("pair").agg(F.sum("docs").alias("count"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n_docs) of every id pair that some document has linked."""
    width = len(coders(path_a, path_b)[1].entries)
    found = count_pairs(chunk_pairs(linked(docs, path_a, path_b)))
    return found.select(F.expr(f"cast(pair div {width} as int)").alias("a"), F.expr(f"cast(pair % {width} as int)").alias("b"), F.col("count").alias("n_docs"))


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and the document's groups as text, ``a1,a2|b1;a3|b2,b3``."""
    return linked(docs, path_a, path_b, digest=False).where("docs is null").select("doc_id", "groups")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The numbers of every document's tokens, groups and links, and what its links count
    in the whole corpus; see ALIGNED."""
    width = len(coders(path_a, path_b)[1].entries)
    rows = cut(linked(docs, path_a, path_b))
    pairs = cut(chunk_pairs(rows))
    counted = count_pairs(pairs).withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.expr(f"pair div {width}"))))
    answers = pairs.select("chunk", "place", "pair").join(counted, "pair").select("chunk", "place", "count", "best")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        place = right["place"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy()
        kind, sums = place_type(len(place)), []
        for raw, often in zip(left["pairs"].to_pylist(), left["times"].to_pylist(), strict=True):
            at = np.frombuffer(raw, kind)
            times = np.frombuffer(often, "u1" if len(often) == len(at) else "<u4").astype(np.int64)
            sums.append((int(times @ best[at]), int(times @ count[at])))
        n_best, count_sum = (pa.array(x, pa.int64()) for x in (zip(*sums, strict=True) if sums else ((), ())))
        kept = [left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*kept, n_best, count_sum, left["groups"]], [*(c.split()[0] for c in ALIGNED.split(", "))])

    own = rows.where("docs is null").drop("docs")
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, ALIGNED)
