"""BPE encoding as a bounded-lookahead transducer, and incremental decoding.

Whether a boundary between two symbols survives all merges depends on a bounded
stretch of text to its right. For a merge (u, v) of rank r that stretch is at most

    reach(r) = |v| + max(reach(r') : r' < r, the left part of r' ends the merge tree of v)

because only an earlier merge whose left part is a right-edge node of v can take v's end
away, and that merge in turn depends on its own right part. The maximum of ``reach`` is
the merge list's sufficient lookahead: once that many symbols follow a token's end, the
token is stable and is emitted. A piece of any length is thus encoded with a window of
constant size; short pieces, nearly all, fit one window.

A text is read in segments that end at white space. Segments of together some million
characters are split into pieces by character class; Arrow finds the distinct pieces, which
are merged side by side as rows of a matrix (in windows, where longer than 32 bytes); ids
are decoded as they are emitted, and digests take both up segment by segment. So memory is
bounded by those segments, and by the longest run without white space.

The library's parts follow different versions of Unicode: letters and numbers 16.0, lower
case 17.0, normalisation 9.0. Python's tables are brought to these by the fixed values below.

The tokenizer file is a parameter. The files covered are those of the installed
tokenizers library with a BPE model over all byte symbols, NFC / white space / lower-case
normalisers, PATTERN before byte-level symbols, and an end-of-word suffix or none.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of a segment, and of the segments that are encoded together, about.
SEGMENT_CHARS, SLICE_CHARS = 1 << 20, 1 << 22
#: Bytes of the pieces that are merged together, as rows of a matrix, by their width.
WIDTHS = (8, 16, 32)

# fixed values: the splitting pattern, and the contractions that it puts first
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# fixed values: letters and numbers that Unicode 16.0 added to 15.1, as ranges
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
# fixed values: lower case of letters that Unicode 16.0 and 17.0 added: first, last, distance
NEW_LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
# fixed values: characters after Unicode 9.0 that reorder or compose in later versions only
LATER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0),
    (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols after a token's end that settle it, from the merge list alone."""
    parts: dict[str, tuple[str, str]] = {}
    reach_from: dict[str, int] = {}  # left part of an earlier merge -> its longest reach
    longest = 0
    for left, right in merges:
        best, node = 0, right
        while True:
            best = max(best, reach_from.get(node, 0))
            if node not in parts:
                break
            node = parts[node][1]
        reach = length[right] + best
        reach_from[left] = max(reach_from.get(left, 0), reach)
        parts.setdefault(left + right, (left, right))
        longest = max(longest, reach)
    return longest + 1


class Transducer:
    """Encodes and decodes as one tokenizer file says; state is bounded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(merges):
            self.ranks.setdefault(pair, rank)
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != PATTERN or self.special and any(" " in x for x in self.special):
            raise ValueError("this operator splits texts by another pattern than the file's")
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        length = {t: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t in self.vocab}
        self.lookahead = sufficient_lookahead(merges, length)
        self.window = 4 * self.lookahead
        self._tables(merges)

    def _tables(self, merges: list[tuple[str, str]]) -> None:
        """The merges by token number: sorted pairs, their ranks, and what a rank makes."""
        number = self.vocab.__getitem__
        self.single = np.array([number(x) for x in self.symbols], np.int64)
        self.last = np.array([number(x + self.suffix) for x in self.symbols], np.int64)
        self.size = max(self.vocab.values()) + 1
        pairs = np.array([number(a) * self.size + number(b) for a, b in merges], np.int64)
        self.pairs, self.pair_rank = np.unique(pairs, return_index=True)  # the first rank of a pair
        self.made = np.array([number(a + b) for a, b in merges], np.int64)
        self.spaced = pa.array([f" {self.names.get(i, '')}".encode() for i in range(self.size)], pa.binary())

    # -- encoding -----------------------------------------------------------

    def merge(self, parts: list[str]) -> list[str]:
        """Merges symbols by rank, leftmost first, until no pair has a rank."""
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def tokens(self, raw: bytes):
        """Tokens of one piece, each emitted once the lookahead has settled it."""
        symbols, at, n = self.symbols, 0, len(raw)
        while n - at > self.window:
            seen = 0
            for token in self.merge([symbols[b] for b in raw[at : at + self.window]]):
                if seen + len(token) > self.window - self.lookahead:
                    break
                seen += len(token)
                yield token
            at += seen
        last = [symbols[b] for b in raw[at:]]
        last[-1] += self.suffix
        yield from self.merge(last)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token numbers; the number of merges where there is none."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.pair_rank[at], len(self.made))

    def merge_rows(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Token numbers of pieces, which are rows of bytes, -1 behind the last: every step
        merges the first pair of least rank in each row that has one."""
        (n, width), none = raw.shape, len(self.made)
        cols = np.arange(width)
        tokens = np.where(cols < length[:, None], self.single[raw], -1)
        tokens[np.arange(n), length - 1] = self.last[raw[np.arange(n), length - 1]]
        ranks = np.full((n, width), none)
        ranks[:, :-1] = self.rank(tokens[:, :-1], tokens[:, 1:])
        done, row = np.full((n, width), -1), np.arange(n)
        while len(row):
            best = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), best]
            open_ = least < none
            done[row[~open_]] = tokens[~open_]
            row, best, least, tokens, ranks = row[open_], best[open_], least[open_], tokens[open_], ranks[open_]
            own = np.arange(len(row))
            tokens[own, best] = self.made[least]
            tokens = np.take_along_axis(tokens, np.minimum(cols + (cols > best[:, None]), width - 1), 1)
            tokens[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= best[:, None]), width - 1), 1)
            ranks[:, -1] = none
            for at in (best - 1, best):  # the pairs that the new token is part of
                near = (at >= 0) & (at < width - 1)
                ranks[own[near], at[near]] = self.rank(tokens[own[near], at[near]], tokens[own[near], at[near] + 1])
        return done

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data, length = np.frombuffer(pieces.buffers()[2], np.uint8), np.diff(at)
        found, count = [], np.zeros(len(pieces), np.int64)
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            rows = np.flatnonzero((length > low) & (length <= width))
            if len(rows):
                spread = np.minimum(at[rows, None] + np.arange(width), len(data) - 1)
                made = self.merge_rows(data[spread], length[rows])
                count[rows] = (made >= 0).sum(axis=1)
                found.append((rows, made[made >= 0]))
        for row in np.flatnonzero(length > WIDTHS[-1]).tolist():
            ids = [self.vocab[t] for t in self.tokens(data[at[row] : at[row + 1]].tobytes())]
            count[row] = len(ids)
            found.append((np.array([row]), np.array(ids, np.int64)))
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for rows, ids in found:
            out[spans(start[rows], count[rows])] = ids
        return out, count

    def split(self, text: str) -> tuple[pa.Array, np.ndarray]:
        """The pieces of a normalised text, as binary, and the places of their first characters."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = kinds()[points]
        first = (kind > 0) & ((np.diff(kind, prepend=0) != 0) | (kind == NUMBER))
        # a contraction is a piece where another piece could start
        marks = np.flatnonzero(first & (points == ord("'")))
        for tail in CONTRACTIONS:
            near = marks[marks + len(tail) < len(points)]
            hit = near[np.logical_and.reduce([points[near + 1 + k] == ord(c) for k, c in enumerate(tail)])] if len(near) else near
            first[hit + 1] = False
            after = hit + 1 + len(tail)
            after = after[after < len(points)]
            first[after[kind[after] > 0]] = True
        start = np.flatnonzero(first)
        wide = np.ones(len(points), np.int8)
        for bound in (0x80, 0x800, 0x10000):
            wide += points >= bound
        wide[kind == 0] = 0
        bytes_before = np.concatenate(([0], np.cumsum(wide, dtype=np.int64)))
        kept = points[kind > 0].tobytes().decode("utf-32-le")
        offsets = np.append(bytes_before[start], bytes_before[-1]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept.encode())]), start

    def normalise(self, text: str) -> str:
        """NFC and lower case, white space beyond ASCII as a space."""
        if text.isascii():
            return text.lower() if self.lower else text
        odd = np.bitwise_or.reduce(_ODD[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(_ODD) - 1)])
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(_LATER.split(text)))
            odd |= 1
        if odd & 1:
            text = _WIDE_SPACE.sub(" ", text)
        if self.lower:
            # letter by letter, as the library does: no final sigma
            text = text.replace("Σ", "σ").lower()
            if odd & 2:
                text = text.translate(_LOWER)
        return text

    def segments(self, text: str):
        """The text in parts that end before white space, as (text, whether it is special)."""
        at, n = 0, len(text)
        while at < n:
            end = at + SEGMENT_CHARS
            if end < n:
                gap = _ASCII_SPACE.search(text, end)
                end = gap.start() if gap else n
            part = text[at:end]
            at = end
            if self.special_cut and any(s in part for s in self.special):
                yield from ((x, k % 2 == 1) for k, x in enumerate(self.special_cut.split(part)) if x)
            else:
                yield part, False

    def encode_all(self, parts: list[tuple[str, bool]]) -> tuple[list, list]:
        """Ids (little-endian 32-bit) and decoding of each part, as buffers; the decoding
        has each token behind a space, and is empty for files with a byte-level decoder."""
        texts = ["" if special else self.normalise(t) for t, special in parts]
        pieces, place = self.split(" ".join(texts))
        coded = pieces.dictionary_encode()
        own, count = self.encode_pieces(coded.dictionary)
        index = coded.indices.to_numpy()
        ids = own[spans((np.cumsum(count) - count)[index], count[index])].astype("<u4")
        # token counts up to the end of each part
        ends = np.searchsorted(place, np.cumsum([len(t) + 1 for t in texts]))
        ends = np.concatenate(([0], np.cumsum(count[index])))[np.concatenate(([0], ends))]
        raw = memoryview(ids.tobytes())
        out = [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
        if self.decoder is None:
            names = self.spaced.take(pa.array(ids))
            at = np.frombuffer(names.buffers()[1], np.int32)[ends] if len(ids) else ends * 0
            said = memoryview(names.buffers()[2] or b"")
            decoded = [said[a:b] for a, b in zip(at, at[1:])]
        else:
            decoded = [b""] * len(parts)
        for k, (part, special) in enumerate(parts):
            if special:
                out[k], decoded[k] = self.special[part].to_bytes(4, "little"), b" " + part.encode()
        return out, decoded

    def encoded(self, texts):
        """(number, ids, decoding) of the parts of numbered texts, in order; the last part
        of a text is followed by (number, None, None)."""
        held, size = [], 0

        def flush():
            ids, decoded = self.encode_all([part for _, part in held if part is not None])
            at = 0
            for number, part in held:
                if part is None:
                    yield number, None, None
                else:
                    yield number, ids[at], decoded[at]
                    at += 1

        for number, text in enumerate(texts):
            for part in self.segments(text or ""):
                held.append((number, part))
                size += len(part[0])
                if size >= SLICE_CHARS:
                    yield from flush()
                    held, size = [], 0
            held.append((number, None))
        yield from flush()

    # -- decoding -----------------------------------------------------------

    def decode_machine(self):
        """A state machine: send() an id for the text that becomes certain, None at the end.

        A file with a byte-level decoder maps tokens back to bytes, and an incremental
        UTF-8 decoder holds back at most three bytes of an unfinished character. A file
        without decoder joins token names by spaces, as the library does."""
        machine = self._named() if self.decoder is None else self._bytes()
        next(machine)
        return machine

    def _named(self):
        i = yield ""
        lead = ""
        while i is not None:
            i = yield lead + self.names[i]
            lead = " "
        yield ""

    def _bytes(self):
        back = {s: b for b, s in enumerate(self.symbols)}
        special = set(self.special.values())
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        i = yield ""
        while i is not None:
            name = self.names[i]
            i = yield machine.decode(name.encode() if i in special else bytes(back[c] for c in name))
        yield machine.decode(b"", True)

    def decode_stream(self, ids):
        """Text of a stream of ids, as it becomes certain."""
        machine = self.decode_machine()
        for i in ids:
            yield machine.send(i)
        yield machine.send(None)

    def decode(self, ids) -> str:
        return "".join(self.decode_stream(ids))


def spelled(ranges) -> str:
    """Ranges of code points as the inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


#: Kinds of characters that the pattern tells apart; white space is 0.
LETTER, NUMBER, OTHER = 1, 2, 3


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every code point, letters and numbers being those of Unicode 16.0."""
    known = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((known.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.int8, sys.maxunicode + 1)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            table[a : b + 1] = kind
    table[[*range(9, 14), 32, *WIDE_SPACES]] = 0
    return table


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of count[0] numbers, then those of the next start."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


# \s as the file's patterns have it, beyond and within ASCII
WIDE_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WIDE_SPACE = regex.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ASCII_SPACE = regex.compile("[\t-\r ]")
_LATER = regex.compile(f"([{spelled(LATER_MARKS)}])")
_LOWER = {c: c + step for a, b, step in NEW_LOWER for c in range(a, b + 1)}
#: Bits of a code point: 1 for white space beyond ASCII, 2 for a capital of NEW_LOWER.
_ODD = np.zeros(0x20001, np.uint8)
_ODD[list(WIDE_SPACES)] = 1
_ODD[list(_LOWER)] = 2


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit) of every document.

    Null and empty texts, and texts of white space only, have no ids. Repeated rows are
    encoded each; extra columns are ignored; an empty table gives no row."""

    def rows(batches):
        machine = transducer(path)
        for batch in batches:
            ids, own = [], []
            for _, part, _ in machine.encoded(t.as_py() for t in batch.column(1)):
                if part is not None:
                    own.append(part)
                else:
                    ids.append(b"".join(own))
                    own = []
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of rows with ``ids``; null ids decode to no text."""

    def rows(batches):
        machine = transducer(path)
        for batch in batches:
            texts = [machine.decode(np.frombuffer(b.as_py() or b"", "<u4").tolist()) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


class Digest:
    """Counts and hashes of one document's ids and decoded text, taken up part by part."""

    def __init__(self, machine: Transducer):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()
        self.machine = None if machine.decoder is None else machine.decode_machine()

    def take(self, ids, decoded) -> None:
        if self.machine is not None:
            for i in np.frombuffer(ids, "<u4").tolist():
                self.text.update(self.machine.send(i).encode())
        else:
            self.text.update(decoded if self.n else decoded[1:])
        self.ids.update(ids)
        self.n += len(ids) // 4

    def result(self) -> tuple[int, str, str]:
        if self.machine is not None:
            self.text.update(self.machine.send(None).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of ids and of decoded text, in one pass: a document's ids are decoded as
    they are emitted, so neither is shuffled or stored. Nulls and odd rows as in ``encode``."""

    def rows(batches):
        machine = transducer(path)
        for batch in batches:
            found, own = [], Digest(machine)
            for _, ids, decoded in machine.encoded(t.as_py() for t in batch.column(1)):
                if ids is not None:
                    own.take(ids, decoded)
                else:
                    found.append(own.result())
                    own = Digest(machine)
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, DIGEST)
