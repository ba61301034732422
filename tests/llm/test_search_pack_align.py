"""Lexical search, hierarchical packing and alignment against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import align, binpack, bpe, packing, search
from corpusloom.llm import queries as registered

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [
    (9001, None), (9002, ""), (9003, " "), (9004, "\n\n  x \t y  "), (9005, "a▁b <|endoftext|> <s> <unk> <0x41>"), (9006, "a  b 　 c  d  e"),
    (9007, "\x00 \x01 a\x1c b"), (9008, "日本語 テスト 🙂👍🏽 ﷺ"), (None, "the null id"), (None, "the null id"), (9009, "x" * 9000 + " " + "é" * 4000), (9009, "x" * 9000 + " " + "é" * 4000),
    (9010, "  lead"), (9011, "trail  "), (9012, "ends in a space "), (9013, "don't  we'll \r\n\r\n it's"), (9014, " " * 500), (9015, "﻿bom a​b é á"),
    (9016, "the word " * 30_000), (-5, "The THE the"), (-(1 << 40), "the"), (1 << 60, "the"),
]


@pytest.fixture(scope="module")
def docs(spark, small):
    """The smallest documents, with odd ones, repeats and clashing names."""
    base = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    rows = base.unionByName(extra)
    return rows.withColumns({"chunk": F.lit(7), "bin": F.lit("clash"), "score": F.lit(1.5), "length": F.lit(True), "pairs": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


# -- search -----------------------------------------------------------------


def brute_search(texts, queries, k):
    held = [(i, Counter(re.findall(TERMS, (t or "").translate(LOWER)))) for i, t in texts]
    held = [(i, c, c.total()) for i, c in held if c]
    n, total = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c, size in held:
            m = 100 - 90 + (90 * size * n) // total
            score = 0
            for t in set(re.findall(TERMS, (text or "").translate(LOWER))):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(scores[:k], 1)]
    return out


QUERIES = [(1, None), (2, ""), (3, "the"), (4, "The null ID"), (4, "The null ID"), (5, "x" * 9000), (None, "é" * 4000 + " word"), (6, "日本語 テスト"), (7, "absent-term"), (8, "the word " * 5000)]


@pytest.fixture(scope="module")
def asked(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    return rows[:12] + QUERIES


@pytest.mark.parametrize("settings", [{}, {"BLOCK_TERMS": 200, "CHUNK_DOCS": 3, "WINDOW": 64, "BUCKET": 4}, {"CHUNK_BYTES": 5000, "WINDOW": 1, "GROUPS": 2}])
def test_search(spark, docs, texts, asked, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(search, name, value)
    queries = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id long, text string, score int")
    for k in (10,) if settings else (1, 10):
        assert bag(search.search(docs, queries, k).collect()) == bag(brute_search(texts, asked, k))


def test_search_without_rows(spark, docs, asked):
    queries = spark.createDataFrame(asked, "item_id long, text string")
    assert search.search(docs.limit(0), queries).count() == 0
    assert search.search(docs, queries.limit(0)).count() == 0
    assert search.search(docs.where("doc_id in (9001, 9002, 9003)"), queries).count() == 0
    names = ["item_id", "rank", "doc_id", "score"]
    assert search.search(docs, queries.limit(0)).columns == search.search(docs, queries).columns == names


# -- packing ----------------------------------------------------------------


@pytest.fixture(scope="module")
def encoded(texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(bpe.default_tokenizer())
    return [(i, [*coder.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("capacity, a_task", [(4096, 16_384), (4096, 20), (512, 9), (1, 3000)])
def test_packing(spark, docs, encoded, monkeypatch, capacity, a_task):
    monkeypatch.setattr(binpack, "PIECES_A_TASK", a_task)
    if capacity == 1:  # short documents only
        docs, encoded = docs.where("length(text) < 60 or text is null"), [x for x in encoded if len(x[1]) < 60 and x[0] is not None and x[0] > 9000]
        docs = docs.where("doc_id > 9000 and doc_id not in (9009, 9014, 9016)")
        encoded = [x for x in encoded if x[0] not in (9009, 9014, 9016) and x[0] < 1 << 50]
        docs = docs.where(f"doc_id < {1 << 50}")
    rows = binpack.pack(docs, bpe.default_tokenizer(), capacity).collect()
    want = [(i, k, a, len(ids[a : a + capacity]), crc(ids[a : a + capacity])) for i, ids in encoded for k, a in enumerate(range(0, len(ids), capacity))]
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == bag(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    best = len(packing.best_fit_decreasing([w[3] for w in want], capacity))
    # bins stay whole on the way up, which costs where a task packs a handful of pieces only
    assert len(held) <= best + (best // 100 if a_task > 100 else max(1, best // 25))


def test_packing_joins_open_bins(spark, monkeypatch):
    """A task for each piece: quarter bins meet on the way up, over three levels."""
    monkeypatch.setattr(binpack, "PIECES_A_TASK", 1)
    monkeypatch.setattr(binpack, "FAN", 4)
    rows = spark.createDataFrame([(i, "a " * 24) for i in range(64)], "doc_id long, text string")
    packed = binpack.pack(rows, bpe.default_tokenizer(), 100).collect()
    assert len({r.sequence_id for r in packed}) == 16


def test_sequences(spark, docs, encoded):
    packed = binpack.pack(docs, bpe.default_tokenizer(), 700, ids=True)
    lines = binpack.sequences(packed).collect()
    by_doc = defaultdict(Counter)
    for line in lines:
        ids = np.frombuffer(line.ids, "<u4")
        assert line.cu_seqlens[0] == 0 and line.cu_seqlens[-1] == len(ids) <= 700 and len(line.doc_ids) == len(line.cu_seqlens) - 1
        for doc, a, b in zip(line.doc_ids, line.cu_seqlens, line.cu_seqlens[1:]):
            by_doc[doc][tuple(ids[a:b].tolist())] += 1
    want = defaultdict(Counter)
    for i, ids in encoded:
        for a in range(0, len(ids), 700):
            want[i][tuple(ids[a : a + 700])] += 1
    assert by_doc == want


def test_packing_nothing(docs):
    assert binpack.pack(docs.limit(0), bpe.default_tokenizer()).count() == 0


# -- alignment --------------------------------------------------------------


def brute_align(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = align.default_paths()
    a_coder, b_coder = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_coder.encode_special_tokens = True
    entries_a, entries_b = (c.entries.to_pylist() for c in align.coders(path_a, path_b))
    found, count = [], Counter()
    for doc, text in texts:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = a_coder.encode(f" {text}", add_special_tokens=False).ids, b_coder.encode(text)
            if not b"".join(entries_a[i] for i in a) == b"".join(entries_b[i] for i in b) == f" {text}".encode():
                a = b = []
        i = j = first_a = first_b = end_a = end_b = 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            to_a, to_b = end_a + len(entries_a[a[i]]), end_b + len(entries_b[b[j]])
            if to_a <= to_b:
                i, end_a = i + 1, to_a
            if to_b <= to_a:
                j, end_b = j + 1, to_b
            if to_a == to_b:
                groups.append(",".join(map(str, a[first_a:i])) + "|" + ",".join(map(str, b[first_b:j])))
                first_a, first_b = i, j
        count.update(set(links))
        found.append((doc, len(a), len(b), groups, links))
    most = {}
    for (x, _), c in count.items():
        most[x] = max(most.get(x, 0), c)
    rows = [
        (doc, n_a, n_b, len(g), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for doc, n_a, n_b, g, links in found
    ]
    return rows, count, {doc: ";".join(g) for doc, _, _, g, _ in found}


@pytest.mark.parametrize("settings", [{}, {"CHUNK_BYTES": 3000, "BLOCK_BYTES": 40}])
def test_alignment(docs, texts, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(align, name, value)
    rows, count, groups = brute_align(texts)
    assert bag(align.align(docs, *align.default_paths()).collect()) == bag(rows)
    assert {(r.a, r.b): r.n_docs for r in align.pair_counts(docs, *align.default_paths()).collect()} == count
    assert {r.doc_id: r.groups for r in align.groups(docs, *align.default_paths()).collect()} == groups


def test_alignment_of_nothing(docs):
    assert align.align(docs.limit(0), *align.default_paths()).count() == 0
    rows = align.align(docs.where("doc_id in (9001, 9002, 9005)"), *align.default_paths()).collect()
    assert sorted(map(tuple, rows)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (9001, 9002, 9005)]


def test_components():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 30), (500, 700), (4000, 3999)):
        u, v = (rng.integers(0, n, m), rng.integers(0, n, m)) if m != 3999 else (np.arange(m), np.arange(m) + 1)
        home = list(range(n))

        def find(x, home=home):
            while home[x] != x:
                x = home[x]
            return x

        for a, b in zip(u.tolist(), v.tolist()):
            a, b = find(a), find(b)
            home[max(a, b)] = min(a, b)
        assert align.components(n, u, v).tolist() == [find(x) for x in range(n)]


def test_byte_tokens_on_every_character():
    """The byte encoder against the file's own library, each character in some places."""
    from tokenizers import Tokenizer

    path = align.default_paths()[0]
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    own = align.ByteTokens(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        texts = [f" a{c}b 1{c}2 !{c}? {c}  {c} x" for c in points[at : at + 4096]]
        assert own.encode(texts) == [e.ids for e in coder.encode_batch_fast(texts, add_special_tokens=False)]


def test_words_join_again(docs):
    """Texts cut into words encode to the same ids as whole texts, for random odd texts."""
    rng = np.random.default_rng(8)
    pool = [" ", " ", "  ", "\n", "\t", " ", " ", "　", "\x85", "\x1c", "a", "bc", "'s", "'", "1", "!", "é", "ñ", "日", "🙂", "́", "​", "▁", "<s>", "\x00"]
    texts = ["".join(rng.choice(pool, rng.integers(1, 30))) for _ in range(1500)]
    coders = align.coders(*align.default_paths())
    batch = align.align_chunk(0, list(range(len(texts))), [t.encode() for t in texts], *coders, digest=False)
    _, _, groups = brute_align(list(enumerate(texts)))
    assert batch["groups"].to_pylist()[:-1] == [groups[i] for i in range(len(texts))]


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_best_fit_packing", "op13_alignment"])
def test_registered(spark, small, name):
    assert registered.QUERIES[name](spark, small).count() > 0
