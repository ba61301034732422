"""Texts made to clash under a fixed hash, and keyed fingerprints."""

import numpy as np

from corpusloom.llm import jaccard, kern, quality, suffixes
from corpusloom.llm.io import cut


def twins(size: int = 2048) -> tuple[str, str]:
    """Two words with the same polynomial fingerprint for every base: the Thue-Morse
    sequence over two letters, and its complement."""
    ones = np.array([bin(i).count("1") & 1 for i in range(size)])
    return "".join("xy"[i] for i in ones), "".join("yx"[i] for i in ones)


def test_twins_clash_in_a_fixed_hash():
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in twins())
    at, end = np.array([0]), np.array([len(x)])
    assert kern.span_hash(kern.prefix_sums(x), at, end) == kern.span_hash(kern.prefix_sums(y), at, end)
    own = kern.Keyed(b"some key")
    assert own.spans(x, at, end) != own.spans(y, at, end)


def test_keyed():
    rng = np.random.default_rng(2)
    words = sorted({bytes(rng.integers(97, 100, rng.integers(1, 9)).tolist()) for _ in range(9000)}, key=lambda w: rng.random())
    buf = np.frombuffer(b" ".join(words + words), np.uint8)
    for key in (b"a", b"b" * 15):
        made = kern.Keyed(key).words(buf)
        n = len(words)
        assert len(set(made[:n].tolist())) == n and (made[:n] == made[n:]).all()
        # tables that grow in other steps hold the same numbers
        grown = kern.Keyed(key)
        grown.words(np.frombuffer(b"q" * 70_000, np.uint8))
        assert (grown.words(buf) == made).all()
        for width in (1, 3, 5):
            runs = kern.Keyed(key).windows(made, width)
            want = len({tuple(made[i : i + width].tolist()) for i in range(len(made) - width + 1)})
            assert len(set(runs.tolist())) == want
        assert len(kern.Keyed(key).windows(made[:2], 3)) == 0
    assert (kern.Keyed(b"a").words(buf) != kern.Keyed(b"b").words(buf)).all()


def test_jaccard_keeps_twins_apart(spark):
    x, y = twins()
    rows = spark.createDataFrame([(1, f"a {x} b"), (2, f"a {y} b"), (3, f"A {x} B")], "doc_id long, text string")
    got = jaccard.join(rows, jaccard.Rule(3, 90)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_jaccard_ids_of_reordered_texts(spark):
    """Texts with the same words in another order, whose shingle fingerprints have nearly the
    same sum: 64 pairs, of which plain sums gave several one id."""
    texts = [f"a{k} b{k} {mid} c{k} d{k}" for k in range(64) for mid in (f"x{k} y{k}", f"y{k} x{k}")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.join(rows, jaccard.Rule(3, 90)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(k, 4, k) for k in range(len(texts))]


def test_quality_tells_twins_apart(spark):
    x, y = twins()
    rows = spark.createDataFrame([(1, f"{x}\n{y}\n{x}")], "doc_id long, text string")
    assert quality.ledger(rows).select("n_dup_lines").first()[0] == 1


def test_suffixes_do_not_rest_on_fingerprints(spark, monkeypatch):
    """If every anchor's fingerprint clashed, the same bytes would go."""
    rng = np.random.default_rng(4)
    line = lambda n: "".join(rng.choice(list("abcdef "), n))
    shared = line(600)
    texts = [line(400), line(400), line(900) + shared + line(300), shared[:450] + line(500), line(1000), line(350) + shared]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, suffixes.dedup(rows).collect()))
    assert [r[2] for r in want] == [0, 0, 600, 450, 0, 600]
    monkeypatch.setattr(suffixes, "repeated_names", lambda items: cut(items.drop("core")))
    assert sorted(map(tuple, suffixes.dedup(rows).collect())) == want
