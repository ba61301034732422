"""Stores, streams, digests and deltas over changes."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import delta, documents, graph, merkle, snapshot
from corpusloom.streaming import changes
from corpusloom.streaming.store import KeyedStore


def pairs(df):
    return sorted(map(tuple, df.collect()))


def table(spark, rows, names="path string, hash string"):
    return spark.createDataFrame(rows, names)


def part_files(path):
    return [p for p in Path(path).rglob("part-*.parquet")]


def test_store(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "path string, hash string", ("path",), buckets=8, ratio=10.0, most=3)
    assert pairs(store.rows()) == [] and pairs(store.lookup(table(spark, [("a", "")]))) == []
    want, gone = {}, lambda *p: table(spark, [(x, None) for x in p])
    for v in range(1, 9):
        up = {f"k{v}": str(v), "same": str(v)}
        want |= up
        out = [f"k{v - 3}"] if v > 3 else []
        for p in out:
            del want[p]
        assert store.apply(table(spark, list(up.items())), gone(*out)) == v
        store.merge()
        assert dict(pairs(store.rows())) == want
    assert dict(pairs(store.lookup(table(spark, [("same", ""), ("k1", ""), ("k8", "")])))) == {"same": "8", "k8": "8"}
    assert dict(pairs(store.rows(before=3))) == {"k1": "1", "k2": "2", "same": "2"}
    assert {r.kind for r in store.commits().collect()} == {"base", "run", "delta"}  # the first batch became a base
    assert store.merge(force=True) == "base" and dict(pairs(store.rows())) == want and store.merge(force=True) is None


def test_store_without_changes(spark, tmp_path):
    store = changes.file_store(spark, str(tmp_path / "s"))
    none = table(spark, [])
    store.apply(none, none)
    assert pairs(store.rows()) == [] and store.merge() is None or pairs(store.rows()) == []
    store.apply(table(spark, [("a", "1"), (None, "2")]), none)
    assert dict(pairs(store.lookup(table(spark, [("a", "")])))) == {"a": "1"}


def batch_of(spark, rows, at="2024-01-01T00:00:00"):
    return spark.createDataFrame([(p, c, at) for p, c in rows], "path string, content string, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_twenty_batches(spark, tmp_path):
    """The state after each batch; what is written follows the change, not the store."""
    store = changes.file_store(spark, str(tmp_path / "s"), buckets=16)
    first = [(f"d/f{i}", f"content {i}") for i in range(2000)]
    state, sizes = dict(first), []
    changes.apply_batch(batch_of(spark, first), store, "s", 0)
    base = len(part_files(tmp_path / "s"))
    for b in range(1, 20):
        rows = [(f"d/f{b}", f"new {b}"), (f"d/f{100 + b}", None), (f"e/g{b}", "x"), (f"d/f{200 + b}", f"content {200 + b}")]
        got = changes.apply_batch(batch_of(spark, rows), store, "s", b)
        assert sorted((r.path, r.status) for r in got.collect()) == sorted([(f"d/f{b}", "modified"), (f"d/f{100 + b}", "deleted"), (f"e/g{b}", "added")])
        for p, c in rows:
            state.pop(p, None) if c is None else state.__setitem__(p, c)
        delta_dir = tmp_path / "s" / "delta" / f"version={b + 1}"
        sizes.append(len(part_files(delta_dir)))
    assert max(sizes) <= 3 and base <= 50
    want = pairs(snapshot.snapshot(table(spark, list(state.items()), "path string, content string")))
    assert pairs(store.rows()) == want


def test_batch_again(spark, tmp_path):
    """A batch that ran before gives the same changes and the same state."""
    store = changes.file_store(spark, str(tmp_path / "s"), ratio=0.0)
    changes.apply_batch(batch_of(spark, [("a", "1"), ("b", "2")]), store, "s", 0)
    rows = batch_of(spark, [("a", "1x"), ("b", None), ("c", "3")])
    one, state = pairs(changes.apply_batch(rows, store, "s", 1)), pairs(store.rows())
    assert pairs(changes.apply_batch(rows, store, "s", 1)) == one and pairs(store.rows()) == state
    # another stream over the same store goes on from its state
    assert pairs(changes.apply_batch(batch_of(spark, [("a", "1x"), ("d", "4")]), store, "other", 0).select("path", "status")) == [("d", "added")]
    assert [p for p, _ in pairs(store.rows())] == ["a", "c", "d"]


def test_failed_batch(spark, tmp_path):
    """A batch whose changes are not taken runs again, and is written once."""
    log, seen, fail = tmp_path / "log", [], [True]
    log.mkdir()

    def handle(batch, number):
        if number == 1 and fail.pop():
            raise ValueError("not yet")
        seen.append(sorted((r.path, r.status) for r in batch.collect()))

    def run():
        changes.watch(spark, str(log), str(tmp_path / "store"), str(tmp_path / "cp"), handle).awaitTermination(120)

    write = lambda name, rows: (log / name).write_text("\n".join(json.dumps({"path": p, "content": c, "at": "2024-01-01T00:00:00"}) for p, c in rows))
    write("1.json", [("a", "1"), ("b", "2")])
    run()
    write("2.json", [("a", "1x"), ("b", None), ("c", "3")])
    with pytest.raises(Exception, match="not yet"):
        run()
    fail.append(False)
    run()
    assert seen == [[("a", "added"), ("b", "added")], [("a", "modified"), ("b", "deleted"), ("c", "added")]]


def test_equal_times(spark):
    rows = batch_of(spark, [("a", None), ("a", "1"), ("a", "2"), ("b", None)])
    assert pairs(changes.last_entries(rows)) == [("a", "2"), ("b", None)]


# -- digests ----------------------------------------------------------------


def test_merkle(spark):
    old = {f"a/b{i}/c{j}/f{k}": "h" for i in range(4) for j in range(4) for k in range(4)} | {"top": "1", "gone/x": "1"}
    new = {**old, "a/b1/c2/f3": "changed", "a/b3/new": "1", "top": "2"}
    del new["gone/x"]
    sides = [table(spark, list(t.items())) for t in (new, old)]
    assert pairs(merkle.diff(*sides).select("path", "status")) == [("a/b1/c2/f3", "modified"), ("a/b3/new", "added"), ("gone/x", "deleted"), ("top", "modified")]
    met = {r.level: r.met for r in merkle.differing(*(merkle.digested(s) for s in sides)).collect()}
    # root; a and gone; four below a; below b1 and b3 only
    assert met == {0: 1, 1: 2, 2: 4, 3: 8}
    assert pairs(merkle.subtree_counts(*sides)) == [("", 4), ("a", 2), ("a/b1", 1), ("a/b1/c2", 1), ("a/b3", 1), ("gone", 1)]
    assert pairs(merkle.diff(sides[0], sides[0])) == []
    none = table(spark, [])
    assert pairs(merkle.diff(none, none)) == [] and len(pairs(merkle.diff(none, sides[1]))) == len(old)


# -- deltas -----------------------------------------------------------------


def test_deps_delta(spark):
    """An import is decided again when a better file comes or its file goes."""
    old = [("a/x.ts", "import './m'"), ("a/m.js", ""), ("a/y.ts", "import './m'; require('./m.js')"), ("b/z.py", "from .q import r"), ("b/q.py", "")]
    new = [("a/x.ts", "import './m'"), ("a/m.js", ""), ("a/m.ts", ""), ("a/y.ts", "import './m'; require('./m.js')"), ("b/z.py", "from .q import r"), ("a/n.ts", "import './x'")]
    names = "path string, content string"
    state = delta.deps(table(spark, old, names))
    assert pairs(state.edges) == [("a/x.ts", "a/m.js", 1), ("a/y.ts", "a/m.js", 2), ("b/z.py", "b/q.py", 1)]
    changed = [r for r in new if r not in old]
    came, went = [(p,) for p in ("a/m.ts", "a/n.ts")], [("b/q.py",)]
    after, change = delta.deps_delta(state, table(spark, changed, names), table(spark, came, "path string"), table(spark, went, "path string"), table(spark, [(p,) for p, _ in new], "path string"))
    full = delta.deps(table(spark, new, names))
    assert pairs(after.edges) == pairs(full.edges) and pairs(after.links) == pairs(full.links)
    assert pairs(after.candidates) == pairs(full.candidates.select(*after.candidates.columns))
    assert ("b/z.py", "b/q.py", -1) in pairs(change) and ("a/n.ts", "a/x.ts", 1) in pairs(change)


def test_index_delta(spark):
    names = "doc_path string, content string"
    old = [("a.md", "[x](/src/a.ts) [y](/src/b.ts)"), ("b.md", "[x](/src/a.ts)"), ("c.md", "[x](/src/c.ts)")]
    index = documents.doc_index(documents.source_refs(table(spark, old, names)))
    rows = delta.index_delta(index, table(spark, [("a.md", "[x](/src/a.ts) [y](/src/d.ts)"), ("n.md", "[x](/lib/n.ts)")], names), table(spark, [("c.md",)], "doc_path string"))
    assert pairs(rows.plus) == [("a.md", "src/d.ts"), ("n.md", "lib/n.ts")] and pairs(rows.minus) == [("a.md", "src/b.ts"), ("c.md", "src/c.ts")]
    assert pairs(rows.applied(index)) == [("a.md", "src/a.ts"), ("a.md", "src/d.ts"), ("b.md", "src/a.ts"), ("n.md", "lib/n.ts")]


def test_one_pass(spark, small, tmp_path):
    """Imports and exports read the files once, for all languages."""
    from corpusloom.operators import modules

    spark.createDataFrame([("src/a.ts", "x")], "path string, content string").write.parquet(str(tmp_path / "f"))
    rows = spark.read.parquet(str(tmp_path / "f"))
    for made in (graph.imports(rows), modules.exports(rows)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
