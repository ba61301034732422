"""Writing rows as files: whole or not at all, and redone after a stop."""

import json
import os

import pytest

from corpusloom.operators import projects
from corpusloom.sources import sinks, writer

FILES = "path string, text string"


def below(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8", newline="").read() for d, _, names in os.walk(root) for f in names}


def test_writes_and_replaces(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"d{k % 7}/f{k}.md", f"text {k} é\r\n" * (k % 3)) for k in range(60)]
    assert writer.write_files(spark.createDataFrame(rows, FILES), root) == 60
    assert below(root) == dict(rows)
    again = [("d0/f0.md", "new"), ("other", None), ("long", "x" * 3_000_000)]
    assert writer.write_files(spark.createDataFrame(again, FILES), root) == 3
    assert below(root) == dict(rows) | {"d0/f0.md": "new", "other": "", "long": "x" * 3_000_000}
    assert writer.write_files(spark.createDataFrame([], FILES), root) == 0
    assert not os.listdir(f"{root}/{writer.LOG}")


def test_file_uri(spark, tmp_path):
    assert writer.write_files(spark.createDataFrame([("a/b", "c")], FILES), f"file:{tmp_path}/x") == 1
    assert below(f"{tmp_path}/x") == {"a/b": "c"}


@pytest.mark.parametrize("bad", [None, "", "/abs", "a//b", "../up", "a/../b", "a/", f"{writer.LOG}/x", "twice"])
def test_failed_job_leaves_nothing(spark, tmp_path, bad):
    """Other tasks had staged their files; neither these nor the log remain."""
    root = str(tmp_path)
    rows = spark.createDataFrame([(f"f{k}", "x") for k in range(40)] + [("twice", "1"), (bad, "2")], FILES)
    with pytest.raises(Exception, match="no relative path|more than one row"):
        writer.write_files(rows, root)
    assert below(root) == {} and not os.listdir(f"{root}/{writer.LOG}")


def test_publishing_is_redone(spark, tmp_path):
    """A driver lost between commit and publishing, in the midst of it, or before the commit."""
    root = str(tmp_path)
    spark.dataSource.register(writer.FilesSink)
    rows = [(f"d/f{k}", str(k)) for k in range(30)]
    spark.createDataFrame(rows, FILES).repartition(3).write.format("corpus_files").mode("append").save(root)
    (log,) = os.listdir(f"{root}/{writer.LOG}")
    assert set(below(root)) & dict(rows).keys() == set()  # nothing is seen before it is published
    folder = next(n for n in os.listdir(f"{root}/{writer.LOG}/{log}") if n != writer.COMMIT)
    moved = os.listdir(f"{root}/{writer.LOG}/{log}/{folder}/d")[0]
    os.makedirs(f"{root}/d")
    os.rename(f"{root}/{writer.LOG}/{log}/{folder}/d/{moved}", f"{root}/d/{moved}")
    os.makedirs(f"{root}/{writer.LOG}/0-unfinished/x")
    # leftovers of a task attempt that the commit does not name
    os.makedirs(f"{root}/{writer.LOG}/{log}/lost")
    open(f"{root}/{writer.LOG}/{log}/lost/f99", "w").close()
    # the next writer finishes it first, so its own file is the later one
    assert writer.write_files(spark.createDataFrame([("d/f7", "later")], FILES), root) == 1
    assert {p: t for p, t in below(root).items() if not p.startswith(".")} == dict(rows) | {"d/f7": "later"}
    assert os.listdir(f"{root}/{writer.LOG}") == ["0-unfinished"]
    assert writer.publish(spark, root) == 0


def test_overwrite_is_refused(spark, tmp_path):
    spark.dataSource.register(writer.FilesSink)
    with pytest.raises(Exception, match="mode append"):
        spark.createDataFrame([("a", "b")], FILES).write.format("corpus_files").mode("overwrite").save(str(tmp_path))


def test_only_replaced_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "x", 0), ("b/c.md", "y", 2), ("d.md", "z", None)], "doc_path string, content string, n_replaced long")
    assert sinks.rewrite(docs, str(tmp_path)) == 1 and below(tmp_path) == {"b/c.md": "y"}


def test_structure(spark, tmp_path):
    files = [
        ("p", "src/api/a.ts", "x"), ("p", "src/api/b.ts", None), ("p", "src/api/b.ts", None), ("p", "lib/u/v/c.py", ""), ("p", "node_modules/q/index.js", ""), ("p", "README.md", "# P"), ("p", "docs/x.md", ""), ("p", "main.go", ""),
        ("q", "tools/t.go", ""), ("q", ".hid/t.go", ""), ("q", "go.mod", "module x"), ("r", "notes.txt", None), (None, "src/api/a.ts", ""), ("s", None, None),
    ]
    rows = projects.structure(spark.createDataFrame(files, "project string, path string, content string"), ["node_modules"])
    assert sinks.save_json(rows.withColumn("path", rows.projectName), "path", str(tmp_path)) == 4
    got = {name: json.loads(text) for name, text in below(tmp_path).items()}
    assert got["p"] == {
        "projectName": "p", "projectType": [], "entryPoints": ["main.go"], "docsFound": ["README.md", "docs/x.md"],
        "modules": [{"name": "u", "path": "lib/u", "files": 1}, {"name": "api", "path": "src/api", "files": 3}], "stats": {"totalFiles": 5, "totalModules": 2, "totalDocs": 2},
    }
    assert got["q"]["modules"] == [{"name": "tools", "path": "tools", "files": 1}] and got["q"]["projectType"] and got["q"]["stats"]["totalFiles"] == 2
    for name in "rs":
        assert got[name] == {"projectName": name, "projectType": [], "entryPoints": [], "modules": [], "docsFound": [], "stats": {"totalFiles": 0, "totalModules": 0, "totalDocs": 0}}
