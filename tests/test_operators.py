"""Hand-made vectors and properties of the operators."""

import hashlib
import base64
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths, rules
from corpusloom.operators import docstrings, documents, files, graph, modules, navigation, projects, snapshot, translation
from corpusloom.plans import incremental
from corpusloom.sources import sinks, tree
from corpusloom.streaming import changes


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "path, want",
    [("src/core/analyzeProject.ts", "modules/core/analyze-project.md"), ("src/main.py", "modules/main.md"), ("src/a/b_c.go", "modules/a/b-c.md"), ("lib/x.ts", None), ("src/x.md", None)],
)
def test_infer_doc_path(spark, path, want):
    assert one(spark, paths.infer_doc_path(F.col("p")), p=path) == want


@pytest.mark.parametrize("path, want", [("a/b.ts", ".ts"), (".bashrc", ""), ("a.tar.gz", ".gz"), ("x/y", ""), ("a/.x.y", ".y")])
def test_extension(spark, path, want):
    assert one(spark, paths.extension(F.col("p")), p=path) == want


def test_normalise(spark):
    assert one(spark, paths.normalise(F.col("p")), p="a/./b/../c//d/../../e") == "a/e"


def test_sanitise(spark):
    text, n = documents.sanitised(F.col("c"), "/R")
    rows = {
        "[a](file:///R/src/foo.ts#L1-L50)": ("[a](/src/foo.ts#L1-L50)", 1),
        "[a](src/foo.ts)": ("[a](/src/foo.ts)", 1),
        "[a](/R/lib/x.ts)": ("[a](/lib/x.ts)", 1),
        "[a](/src/foo.ts)": ("[a](/src/foo.ts)", 0),
        "[a](file:///else/src/foo.ts)": ("[a](file:///else/src/foo.ts)", 0),
    }
    got = spark.createDataFrame([(c,) for c in rows], "c string").select("c", text.alias("t"), n.alias("n"))
    assert {r.c: (r.t, r.n) for r in got.collect()} == rows
    again = got.select(F.col("t").alias("c")).select(text.alias("t"), F.col("c"))
    assert again.where("t <> c").count() == 0


def test_source_refs_drop_placeholders(spark):
    docs = spark.createDataFrame([("d.md", "[x](/src/a.ts#L2-L5) [y](../lib/b.py) [z](/src/source.ts) [e](/src/example/q.ts) [w](/src/a.ts#L2-L5) [f](/src/dir/)")], "doc_path string, content string")
    got = {(r.file, r.line_start, r.line_end) for r in documents.source_refs(docs).collect()}
    assert got == {("src/a.ts", 2, 5), ("lib/b.py", None, None)}


@pytest.mark.parametrize("blocks, want", [("m", 0), ("mt", 1), ("t", 1), ("mm", 1), ("tm", 1)])
def test_code_examples(spark, blocks, want):
    fence = {"m": "```mermaid\nA\n```\n", "t": "```ts\nx\n```\n"}
    docs = spark.createDataFrame([("d.md", "".join(fence[b] for b in blocks))], "doc_path string, content string")
    assert documents.metrics(docs).first().n_examples == want


@pytest.mark.parametrize("score, level", [(6, "basic"), (7, "standard"), (11, "standard"), (12, "professional")])
def test_levels(spark, score, level):
    # traced 2, and links, examples, diagrams and sections as the score asks
    rest = score - 2
    cells = {"n_sections": 0, "n_subsections": 0, "n_empty": 0, "n_diagrams": 0, "n_examples": 0, "n_links": 0, "n_lines": 0}
    for name, steps in (("n_diagrams", {3: 3, 2: 2, 1: 1}), ("n_links", {2: 3, 1: 1}), ("n_examples", {2: 3, 1: 1}), ("n_lines", {1: 50})):
        best = max((p for p in steps if p <= rest), default=0)
        if best:
            cells[name], rest = steps[best], rest - best
    if rest:
        cells["n_sections"] = {1: 1, 2: 5, 3: 8}[rest]  # few empty sections give a point too
    row = spark.range(1).select(F.lit("d").alias("doc_path"), *(F.lit(v).cast("long").alias(k) for k, v in cells.items()), F.lit(True).alias("traced"))
    got = documents.levels(row).first()
    assert (got.score, got.level) == (score, level)


@pytest.mark.parametrize("levels, code", [(["standard"], 0), (["basic", "standard", "standard", "standard"], 1), (["basic"] * 3 + ["standard"], 2)])
def test_exit_code(spark, levels, code):
    rows = spark.createDataFrame([(x, 0, 0) for x in levels], "level string, n_diagrams long, n_empty long")
    assert documents.rollup(rows).first().exit_code == code


def test_lint(spark):
    body = "x\n```mermaid\nA[x]\nsubgraph A[y]\nB[\"q\"]\nclass[z]\n%% end[x]\nsubgraph S[\"t\"]\n```\n```mermaid\nA[z]\n"
    got = {(r.number, r.rule, r.name) for r in documents.lint_diagrams(spark.createDataFrame([(1, body)], "doc_id long, content string")).collect()}
    assert got == {(3, "id used twice", "A"), (4, "quoted label", "B"), (5, "reserved id", "class"), (7, "quoted subgraph", "S")}


def test_gitignore(spark):
    lines = spark.createDataFrame([(x,) for x in ("dist/", "tmp", "*.log", "!keep/", "a/b", "x.y")], "line string")
    assert {r.name for r in files.gitignore_dirs(lines).collect()} == {"dist", "tmp"}


def test_diff_properties(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    b = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "path string, hash string")
    assert {r.status for r in snapshot.diff(a, a).collect()} == {"unchanged"}
    assert {(r.path, r.status) for r in snapshot.diff(b, a).collect()} == {("a", "deleted"), ("b", "unchanged"), ("c", "modified"), ("d", "added")}


def test_impact(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("a", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {r.node: (r.depth, r.chain) for r in graph.impact(edges, seeds).collect()}
    assert got == {"b": (1, ["a", "b"]), "c": (2, ["a", "b", "c"]), "d": (3, ["a", "b", "c", "d"])}
    assert graph.impact(edges, seeds, 0).count() == 0
    assert {r.node for r in graph.closure(edges, seeds).collect()} == set("abcde")
    with pytest.raises(ValueError):
        graph.impact(edges, seeds, float("nan"))


def test_imports_resolve(spark):
    tree_ = [
        ("src/a/x.ts", "import { q } from './y';\nimport '../b/index.js';\nconst z = require('./z.js')"), ("src/a/y.tsx", ""), ("src/b/index.ts", ""), ("src/a/z/index.js", ""),
        ("pkg/m.py", "from .n import x\nfrom ..top import y\n"), ("pkg/n.py", ""), ("top.py", ""), ("r.rs", "mod other;"), ("other.rs", ""),
    ]
    rows = spark.createDataFrame(tree_, "path string, content string")
    got = {(r.src, r.dst) for r in graph.resolve(graph.imports(rows), rows).collect()}
    assert got == {("src/a/x.ts", "src/a/y.tsx"), ("src/a/x.ts", "src/b/index.ts"), ("src/a/x.ts", "src/a/z/index.js"), ("pkg/m.py", "pkg/n.py"), ("pkg/m.py", "top.py"), ("r.rs", "other.rs")}


@pytest.mark.parametrize("score, exports, role, want", [(50, 0, "x", "full"), (29, 4, "x", "simple"), (40, 6, "utility", "simple"), (40, 6, "core", "full")])
def test_template(spark, score, exports, role, want):
    assert one(spark, modules.template(F.col("s"), F.col("e"), F.col("r")), s=score, e=exports, r=role) == want


def test_translation_round(spark):
    sources = spark.createDataFrame([("en", "a", "1"), ("en", "b", "2"), ("en", "c", "3")], "lang string, file string, hash string")
    targets = sources.where("file <> 'c'").select("lang", "file")
    memory = spark.createDataFrame([("en", "a", "1"), ("en", "b", "0"), ("xx", "z", "9")], "lang string, file string, hash string")
    state = lambda m: {r.file: r.status for r in translation.status(sources, targets, m).collect()}
    assert state(memory) == {"a": "synced", "b": "outdated", "c": "missing"}
    synced = translation.sync(memory, sources, targets)
    assert state(synced) == {"a": "synced", "b": "synced", "c": "missing"}
    assert synced.where("lang = 'xx'").count() == 1


def test_plan_parts_are_disjoint(spark, small):
    from corpusloom.plans.catalog import planned

    plan = planned(spark, small)
    affected, kept = ({r.doc_path for r in df.collect()} for df in (plan.affected, plan.preserved))
    assert affected and kept and not affected & kept


def test_enriched_by_name(spark):
    src = spark.createDataFrame([("src/a/fooBar.ts",), ("src/x.ts",)], "path string")
    docs = spark.createDataFrame([("modules/a/foo-bar.md",)], "doc_path string")
    assert [(r.doc_path, r.source_path) for r in incremental.by_name(src, docs).collect()] == [("modules/a/foo-bar.md", "src/a/fooBar.ts")]


def test_docstrings(spark):
    rows = [
        ("a.py", 'def f(a):\n    """Does.\n\n    Args:\n        a (int): n\n        b: m\n    Returns:\n        one\n    Example:\n        f(1)\n    """\n'),
        ("b.py", 'def g(a: int) -> int:\n    """No."""\n'),
        ("c.ts", "/** Adds.\n * @param {number} a - first\n * @returns {number} sum\n */\nexport function add(a) {}\n\n/** A class. */\nclass K {}\n"),
    ]
    got = {r.name: r for r in docstrings.entries(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert set(got) == {"f", "add", "K"}
    assert [(p.name, p.type) for p in got["f"].params] == [("a", "int"), ("b", "Any")] and got["f"].returns in ("one", "")
    assert got["add"].returns == "number: sum" and got["add"].params[0].description == "first" and got["K"].type == "class" and got["K"].line == 7


def test_docstring_odd_files(spark):
    rows = [
        ("a.py", None),
        ("b.ts", ""),
        ("c.go", "/** x */\nclass A {}"),
        (None, "/** x */\nclass A {}"),
        ("d.js", "/** One */ const a = 1;\n\n/** Two\r\n * @param {string} b no dash\n * @param c\n * @return {T} r\n * @example\n * use(b)\n */\nasync function two() {}"),
        ("e.PY", "import x\n\nasync def f(a):\n    '''Says.\n    Params:\n        x.y: z: w\n        plain\n    Yields:\n        a\n        b'''\n\nclass C:\n    \"\"\"\"\"\"\n"),
    ]
    got = {r.name: r for r in docstrings.entries(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert set(got) == {"a", "two", "f", "C"}
    two, f = got["two"], got["f"]
    assert (two.line, two.description, two.returns) == (3, "Two use(b)", "T: r") and [tuple(p) for p in two.params] == [("b", "string", "no dash")]
    assert (f.line, f.description, f.returns, f.examples) == (2, "Says.", "b", []) and [tuple(p) for p in f.params] == [("y", "Any", "z: w")]
    assert (got["C"].description, got["C"].params, got["C"].returns, got["C"].line) == ("", [], None, 11)


def test_projects(spark):
    rows = spark.createDataFrame([("p", "Gem.gemspec", 'spec.version = "1.2"'), ("p", "sub/package.json", "{}"), ("q", "package.json", '{"devDependencies": {"vue": "3"}}')], "project string, path string, content string")
    assert {(r.project, r.language) for r in projects.languages(rows).collect()} == {("p", "ruby"), ("q", "javascript")}
    assert {r.value for r in projects.types(rows).where("project = 'q'").collect()} == {"nodejs", "vue"}
    assert [r.version for r in projects.own_version(rows).collect()] == ["1.2"]


def test_search_excerpt(spark):
    index = spark.createDataFrame([(1, "Needle", "x"), (2, "t", "a" * 100 + "needle" + "b" * 100), (3, "t", "none")], "doc_id long, title string, body string")
    got = navigation.search(index, "needle").collect()
    assert [r.doc_id for r in got] == [1, 2] and got[1].excerpt == "…" + "a" * 40 + "needle" + "b" * 60 + "…"


def test_tree_source(spark, tmp_path):
    for name, text in {"src/a.ts": "1", "src/_index.md": "2", ".hidden/x.ts": "3", "node_modules/y.ts": "4"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.text for r in tree.read_tree(spark, str(tmp_path), exclude="node_modules", partitionFiles="1").collect()}
    assert got == {"src/a.ts": "1", "src/_index.md": "2", ".hidden/x.ts": "3"}
    assert {r.path for r in tree.read_tree(spark, str(tmp_path), extensions=".md", content="false").collect()} == {"src/_index.md"}


def test_store_reads_only_what_is_below(spark, tmp_path):
    """Files beside the wanted ones are not read, however large; a single file is found too."""
    for name, text in (("docs/a.md", "a"), ("docs/deep/b.md", "b"), ("docs2/c.md", "c"), ("other.bin", "x" * 5000)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    most = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(most, 1000)
    try:
        found = lambda below: {r.path: r.text for r in tree.from_store(spark, str(tmp_path), below).collect()}
        assert found("docs") == {"docs/a.md": "a", "docs/deep/b.md": "b"}
        assert found("docs/a.md") == {"docs/a.md": "a"}
    finally:
        spark.conf.unset(most)
    assert len(tree.from_store(spark, str(tmp_path)).collect()) == 4


def test_walk_files_reads_documents_only(spark, tmp_path):
    from corpusloom import registry

    for name in ("documents.parquet/part-0.parquet", "documents.parquet/part-1.parquet", "lineitem.parquet"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * (1 if "part" in name else 500))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        rows = registry.QUERIES["walk_files"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    names = ["documents.parquet/part-0.parquet", "documents.parquet/part-1.parquet"]
    assert sorted(map(tuple, rows)) == [(n, hashlib.sha256(n.encode()).hexdigest()[:16]) for n in names]


def test_stream(spark, tmp_path):
    log, seen = tmp_path / "log", []
    log.mkdir()
    write = lambda name, rows: (log / name).write_text("\n".join(json.dumps({"path": p, "content": c, "at": "2024-01-01T00:00:00"}) for p, c in rows))

    def handle(batch, _):
        seen.append(sorted((r.path, r.status) for r in batch.collect()))

    run = lambda: changes.watch(spark, str(log), str(tmp_path / "store"), str(tmp_path / "cp"), handle).awaitTermination(60)
    write("1.json", [("a", "1"), ("b", "2")])
    run()
    write("2.json", [("a", "1x"), ("b", None), ("c", "3")])
    run()
    assert seen == [[("a", "added"), ("b", "added")], [("a", "modified"), ("b", "deleted"), ("c", "added")]]
    assert sinks.load(spark, str(tmp_path / "nowhere"), "path string").count() == 0


def test_badges(spark):
    svg = one(spark, navigation.badge_svg(F.col("p"), F.lit("90%"), F.lit("red")), p="测a1")
    assert svg.startswith('<svg xmlns="http://www.w3.org/2000/svg" width="65" height="20" role="img" aria-label="测a1: 90%">')
    assert '<rect x="35" width="30" height="20" fill="#e05d44"/>' in svg and '<rect width="35" height="20" fill="#555"/>' in svg
    assert '<text x="175" y="140" transform="scale(.1)" fill="#fff" textLength="250">测a1</text>' in svg and '<text x="500" y="140"' in svg and 'y2="100%"' in svg
    mark = one(spark, navigation.badge_markdown(F.col("p"), F.lit("90%"), F.lit("red")), p="测a1")
    head, data = mark.split(";base64,")
    assert head == "![测a1](data:image/svg+xml" and base64.b64decode(data[:-1]).decode() == svg


def test_register_language(spark):
    rows = spark.createDataFrame([("src/a/x.lua", "local m = require('b.y')\nfunction go() end"), ("b/y.lua", "")], "path string, content string")
    plain = rows.select(paths.language(F.col("path")).alias("l")).collect()
    rules.register_language("lua", (".lua",), aliases=("luajit",), excluded=("lua_modules",), imports=(r"require\('([^']+)'\)",), resolve=((".lua",), ("init.lua",)), exports=(r"\bfunction\s+(\w+)",))
    try:
        assert {r.l for r in plain} == {None} and {r.l for r in rows.select(paths.language(F.col("path")).alias("l")).collect()} == {"lua"}
        assert one(spark, paths.canonical_language(F.col("p")), p="LuaJIT") == "lua" and "lua_modules" in files.excluded_names()
        assert [r.specifier for r in graph.imports(rows).collect()] == ["b.y"] and [r.name for r in modules.exports(rows).collect()] == ["go"]
        assert rows.where(files.is_code(F.col("path"))).count() == 2
        with pytest.raises(ValueError):
            rules.register_language("lua2", (".lua",))
    finally:
        rules.forget_language("lua")
    assert one(spark, paths.language(F.col("p")), p="x.lua") is None


def test_discover_prefers_source_roots(spark):
    rows = spark.createDataFrame([("src/a/x.ts",), ("tools/y.ts",)], "path string")
    assert [tuple(r) for r in files.discover(rows).collect()] == [("src", "a", 1)]
    assert [tuple(r) for r in files.discover(rows.where("path like 'tools%'")).collect()] == [("", "tools", 1)]
    assert files.discover(rows.limit(0)).count() == 0


def test_lost_store_version_is_an_error(spark, tmp_path):
    from pyspark.errors import AnalysisException

    assert sinks.load(spark, str(tmp_path / "none"), changes.STORE).count() == 0
    with pytest.raises(AnalysisException):
        sinks.load(spark, str(tmp_path / "none"), changes.STORE, required=True)
