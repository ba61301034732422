"""Markdown documents: source references, links, metrics, levels, issues, diagrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, rules
from ..functions.paths import count

ROOTS = "src|lib|app|packages"


def source_refs(docs: DataFrame) -> DataFrame:
    """docs(doc_path, content) -> doc_path, file, line_start, line_end: references to source
    files by root-relative and relative links, placeholders and directories left out."""

    def found(lead: str) -> DataFrame:
        pattern = rf"\[[^\n]*?\]\({lead}((?:{ROOTS})/[^\n]+?)(?:#L(\d+)(?:-L(\d+))?)?\)"
        cells = F.arrays_zip(*(F.regexp_extract_all("content", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "file"), (2, "a"), (3, "b"))))
        return docs.select("doc_path", F.explode(cells).alias("c")).select("doc_path", "c.file", F.expr("try_cast(c.a as int)").alias("line_start"), F.expr("try_cast(c.b as int)").alias("line_end"))

    file = F.col("file")
    made_up = file.rlike("^(src/source\\.ts|src/file\\.ts|src/diagram\\.ts|path/to/)") | file.contains("example") | file.contains("template")
    return found("/").unionAll(found(r"\.\.?/")).distinct().where(~made_up & ~file.endswith("/"))


def doc_index(refs: DataFrame) -> DataFrame:
    """The edge table between documents and sources; both directions read it."""
    return refs.select("doc_path", F.col("file").alias("source_path")).distinct()


def doc_links(docs: DataFrame) -> DataFrame:
    """docs(doc_path, content) -> src_doc, dst_doc: links to other Markdown documents, with
    ./ and ../ resolved against the linking document."""
    target = F.explode(F.regexp_extract_all("content", F.lit(r"\]\((?!http|#)([^)#\s]*\.md)(?:#[^)]*)?\)"), F.lit(1)))
    links = docs.select("doc_path", target.alias("to"))
    dst = F.when(F.col("to").startswith("."), paths.normalise(F.concat_ws("/", paths.dirname(F.col("doc_path")), F.col("to")))).otherwise(F.regexp_replace("to", "^/", ""))
    return links.select(F.col("doc_path").alias("src_doc"), dst.alias("dst_doc")).where("src_doc <> dst_doc").distinct()


def sanitised(content: Column, root: str) -> tuple[Column, Column]:
    """``content`` with links to files under ``root`` made root-relative, and how many."""
    quoted = "\\Q" + root.rstrip("/") + "\\E"
    steps = (
        (rf"(\[[^\n]*?\]\()file://[^)\n]*?{quoted}(/[^)\n]*\))", "$1$2"),
        (rf"(\[[^\n]*?\]\(){quoted}(/[^)]*\))", "$1$2"),
        (rf"(\[[^\n]*?\]\()((?:{ROOTS})/[^)]+\))", "$1/$2"),
    )
    total = F.lit(0).cast("long")
    for pattern, to in steps:
        total = total + count(pattern, content)
        content = F.regexp_replace(content, pattern, to)
    return content, total


def metrics(docs: DataFrame) -> DataFrame:
    """docs(doc_path, content) -> counts and flags, in built-in expressions only."""
    text, low = F.col("content"), F.lower("content")
    has = lambda words: reduce(Column.__or__, (low.contains(w) for w in words))
    lines = F.split(text, "\n", -1)
    # a heading of level 2 or 3 followed by blank lines up to the next heading or the end
    empty = count(r"(?m)^#{2,3} [^\n]*(?=(?:\n\s*)*(?:\n#{1,3} |\z))", text)
    return docs.select(
        "doc_path",
        F.size(lines).cast("long").alias("n_lines"),
        count("(?m)^## ", text).alias("n_sections"),
        count("(?m)^### ", text).alias("n_subsections"),
        empty.alias("n_empty"),
        count(r"```mermaid[\s\S]*?```", text).alias("n_diagrams"),
        count(r"```(?!mermaid)[\s\S]*?```", text).alias("n_examples"),
        F.floor(count(r"(?m)^\|.*\|$", text) / 2).cast("long").alias("n_tables"),
        count(r"\[.*?\]\((?!http).*?\.md.*?\)", text).alias("n_links"),
        text.rlike(r"\*\*Section sources\*\*|\*\*Diagram sources\*\*|file://").alias("traced"),
        has(rules.PRACTICE_WORDS).alias("has_practices"),
        has(rules.PERFORMANCE_WORDS).alias("has_performance"),
        has(rules.TROUBLE_WORDS).alias("has_trouble"),
    )


def points() -> Column:
    at_least = lambda name, *steps: reduce(lambda w, s: w.when(F.col(name) >= s[0], s[1]), steps[1:], F.when(F.col(name) >= steps[0][0], steps[0][1])).otherwise(0)
    headings = F.col("n_sections") + F.col("n_subsections")
    return (
        at_least("n_sections", (12, 3), (8, 2), (5, 1))
        + F.when((headings > 0) & (F.col("n_empty") / F.greatest(headings, F.lit(1)) <= F.lit(0.1).cast("double")), 1).otherwise(0)
        + at_least("n_subsections", (1, 1))
        + at_least("n_diagrams", (3, 3), (2, 2), (1, 1))
        + at_least("n_examples", (3, 2), (1, 1))
        + at_least("n_links", (3, 2), (1, 1))
        + F.when(F.col("traced"), 2).otherwise(0)
        + at_least("n_lines", (50, 1))
    ).cast("long")


def levels(found: DataFrame) -> DataFrame:
    """metrics -> the same with score (at most 15) and level."""
    rows = found.withColumn("score", points())
    return rows.withColumn("level", F.when(F.col("score") >= 12, "professional").when(F.col("score") >= 7, "standard").otherwise("basic"))


def role_of(path: Column) -> Column:
    """The role whose size is expected: by first directory, then by words of the file name."""
    name = F.lower(paths.stem(path))
    words = lambda ws: reduce(Column.__or__, (name.contains(w) for w in ws))
    first = F.element_at(F.split(path, "/"), 1)
    return F.when(first.isin("core", "internal") | words(rules.CORE_WORDS), "core").when(words(rules.UTILITY_WORDS), "utility").when(name.isin(*rules.INDEX_NAMES), "index").otherwise("other")


def expected(docs: DataFrame) -> DataFrame:
    """docs(doc_path) -> role and least lines, sections, diagrams and examples."""
    rows = docs.select("doc_path", role_of(F.col("doc_path")).alias("role"))
    names = ("min_lines", "min_sections", "min_diagrams", "min_examples")
    pick = lambda i: reduce(lambda w, kv: w.when(F.col("role") == kv[0], kv[1][i]), list(rules.EXPECTED.items())[1:], F.when(F.col("role") == "core", rules.EXPECTED["core"][i])).cast("long")
    return rows.select("*", *(pick(i).alias(n) for i, n in enumerate(names)))


def issues(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (doc_path, issue) for every shortfall of a document."""
    c, text = F.col, lambda x: F.col(x).cast("string")
    short = lambda what, have, need, tail="": F.when(c(have) < c(need), F.concat(F.lit(f"Insufficient {what}: "), text(have), F.lit("/"), text(need), F.lit(tail)))
    core = c("min_sections") >= 8
    found_issues = F.array_compact(F.array(
        short("lines", "n_lines", "min_lines", " (based on module complexity)"),
        short("sections", "n_sections", "min_sections"),
        short("diagrams", "n_diagrams", "min_diagrams"),
        short("code examples", "n_examples", "min_examples"),
        F.when(~c("traced") & (c("min_lines") >= 150), "Missing source tracing (Section sources)"),
        F.when(core & ~c("has_practices"), 'Core module missing "Best Practices" section'),
        F.when(core & ~c("has_performance"), 'Core module missing "Performance Optimization" section'),
        F.when(core & ~c("has_trouble"), 'Core module missing "Error Handling" section'),
        F.when(c("n_links") < 1, "Missing cross-links to related documents"),
    ))
    return found.join(wanted, "doc_path").select("doc_path", F.explode(found_issues).alias("issue"))


def empty_sections(docs: DataFrame) -> DataFrame:
    """(doc_path, issue) for every level 2 or 3 heading with nothing before the next heading."""
    titles = F.regexp_extract_all("content", F.lit(r"(?m)^(#{2,3} [^\n]*)(?=(?:\n\s*)*(?:\n#{1,3} |\z))"), F.lit(1))
    return docs.select("doc_path", F.explode(titles).alias("title")).select("doc_path", F.concat(F.lit('Empty section: "'), paths.trimmed(F.col("title")), F.lit('"')).alias("issue"))


def rollup(rows: DataFrame) -> DataFrame:
    """levels -> one row: totals, counts and shares (percent, one decimal) by level, exit code."""
    n = F.count(F.lit(1))
    level = lambda name: F.count_if(F.col("level") == name)
    share = lambda name: F.round(level(name) * F.lit(100.0).cast("double") / F.greatest(n, F.lit(1)), 1)
    code = F.when(level("basic") * 2 > n, 2).when(level("basic") > 0, 1).otherwise(0).cast("long")
    return rows.agg(
        n.alias("n_docs"), *(f(x).alias(f"{t}_{x}") for x in ("professional", "standard", "basic") for t, f in (("n", level), ("pct", share))),
        F.coalesce(F.sum("n_diagrams"), F.lit(0)).alias("n_diagrams"), F.coalesce(F.sum("n_empty"), F.lit(0)).alias("n_empty"), code.alias("exit_code"),
    )


def diagram_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, content) -> doc_id, block, row, line: the lines inside diagram fences,
    numbered from the line of the fence as 1 on in ``row``. A fence that nothing closes runs
    to the end."""
    lines = docs.select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "raw")).withColumn("line", paths.trimmed(F.col("raw")))
    order = Window.partitionBy("doc_id").orderBy("at")
    opens, closes = F.col("line") == "```mermaid", F.col("line") == "```"
    mark = F.last(F.when(opens, F.lit(1)).when(closes, F.lit(0)), ignorenulls=True).over(order)
    rows = lines.withColumn("inside", F.coalesce(mark, F.lit(0))).withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(order))
    start = F.min(F.when(opens, F.col("at"))).over(Window.partitionBy("doc_id", "block"))
    rows = rows.withColumn("row", (F.col("at") - start).cast("long")).withColumn("number", F.col("at").cast("long"))
    return rows.where((F.col("inside") == 1) & ~opens).select("doc_id", "block", "row", "number", "line")


def lint_diagrams(docs: DataFrame) -> DataFrame:
    """doc_id, number, severity, rule, name for every fault of a diagram line; ``number``
    is that of the line above, counted from 1."""
    rows = diagram_lines(docs).where("not line like '\\%\\%%'")
    line = F.col("line")
    get = lambda pattern, i=1: F.regexp_extract(line, pattern, i)
    box = get(r"^subgraph\s+([A-Za-z0-9_]+)\[")
    node = get(r"^([A-Za-z0-9_]+)\[")
    odd = get(r'^subgraph\s+([^\[\s"\-]+)\[')
    quoted_box = get(r'^subgraph\s+([A-Za-z0-9_]+)\["[^"]+"\](?:\s*\[|$)')
    reserved = get("^(" + "|".join(rules.RESERVED_IDS) + r")\[")
    quoted = get(r'^\s*([A-Za-z0-9_]+)\["[^"]+"\]\s*$')

    def fault(severity: str, rule: str, name: Column, test: Column) -> Column:
        return F.when((name != "") & test, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), name.alias("name")))

    always = F.lit(True)
    single = F.array_compact(F.array(
        fault("warn", "subgraph id", odd, ~odd.rlike("^[A-Za-z0-9_]+$")),
        fault("error", "quoted subgraph", quoted_box, always),
        fault("error", "reserved id", reserved, always),
        fault("error", "quoted label", quoted, always),
    ))
    out = rows.select("doc_id", "number", F.explode(single).alias("f")).select("doc_id", "number", "f.*")
    nodes = rows.select("doc_id", "block", node.alias("name")).where("name <> ''").distinct()
    boxes = rows.select("doc_id", "block", "number", box.alias("name")).where("name <> ''")
    clash = boxes.join(nodes, ["doc_id", "block", "name"]).select("doc_id", "number", F.lit("error").alias("severity"), F.lit("id used twice").alias("rule"), "name")
    return out.unionAll(clash)
