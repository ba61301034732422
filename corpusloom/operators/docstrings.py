"""Documentation comments of declarations, as rows.

Declarations are matches of a pattern, exploded with their line; a comment is an array of
lines, and each output column an expression over that array. No Python, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: declarations with comments, tags, parameters and section titles
SCRIPT = r"/\*\*\s*([\s\S]*?)\*/\s*(?:export\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type)\s+(\w+)"
PYTHON = r"""(?:^|\n)((?:async\s+)?def|class)\s+(\w+)[^:]*:\s*(?:\n\s+)?(?:\"\"\"([\s\S]*?)\"\"\"|'''([\s\S]*?)''')"""
SCRIPT_ENDINGS, PYTHON_ENDINGS = ("js", "jsx", "ts", "tsx", "mjs", "cjs"), ("py", "pyi")
PARAM_TAG = r"@param\s+\{([^}]+)\}\s+(\w+)\s*-?\s*(.*)"
RETURN_TAG = r"@returns?\s+\{([^}]+)\}\s*(.*)"
PARAM = r"(\w+)\s*(?:\(([^)]+)\))?\s*:\s*(.*)"
TITLES = {
    "params": ("Args:", "Arguments:", "Parameters:", "Params:"),
    "returns": ("Returns:", "Return:", "Yields:"),
    "examples": ("Example:", "Examples:", "Usage:"),
}
OTHER_TITLE = r"^[^:]*:$"

def group(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, pattern, k)


def line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def declarations(files: DataFrame, endings: tuple[str, ...], pattern: str) -> DataFrame:
    """path, hit, line of every match of ``pattern`` in files with these endings: the line
    follows from the line breaks in the text between matches and in earlier matches."""
    content = F.coalesce("content", F.lit(""))
    own = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*endings)).select("path", F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("hits"), F.split(content, pattern, -1).alias("between"))
    breaks = lambda texts, n: F.aggregate(F.slice(texts, F.lit(1), n), F.lit(0), lambda total, t: total + line_breaks(t))
    placed = F.transform("hits", lambda hit, k: F.struct(hit.alias("hit"), (breaks("between", k + 1) + breaks("hits", k) + 1).cast("long").alias("line")))
    return own.select("path", F.inline(placed))


def params(lines: Column, pattern: str, name: int, kind: int) -> Column:
    """The parameters that lines describe: name, type ("Any" where none is given), description."""
    typed = lambda line: F.when(group(line, pattern, kind) == "", "Any").otherwise(group(line, pattern, kind))
    read = lambda line: F.struct(group(line, pattern, name).alias("name"), typed(line).alias("type"), group(line, pattern, 3).alias("description"))
    return F.transform(F.filter(lines, lambda line: line.rlike(pattern)), read)


def script_entries(files: DataFrame) -> DataFrame:
    """Entries of block comments that stand directly before a declaration."""
    hit, lines = F.col("hit"), F.col("lines")
    rows = declarations(files, SCRIPT_ENDINGS, SCRIPT)
    rows = rows.withColumn("lines", F.transform(F.split(group(hit, SCRIPT, 1), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^\*\s?", "")))
    words, whole = F.filter(lines, lambda x: ~x.startswith("@")), F.lower(hit)
    kind = F.coalesce(*(F.when(whole.contains(k), k) for k in ("class", "interface", "type")), F.lit("function"))
    results = F.filter(lines, lambda x: x.rlike("^" + RETURN_TAG))
    result = lambda x: F.concat(group(x, RETURN_TAG, 1), F.lit(": "), group(x, RETURN_TAG, 2))
    return rows.select(
        "path", group(hit, SCRIPT, 2).alias("name"), kind.alias("type"), F.trim(F.array_join(words, " ")).alias("description"),
        params(lines, "^" + PARAM_TAG, 2, 1).alias("params"), result(F.try_element_at(results, F.lit(-1))).alias("returns"), F.array().cast("array<string>").alias("examples"), "line",
    )


def python_entries(files: DataFrame) -> DataFrame:
    """Entries of documentation strings of top-level functions and classes.

    A line belongs to the section of the last title above it."""
    hit = F.col("hit")
    body = F.when(group(hit, PYTHON, 3) != "", group(hit, PYTHON, 3)).otherwise(group(hit, PYTHON, 4))
    section = lambda x: F.coalesce(*(F.when(x.isin(*titles), name) for name, titles in TITLES.items()), F.when(x.rlike(OTHER_TITLE), "other"))
    rows = declarations(files, PYTHON_ENDINGS, PYTHON).withColumn("lines", F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))
    rows = rows.withColumn("titles", F.filter(F.transform("lines", lambda x, at: F.struct(at.alias("at"), section(x).alias("of"))), lambda t: t["of"].isNotNull()))
    above = lambda at: F.try_element_at(F.filter("titles", lambda t: t["at"] <= at), F.lit(-1))["of"]
    told = F.filter(F.transform("lines", lambda x, at: F.struct(x.alias("line"), F.coalesce(above(at), F.lit("description")).alias("of"))), lambda x: section(x["line"]).isNull())
    rows = rows.withColumn("told", told)
    under = lambda name: F.transform(F.filter("told", lambda x: x["of"] == name), lambda x: x["line"])
    return rows.select(
        "path", group(hit, PYTHON, 2).alias("name"), F.when(group(hit, PYTHON, 1).contains("def"), "function").otherwise("class").alias("type"),
        F.trim(F.array_join(under("description"), " ")).alias("description"), params(under("params"), PARAM, 1, 2).alias("params"),
        F.try_element_at(under("returns"), F.lit(-1)).alias("returns"), under("examples").alias("examples"), "line",
    )


def entries(files: DataFrame) -> DataFrame:
    """files(path, content) -> one row an entry; other languages than scripts and Python have none."""
    return script_entries(files).unionByName(python_entries(files))


def summary(found: DataFrame) -> DataFrame:
    n = lambda test, name: F.count_if(test).alias(name)
    kind = F.col("type")
    return found.agg(F.count(F.lit(1)).alias("total"), n(kind == "function", "functions"), n(kind == "class", "classes"), n(kind.isin("type", "interface"), "types"), n(F.size("examples") > 0, "with_examples"))


def markdown(found: DataFrame) -> DataFrame:
    """path, md: the entries of a file as Markdown, functions, classes, then types."""
    order = F.when(F.col("type") == "function", 1).when(F.col("type") == "class", 2).otherwise(3)
    params = F.array_join(F.transform("params", lambda p: F.concat(F.lit("- `"), p["name"], F.lit("` ("), p["type"], F.lit("): "), p["description"])), "\n")
    text = F.concat(
        F.lit("### `"), "name", F.lit("`\n\n"), "description", F.lit("\n"),
        F.when((F.size("params") > 0) & (order == 1), F.concat(F.lit("\n**参数:**\n\n"), params, F.lit("\n"))).otherwise(""),
        F.when(F.col("returns").isNotNull() & (order == 1), F.concat(F.lit("\n**返回值:** "), "returns", F.lit("\n"))).otherwise(""),
    )
    rows = found.select("path", order.alias("o"), "line", text.alias("text")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("o", "line", "text"))).alias("rows"))
    part = lambda k, head: F.when(F.exists("rows", lambda r: r["o"] == k), F.concat(F.lit(f"## {head}\n\n"), F.array_join(F.transform(F.filter("rows", lambda r: r["o"] == k), lambda r: r["text"]), "\n")))
    return rows.select("path", F.concat_ws("\n", part(1, "函数"), part(2, "类"), part(3, "类型定义")).alias("md"))
