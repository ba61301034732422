"""Titles, tables of contents, side bars, search, badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules


def title(content: Column, path: Column) -> Column:
    """The first level-1 heading, else the file name in words."""
    own = F.regexp_extract(content, r"(?m)^[ \t]*# +([^\n]*)", 1)
    words = F.array_join(F.transform(F.split(F.translate(paths.stem(path), "-_", "  "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(own != "", paths.trimmed(own)).otherwise(words)


def contents_lines(docs: DataFrame, base: str = "/") -> DataFrame:
    """docs(doc_path, content) -> section, doc_path, line: one line of a table of contents each."""
    rows = docs.where("doc_path rlike '^(modules|api|guides|design)/[^/]+\\\\.md$'").where(~F.regexp_extract("doc_path", "[^/]*$", 0).isin("index.md", "_index.md"))
    line = F.concat(F.lit("- ["), title(F.col("content"), F.col("doc_path")), F.lit(f"]({base}"), F.col("doc_path"), F.lit(")"))
    return rows.select(F.regexp_extract("doc_path", "^([^/]+)/", 1).alias("section"), "doc_path", line.alias("line"))


def contents(docs: DataFrame, lang: str = "en", base: str = "/") -> DataFrame:
    """A table of contents, one text a section; a section's lines are its own files'."""
    labels = dict(zip(("toc", "home", "modules", "api"), rules.LABELS[lang], strict=True))
    lines = contents_lines(docs, base).groupBy("section").agg(F.array_sort(F.collect_list(F.struct("doc_path", "line"))).alias("rows"))
    head = F.when(F.col("section") == "modules", labels["modules"]).when(F.col("section") == "api", labels["api"]).otherwise(F.initcap("section"))
    return lines.select("section", F.concat(F.lit("## "), head, F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("toc"))


def sidebar(docs: DataFrame) -> DataFrame:
    """docs(doc_path, content) -> sort_key, line: side-bar lines in order of ``sort_key``.

    A key has, per level, files before directories and _index.md first, so no recursion is
    needed; a directory's line is made from any of its files."""
    shown = docs.where("doc_path like '%.md' and not doc_path rlike '(^|/)(assets/|[.])'")
    parts = F.split("doc_path", "/")
    depth = F.size(parts) - 1
    folders = F.transform(F.slice(parts, F.lit(1), depth), lambda p: F.concat(F.lit("2"), p))
    name = F.element_at(parts, -1)
    own = F.concat(F.when(name == "_index.md", F.lit("0")).otherwise(F.lit("1")), name)
    files = shown.select(F.array_join(F.concat(folders, F.array(own)), "/").alias("sort_key"), F.concat(F.repeat(F.lit("  "), depth), F.lit("- ["), title(F.col("content"), F.col("doc_path")), F.lit("](/"), F.col("doc_path"), F.lit(")")).alias("line"))
    level = F.explode(F.sequence(F.lit(1), depth)).alias("k")
    dirs = shown.where("doc_path like '%/%'").select(parts.alias("parts"), level).select(
        F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("k")), lambda p: F.concat(F.lit("2"), p)), "/").alias("sort_key"),
        F.concat(F.repeat(F.lit("  "), F.col("k") - 1), F.lit("- "), F.element_at("parts", F.col("k"))).alias("line"),
    )
    return files.unionAll(dirs.distinct())


def sidebar_json(docs: DataFrame, lang: str = "en") -> DataFrame:
    """docs(doc_path, content) -> one JSON text: the fixed first pages, then text and link of
    every module page, by name; without module pages, the first pages alone."""
    names = zip((rules.LABELS[lang][1], *rules.FIRST_PAGES[lang]), ("/", "/getting-started", "/architecture"), strict=True)
    first = F.array(*(F.struct(F.lit(text).alias("text"), F.lit(link).alias("link")) for text, link in names))
    pages = docs.where("doc_path rlike '^modules/[^/]+\\\\.md$'").where(~F.regexp_extract("doc_path", "[^/]*$", 0).isin("index.md", "_index.md"))
    items = pages.agg(F.array_sort(F.collect_list(F.struct(F.regexp_replace("doc_path", r"^(.*)\.md$", "/$1").alias("link"), title(F.col("content"), F.col("doc_path")).alias("text")))).alias("items"))
    own = F.when(F.size("items") > 0, F.transform("items", lambda i: F.struct(i["text"].alias("text"), i["link"].alias("link"))))
    return items.select(F.to_json(F.struct(first.alias("/"), own.alias("/modules/"))).alias("json"))


def search_index(docs: DataFrame, most: int = 5000) -> DataFrame:
    """docs(doc_path, content) -> path, title, url, body: Markdown marks stripped."""
    body = F.col("content")
    # fixed values: what is stripped, in order
    steps = (
        (r"^---[\s\S]*?---\n", ""), (r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"[*_~#]+([^*_\n]+)[*_~#]*", "$1"), (r"(?m)^#+\s+", ""), (r"(?m)^[-*+]\s+", ""), (r"(?m)^[ \t]+|[ \t]+$", ""), (r"\n{3,}", "\n\n"),
    )
    for pattern, to in steps:
        body = F.regexp_replace(body, pattern, to)
    own = F.regexp_extract("content", r"(?m)^#\s+([^\n]+)", 1)
    name = F.when(own != "", F.trim(own)).otherwise(F.translate(paths.stem(F.col("doc_path")), "-_", "  "))
    return docs.select(F.concat(F.lit("/"), "doc_path").alias("path"), name.alias("title"), F.concat(F.lit("/"), F.regexp_replace("doc_path", r"\.md$", ".html")).alias("url"), F.substring(body, 1, most).alias("body"))


def excerpt(body: Column, low: Column) -> Column:
    """The text around a lower-case term's first place in ``body``; empty without one."""
    at = F.instr(F.lower(body), low)
    start, end = F.greatest(at - 41, F.lit(0)), F.least(F.length(body), at - 1 + F.length(low) + 60)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(body, start + 1, end - start), F.when(end < F.length(body), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise("")


def search(index: DataFrame, term: str, most: int = 20) -> DataFrame:
    """index(doc_id, title, body) -> the first ``most`` hits, title hits first, with excerpts."""
    low = term.lower()
    found = F.lower("body").contains(low)
    hit = F.lower("title").contains(low)
    rows = index.where(hit | found).select("doc_id", "title", hit.alias("title_hit"), excerpt(F.col("body"), F.lit(low)).alias("excerpt"))
    return rows.orderBy(F.desc("title_hit"), "doc_id").limit(most)


def badge_width(text: Column) -> Column:
    wide, digits = F.regexp_count(text, F.lit("[一-龥]")), F.regexp_count(text, F.lit("[0-9]"))
    return (wide * 12 + digits * 7 + (F.length(text) - wide - digits) * 6 + 10).cast("long")


def badge_color(name: Column) -> Column:
    """A named colour's value; other names are colours themselves."""
    table = F.create_map(*(F.lit(x) for pair in rules.BADGE_COLORS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, name), name)


# fixed values: the badge's SVG and HTML
BADGE_SVG = '''<svg xmlns="http://www.w3.org/2000/svg" width="%1$s" height="20" role="img" aria-label="%4$s: %5$s">
  <title>%4$s: %5$s</title>
  <linearGradient id="s" x2="0" y2="100%%">
    <stop offset="0" stop-color="#bbb" stop-opacity=".1"/>
    <stop offset="1" stop-opacity=".1"/>
  </linearGradient>
  <clipPath id="r">
    <rect width="%1$s" height="20" rx="3" fill="#fff"/>
  </clipPath>
  <g clip-path="url(#r)">
    <rect width="%2$s" height="20" fill="%6$s"/>
    <rect x="%2$s" width="%3$s" height="20" fill="%7$s"/>
    <rect width="%1$s" height="20" fill="url(#s)"/>
  </g>
  <g fill="#fff" text-anchor="middle" font-family="Verdana,Geneva,DejaVu Sans,sans-serif" text-rendering="geometricPrecision" font-size="110">
    <text aria-hidden="true" x="%8$s" y="150" fill="#010101" fill-opacity=".3" transform="scale(.1)" textLength="%10$s">%4$s</text>
    <text x="%8$s" y="140" transform="scale(.1)" fill="#fff" textLength="%10$s">%4$s</text>
    <text aria-hidden="true" x="%9$s" y="150" fill="#010101" fill-opacity=".3" transform="scale(.1)" textLength="%11$s">%5$s</text>
    <text x="%9$s" y="140" transform="scale(.1)" fill="#fff" textLength="%11$s">%5$s</text>
  </g>
</svg>'''
BADGE_HTML = '''<span style="display:inline-flex;align-items:center;font-family:Verdana,sans-serif;font-size:11px;line-height:1;white-space:nowrap;">
  <span style="background:%3$s;color:#fff;padding:3px 6px;border-radius:3px 0 0 3px;">%1$s</span>
  <span style="background:%4$s;color:#fff;padding:3px 6px;border-radius:0 3px 3px 0;">%2$s</span>
</span>'''


def badge_svg(label: Column, message: Column, color: Column, label_color: Column | None = None) -> Column:
    left, right = badge_width(label), badge_width(message)
    back = badge_color(F.lit("gray") if label_color is None else label_color)
    # ten times the middles of both halves: whole numbers
    middles = left * 5, left * 10 + right * 5
    return F.format_string(BADGE_SVG, left + right, left, right, label, message, back, badge_color(color), *middles, (left - 10) * 10, (right - 10) * 10)


def badge_markdown(label: Column, message: Column, color: Column) -> Column:
    data = F.translate(F.base64(F.encode(badge_svg(label, message, color), "UTF-8")), "\r\n", "")
    return F.concat(F.lit("!["), label, F.lit("](data:image/svg+xml;base64,"), data, F.lit(")"))


def badge_html(label: Column, message: Column, color: Column, label_color: Column | None = None) -> Column:
    return F.format_string(BADGE_HTML, label, message, badge_color(F.lit("gray") if label_color is None else label_color), badge_color(color))


def coverage_color(share: Column) -> Column:
    return F.when(share >= 80, "brightgreen").when(share >= 60, "yellow").when(share >= 40, "orange").otherwise("red")
