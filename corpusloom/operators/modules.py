"""Module signals, roles, templates and hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from .graph import matched


def _any(name: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (name.contains(w) for w in words))


def category(name: Column) -> Column:
    low = F.lower(name)
    steps = [(_any(low, words), label) for label, words in rules.CATEGORIES]
    return reduce(lambda w, s: w.when(*s), steps[1:], F.when(*steps[0])).otherwise("module")


def complexity(n_files: Column, n_lines: Column, n_exports: Column, depth: Column) -> Column:
    """A score of at most 100 from capped counts, rounded half up."""
    d = lambda c: c.cast("double")
    cap = lambda c, most: F.least(c, F.lit(float(most)))
    total = cap(d(n_files) * 3, 30) + cap(d(n_lines) / 50, 30) + cap(d(n_exports) * F.lit(1.5), 20) + cap(d(depth) * 5, 20)
    return F.least(F.floor(total + F.lit(0.5)), F.lit(100)).cast("long")


def nesting(files: DataFrame) -> DataFrame:
    """files(module, depth, content) -> module, n_files, n_lines, depth: directory depth plus
    one for every twenty indented lines (five at most), the most over files."""
    lines = F.split("content", "\n", -1)
    indented = F.size(F.filter(lines, lambda x: x.startswith("  ") | x.startswith("\t")))
    own = F.col("depth") + F.least(F.floor(indented / 20), F.lit(5))
    return files.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.size(lines)).cast("long").alias("n_lines"), F.max(own).cast("long").alias("depth"))


def exports(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, name: what each file's language lets other files use."""
    return matched(files, rules.EXPORTS).select("path", "name").distinct()


def export_samples(files: DataFrame, most: int = 20, samples: int = 10) -> DataFrame:
    """files(module, path, content) of modules' own directories -> module, n_exports (at
    most ``most``) and the first ``samples`` names, in order; modules without any have none."""
    names = exports(files).join(files.select("path", "module").distinct(), "path").select("module", "name").distinct()
    place = F.row_number().over(Window.partitionBy("module").orderBy("name"))
    counts = names.groupBy("module").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n_exports"))
    first = names.withColumn("place", place).where(F.col("place") <= samples).groupBy("module").agg(F.array_sort(F.collect_list("name")).alias("samples"))
    return counts.join(first, "module")


def degrees(edges: DataFrame) -> DataFrame:
    """edges(src, dst) of files -> module, n_in, n_out, is_entry. A module is a file's first
    two directories; in-degree counts distinct importers from outside."""
    module = lambda c: F.regexp_extract(c, "^([^/]+/[^/]+)/", 1)
    rows = edges.select("src", "dst", module("src").alias("from"), module("dst").alias("to"))
    out = rows.groupBy(F.col("from").alias("module")).agg(F.count(F.lit(1)).alias("n_out"))
    into = rows.where(F.col("from") != F.col("to")).groupBy(F.col("to").alias("module")).agg(F.count_distinct("src").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.join(into, "module", "full").select("module", zero("n_in"), zero("n_out"), (F.coalesce("n_in", F.lit(0)) > 0).alias("is_entry"))


def role(name: Column, is_entry: Column, n_in: Column, n_exports: Column, score: Column, n_files: Column) -> Column:
    low = F.lower(name)
    steps = [(_any(low, words), label) for label, words in rules.ROLES]
    steps += [(is_entry & (n_in > 5), "core"), (n_exports > 15, "core"), (score > 60, "core"), ((n_files <= 5) & (n_exports <= 5), "utility")]
    return reduce(lambda w, s: w.when(*s), steps[1:], F.when(*steps[0])).otherwise("unknown")


def template(score: Column, n_exports: Column, role_: Column) -> Column:
    return F.when((score >= 50) | (n_exports >= 10), "full").when((score < 30) & (n_exports < 5), "simple").when(role_.isin("test", "config", "utility"), "simple").otherwise("full")


def hints(name: Column, is_entry: Column, n_in: Column, n_out: Column, n_exports: Column) -> Column:
    low = F.lower(name)
    found = F.array_compact(F.array(
        *(F.when(low.rlike(rf"\b({words})"), hint) for words, hint in rules.HINTS),
        F.when(n_exports > 20, rules.HINT_EXPORTS),
        F.when(n_in > 10, rules.HINT_DEPENDED),
        F.when(is_entry & (n_out > 10), rules.HINT_ENTRY),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit(rules.HINT_NONE))).otherwise(found)


def report(rows: DataFrame) -> DataFrame:
    """Analysed modules -> module, md: a report in Markdown.

    Columns: module, path, language (null: unknown), n_files, n_lines, n_exports, score,
    is_entry, n_in, n_out, depth, role, template, hints. Role and template are taken as
    given; the reasons name the rule that gives them."""
    c = F.col
    named = reduce(Column.__or__, (_any(F.lower("module"), words) for _, words in rules.ROLES))
    told = lambda label, name: F.concat(F.lit(f"{label}="), c(name).cast("string"))
    by_name = F.try_element_at(F.create_map(*(F.lit(x) for pair in rules.ROLE_REASONS.items() for x in pair)), c("role"))
    # rule, reason and deciding signals, the first that holds
    steps = [
        (named, by_name, F.array(F.lit("directory name pattern"))),
        (c("is_entry") & (c("n_in") > 5), F.lit(rules.REASON_ENTRY), F.array(F.lit("isEntry=true"), told("incomingDeps", "n_in"))),
        (c("n_exports") > 15, F.lit(rules.REASON_EXPORTS), F.array(told("exportCount", "n_exports"))),
        (c("score") > 60, F.lit(rules.REASON_SCORE), F.array(told("complexityScore", "score"))),
        ((c("n_files") <= 5) & (c("n_exports") <= 5), F.lit(rules.REASON_SMALL), F.array(told("fileCount", "n_files"), told("exportCount", "n_exports"))),
        (F.lit(True), F.lit(rules.REASON_NONE), F.array(told("fileCount", "n_files"), told("exportCount", "n_exports"), told("complexityScore", "score"))),
    ]
    why = F.coalesce(*(F.when(test, reason) for test, reason, _ in steps))
    signals = F.array_join(F.coalesce(*(F.when(test, found) for test, _, found in steps)), ", ")
    by_role = F.try_element_at(F.create_map(*(F.lit(x) for pair in rules.TEMPLATE_REASONS.items() for x in pair)), c("role"))
    fits = F.when((c("score") >= 50) | (c("n_exports") >= 10), rules.TEMPLATE_HIGH).when((c("score") < 30) & (c("n_exports") < 5), rules.TEMPLATE_LOW).otherwise(by_role)
    file = F.when(c("template") == "full", rules.TEMPLATE_FILES["full"]).otherwise(rules.TEMPLATE_FILES["simple"])
    # fixed values: the report's lines
    table = (("fileCount", "n_files"), ("estimatedLines", "n_lines"), ("exportCount", "n_exports"), ("complexityScore", "score"), ("isEntry", "is_entry"), ("incomingDeps", "n_in"), ("outgoingDeps", "n_out"), ("maxNestingDepth", "depth"))
    lines = [
        F.concat(F.lit("## Module: "), "module"), F.concat(F.lit("**Path**: `"), "path", F.lit("`")), F.lit(""),
        F.lit("### Quantitative Signals (from code analysis)"), F.lit("| Signal | Value |"), F.lit("|--------|-------|"),
        *(F.concat(F.lit(f"| {label} | "), c(name).cast("string"), F.lit(" |")) for label, name in table),
        F.concat(F.lit("| primaryLanguage | "), F.coalesce("language", F.lit("unknown")), F.lit(" |")), F.lit(""),
        F.lit("### Role Recommendation (model overrideable)"), F.concat(F.lit("**Role**: `"), "role", F.lit("` — *"), why, F.lit("*")), F.concat(F.lit("**Top signals**: "), signals), F.lit(""),
        F.lit("### Template Recommendation (model overrideable)"), F.concat(F.lit("**Template**: `"), file, F.lit("` — *"), fits, F.lit("*")),
        F.concat(F.lit("**Basis**: "), told("complexityScore", "score"), F.lit(", "), told("exportCount", "n_exports")), F.lit(""),
        F.lit("### Semantic Hints (for model reference)"), F.array_join(F.transform("hints", lambda h: F.concat(F.lit("- "), h)), "\n"),
    ]
    return rows.select("module", F.concat_ws("\n", *lines).alias("md"))
