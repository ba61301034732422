"""Predicates over file paths, and directory-level aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules


def is_code(path: Column) -> Column:
    return paths.extension(path).isin(*rules.code_endings())


def is_doc(path: Column) -> Column:
    return paths.extension(path).isin(*rules.DOCS)


def excluded_names(more: tuple[str, ...] = ()) -> list[str]:
    """The exclude set: common names, those of every language, and a project's own."""
    return sorted({*rules.EXCLUDED, *(n for names in rules.EXCLUDED_BY.values() for n in names), *more})


def is_excluded(path: Column, names: list[str]) -> Column:
    """Whether any part of the path is an excluded name or ends as a ``*tail`` name does."""
    plain = [n for n in names if not n.startswith("*")]
    tails = [n[1:] for n in names if n.startswith("*")]

    def hit(part: Column) -> Column:
        test = part.isin(*plain)
        for tail in tails:
            test = test | part.endswith(tail)
        return test

    return F.exists(F.split(path, r"[\\/]"), hit)


def included(files: DataFrame, names: list[str]) -> DataFrame:
    path = F.col("path")
    return files.where(~is_excluded(path, names) & (is_code(path) | is_doc(path)))


def is_known_doc(path: Column) -> Column:
    """Well-known documents: root files by name, and Markdown directly under docs/."""
    # fixed values: root file names
    names = ("README.md", "README.zh.md", "CONTRIBUTING.md", "CHANGELOG.md", "ARCHITECTURE.md", "LICENSE", "docs.md", "API.md", "SECURITY.md", "CODE_OF_CONDUCT.md", "DEVELOPMENT.md", "ROADMAP.md")
    return path.isin(*names) | path.rlike(r"^docs/[^/]+\.md$")


def known_docs(files: DataFrame) -> DataFrame:
    return files.where(is_known_doc(F.col("path"))).select("path")


def modules(files: DataFrame) -> DataFrame:
    """Immediate children of the source roots that hold code: root, module, n_files."""
    roots = "|".join(rules.SOURCE_ROOTS)
    part = lambda i: F.regexp_extract("path", rf"^({roots})/([^/]+)/", i)
    code = files.where(is_code(F.col("path"))).select(part(1).alias("root"), part(2).alias("module"))
    return code.where("module <> ''").groupBy("root", "module").agg(F.count(F.lit(1)).alias("n_files"))


def discover(files: DataFrame) -> DataFrame:
    """``modules``; where no source root holds any, the visible root directories with code."""
    found = modules(files)
    own = F.regexp_extract("path", "^([^./][^/]*)/", 1)
    roots = files.where(is_code(F.col("path"))).select(F.lit("").alias("root"), own.alias("module")).where("module <> ''")
    roots = roots.groupBy("root", "module").agg(F.count(F.lit(1)).alias("n_files"))
    # one row at most decides between the two
    return found.unionAll(roots.join(F.broadcast(found.select(F.lit(1).alias("any")).limit(1)), F.lit(True), "left_anti"))


def settings(files: DataFrame) -> DataFrame:
    """files(project, content) -> project, language, exclude, use_gitignore of each project.

    ``content`` is a project's settings as JSON, null where it has none. A field that is
    missing, null or (``exclude``) no list takes its default, and so do all where the text
    is no JSON."""
    text, base = F.col("content"), rules.DEFAULT_SETTINGS
    field = lambda name: F.get_json_object(text, f"$.{name}")
    listed = F.when(field("exclude").startswith("["), F.from_json(field("exclude"), "array<string>"))
    none = F.array(*map(F.lit, base["exclude"])).cast("array<string>")
    return files.select(
        "project", F.coalesce(field("language"), F.lit(base["language"])).alias("language"), F.coalesce(listed, none).alias("exclude"),
        F.coalesce(field("useGitignore").try_cast("boolean"), F.lit(base["use_gitignore"])).alias("use_gitignore"),
    )


def gitignore_dirs(lines: DataFrame) -> DataFrame:
    """Directory names of ignore-file lines: entries that end in /, or bare names."""
    line = paths.trimmed(F.col("line"))
    plain = ~line.rlike(r"^(#|!|$)")
    folder = F.when(line.endswith("/"), F.regexp_replace(line, "/$", "")).when(~line.rlike(r"[*?/.]"), line)
    return lines.where(plain).select(folder.alias("name")).where("name is not null and not name rlike '[*?/]'").distinct()
