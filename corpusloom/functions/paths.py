"""Column expressions over relative POSIX paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ALIASES, LANGUAGE_OF


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows; empty for names that start with their only dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.md$", "")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def language(path: Column) -> Column:
    """The language of a file by its extension in lower case; null for others."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return F.try_element_at(table, F.lower(extension(path)))


def canonical_language(name: Column) -> Column:
    """The language that a name or one of its aliases means, in any case; null for others."""
    table = F.create_map(*(F.lit(x) for lang, names in ALIASES.items() for alias in (lang, *names) for x in (alias, lang)))
    return F.try_element_at(table, F.lower(name))


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"), r"[\s_]+", "-"))


def infer_doc_path(path: Column) -> Column:
    """src/a/fooBar.ts -> modules/a/foo-bar.md; null for paths not under src or without a code extension."""
    endings = "|".join(e[1:] for e in LANGUAGE_OF)
    inner = F.regexp_extract(path, rf"(?i)^src/(.+?)\.({endings})$", 1)
    folder = F.regexp_extract(inner, "^(.*/)", 1)
    return F.when(inner != "", F.concat(F.lit("modules/"), folder, kebab(basename(inner)), F.lit(".md")))


def normalise(path: Column) -> Column:
    """``path`` with its . and .. parts resolved; .. above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    return F.array_join(walked, "/")


def count(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def trimmed(text: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
