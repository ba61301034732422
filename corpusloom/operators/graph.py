"""Import edges, reachability and link closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules
from .lineage import cut


def matched(files: DataFrame, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """files(path, content) -> path, language, name: group 1 of every match of the patterns
    that ``table`` has for a file's language. One pass over the files: a row meets the
    patterns of its own language only."""
    language = F.col("language")
    arms = [(language == name, F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns)))) for name, patterns in table.items() if patterns]
    case = reduce(lambda c, arm: c.when(*arm), arms[1:], F.when(*arms[0]))
    return files.withColumn("language", paths.language(F.col("path"))).select("path", "language", F.explode(case).alias("name"))


def imports(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, language, specifier: what each file's import statements name."""
    return matched(files, rules.IMPORTS).withColumnRenamed("name", "specifier").distinct()


def target_base(language: Column, path: Column, specifier: Column) -> Column:
    """The path, without extension, that a specifier names from a file's directory."""
    folder = paths.dirname(path)
    script = paths.normalise(F.concat_ws("/", folder, F.regexp_replace(specifier, r"\.js$", "")))
    # a Python import climbs one directory for every leading dot after the first
    dots = F.length(F.regexp_extract(specifier, r"^\.*", 0))
    rest = F.translate(F.regexp_replace(specifier, r"^\.+", ""), ".", "/")
    python = paths.normalise(F.concat_ws("/", folder, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest))
    return F.when(language == "python", python).when(language == "java", F.translate(specifier, ".", "/")).otherwise(script)


def candidates(found: DataFrame) -> DataFrame:
    """imports -> path, specifier, rank, dst: the files that each import accepts, by priority."""
    arms = []
    for name in rules.IMPORTS:
        endings, folders = rules.RESOLVE.get(name, ((), ()))
        arms.append((F.col("language") == name, F.array(*map(F.lit, ("", *endings, *(f"/{f}" for f in folders))))))
    tails = reduce(lambda c, arm: c.when(*arm), arms[1:], F.when(*arms[0]))
    rows = found.select("path", "specifier", target_base(F.col("language"), F.col("path"), F.col("specifier")).alias("base"), F.posexplode(tails).alias("rank", "tail"))
    return rows.select("path", "specifier", "rank", F.concat("base", "tail").alias("dst"))


def chosen(options: DataFrame, known: DataFrame) -> DataFrame:
    """candidates, known(path) -> path, specifier, dst: the first one that exists."""
    there = known.select(F.col("path").alias("dst")).distinct()
    return options.join(there, "dst").groupBy("path", "specifier").agg(F.min_by("dst", "rank").alias("dst"))


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """imports -> src, dst: the first existing candidate of each import, by priority.

    Candidates are exploded with their rank and joined to the file list on path."""
    return chosen(candidates(found), files).select(F.col("path").alias("src"), "dst").distinct()


def imported_by(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("n_importers"))


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Nodes that import a seed, directly or through others: node, depth, chain.

    Breadth first, one join a level with the visited nodes taken out; of the shortest
    chains the least is kept. From the second level on, fronts are cut to the checkpoint
    folder: every later level reads them twice, and a plan of all levels would double with
    each."""
    if not isinstance(depth, int) or depth < 0:
        raise ValueError("depth must be a whole number")
    visited = seeds.select("node").distinct()
    if depth > 1:
        visited = cut(visited)
    front = visited.select("node", F.lit(0).cast("long").alias("depth"), F.array(F.col("node").cast("string")).alias("chain"))
    levels = []
    for level in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("next"), F.concat("chain", F.array(F.col("src").cast("string"))).alias("chain"))
        step = step.groupBy(F.col("next").alias("node")).agg(F.min("chain").alias("chain")).join(visited, "node", "left_anti")
        front = step.select("node", F.lit(level).cast("long").alias("depth"), "chain")
        if depth > 1:
            front = cut(front)
        levels.append(front)
        visited = visited.unionAll(front.select("node"))
    if not levels:
        return front.limit(0)
    return reduce(DataFrame.unionAll, levels)


def referrers(links: DataFrame, docs: DataFrame, depth: int = 1) -> DataFrame:
    """Documents that link to one of ``docs`` within ``depth`` steps, these not included."""
    return impact(links.select("src", "dst"), docs, depth).select("node", "depth")


def closure(links: DataFrame, docs: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """All documents that reach one of ``docs`` along links, these included, to a fixpoint.

    A frontier loop on the driver; each round is cut to the checkpoint folder."""
    front = seen = cut(docs.select("node").distinct())
    for _ in range(most_rounds):
        front = cut(links.join(front, F.col("dst") == F.col("node")).select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionAll(front))
    raise RuntimeError("the closure did not settle")
