"""Snapshot differences by directory digests: only differing subtrees are met.

A directory's digest is the sum, in four words modulo 2**64, of the SHA-256 of all (path,
hash) pairs below it, with their number. Sums are pre-aggregated and of fixed size, so a
directory may hold any share of all files. A comparison starts at the root and descends,
level by level, into the directories whose digests differ; files are read below those only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

WORDS = ("s0", "s1", "s2", "s3")


def digested(snapshot: DataFrame) -> DataFrame:
    """snapshot(path, hash) -> dir, parent, level, n_files, s0..s3: every directory, the root
    being '' of level 0, with its digest."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    sha = F.sha2(F.concat_ws("\u0000", "path", "hash"), 256)
    word = lambda k: F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long")
    rows = snapshot.select(F.posexplode(above).alias("level", "dir"), *(word(k).alias(w) for k, w in enumerate(WORDS)))
    # sums in decimals, which do not overflow, brought back to 64 bits
    total = lambda w: F.pmod(F.sum(F.col(w).cast("decimal(38,0)")), F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("string")
    sums = rows.groupBy("dir", "level").agg(F.count(F.lit(1)).alias("n_files"), *(total(w).alias(w) for w in WORDS))
    return sums.select("dir", F.when(F.col("level") > 0, F.regexp_replace("dir", "/?[^/]*$", "")).alias("parent"), "level", "n_files", *WORDS)


def differing(new: DataFrame, old: DataFrame) -> DataFrame:
    """Directories (dir, level, met) of two digested snapshots whose digests differ; ``met``
    counts the rows of that level that were compared to find them.

    One join a level, of the children of differing directories only; a level is read by its
    number, by which stores of digests can be partitioned."""
    deepest = new.unionAll(old).agg(F.max("level")).first()[0]
    names = ("dir", *WORDS, "n_files")
    same = reduce(lambda x, y: x & y, (F.col(f"n.{w}").eqNullSafe(F.col(f"o.{w}")) for w in names[1:]))
    front, found = None, []
    for level in range((deepest if deepest is not None else -1) + 1):
        own = [t.where(F.col("level") == level) for t in (new, old)]
        if front is not None:
            own = [t.join(front.select(F.col("dir").alias("parent")), "parent", "left_semi") for t in own]
        met = own[0].select(*names).alias("n").join(own[1].select(*names).alias("o"), F.col("n.dir") == F.col("o.dir"), "full")
        told = cut(met.select(F.coalesce("n.dir", "o.dir").alias("dir"), F.lit(level).alias("level"), same.alias("same")))
        n_met = told.count()
        front = told.where("not same").select("dir", "level", F.lit(n_met).cast("long").alias("met"))
        found.append(front)
        if front.isEmpty():
            break
    if not found:
        return new.select("dir", "level", F.lit(0).cast("long").alias("met")).limit(0)
    return reduce(DataFrame.unionAll, found)


def diff(new: DataFrame, old: DataFrame, new_dirs: DataFrame | None = None, old_dirs: DataFrame | None = None) -> DataFrame:
    """Snapshots (path, hash) -> path, status (added, modified, deleted), hash of the files
    that changed. Digests that are stored already can be given."""
    from .snapshot import diff as join_diff

    dirs = differing(new_dirs or digested(new), old_dirs or digested(old)).select("dir")
    near = lambda t: t.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")).join(dirs, "dir", "left_semi").select("path", "hash")
    return join_diff(near(new), near(old)).where("status <> 'unchanged'")


def subtree_counts(new: DataFrame, old: DataFrame) -> DataFrame:
    """dir, n_changed of every directory with changed files anywhere below it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return diff(new, old).select(F.explode(above).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n_changed"))
