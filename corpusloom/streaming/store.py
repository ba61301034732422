"""A keyed table that changes by batches, at a cost that follows the change.

Rows are dealt to buckets by a hash of their key. A batch writes a delta: the rows that
changed and the keys that went, in files of their buckets only. A key's current row is its
last one by version. Reading some keys reads their buckets only. Every ``most`` deltas are
merged into a run, and base and run into a new base once deltas and run hold more than
``ratio`` times the base's rows: so few files are read, and the rows merged stay in
proportion to the rows changed.

Versions are numbers. A version counts once its row in the table of commits is written,
which is the last step; what an interrupted batch left is overwritten by its repetition.
A commit names the stream and its batch: a batch that runs again gets its own version and
reads the state before it; another stream over the same store goes on after the last one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMITS = "version long, kind string, stream string, batch long, n_rows long"


@dataclass(frozen=True)
class KeyedStore:
    """``schema`` (a DDL string) has the columns of a row, among them those of ``key``."""

    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...]
    buckets: int = 64
    ratio: float = 0.5
    most: int = 16

    # -- reading -------------------------------------------------------------

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMITS)

    def _live(self, before: int | None) -> list:
        """The newest base, the run after it and the deltas after that, one commit row each:
        at most ``most`` + 2, but for what failed merges left."""
        rows = self.commits() if before is None else self.commits().where(F.col("version") < before)
        newest = {r[0]: r[1] for r in rows.where("kind <> 'delta'").groupBy("kind").agg(F.max("version")).collect()}
        base = newest.get("base", -1)
        run = max(base, newest.get("run", -1))
        kind, version = F.col("kind"), F.col("version")
        live = (kind == "base") & (version == base) | (kind == "run") & (version == run) & (version > base) | (kind == "delta") & (version > run)
        return rows.where(live).dropDuplicates(["version", "kind"]).collect()

    def _versions(self, before: int | None, kinds: tuple[str, ...] = ("base", "run", "delta")) -> DataFrame:
        live = [row for row in self._live(before) if row.kind in kinds]
        names = [f.name for f in StructType.fromDDL(self.schema)]
        if not live:
            return self.spark.createDataFrame([], f"{self.schema}, gone boolean, version long, bucket int")
        rows = None
        for row in live:
            part = self.spark.read.option("basePath", f"{self.path}/{row.kind}").schema(f"{self.schema}, gone boolean, version long, bucket int").parquet(f"{self.path}/{row.kind}/version={row.version}")
            part = part.select(*names, "gone", "version", "bucket")
            rows = part if rows is None else rows.unionAll(part)
        return rows

    def _last(self, rows: DataFrame, tombs: bool = False) -> DataFrame:
        names = [f.name for f in StructType.fromDDL(self.schema)]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*names, "gone"), "version").alias("r"))
        return last.select("r.*") if tombs else last.where("not r.gone").select(*(f"r.{n}" for n in names))

    def rows(self, before: int | None = None) -> DataFrame:
        """All current rows, or those before a version."""
        return self._last(self._versions(before))

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The current rows of some keys. Their buckets, a list of bounded length, prune the
        directories that are read."""
        keys = keys.select(*self.key).distinct().withColumn("bucket", self.bucket())
        wanted = [r[0] for r in keys.select("bucket").distinct().collect()]
        found = self._versions(before).where(F.col("bucket").isin(wanted)) if wanted else self._versions(before).limit(0)
        return self._last(found.join(keys, [*self.key, "bucket"], "left_semi"))

    # -- writing -------------------------------------------------------------

    def version_of(self, stream: str, batch: int) -> int:
        """The version that a stream's batch has, or the next one."""
        own = self.commits().where((F.col("stream") == stream) & (F.col("batch") == batch) & (F.col("kind") == "delta")).agg(F.max("version")).first()[0]
        if own is not None:
            return own
        return (self.commits().agg(F.max("version")).first()[0] or 0) + 1

    def _write(self, rows: DataFrame, kind: str, version: int, stream: str, batch: int) -> int:
        to = f"{self.path}/{kind}/version={version}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
        n = self.spark.read.schema(f"{self.schema}, gone boolean, bucket int").parquet(to).count()
        self.spark.createDataFrame([(version, kind, stream, batch, n)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return n

    def apply(self, upserts: DataFrame, gone: DataFrame, stream: str = "", batch: int | None = None) -> int:
        """Writes a batch: rows to put in place of their keys' rows, and keys to take out.
        Returns its version. A batch of a stream that ran before is written again."""
        version = self.version_of(stream, batch) if batch is not None else (self.commits().agg(F.max("version")).first()[0] or 0) + 1
        names = [f.name for f in StructType.fromDDL(self.schema)]
        empty = [F.col(n) if n in self.key else F.lit(None).cast(f.dataType).alias(n) for n, f in ((f.name, f) for f in StructType.fromDDL(self.schema))]
        rows = upserts.select(*names, F.lit(False).alias("gone")).unionAll(gone.select(*empty, F.lit(True).alias("gone")))
        self._write(rows, "delta", version, stream, -1 if batch is None else batch)
        return version

    def merge(self, force: bool = False) -> str | None:
        """Merges into a new base or run where deltas have grown enough; which of them."""
        live = self._live(None)
        sizes = {kind: sum(r.n_rows for r in live if r.kind == kind) for kind in ("base", "run", "delta")}
        deltas = sum(r.kind == "delta" for r in live)
        if not deltas:
            return None
        last = max(r.version for r in live)
        if force or sizes["run"] + sizes["delta"] > self.ratio * sizes["base"]:
            self._write(self.rows().withColumn("gone", F.lit(False)), "base", last, "", -1)
            return "base"
        if deltas >= self.most:
            self._write(self._last(self._versions(None, ("run", "delta")), tombs=True), "run", last, "", -1)
            return "run"
        return None
