"""Plans over a stream of source changes.

A change log (path, content, or null content for a deleted file) arrives as files. Each
micro-batch is compared with the stored rows of its own paths, which are all that it reads
and writes (``store.KeyedStore``), and its changes are handed on. A batch that runs again
after a failure reads the state before it and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import snapshot
from ..operators.lineage import cut
from .store import KeyedStore

LOG = "path string, content string, at timestamp"
STORE = "path string, hash string"


def last_entries(batch: DataFrame) -> DataFrame:
    """path, content of each path's last entry. Of entries of one time, one with content
    counts before a deletion, then the greatest content: a rerun decides alike."""
    order = F.struct(F.col("at"), F.col("content").isNotNull(), F.col("content"))
    return batch.groupBy("path").agg(F.max_by(F.struct("content"), order).alias("c")).select("path", "c.content")


def batch_changes(batch: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, new snapshot) for one batch over a whole snapshot (path, hash)."""
    last = last_entries(batch)
    fresh = snapshot.snapshot(last.where("content is not null"))
    rest = store.join(last.select("path"), "path", "left_anti")
    new = rest.unionByName(fresh)
    return snapshot.diff(new, store).where("status <> 'unchanged'"), new


def file_store(spark: SparkSession, path: str, **settings) -> KeyedStore:
    """The store of files' fingerprints by path."""
    return KeyedStore(spark, path, STORE, ("path",), **settings)


def apply_batch(batch: DataFrame, store: KeyedStore, stream: str, batch_id: int) -> DataFrame:
    """Brings the store up to the batch; its changes: path, status, hash (of a deleted file,
    the one it had). Reads and writes the batch's paths only."""
    last = cut(last_entries(batch))
    version = store.version_of(stream, batch_id)
    old = store.lookup(last, before=version)
    new = snapshot.snapshot(last.where("content is not null"))
    changes = cut(snapshot.diff(new, old).where("status <> 'unchanged'"))
    store.apply(changes.where("status <> 'deleted'"), changes.where("status = 'deleted'"), stream, batch_id)
    store.merge()
    return changes


def watch(spark: SparkSession, log: str, store: str, checkpoint: str, handle: Callable[[DataFrame, int], None], buckets: int = 64, **trigger) -> StreamingQuery:
    """Starts the stream over the JSON files in ``log``; ``handle(changes, batch_id)`` gets
    each batch's changes. ``trigger`` is passed to ``DataStreamWriter.trigger``. A new
    ``checkpoint`` over a store that other streams have filled goes on from its state."""

    def each(batch: DataFrame, batch_id: int) -> None:
        handle(apply_batch(batch, file_store(batch.sparkSession, store, buckets=buckets), checkpoint, batch_id), batch_id)

    rows = spark.readStream.schema(LOG).json(log)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
