"""Reading the tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Rows of two or three numbers that one task takes easily.
ROWS_A_PARTITION = 250_000


#: Rows of an Arrow batch, unless the session says otherwise: Spark's 10,000 whole texts
#: are held several times on their way to a Python worker.
BATCH_ROWS = 2000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    # workers find this package where the driver's working directory is another one
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", home)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """The name, lengthened until the documents have no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return a plan that reads it.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is
    unset, a local session takes a temporary folder and any other raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint()


def compact(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, in as few partitions as that number asks for: what
    reads it next then starts few tasks. Tables of many rows stay as they are."""
    parts = max(1, -(-rows // ROWS_A_PARTITION))
    return df.coalesce(parts)
