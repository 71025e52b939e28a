"""Tables written between steps, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; in local mode without one, a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.gettempdir()}/mossgrove-scratch")
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def own(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{root(spark)}/mossgrove/{spark.sparkContext.applicationId}"


def place(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, at which nothing lies yet."""
    return f"{own(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: lineage ends there, and a lost executor costs no more than a re-read.

    The files stay until drop() or clear(), or until the folder is cleaned up.
    """
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame | None) -> None:
    """Deletes the files of a table made by store()."""
    path = getattr(df, "_step_path", None)
    if path:
        delete(df.sparkSession, path)


#: Rows of a stored table up to which it is sent to every executor; of more it is shuffled.
BROADCAST_ROWS = 200_000


def small(stored: DataFrame) -> DataFrame:
    """A table of narrow rows, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(stored) if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else stored


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application stored; what was read from them can't be read again."""
    delete(spark, own(spark))
