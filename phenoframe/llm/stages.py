"""Cutting lineage, and joins with a side of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table goes to every executor; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000


def shared_folder(df: DataFrame) -> str:
    """The checkpoint folder that the session names; only a local session that names none gets a temporary one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpus-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, read from there from now on."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and read back."""
    path = f"{shared_folder(df).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow, and already cut) marked for broadcast when it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Scratch:
    """Tables of one run in the checkpoint folder, removed together once the run's result is written."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.folder = f"{shared_folder(df).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.written = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet to the run's folder and read back."""
        self.written += 1
        path = f"{self.folder}/{self.written}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, result: DataFrame, name: str) -> DataFrame:
        """The result, written beside the run's folder; the folder goes."""
        kept = stored(result, name)
        self.remove()
        return kept

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
