"""Materialising intermediate results.

A pipeline reads its tagged journal rows in several branches (readings are
paired with readings of the same table) and reads its status rows twice
(once to find each patient's latest date, once to bring that day's rows
back).  Without materialisation every read re-runs the journal scan.

``materialise`` writes the DataFrame as a parquet table under the session's
checkpoint folder (``spark.checkpoint.dir``, or the folder set with
``SparkContext.setCheckpointDir``) and reads it back.  On a cluster that
folder is shared storage: the files outlive lost executors and cut the
lineage.  Parquet rather than an RDD checkpoint: it is columnar and
compressed, written by Spark's vectorised writer instead of row-by-row
object serialisation, and each later read prunes columns (the per-patient
aggregation reads three of them).  A session on a cluster must name that
folder; without one a pipeline would scan its journal once per branch, so
``materialise`` raises.

Every stage is in the ledger of a run.  Inside ``staged_run`` that is the
block's own ledger, whatever other threads or sessions do meanwhile: write
the results there, and the block's stages go at its end.  Outside any run
the stages back DataFrames that the caller may still read; they go when the
application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """Stages, and what else a run leaves behind, with how to remove it."""

    def __init__(self) -> None:
        self._removals: list[Callable[[], None]] = []

    def add(self, removal: Callable[[], None]) -> None:
        self._removals.append(removal)

    def remove(self) -> None:
        while self._removals:
            self._removals.pop()()


_run: ContextVar[Ledger | None] = ContextVar("run", default=None)
_application = Ledger()


@atexit.register
def _end() -> None:
    with suppress(Exception):  # the session may be gone
        _application.remove()


def on_end(removal: Callable[[], None]) -> None:
    """Have something removed at the end of the present run, or of the application."""
    (_run.get() or _application).add(removal)


def new_folder(df: DataFrame, name: str) -> str:
    """A fresh folder under the checkpoint folder, in the ledger (its files may go after the session has stopped)."""
    folder, spark = checkpoint_folder(df), df.sparkSession
    if not folder:
        raise ValueError("stages need spark.checkpoint.dir, a folder that all executors share (or stage=False)")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/phenoframe-{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    on_end(lambda: files.delete(path, True))
    return path.toString()


def checkpoint_folder(df: DataFrame) -> str | None:
    spark = df.sparkSession
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    context = spark.sparkContext
    if not context.getCheckpointDir() and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="phenoframe-", dir="/tmp"))
    return context.getCheckpointDir()


@contextmanager
def staged_run(spark: SparkSession) -> Iterator[Ledger]:
    """A run with a ledger of its own: what is staged inside the block goes when it ends."""
    ledger = Ledger()
    token = _run.set(ledger)
    try:
        yield ledger
    finally:
        _run.reset(token)
        ledger.remove()


def materialise(df: DataFrame, enabled: bool = True, name: str = "stage",
                partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh parquet folder under the checkpoint folder and
    return a DataFrame reading it; ``df`` unchanged when not ``enabled``.
    ``partition_by`` lays the files out by those columns, so readers that
    filter on them read only their part."""
    if not enabled:
        return df
    path = new_folder(df, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.parquet(path)
    return out.select(*df.columns) if partition_by else out
