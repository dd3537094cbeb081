"""Joins that bring rows back to keys of which a few may hold most of the rows.

A frequency sketch of bounded size finds the keys that have a large share of
the rows.  They are few, so they go to every task; their rows are dealt over
salts, and the one row that each has on the other side is repeated for each
salt.  All other rows join by key as usual: one shuffle, no reliance on
adaptive splitting.  A key that the sketch misses or overrates costs time
only; the rows are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys that are treated as heavy, and keys that the sketch keeps count of: one with more than about a thousandth of the rows is never missed.
HEAVY_KEYS, TRACKED = 200, 4000
#: Share of the rows above which a key is heavy, and rows below which none is (a task takes them easily).
HEAVY_SHARE, LEAST_ROWS = 1 / 500, 10_000


def n_salts(df: DataFrame) -> int:
    """As many salts as shuffle partitions: a key with all rows fills the cluster."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys with more than ``HEAVY_SHARE`` of the rows (``_heavy``), at most ``HEAVY_KEYS``, by one partial aggregation."""
    found = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {HEAVY_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("total"))
    each = found.select("total", F.explode("top").alias("top"))
    enough = (F.col("top.count") >= LEAST_ROWS) & (F.col("top.count") > F.col("total") * HEAVY_SHARE)
    return each.where(enough).select(F.col("top.item").alias("_heavy"))


def dealt(df: DataFrame, heavy: DataFrame, key: str, salts: int) -> DataFrame:
    """``df`` with a ``_salt``: rows of heavy keys in turn, 0 for all others."""
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    marked = df.withColumn("_turn", turn).join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    return marked.withColumn("_salt", F.when(F.col("_heavy").isNotNull(), F.col("_turn")).otherwise(0)).drop("_turn", "_heavy")


def repeated(df: DataFrame, heavy: DataFrame, key: str, salts: int) -> DataFrame:
    """``df`` with a ``_salt``: a row for each salt for heavy keys, 0 for all others."""
    marked = df.join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    every: Column = F.when(F.col("_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("_salt", F.explode(every)).drop("_heavy")


def bring_back(df: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``on`` columns are in ``found`` (which has each combination once); the first of them is the key that may be heavy."""
    key, salts = on[0], n_salts(df)
    heavy = heavy_keys(df, key)
    right = repeated(found.select(*on), heavy, key, salts)
    return dealt(df, heavy, key, salts).join(right, [*on, "_salt"], "left_semi").drop("_salt")
