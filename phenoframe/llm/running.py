"""Running totals over sorted groups of any size, and joins with hot keys.

A window over a group gathers the group in one task.  ``running`` sorts the
rows by ranges of (group, order) instead, so that a large group spans many
partitions, totals each partition by itself, and adds to the first group of
a partition what the partitions before it hold of that group: one row a
partition, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenoframe.llm.stages import Scratch

#: A key is hot when it has more than this share of the rows; there are at most as many hot keys as one over it.
HOT_SHARE = 1 / 500


def changes(keys: pa.Array, last) -> np.ndarray:
    """Where a sorted column's value differs from the one before it (``last`` before the first; None at the start)."""
    here, before = keys.slice(1), keys.slice(0, len(keys) - 1)
    differs = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before)))
    return np.r_[last is None or last[0] != keys[0].as_py(), differs.to_numpy(zero_copy_only=False)]


def totals_in_part(group: str, sums: list[str], xors: list[str]):
    """Step of ``mapInArrow`` over a sorted partition; ``edge`` marks its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, held = None, None
        carry = {"place": 0, **{c: 0 for c in [*sums, *xors]}}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield held
            keys = batch.column(batch.schema.names.index(group))
            new = changes(keys, last)
            segment = np.cumsum(new)
            starts = np.r_[0, np.flatnonzero(new)] if not new[0] else np.flatnonzero(new)
            start = starts[segment - (1 if new[0] else 0)]
            first = segment == 0
            out = {"place": np.arange(n) - start + np.where(first, carry["place"], 0)}
            for c in sums:
                v = batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False)
                total = np.cumsum(v)
                out[c] = total - total[start] + v[start] + np.where(first, carry[c], 0)
            for c in xors:
                v = batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False)
                total = np.bitwise_xor.accumulate(v)
                out[c] = total ^ total[start] ^ v[start] ^ np.where(first, carry[c], 0)
            last = (keys[n - 1].as_py(),)
            carry = {c: int(v[-1]) for c, v in out.items()}
            carry["place"] += 1
            columns = [*batch.columns, *(pa.array(out[c].astype(np.int64)) for c in ["place", *sums, *xors]), pa.array(np.full(n, part, np.int32))]
            edge = np.zeros(n, dtype=bool)
            held = pa.RecordBatch.from_arrays([*columns, pa.array(edge)], names=[*batch.schema.names, *(f"run_{c}" for c in ["place", *sums, *xors]), "part", "edge"])
        if held is not None:
            edge = np.zeros(held.num_rows, dtype=bool)
            edge[-1] = True
            yield held.set_column(held.num_columns - 1, "edge", pa.array(edge))

    return run


def running(df: DataFrame, group: str, order: list[str], scratch: Scratch, sums: list[str] | None = None, xors: list[str] | None = None) -> DataFrame:
    """``df`` with ``run_place`` (rows of the group before this one) and, for each named long column without NULLs,
    its sum or exclusive or over the group up to and with this row, as ``run_<column>``.

    NULL groups are one group; NULLs sort first; equal rows stand in any
    order.  ``df`` is read twice (Spark samples it for the ranges), so pass a
    stored table.  It must have no columns named ``tie``, ``part`` or ``edge``.
    """
    sums, xors = sums or [], xors or []
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("tie")]
    tied = df.withColumn("tie", F.monotonically_increasing_id())
    sorted_rows = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    added = [T.StructField(f"run_{c}", T.LongType()) for c in ["place", *sums, *xors]]
    schema = T.StructType([*sorted_rows.schema.fields, *added, T.StructField("part", T.IntegerType()), T.StructField("edge", T.BooleanType())])
    rows = scratch.keep(sorted_rows.mapInArrow(totals_in_part(group, sums, xors), schema), "running")
    # What each partition passes on to the next one that has rows, at most one row a partition.
    so_far = Window.partitionBy(group).orderBy("part")
    passed = rows.where("edge").select(
        F.lead("part").over(Window.orderBy("part")).alias("into"), F.col(group).alias("of"), "part",
        (F.col("run_place") + 1).alias("add_place"), *(F.col(f"run_{c}").alias(f"add_{c}") for c in [*sums, *xors]))
    by_group = so_far.partitionBy("of")
    passed = passed.select("into", "of", *(F.sum(f"add_{c}").over(by_group).alias(f"add_{c}") for c in ["place", *sums]),
                           *(F.expr(f"bit_xor(add_{c})").over(by_group).alias(f"add_{c}") for c in xors)).where("into is not null")
    met = rows.join(F.broadcast(passed), (F.col("part") == F.col("into")) & F.col(group).eqNullSafe(F.col("of")), "left")
    zero = F.lit(0).cast("long")
    return met.select(*df.columns, *((F.col(f"run_{c}") + F.coalesce(f"add_{c}", zero)).alias(f"run_{c}") for c in ["place", *sums]),
                      *(F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"add_{c}", zero)).alias(f"run_{c}") for c in xors))


def join_hot(rows: DataFrame, facts: DataFrame, on: list[str], number: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row a key and in ``number`` how many of the ``total`` rows have it.

    Facts of hot keys go to every task (``1 / HOT_SHARE`` of them at most,
    as their rows add up to ``total``), so the rows of a hot key stay where
    they are; only the other rows are shuffled by key.
    """
    least = int(total * HOT_SHARE) + 1
    hot = F.broadcast(facts.where(F.col(number) > least))
    there = rows.join(hot, on)
    other = rows.join(hot.select(*on), on, "left_anti").join(facts.where(F.col(number) <= least), on)
    return there.unionByName(other)
