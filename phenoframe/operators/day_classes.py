"""Pairs of readings of a patient-day by the classes of their values.

A rule set that bands two values compares each with a few break points, so
it cannot tell apart two values of the same piece: a break point itself or
the open interval between two of them.  A day's readings of one side are
then a small bit mask of pieces, and the categories of all its pairs follow
from two masks and a table of the rule set over pieces.  A patient-day costs
one hash aggregation of integers, however many rows and pairs it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.banding import Rule


def band_index(rules: list[Rule], labels: list[str]) -> Column:
    """1-based position in ``labels`` of the first matching rule's label; NULL for other labels and where no rule matches."""
    expr = None
    for predicate, label in rules:
        value = F.lit(labels.index(label) + 1 if label in labels else None).cast("int")
        expr = F.when(predicate, value) if expr is None else expr.when(predicate, value)
    return expr


def piece(value: Column, breaks: list[float]) -> Column:
    """Number of a value's piece: 2 i below the i-th break point (from 0), 2 i + 1 on it; NULL stays NULL (NaN is above all)."""
    return reduce(lambda a, b: a + b, [(value >= b).cast("int") + (value > b).cast("int") for b in breaks])


def inner_values(breaks: list[float]) -> list[float]:
    """A value of each piece, in order."""
    out = [breaks[0] - 1.0]
    for low, high in zip(breaks, [*breaks[1:], breaks[-1] + 2.0]):
        out += [float(low), (low + high) / 2]
    return out


def bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), number)


Table = dict[tuple[int, int], int]


def pair_table(spark: SparkSession, rules: list[Rule], labels: list[str], left: list, right: list, names: tuple[str, str], kind: str) -> Table:
    """Position of the label that ``rules`` give to each (left, right) pair of values, by their places; pairs without one are left out.

    The rules are evaluated on constant rows, which takes no job."""
    def sql(v) -> str:
        return f"CAST(NULL AS {kind})" if v is None else f"CAST('{v}' AS {kind})"

    rows = ", ".join(f"({i}, {j}, {sql(a)}, {sql(b)})" for i, a in enumerate(left) for j, b in enumerate(right))
    found = spark.sql(f"SELECT * FROM VALUES {rows} AS t(i, j, {names[0]}, {names[1]})").select("i", "j", band_index(rules, labels).alias("at"))
    return {(r.i, r.j): r["at"] for r in found.collect() if r["at"]}


def shifted(table: Table, left: int, right: int) -> Table:
    return {(i + left, j + right): at for (i, j), at in table.items()}


def has_position(table: Table, at: int, left: Column, right: Column) -> Column:
    """Whether a pair of the masks' pieces has the label at a position."""
    partners: dict[int, int] = {}
    for (i, j), found in table.items():
        if found == at:
            partners[i] = partners.get(i, 0) | 1 << j
    groups: dict[int, int] = {}
    for i, mask in partners.items():
        groups[mask] = groups.get(mask, 0) | 1 << i
    tests = [(left.bitwiseAND(F.lit(own)) != 0) & (right.bitwiseAND(F.lit(other)) != 0) for other, own in groups.items()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def extremes(table: Table, left: Column, right: Column) -> tuple[Column, Column]:
    """Least and greatest position among the pairs of two masks; NULL when they have none."""
    positions = sorted(set(table.values()))

    def first(order: list[int]) -> Column:
        return reduce(lambda e, at: e.when(has_position(table, at, left, right), at), order[1:], F.when(has_position(table, order[0], left, right), order[0]))

    return first(positions), first(positions[::-1])


def known_keys(keys: list[str]) -> Column:
    """Only rows with all keys pair."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def agreeing_days(days: DataFrame, width: int, key: str = "PATIENT_ID", date: str = "DATE") -> DataFrame:
    """Each patient's latest day with a category, if all its rows have one: ``key`` and ``date``.

    ``days`` has rows (or summaries of rows) with ``_lo`` and ``_hi``, the
    least and greatest category position in 1..``width``, NULL when there is
    none.  Day and position are packed in one long, so this is a hash aggregation.
    """
    w = width + 1
    # No filter on ``_lo``: pushed down, it would repeat the rules that made it in the generated code.
    day = F.when(F.col("_lo").isNotNull(), F.unix_date(F.col(date)).cast("long"))
    stats = days.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(day).alias("_day"), F.max(day * w + F.col("_hi")).alias("_top"), F.min(-day * w + F.col("_lo")).alias("_low"))
    same = F.col("_top") - F.col("_day") * w == F.col("_low") + F.col("_day") * w
    return stats.where(same).select(key, F.date_from_unix_date(F.col("_day").cast("int")).alias(date))
