"""Combining sources: label, align by name, de-duplicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(dfs: list[DataFrame], labels: list[dict] | None = None, distinct: bool = True,
                  columns: list[str] | None = None) -> DataFrame:
    """Union DataFrames by column name.

    ``labels`` gives, per input, constant columns to add (e.g. a source name
    and a priority).  Columns missing from an input are NULL.  ``columns``
    fixes the output columns and their order.  ``distinct`` removes exact
    duplicate rows, as SQL ``UNION`` does; aligning by name (not position)
    avoids mixing up columns that sit in different orders in the inputs.
    """
    parts = []
    for i, df in enumerate(dfs):
        for name, value in ((labels[i] if labels else {}) or {}).items():
            df = df.withColumn(name, F.lit(value))
        parts.append(df)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if columns is not None:
        out = out.select(*columns)
    return out.distinct() if distinct else out
