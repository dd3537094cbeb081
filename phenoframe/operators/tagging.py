"""Code-list tagging and category labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join


def tag_codes(journal: DataFrame, codes: DataFrame, tags: list[str] | None = None,
              code_col: str = "CODE", key: str = "code", dedupe_codes: bool = False) -> DataFrame:
    """Keep journal rows whose code is in ``codes`` and add its tag columns.

    ``tags`` defaults to every non-key column of the list.  A code listed
    twice fans its journal rows out twice, as a join does; ``dedupe_codes``
    drops exact duplicate list rows first.  The list is broadcast when small,
    so the journal is not shuffled.
    """
    tags = [c for c in codes.columns if c not in (key, "ix")] if tags is None else tags
    # Codes are strings (up to 16 digits); a list read with numeric types is
    # cast so the join compares text, never numbers.
    right = codes.select(F.col(key).cast("string").alias(code_col), *tags)
    if dedupe_codes:
        right = right.dropDuplicates()
    joined = lookup_join(journal, right, code_col, "inner", checked=codes)
    return joined.select(*journal.columns, *tags)


def label_category(df: DataFrame, labels: DataFrame, col: str = "ETHNIC_CATEGORY_CODE",
                   key: str = "ETHNIC_CATEGORY_ID", label: str = "ETHNIC_CATEGORY_LABEL") -> DataFrame:
    """Add the label of a category code (NULL when the code is not listed)."""
    right = labels.select(F.col(key).alias(col), F.col(label))
    return lookup_join(df, right, col, "left", checked=labels).select(*df.columns, label)
