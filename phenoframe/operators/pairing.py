"""Same-day pairing of two kinds of journal row (systolic with diastolic,
height with weight, fasting with two-hour glucose)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two readings pair when they belong to the same patient, day, practice and
# extract periods.  Equality, not null-safe equality: a NULL never pairs.
PAIR_KEYS = ["PATIENT_ID", "DATE", "PRACTICE", "REPORTING_PERIOD_END_DATE",
             "JOURNAL_REPORTING_PERIOD_END_DATE"]


def pair_same_day(left: DataFrame, right: DataFrame, take: dict[str, str], how: str = "inner",
                  keys: list[str] | None = None, distinct_partners: bool = False) -> DataFrame:
    """Attach columns of same-day ``right`` rows to ``left`` rows.

    ``take`` maps a right column to the name it gets on the output; an
    existing left column of that name is replaced in place, new names are
    appended.  ``how`` is ``inner`` or ``left`` (unmatched left rows keep
    NULLs).  Every matching pair is produced, as an equi-join does.

    ``distinct_partners`` first reduces the right side to distinct
    (keys, taken columns): callers whose result is de-duplicated anyway pass
    it, which shrinks the pairs a busy day produces without changing the
    de-duplicated result.
    """
    keys = keys or PAIR_KEYS
    right_sel = right.select(*keys, *[F.col(src).alias(dst) for src, dst in take.items()])
    if distinct_partners:
        right_sel = right_sel.dropDuplicates()
    left_sel = left.drop(*[c for c in take.values() if c in left.columns and c not in keys])
    if how == "inner":
        # Spark infers IS NOT NULL on the keys for an inner join; say it for
        # the left side too so it reaches the scan.
        cond = None
        for k in keys:
            cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
        left_sel = left_sel.filter(cond)
    joined = left_sel.join(right_sel, keys, how)
    order = list(left.columns) + [c for c in take.values() if c not in left.columns]
    return joined.select(*order)


def day_pairs(rows: DataFrame, left: Column, right: Column, left_values: dict[str, Column], right_values: dict[str, Column],
              keys: list[str] | None = None) -> DataFrame:
    """Distinct pairs of the values of two kinds of row of one table, from narrow rows.

    ``left`` and ``right`` say which rows are of either kind.  Each side is
    reduced to its distinct keys and values, map-side first, before they
    meet.  NULL keys never pair.
    """
    keys = keys or PAIR_KEYS
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    def narrow(side: Column, columns: dict[str, Column]) -> DataFrame:
        return rows.where(known & side).select(*keys, *[c.alias(n) for n, c in columns.items()]).distinct()

    return narrow(left, left_values).join(narrow(right, right_values), keys)
