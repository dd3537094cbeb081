"""Growth-reference lookup: L, M and S for a child's sex at the whole months
below and above the exact age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import is_small

# FIXED VALUES: sex codes selecting the boys' and girls' columns.
SEX_BOYS = 1
SEX_GIRLS = 2


def bracketed(lms: DataFrame, month: str) -> DataFrame:
    """The reference with a row for each month that is in it or whose next one is: ``_month``, and the values at it
    (``<column>_LOW``) and at the next month (``<column>_NEXT``)."""
    values = [f"{g}_{p}" for g in ("BOYS", "GIRLS") for p in "LMS"]
    at = lms.select(F.col(month).alias("_month"), *[F.col(v).alias(f"_{v}_LOW") for v in values])
    after = lms.select((F.col(month) - 1).alias("_month"), *[F.col(v).alias(f"_{v}_NEXT") for v in values])
    return at.join(after, "_month", "full")


def lms_lookup(df: DataFrame, lms: DataFrame, sex: str = "SEX", lower: str = "AGE_LOWER",
               upper: str = "AGE_UPPER", month: str = "Months_Calculated") -> DataFrame:
    """Add ``L_LOW, M_LOW, S_LOW`` (at ``lower`` months) and ``L_HIGH,
    M_HIGH, S_HIGH`` (at ``upper``, which is ``lower`` or the month after it).
    Other sex codes, or months outside the table, get NULL.  Both ends come
    from one join with a table of a few hundred rows, broadcast after a size
    check of ``lms``, so the rows are not shuffled."""
    ref = bracketed(lms, month)
    ref = F.broadcast(ref) if is_small(lms) else ref
    out = df.join(ref, df[lower] == ref["_month"], "left")
    same = F.col(lower) == F.col(upper)

    def of(p: str, end: str) -> Column:
        return F.when(F.col(sex) == SEX_BOYS, F.col(f"_BOYS_{p}_{end}")).when(F.col(sex) == SEX_GIRLS, F.col(f"_GIRLS_{p}_{end}"))

    low = [of(p, "LOW").alias(f"{p}_LOW") for p in "LMS"]
    high = [F.when(same, of(p, "LOW")).when(F.col(upper) == F.col(lower) + 1, of(p, "NEXT")).alias(f"{p}_HIGH") for p in "LMS"]
    return out.select(*[df[c] for c in df.columns], *low, *high)
