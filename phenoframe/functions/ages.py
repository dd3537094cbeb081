"""Age expressions.

Ages follow Spark SQL decimal arithmetic on purpose: ``datediff / 365.25``
divides an INT by a DECIMAL(5,2) literal, which yields DECIMAL(18,6) rounded
half-up to 6 places.  487 days is 1.333333 years, 15.999996 months, so the
floor and ceiling of the month age are 15 and 16 -- not 16 and 16 as double
arithmetic would give.  Keeping the decimal keeps the growth-reference
lookups identical.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: days per year and months per year used by the age rules.
DAYS_PER_YEAR = Decimal("365.25")
MONTHS_PER_YEAR = 12


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_years(end, birth, whole: bool = False) -> Column:
    """Age in years at ``end`` as DECIMAL(18,6); ``whole`` floors it to INT."""
    age = F.datediff(_col(end), _col(birth)) / F.lit(DAYS_PER_YEAR)
    return F.floor(age).cast("int") if whole else age


def age_by_year(date, year_of_birth) -> Column:
    """Age by calendar year: ``year(date) - year_of_birth`` (INT)."""
    return (F.year(_col(date)) - _col(year_of_birth)).cast("int")


def age_months(end, birth) -> Column:
    """Age in months as DECIMAL(21,6): the 6-place year age times 12."""
    return age_years(end, birth) * F.lit(MONTHS_PER_YEAR)


def age_months_bracket(months) -> dict[str, Column]:
    """Whole months below and above an age in months, and the fraction
    between them: ``AGE_LOWER``, ``AGE_UPPER`` (INT) and ``AGE_DIFF``."""
    m = _col(months)
    return {
        "AGE_LOWER": F.floor(m).cast("int"),
        "AGE_UPPER": F.ceil(m).cast("int"),
        "AGE_DIFF": m - F.floor(m),
    }
