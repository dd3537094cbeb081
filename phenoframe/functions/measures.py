"""Body measurements and growth-reference (LMS) arithmetic.

Divisions use ``try_divide`` so a zero divisor gives NULL (the row then
bands as INDETERMINABLE / ERROR) instead of failing the job under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: a height between 0 and 3 inclusive is taken to be in metres.
HEIGHT_METRES_MAX = 3


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def height_to_cm(value) -> Column:
    """Heights recorded in metres (0..3) are converted to centimetres."""
    v = _c(value)
    return F.when((v >= 0) & (v <= HEIGHT_METRES_MAX), v * 100).otherwise(v)


def bmi_from_hw(weight, height_cm) -> Column:
    """``weight / (height_cm / 100) ** 2``; NULL when the height is 0."""
    return F.try_divide(_c(weight), F.pow(_c(height_cm) / 100, 2))


def interpolate(low, high, frac) -> Column:
    """``low + (high - low) * frac``"""
    lo = _c(low)
    return lo + (_c(high) - lo) * _c(frac)


def lms_interpolate(frac="AGE_DIFF") -> dict[str, Column]:
    """L, M and S at the exact age, from the values at the whole months
    below (``*_LOW``) and above (``*_HIGH``)."""
    f = _c(frac).cast("double")
    return {f"{p}_TO_USE": interpolate(f"{p}_LOW", f"{p}_HIGH", f) for p in ("L", "M", "S")}


def lms_zscore(value, l="L_TO_USE", m="M_TO_USE", s="S_TO_USE") -> Column:
    """Box-Cox z-score ``((value / M) ** L - 1) / (L * S)``.  L = 0 gives
    NULL; a negative base with a fractional L gives NaN."""
    lc = _c(l)
    return F.try_divide(F.pow(F.try_divide(_c(value), _c(m)), lc) - 1, lc * _c(s))
