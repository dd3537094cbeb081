"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup side (code list, growth reference, list of years) is broadcast only
# when it has at most this many rows; bigger ones are joined by shuffle.
# and this many bytes of text.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20

_checked: "weakref.WeakKeyDictionary[DataFrame, bool]" = weakref.WeakKeyDictionary()


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Reads at most ``max_rows + 1`` rows, once per DataFrame object.  Only
    used on lookup tables, never on journals.
    """
    hit = _checked.get(df)
    if hit is None:
        size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
        hit = size[0] <= max_rows and (size[1] or 0) <= MAX_BROADCAST_BYTES
        _checked[df] = hit
    return hit


def maybe_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it passes the size check, else ``df`` unchanged."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def lookup_join(df: DataFrame, small: DataFrame, on, how: str = "inner",
                max_rows: int = MAX_BROADCAST_ROWS, checked: DataFrame | None = None) -> DataFrame:
    """Join a fact table with a lookup table, broadcasting it when small.
    ``checked``: the caller's own table from which ``small`` selects, whose
    size is then checked once and remembered."""
    return df.join(F.broadcast(small) if is_small(small if checked is None else checked, max_rows) else small, on, how)
