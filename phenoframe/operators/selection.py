"""Per-patient selection: latest record, best source, conflict removal,
modal category, de-duplication, living patients, unknown codes.

Every operator here is a partial (map-side) aggregation to at most one row
per patient, followed by a join that brings the rows back.  No patient's
rows are ever gathered into one task or one group: a patient holding a third
of the data is combined map-side, and with ``salted`` that patient's rows are
dealt over salts (``operators.heavy``), as the pipelines do with their stages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.codelists import UNKNOWN_ETHNIC_VALUES
from .day_classes import agreeing_days
from .heavy import bring_back

KEY = "PATIENT_ID"


def _not_null(*cols: str) -> Column:
    cond = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        cond = cond & F.col(c).isNotNull()
    return cond


def _back(df: DataFrame, found: DataFrame, on: list[str], salted: bool) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns are in ``found``.  ``salted`` reads ``df`` once more to find heavy patients
    and deals their rows over salts: for stored tables.  Otherwise a semi join, which adaptive execution may split."""
    return bring_back(df, found, on) if salted else df.join(found.select(*on), on, "left_semi")


def latest_per_patient(df: DataFrame, key: str = KEY, date: str = "DATE", salted: bool = False) -> DataFrame:
    """All rows on each patient's latest date.

    Rows with a NULL patient or date never qualify (they cannot equal a
    maximum), so they are dropped first; ties on the latest date are all kept.
    ``salted``: see ``_back``.
    """
    clean = df.filter(_not_null(key, date))
    return _back(clean, clean.groupBy(key).agg(F.max(date).alias(date)), [key, date], salted)


def best_priority(df: DataFrame, key: str = KEY, priority: str = "PRIORITY", salted: bool = False) -> DataFrame:
    """All rows of each patient's best (lowest) priority number.  ``salted``: see ``_back``."""
    clean = df.filter(_not_null(key, priority))
    return _back(clean, clean.groupBy(key).agg(F.min(priority).alias(priority)), [key, priority], salted)


def category_index(cat: str, categories: list[str]) -> Column:
    """1-based position of ``cat`` in ``categories``; NULL stays NULL and a
    value outside the list fails the job (it would otherwise be lost)."""
    c = F.col(cat)
    pos = F.array_position(F.array(*[F.lit(v) for v in categories]), c)
    return F.when(c.isNull(), F.lit(None).cast("long")).when(
        pos > 0, pos).otherwise(F.raise_error(F.concat(F.lit(f"category outside {categories}: "), c)).cast("long"))


def drop_conflicts(df: DataFrame, key: str = KEY, cat: str = "CATEGORY",
                   categories: list[str] | None = None, salted: bool = False) -> DataFrame:
    """Keep patients whose rows show exactly one distinct (non-NULL)
    category; their rows are returned unchanged.

    ``min(cat) = max(cat)`` is the same test as ``count(distinct cat) = 1``
    (both fail when every category is NULL) but is a plain partial
    aggregate.  With ``categories`` (the complete label set) the test runs
    on label positions, so the aggregate keeps numeric buffers and Spark
    hashes instead of sorting.
    """
    v = category_index(cat, categories) if categories else F.col(cat)
    known = df.filter(F.col(key).isNotNull())
    stats = known.groupBy(key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    return _back(known, stats.filter(F.col("_lo") == F.col("_hi")), [key], salted)


def latest_consistent(df: DataFrame, key: str = KEY, date: str = "DATE", cat: str = "CATEGORY",
                      categories: list[str] | None = None, salted: bool = False) -> DataFrame:
    """``drop_conflicts(latest_per_patient(df))`` in one aggregation.  ``salted``: see ``_back``.

    Per patient the aggregation finds the latest date and the greatest and
    least non-NULL category on that date; they agree exactly when the latest
    date shows one category.  A semi join on (patient, date) then returns
    that day's rows.

    With ``categories`` (the complete label set, as the banding pipelines
    have) date and label position are packed into one long --
    ``day * W + position`` for the greatest and ``-day * W + position`` for
    the least, ``W`` = labels + 1 -- so ``max``/``min`` over longs order by
    date first and label second, and the aggregation is a hash aggregation
    (``agreeing_days``).
    Otherwise ``max``/``min`` over structs give the same answer for any
    category type.
    """
    clean = df.filter(_not_null(key, date))
    if categories:
        at = category_index(cat, categories)
        # A row without a category counts for the latest date only.
        pos = clean.select(key, date, F.coalesce(at, F.lit(len(categories) + 1)).alias("_lo"), F.coalesce(at, F.lit(0)).alias("_hi"))
        good = agreeing_days(pos, len(categories) + 1, key, date)
    else:
        day, d, c = F.unix_date(F.col(date)).cast("long"), F.col(date), F.col(cat)
        stats = clean.groupBy(key).agg(
            F.max(F.struct(d.alias("d"), c.alias("c"))).alias("_hi"),
            F.min(F.struct((-day).alias("nd"), c.isNull().alias("n"), c.alias("c"))).alias("_lo"))
        good = stats.filter(F.col("_hi.c") == F.col("_lo.c")).select(key, F.col("_hi.d").alias(date))
    return _back(clean, good, [key, date], salted)


def dedupe_observations(df: DataFrame, key: str = KEY, date: str = "DATE", cat: str = "ETHNICITY",
                        source_cat: str | None = None) -> DataFrame:
    """One row per (patient, date, category) with ``COUNT_RECORDS``.

    ``source_cat`` names the category column in ``df`` when it differs
    from the output name ``cat``.  NULL groups are kept, as GROUP BY does.
    """
    src = F.col(source_cat or cat)
    return df.groupBy(F.col(key), F.col(date), src.alias(cat)).agg(
        F.count(F.lit(1)).alias("COUNT_RECORDS"))


def modal_category(votes: DataFrame, key: str = KEY, cat: str = "ETHNICITY") -> DataFrame:
    """Each patient's most frequent category when it is unique.

    ``votes`` has one row per vote.  Counts per (patient, category) are
    partial aggregates; per patient, ``max(struct(count, cat))`` and
    ``min(struct(-count, cat))`` give the greatest and least category with
    the top count, so the mode is unique exactly when they agree.  Ties are
    dropped, like conflicts.
    """
    counts = votes.filter(_not_null(key, cat)).groupBy(key, cat).agg(F.count(F.lit(1)).alias("_n"))
    per = counts.groupBy(key).agg(
        F.max(F.struct(F.col("_n").alias("n"), F.col(cat).alias("c"))).alias("_hi"),
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(cat).alias("c"))).alias("_lo"),
    )
    return per.filter(F.col("_hi.c") == F.col("_lo.c")).select(key, F.col("_hi.c").alias(cat))


def no_death(journal: DataFrame) -> Column:
    """True for rows with neither a date nor a year of death (a journal may hold either)."""
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in ("DATE_OF_DEATH", "YEAR_OF_DEATH") if c in journal.columns])


def keep_living(df: DataFrame, journal: DataFrame, key: str = KEY) -> DataFrame:
    """Keep patients with at least one journal row without a death date or year.
    Patients absent from the journal are dropped too."""
    alive = journal.filter(no_death(journal) & F.col(key).isNotNull()).select(key).distinct()
    return df.join(alive, key, "left_semi")


def drop_unknown_codes(df: DataFrame, col: str, unknown: list[str] | None = None) -> DataFrame:
    """Drop rows whose category is NULL or one of the 'unknown' spellings."""
    vals = UNKNOWN_ETHNIC_VALUES if unknown is None else unknown
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(vals))


def drop_indeterminable(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """Drop rows whose category is in ``values`` (NULL is dropped too, as
    ``NOT IN`` does)."""
    return df.filter(~F.col(col).isin(values))


def fallback_source(primary: DataFrame, secondary: DataFrame, key: str = KEY, available: DataFrame | None = None) -> DataFrame:
    """``primary`` plus the ``secondary`` rows of patients for whom the first source has nothing.

    ``available`` holds the patients for whom it has something (by default
    those of ``primary``): with the source's records, a patient whose
    records conflict is left out rather than filled from the second source.
    """
    missing = secondary.join((primary if available is None else available).select(key).distinct(), key, "left_anti")
    return primary.unionByName(missing, allowMissingColumns=True)
