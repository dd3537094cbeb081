"""Hospital episode sources: year shards and two-half episode tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shards import Shards, YearTables, newest, table_names

# FIXED VALUES: practice codes that mark an episode as out of scope.
EXCLUDED_PRACTICES = ["Y", "Q99"]
# How many of the newest yearly shards are read.
DEFAULT_SHARDS = 6


def latest_shards(data: DataFrame | Shards, year: str = "YEAR", n: int = DEFAULT_SHARDS) -> DataFrame:
    """Rows of the ``n`` newest years.  Of ``Shards`` the years are read from
    names and only their files are read; of a plain DataFrame from its rows."""
    if isinstance(data, Shards):
        return data.read(data.years(n))
    return data.filter(F.col(year).isin(shard_years(data, year, n)))


def shard_years(data: DataFrame | Shards, year: str = "YEAR", n: int = DEFAULT_SHARDS) -> list[int]:
    """The ``n`` newest years, newest first.  Of ``Shards`` without any job;
    of a plain DataFrame by a scan of its ``year`` column when this is called
    (at most ``n`` values come to the driver)."""
    if isinstance(data, Shards):
        return data.years(n)
    found = data.select(year).where(F.col(year).isNotNull()).distinct().orderBy(F.col(year).desc()).limit(n)
    return [r[0] for r in found.collect()]


def catalog_shard_years(spark: SparkSession, database: str, n: int = DEFAULT_SHARDS, kind: str | None = None) -> list[str]:
    """Years of the permanent ``<prefix>_<kind>_<year>`` tables in a catalog
    database, newest ``n`` first; of one ``kind`` of table only when given
    (datasets need not have the same years).  Reads table names only."""
    kinds = {kind} if kind else {name.split("_")[1] for name in table_names(spark, database) if name.count("_") > 1}
    return [str(y) for y in newest((y for k in kinds for y in YearTables(spark, database, k).years()), n)]


def read_catalog_shards(spark: SparkSession, database: str, kind: str, years: list[str],
                        prefix: str = "", columns: dict[str, str] | None = None) -> DataFrame:
    """Distinct rows of the per-year tables ``{database}.{prefix}{kind}_{year}``,
    with the shard's year as an INT ``YEAR`` column (rows are distinct within
    a year, so the years are never compared with each other).  ``columns``: see ``YearTables``."""
    tables = YearTables(spark, database, kind, prefix, columns)
    parts = [tables.read([int(y)]).distinct() for y in years]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def join_halves(ident: DataFrame, clinical: DataFrame, key: str = "EPISODE_KEY",
                patient: str = "PATIENT_ID", date: str = "EVENT_DATE", ethnic: str = "ETHNIC_CODE",
                practice: str = "PRACTICE_CODE", year: str | None = "YEAR",
                excluded: list[str] | None = None) -> DataFrame:
    """Match the identifying and clinical halves of each episode and drop
    episodes whose practice is excluded or NULL (``NOT IN`` semantics).

    Returns (PATIENT_ID, EVENT_DATE, ETHNIC_CODE[, YEAR]).  The halves are
    joined within a shard when ``year`` is given.
    """
    excluded = EXCLUDED_PRACTICES if excluded is None else excluded
    on = [key] + ([year] if year else [])
    right = clinical.filter(~F.col(practice).isin(excluded))
    cols = [F.col(patient).alias("PATIENT_ID"), F.col(date).alias("EVENT_DATE"), F.col(ethnic).alias("ETHNIC_CODE")]
    if year:
        cols.append(F.col(year).alias("YEAR"))
    return ident.join(right, on, "inner").select(*cols)

