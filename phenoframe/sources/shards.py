"""Hospital datasets kept in yearly shards.

The newest years come from names alone: of the tables of a database, of a
table's partitions, or of a folder's partition folders.  No job runs over
rows.  ``columns`` says which of the dataset's own columns stands for each
column that the library uses; a year that lacks one gives NULLs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_YEAR = re.compile(r"([0-2][0-9]{3})")


def adapt(df: DataFrame, columns: dict[str, str] | None) -> DataFrame:
    """The columns that the library uses, under its names, from a dataset's own; those that it lacks are left out."""
    if not columns:
        return df
    have = {c.lower() for c in df.columns}
    return df.select(*[F.col(own).alias(name) for name, own in columns.items() if own.lower() in have])


def table_names(spark: SparkSession, database: str) -> list[str]:
    """Names of the permanent tables of a database."""
    return [t.tableName for t in spark.sql(f"SHOW TABLES IN {database}").collect() if not t.isTemporary]


def newest(years, n: int | None) -> list[int]:
    return sorted(set(years), reverse=True)[:n]


@dataclass(frozen=True)
class YearTables:
    """Permanent tables ``<prefix>_<kind>_<year>`` of a database, one for each year of a dataset.

    ``columns`` holds for every year, ``by_year`` what differs in some."""
    spark: SparkSession
    database: str
    kind: str
    prefix: str = ""
    columns: dict[str, str] | None = None
    by_year: dict[int, dict[str, str]] = field(default_factory=dict)

    def years(self, n: int | None = None) -> list[int]:
        found = []
        for name in table_names(self.spark, self.database):
            parts = name.split("_")
            if len(parts) > 2 and parts[1] == self.kind and (m := _YEAR.search(parts[2])):
                found.append(int(m.group(1)))
        return newest(found, n)

    def read(self, years: list[int]) -> DataFrame:
        """Rows of the years' tables with ``YEAR``, aligned by name.  Columns that no year has are NULL."""
        parts = []
        for y in years:
            columns = {**(self.columns or {}), **self.by_year.get(y, {})}
            parts.append(adapt(self.spark.table(f"{self.database}.{self.prefix}{self.kind}_{y}"), columns).withColumn("YEAR", F.lit(y)))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        lacking = [c for c in self.columns or {} if c not in rows.columns]
        return rows.withColumns({c: F.lit(None).cast("string") for c in lacking}) if lacking else rows


@dataclass(frozen=True)
class YearPartitions:
    """A dataset partitioned by year: a catalog table, or a folder with ``<year column>=<year>`` folders."""
    spark: SparkSession
    table: str | None = None
    folder: str | None = None
    year: str = "YEAR"
    columns: dict[str, str] | None = None

    def _names(self) -> list[str]:
        if self.table:
            return [r[0] for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect()]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        listed = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return [f.getPath().getName() for f in listed if f.isDirectory()]

    def years(self, n: int | None = None) -> list[int]:
        values = [m.group(1) for name in self._names() if (m := re.search(rf"(?:^|/){self.year}=(-?[0-9]+)(?:/|$)", name))]
        return newest(map(int, values), n)

    def read(self, years: list[int]) -> DataFrame:
        """Rows of the years' partitions only."""
        rows = self.spark.table(self.table) if self.table else self.spark.read.parquet(self.folder)
        rows = rows.filter(F.col(self.year).isin(years))
        return adapt(rows, {**self.columns, "YEAR": self.year} if self.columns else None)


@dataclass(frozen=True)
class BucketedTable:
    """A half of a dataset stored in buckets of (year, episode key), see ``write_bucketed``; both halves are then joined where they are."""
    spark: SparkSession
    table: str
    columns: dict[str, str] | None = None

    def years(self, n: int | None = None) -> list[int]:
        listed = self.spark.sql(f"SHOW TBLPROPERTIES {self.table} ('{YEARS}')").first()[1]
        return newest((int(y) for y in listed.split(",") if y), n)

    def read(self, years: list[int]) -> DataFrame:
        """Rows of the years (rows are sorted by year in each bucket, so others are skipped by their statistics)."""
        rows = self.spark.table(self.table)
        return adapt(rows.filter(F.col("YEAR").isin(years)), {**self.columns, "YEAR": "YEAR"} if self.columns else None)


#: Table property that lists the years of a bucketed half.
YEARS = "phenoframe.years"


def write_bucketed(half: DataFrame, table: str, buckets: int, key: str = "EPISODE_KEY", path: str | None = None) -> BucketedTable:
    """Store a half (with an INT ``YEAR``) in ``buckets`` buckets of (``YEAR``, ``key``), once; every later join of two halves
    with as many buckets needs no shuffle.  The years are noted with the table, so that they are read from the catalog."""
    spark = half.sparkSession
    rows = half.repartition(buckets, "YEAR", key)  # the buckets' own partitioning: a file for each
    writer = rows.write.bucketBy(buckets, "YEAR", key).sortBy("YEAR", key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    years = spark.table(table).select("YEAR").where("YEAR is not null").distinct().collect()
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{YEARS}' = '{','.join(str(r[0]) for r in years)}')")
    return BucketedTable(spark, table)


Shards = YearTables | YearPartitions | BucketedTable
