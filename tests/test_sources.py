import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from phenoframe import normalise_journal
from phenoframe.operators.hospital import catalog_shard_years, read_catalog_shards
from phenoframe.operators.joins import is_small, lookup_join
from phenoframe.operators.staging import materialise
from phenoframe.sources import fixtures


def test_normalise_journal_renames_and_derives(spark):
    df = spark.createDataFrame(
        [("p1", dt.date(1990, 5, 1), "P1", dt.date(2024, 1, 31), dt.date(2024, 1, 31), dt.date(2024, 1, 2),
          dt.date(2024, 1, 2), 123456789012345, 1.5, None)],
        "PID string, DATE_OF_BIRTH date, PRACTICE string, REPORTING_PERIOD_END_DATE date, "
        "JOURNAL_REPORTING_PERIOD_END_DATE date, DATE date, RECORD_DATE date, CODE long, "
        "VALUE1_CONDITION double, VALUE2_CONDITION double")
    out = normalise_journal(df, id_col="PID")
    r = out.first()
    assert r.PATIENT_ID == "p1" and r.YEAR_OF_BIRTH == 1990 and r.CODE == "123456789012345"
    assert r.DATE_OF_DEATH is None and r.YEAR_OF_DEATH is None
    assert out.columns[:len(fixtures.JOURNAL_COLUMNS)] == fixtures.JOURNAL_COLUMNS


def test_normalise_journal_requires_core_columns(spark):
    with pytest.raises(ValueError):
        normalise_journal(spark.createDataFrame([("x",)], "PATIENT_ID string"))


def test_fixture_journal_shape(spark):
    j = fixtures.journal(spark, "/root/testdata/sf0.001")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert j.count() == 5 * events
    assert j.columns == fixtures.JOURNAL_COLUMNS


def test_size_checked_broadcast(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(50).withColumnRenamed("id", "k")
    assert is_small(small, 10) and not is_small(big, 10)
    plan = lookup_join(spark.range(100).withColumnRenamed("id", "k"), big, "k", max_rows=10) \
        ._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_materialise_uses_checkpoint_folder(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    out = materialise(df)
    assert sorted(r.x for r in out.collect()) == [0, 2, 4, 6, 8]
    assert "parquet" in out._jdf.queryExecution().executedPlan().toString().lower()


def test_catalog_shards(spark):
    db = "shards_test"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    base = tempfile.mkdtemp(prefix="phenoframe-cat-", dir="/tmp")
    for y in (2017, 2018, 2019):
        spark.createDataFrame([(y, f"p{y}")], "EPISODE_KEY int, PATIENT_ID string") \
            .write.mode("overwrite").option("path", os.path.join(base, str(y))) \
            .saveAsTable(f"{db}.src_adm_{y}")
    years = catalog_shard_years(spark, db, n=2)
    assert years == ["2019", "2018"]
    df = read_catalog_shards(spark, db, "adm", years, prefix="src_")
    assert sorted(r.YEAR for r in df.collect()) == [2018, 2019]


def test_numeric_codes_become_digit_strings(spark):
    df = spark.createDataFrame(
        [("p1", "P1", dt.date(2024, 1, 31), dt.date(2024, 1, 31), dt.date(2024, 1, 2), dt.date(2024, 1, 2),
          1234567890123456.0, 1.5, None)],
        "PATIENT_ID string, PRACTICE string, REPORTING_PERIOD_END_DATE date, "
        "JOURNAL_REPORTING_PERIOD_END_DATE date, DATE date, RECORD_DATE date, CODE double, "
        "VALUE1_CONDITION double, VALUE2_CONDITION double")
    j = normalise_journal(df)
    assert j.first().CODE == "1234567890123456"
    from phenoframe.operators.tagging import tag_codes
    codes = spark.createDataFrame([(1234567890123456, "A")], "code long, TAG string")
    assert tag_codes(j, codes).select("TAG").first().TAG == "A"
