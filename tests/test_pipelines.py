"""Pipelines: invariants on the synthetic journal, hand-made cases, and the
differential check against the DuckDB oracle."""

import datetime as dt
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from phenoframe.plans import blood_pressure, ethnicity_modal, ethnicity_recent_all, smoking
from phenoframe.sources import fixtures
from phenoframe.sources.codelists import codelist_df

from conftest import SF_SMALL

PIPELINES = ["smoking", "blood_glucose", "blood_pressure", "bmi", "ethnicity_recent_primary",
             "ethnicity_recent_all", "ethnicity_modal"]
CATEGORY = {"smoking": "DATA_DICTIONARY_CATS", "blood_glucose": "CATEGORISED_BLOOD_GLUCOSE",
            "blood_pressure": "FINAL_BP_CATS", "bmi": "BMI_CATEGORY",
            "ethnicity_recent_primary": "ETHNIC_CATEGORY_CODE", "ethnicity_recent_all": "ETHNIC_CATEGORY_CODE",
            "ethnicity_modal": "ETHNIC_CATEGORY_CODE"}


def _norm(v):
    return repr(v) if isinstance(v, float) else v


def _rows(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


def test_contract():
    assert set(se.registry.queries()) == set(se.oracle.oracle_sql())
    assert set(se.registry.queries()) <= set(se.queries()) and set(se.oracle_sql()) <= set(se.queries())
    assert set(PIPELINES) <= set(se.queries())


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() >= 0 and "FINAL_BP_CATS" in df.columns


@pytest.mark.parametrize("name", PIPELINES)
def test_one_category_per_patient(spark, name):
    df = se.queries()[name](spark, SF_SMALL)
    per = df.groupBy("PATIENT_ID").agg(F.countDistinct(CATEGORY[name]).alias("k"))
    assert per.filter("k <> 1").count() == 0
    assert df.filter(F.col("PATIENT_ID").isNull()).count() == 0


@pytest.mark.parametrize("name", list(se.oracle.oracle_sql()))
def test_matches_duckdb_oracle(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = se.queries()[name](spark, SF_SMALL)
    res = con.execute(se.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(res.fetchall(), ocols)


def test_input_order_does_not_matter(spark):
    j = fixtures.journal(spark, SF_SMALL)
    rows = j.collect()
    random.Random(7).shuffle(rows)
    shuffled = spark.createDataFrame(rows, j.schema).repartition(3)
    codes = codelist_df(spark, "smoking")
    a = sorted(tuple(r) for r in smoking(j, codes).collect())
    b = sorted(tuple(r) for r in smoking(shuffled, codes).collect())
    assert a == b


def test_adding_an_older_row_changes_nothing(spark):
    j = fixtures.journal(spark, SF_SMALL, ["bp"])
    codes = codelist_df(spark, "bp")
    base = sorted(tuple(r) for r in blood_pressure(j, codes).collect())
    older = j.limit(50).withColumn("DATE", F.lit(dt.date(2000, 1, 1))).withColumn("LINKS", F.lit("old"))
    more = sorted(tuple(r) for r in blood_pressure(j.unionByName(older), codes).collect())
    assert base == more


def test_hospital_only_patients(spark):
    j = fixtures.journal(spark, SF_SMALL, ["ethnicity"])
    codes = codelist_df(spark, "ethnicity")
    hosp = {k: fixtures.hospital_halves(spark, SF_SMALL, k) for k in ("admitted", "emergency", "outpatient")}
    gp_patients = {r[0] for r in j.select("PATIENT_ID").distinct().collect()}
    recent = {r[0] for r in ethnicity_recent_all(j, codes, hosp).select("PATIENT_ID").collect()}
    modal = {r[0] for r in ethnicity_modal(j, codes, hosp).select("PATIENT_ID").collect()}
    assert recent <= gp_patients              # recent keeps living primary-care patients only
    assert modal - gp_patients                # modal keeps hospital-only patients


def test_smoking_fan_out_with_duplicated_list(spark):
    j = fixtures.journal(spark, SF_SMALL, ["smoking"])
    codes = codelist_df(spark, "smoking")  # the published list repeats rows itself
    doubled = codes.unionByName(codes)
    single = smoking(j, codes).count()
    assert smoking(j, doubled).count() == 2 * single
    once = smoking(j, codes, dedupe_codes=True).count()
    assert smoking(j, doubled, dedupe_codes=True).count() == once < single


@pytest.mark.parametrize("name", PIPELINES)
def test_result_patients_come_from_the_input(spark, name):
    out = {r[0] for r in se.queries()[name](spark, SF_SMALL).select("PATIENT_ID").distinct().collect()}
    journal = fixtures.journal(spark, SF_SMALL).select("PATIENT_ID")
    hosp = [fixtures.hospital_halves(spark, SF_SMALL, k)[0].select("PATIENT_ID")
            for k in ("admitted", "emergency", "outpatient")]
    src = journal
    for h in hosp:
        src = src.unionByName(h)
    assert out <= {r[0] for r in src.distinct().collect()}


def test_union_order_does_not_matter(spark):
    from phenoframe.operators.union import union_sources
    from phenoframe.plans.blood_pressure import readings
    from phenoframe.operators.tagging import tag_codes
    t = tag_codes(fixtures.journal(spark, SF_SMALL, ["bp"]), codelist_df(spark, "bp"))
    num, txt = readings(t)
    a = union_sources([num, txt.select(*num.columns)])
    b = union_sources([txt.select(*num.columns), num])
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_combined_run_equals_separate_runs(spark):
    from phenoframe.plans import blood_glucose, bmi
    from phenoframe.plans.combined import banded_phenotypes
    j = fixtures.journal(spark, SF_SMALL)
    c = lambda n: codelist_df(spark, n)
    lms = fixtures.lms_table(spark)
    combined = banded_phenotypes(j, c("smoking"), c("glucose"), c("bp"), c("bmi"), c("height"), c("weight"), lms)
    separate = {"smoking": smoking(j, c("smoking")), "blood_glucose": blood_glucose(j, c("glucose")),
                "blood_pressure": blood_pressure(j, c("bp")),
                "bmi": bmi(j, c("bmi"), c("height"), c("weight"), lms)}
    for name, df in separate.items():
        got = combined[name]
        assert got.columns == df.columns, name
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr), name
