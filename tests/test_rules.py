"""Banding rules against hand-written expectations (boundaries and NULLs)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from phenoframe.functions import banding as b
from phenoframe.functions.ages import age_months, age_months_bracket, age_years
from phenoframe.functions.measures import bmi_from_hw, height_to_cm, lms_zscore


def _band(spark, schema, rows, rules, default):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(b.band(rules, default)).collect()]


ADULT = "BMI_CAT string, VALUE1_CONDITION double"


@pytest.mark.parametrize("tag,value,expected", [
    ("ALL", 9.999, "INDETERMINABLE"), ("ALL", 10.0, "UNDERWEIGHT"), ("ALL", 18.5, "IDEAL"),
    ("ALL", 25.0, "OVERWEIGHT"), ("ALL", 30.0, "OBESE"), ("ALL", 55.0, "OBESE"),
    ("ALL", 55.001, "INDETERMINABLE"), ("ALL", None, "INDETERMINABLE"),
    ("OBESE", 55.0, "INDETERMINABLE"), ("OBESE", 54.9, "OBESE"), ("OBESE", None, "OBESE"), ("OBESE", 0.0, "OBESE"),
    ("UNDERWEIGHT", 0.0, "UNDERWEIGHT"), ("UNDERWEIGHT", 12.0, "INDETERMINABLE"),
    ("IDEAL", 20.0, "IDEAL"), ("IDEAL", 26.0, "INDETERMINABLE"),
    ("UNDER_IDEAL_BORDER", None, "UNDER 20 NULLS"), ("UNDER_IDEAL_BORDER", 15.0, "UNDERWEIGHT"),
    ("UNDER_IDEAL_BORDER", 20.0, "IDEAL"), ("UNDER_IDEAL_BORDER", 20.1, "INDETERMINABLE"),
    ("OVERWEIGHT", 29.9, "OVERWEIGHT"), ("UNSUITABLE/DECLINED", 3.0, "UNSUITABLE/DECLINED"),
    ("UNKNOWN", None, "INDETERMINABLE"), ("CHILD", 5.0, "CHILD"), ("OTHER", 20.0, "INDETERMINABLE"),
])
def test_adult_bmi(spark, tag, value, expected):
    assert _band(spark, ADULT, [(tag, value)], b.adult_bmi_rules(), "INDETERMINABLE") == [expected]


@pytest.mark.parametrize("tag,value,expected", [
    ("ALL", None, "INDETERMINABLE"), ("ALL", 0.0, "CENTILE"), ("UNDERWEIGHT", 40.0, "UNDERWEIGHT"),
    ("IDEAL", 0.0, "IDEAL"), ("IDEAL", 15.0, "CENTILE"), ("UNDER_IDEAL_BORDER", 0.0, "UNDER 20 NULLS"),
    ("OBESE", None, "OBESE"), ("OBESE", 31.0, "CENTILE"), ("CHILD", 1.0, "CHILD"),
])
def test_child_bmi(spark, tag, value, expected):
    assert _band(spark, ADULT, [(tag, value)], b.child_bmi_rules(), "INDETERMINABLE") == [expected]


def test_child_codes(spark):
    rows = [("920141000000102",), ("920991000000109",), ("921051000000109",), ("920291000000102",)]
    got = _band(spark, "code string", rows, b.child_code_rules("code"), "IDEAL")
    assert got == ["UNDERWEIGHT", "OVERWEIGHT", "OBESE", "IDEAL"]


@pytest.mark.parametrize("z,expected", [
    (-2.0, "UNDERWEIGHT"), (-1.999, "IDEAL"), (4 / 3, "OVERWEIGHT"), (1.3333, "IDEAL"), (2.0, "OBESE"),
    (None, "ERROR"), (float("nan"), "OBESE"),
])
def test_zscore(spark, z, expected):
    assert _band(spark, "BMI_Z_SCORE double", [(z,)], b.zscore_rules(), "ERROR") == [expected]


@pytest.mark.parametrize("s,d,expected", [
    (120, 80, "Pre-High Blood Pressure"), (119, 79, "Ideal Blood Pressure"), (89, 59, "Low Blood Pressure"),
    (140, 90, "High Blood Pressure"), (191, 80, "Indeterminable"), (120, 101, "Indeterminable"),
    (69, 50, "Indeterminable"), (85, 65, "Ideal Blood Pressure"), (100, 85, "Pre-High Blood Pressure"),
    (130, 95, "High Blood Pressure"), (190, 100, "High Blood Pressure"),
])
def test_bp_values(spark, s, d, expected):
    got = _band(spark, "VALUE1_CONDITION double, VALUE2_CONDITION double", [(float(s), float(d))],
                b.bp_value_rules(), b.BP_INDETERMINABLE)
    assert got == [expected]


def test_bp_text_pairs_take_the_higher_level(spark):
    schema = ("INITIAL_BREAKDOWN string, TYPE_OF_JOURNAL string, VALUE1_CONDITION double, "
              "VALUE2_CONDITION double, SBP_CATS string, DBP_CATS string")
    levels = ["Low", "Ideal", "Pre-High", "High"]
    rows, want = [], []
    for i, s in enumerate(levels):
        for j, d in enumerate(levels):
            rows.append(("SBP", "Low-Finding", None, None, f"{s} Systolic Blood Pressure",
                         f"{d} Diastolic Blood Pressure"))
            want.append(f"{levels[max(i, j)]} Blood Pressure")
    rows.append(("SBP", "x", None, None, "Indeterminable", "High Diastolic Blood Pressure"))
    want.append("Indeterminable")
    rows.append(("ALL", "Pre-High Finding", None, None, None, None))
    want.append("Pre-High Blood Pressure")
    rows.append(("ALL", "OE", None, None, None, None))
    want.append("Indeterminable")
    assert _band(spark, schema, rows, b.bp_combined_rules(), b.BP_INDETERMINABLE) == want


def test_bp_text_finding(spark):
    rows = [("High-Finding", None), ("Pre-High Finding", None), ("High-Finding", 5.0), ("OE", None)]
    got = _band(spark, "TYPE_OF_JOURNAL string, VALUE1_CONDITION double", rows,
                b.bp_text_rules("Systolic"), "Indeterminable")
    assert got == ["High Systolic Blood Pressure", "Pre-High Systolic Blood Pressure", "Indeterminable",
                   "Indeterminable"]


@pytest.mark.parametrize("kind,fasting,value,expected", [
    ("HBA1C", "NON-FASTING", 48.0, "PRE-DIABETES"), ("HBA1C", "NON-FASTING", 48.5, "DIABETES"),
    ("HBA1C", "NON-FASTING", 8.9, "INDETERMINABLE"), ("HBA1C", "NON-FASTING", 162.0, "DIABETES"),
    ("PLASMA", "NON-FASTING", 3.9, "LOW"), ("SERUM", "NON-FASTING", 7.8, "PRE-DIABETES"),
    ("BLOOD", "RANDOM", 11.0, "MORE-TESTING-NEEDED"), ("BLOOD", "RANDOM", 11.1, "DIABETES"),
    ("TOLERANCE", "NON-FASTING", 5.0, "INDETERMINABLE"),
])
def test_glucose_single(spark, kind, fasting, value, expected):
    schema = "TYPE_OF_BLOOD_GLUCOSE_RECORD string, FASTING_STATUS string, VALUE1_CONDITION double"
    assert _band(spark, schema, [(kind, fasting, value)], b.glucose_single_rules(), "INDETERMINABLE") == [expected]


@pytest.mark.parametrize("v,w,expected", [
    (5.45, 7.0, "INDETERMINABLE"), (7.5, None, "DIABETES"), (5.0, 6.0, "NORMAL"), (5.0, 8.0, "PRE-DIABETES"),
    (6.0, 5.0, "PRE-DIABETES"), (4.5, 12.0, "DIABETES"), (3.9, None, "NORMAL"), (3.9, 5.0, "INDETERMINABLE"),
    (6.95, None, "INDETERMINABLE"), (6.0, None, "PRE-DIABETES"),
])
def test_glucose_fasting(spark, v, w, expected):
    schema = "VALUE1_CONDITION double, VALUE2_CONDITION double"
    assert _band(spark, schema, [(v, w)], b.glucose_fasting_rules(), "INDETERMINABLE") == [expected]


@pytest.mark.parametrize("cat,code,value,expected", [
    ("Value_Finding_Smoker", "160603005", 9.0, "Smoker"),
    ("Value_Finding_Smoker", "160603005", 10.0, "Indeterminable"),
    ("Observable_Entities", "401201003", 0.0, "Non-Smoker"),
    ("Observable_Entities", "401201003", None, "Non-Smoker"),
    ("Observable_Entities", "401201003", 5.0, "Smoker"),
    ("Observable_Entities", "413173009", 0.0, "Smoker"),
    ("Observable_Entities", "230057008", 21.0, "Indeterminable"),
    ("Observable_Entities", "401159003", None, "Smoker"),
    ("Microtest_Error", "266919005", 0.0, "Non-Smoker"),
    ("smoker_findings_codes", "160612007", 3.0, "Indeterminable"),
])
def test_smoking(spark, cat, code, value, expected):
    schema = "CATEGORY string, CODE string, VALUE1_CONDITION double"
    assert _band(spark, schema, [(cat, code, value)], b.smoking_rules(), "Indeterminable") == [expected]


@pytest.mark.parametrize("status,code,value,expected", [
    ("Non-Smoker", "401201003", 0.0, "Never-Smoker"), ("Non-Smoker", "401201003", None, "Never-Smoker"),
    ("Smoker", "401201003", 5.0, "Current-Smoker"), ("Non-Smoker", "8392000", None, "Non-Smoker History Unknown"),
    ("Non-Smoker", "160617001", None, "Ex-Smoker"), ("Indeterminable", "x", None, "Indeterminable"),
])
def test_smoking_dictionary(spark, status, code, value, expected):
    schema = "SMOKING_CATS string, CODE string, VALUE1_CONDITION double"
    assert _band(spark, schema, [(status, code, value)], b.smoking_dictionary_rules(), "Ex-Smoker") == [expected]


def test_age_487_days_is_decimal(spark):
    df = spark.createDataFrame([(dt.date(2024, 5, 2), dt.date(2023, 1, 1))], "DATE date, DATE_OF_BIRTH date")
    df = df.withColumn("m", age_months("DATE", "DATE_OF_BIRTH")).withColumns(age_months_bracket("m"))
    r = df.select(age_years("DATE", "DATE_OF_BIRTH").alias("y"), "m", "AGE_LOWER", "AGE_UPPER").first()
    assert str(r.y) == "1.333333" and str(r.m) == "15.999996"
    assert (r.AGE_LOWER, r.AGE_UPPER) == (15, 16)


def test_height_and_bmi(spark):
    df = spark.createDataFrame([(1.7, 65.0), (0.0, 65.0), (170.0, 65.0)], "h double, w double")
    rows = df.select(height_to_cm("h").alias("cm")).withColumn("bmi", bmi_from_hw(F.lit(65.0), "cm")).collect()
    assert rows[0].cm == 170.0 and round(rows[0].bmi, 3) == 22.491
    assert rows[1].bmi is None
    assert rows[2].cm == 170.0


def test_zscore_zero_l_is_null(spark):
    df = spark.createDataFrame([(20.0, 0.0, 18.0, 0.1), (20.0, -1.0, 18.0, 0.1)], "v double, l double, m double, s double")
    z = [r[0] for r in df.select(lms_zscore("v", "l", "m", "s")).collect()]
    assert z[0] is None
    assert z[1] == pytest.approx(((20 / 18) ** -1 - 1) / (-1 * 0.1))
