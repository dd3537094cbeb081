from collections import Counter

from phenoframe.functions import banding
from phenoframe.sources import codelists as cl


def rows(name):
    return [r[1:] for r in cl.codelist_rows(name)[0]]


def test_list_sizes():
    sizes = {"bmi": 51, "height": 8, "weight": 9, "glucose": 41, "bp": 98, "smoking": 219, "ethnicity": 489, "ethnic_labels": 19}
    assert {name: len(rows(name)) for name in cl.KEYS} == sizes
    assert len({r[0] for r in rows("smoking")}) == len({(r[0], r[2]) for r in rows("smoking")}) == 84


def test_tag_counts():
    assert Counter(r[2] for r in rows("bmi")) == {
        "CHILD": 17, "OBESE": 10, "ALL": 5, "UNDERWEIGHT": 5, "OVERWEIGHT": 5,
        "UNSUITABLE/DECLINED": 4, "IDEAL": 2, "UNKNOWN": 2, "UNDER_IDEAL_BORDER": 1}
    assert Counter(r[2] for r in rows("glucose")) == {
        "PLASMA": 14, "BLOOD": 12, "SERUM": 10, "HBA1C": 3, "TOLERANCE": 2}
    assert Counter(r[3] for r in rows("glucose")) == {
        "INDETERMINABLE": 18, "NON-FASTING": 11, "OGTT": 5, "FASTING": 4, "RANDOM": 3}
    assert Counter(r[2] for r in rows("bp")) == {"ALL": 42, "SBP": 29, "DBP": 27}


def test_codes_unique_but_for_smoking():
    for name in ("bmi", "glucose", "bp", "ethnicity"):
        assert len({r[0] for r in rows(name)}) == len(rows(name))


def test_repeated_codes_multiply_rows(spark):
    from phenoframe.operators.tagging import tag_codes
    counts = Counter(r[0] for r in rows("smoking"))
    code, n = counts.most_common(1)[0]
    assert n > 1
    journal = spark.createDataFrame([("p", code)], "PATIENT_ID string, CODE string")
    assert tag_codes(journal, cl.codelist_df(spark, "smoking")).count() == n


def test_rule_codes_exist_in_lists():
    smoking = {r[0]: r[2] for r in rows("smoking")}
    for code, _, _ in banding.SMOKER_VALUE_RANGES:
        assert smoking[code] == "Value_Finding_Smoker"
    observable = (banding.OBSERVABLE_NON_SMOKER_IF_EMPTY + banding.OBSERVABLE_NON_SMOKER_IF_NON_NEGATIVE
                  + banding.OBSERVABLE_NON_SMOKER_IF_ZERO + banding.OBSERVABLE_SMOKER_IF_EMPTY
                  + [c for c, *_ in banding.OBSERVABLE_SMOKER_RANGES])
    for code in observable:
        assert smoking[code] == "Observable_Entities"
    for code in banding.NEVER_SMOKER_CODES + banding.NEVER_SMOKER_IF_EMPTY + banding.HISTORY_UNKNOWN_CODES:
        assert code in smoking
    child = {r[0] for r in rows("bmi") if r[2] == "CHILD"}
    for code in (banding.CHILD_CENTILE_UNDERWEIGHT + banding.CHILD_CENTILE_OVERWEIGHT
                 + banding.CHILD_CENTILE_OBESE):
        assert code in child


def test_files_read_alike(spark):
    for name in ("bmi", "smoking", "ethnicity"):
        read = cl.read_codelist(spark, f"file://{cl.codelist_path(name)}", key=cl.KEYS[name][0])
        assert sorted(map(tuple, read.collect())) == sorted(rows(name)) and read.columns == cl.codelist_df(spark, name).columns


def test_read_codelist_csv(spark, tmp_path):
    p = tmp_path / "list.csv"
    p.write_bytes("﻿ConceptID,ConceptId_Description,BMI_CAT\r\n60621009,Body mass index,ALL\r\n"
                  "414915002,Obese,OBESE\r\n".encode("utf-8"))
    df = cl.read_codelist(spark, str(p), key="ConceptID")
    assert df.columns == ["code", "ConceptId_Description", "BMI_CAT"]
    assert sorted(tuple(r) for r in df.collect()) == [
        ("414915002", "Obese", "OBESE"), ("60621009", "Body mass index", "ALL")]
