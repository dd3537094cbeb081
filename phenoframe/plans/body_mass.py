"""Most recent body-mass-index category per patient.

Six ways a BMI reaches the journal: an adult BMI code (valued or stating a
category), an adult same-day height + weight, a child BMI value scored
against a growth reference (LMS), a child same-day height + weight scored the
same way, and a child centile code.  Each becomes rows of the same 14
columns, labelled by ``TABLE_ORIGIN``; the latest date per patient wins and
patients whose latest rows disagree are dropped.

Child rows whose code already states a category without a value are not
added (only centile results and centile codes are), as published.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ages import age_months, age_months_bracket, age_years
from ..functions.banding import (BMI_CATEGORIES, INDETERMINABLE_BMI, KNOWN_CHILD_CATEGORIES, UNUSABLE_ADULT_CATEGORIES,
                                 Z_ERROR_LABEL, adult_bmi_rules, band, child_bmi_rules, child_code_rules,
                                 computed_bmi_rules, zscore_rules)
from ..functions.measures import bmi_from_hw, height_to_cm, lms_interpolate, lms_zscore
from ..operators.day_classes import agreeing_days, band_index
from ..operators.heavy import bring_back
from ..operators.lms import lms_lookup
from ..operators.pairing import day_pairs, pair_same_day
from ..operators.selection import KEY
from ..operators.staging import materialise
from ..operators.tagging import tag_codes
from ..operators.union import union_sources
from ..schemas import require

CAT = "BMI_CATEGORISED_INITIAL"
AGE = "AGE_AT_TIME_OF_JOURNAL"
ADULT_YEARS = 18

RESULT_COLUMNS = [
    "DATE_OF_BIRTH", "SEX", KEY, "ETHNIC", "PRACTICE", "GP_SYSTEM_SUPPLIER",
    "REPORTING_PERIOD_END_DATE", "JOURNAL_REPORTING_PERIOD_END_DATE", "DATE", "RECORD_DATE",
    AGE, "BMI", "BMI_CATEGORY", "TABLE_ORIGIN",
]

_WEIGHT_TAKE = {"RECORD_DATE": "W_RECORD_DATE", "CODE": "W_CODE", "VALUE1_CONDITION": "W_VALUE",
                "LINKS": "W_LINKS"}


def _age():
    return age_years("DATE", "DATE_OF_BIRTH")


def adult_coded(bmi_journal: DataFrame) -> DataFrame:
    """Adult BMI codes, banded; unusable categories and under-18s removed."""
    return (bmi_journal.withColumn(CAT, band(adult_bmi_rules(), INDETERMINABLE_BMI))
            .withColumn(AGE, _age())
            .filter(~F.col(CAT).isin(UNUSABLE_ADULT_CATEGORIES) & (F.col(AGE) >= ADULT_YEARS)))


def height_weight_pairs(height: DataFrame, weight: DataFrame, distinct_partners: bool = False) -> DataFrame:
    """All same-day pairs of a height and a weight with values, with
    ``AGE_AT_TIME_OF_JOURNAL``, ``H_VALUE`` (cm) and ``BMI``; the adult and
    child branches split one join by age."""
    h = height.filter(F.col("VALUE1_CONDITION").isNotNull())
    w = weight.filter(F.col("VALUE1_CONDITION").isNotNull())
    return measured(pair_same_day(h, w, dict(_WEIGHT_TAKE), distinct_partners=distinct_partners))


def measured(pairs: DataFrame) -> DataFrame:
    """Age, height in cm and BMI of height and weight pairs."""
    pairs = pairs.withColumn(AGE, _age()).withColumn("H_VALUE", height_to_cm("VALUE1_CONDITION"))
    return pairs.withColumn("BMI", bmi_from_hw("W_VALUE", "H_VALUE"))


def split_height_weight(pairs: DataFrame, child: bool) -> DataFrame:
    """Adult pairs (18 and over), or child pairs (under 18, raw height in
    (0, 200])."""
    if not child:
        return pairs.filter(F.col(AGE) >= ADULT_YEARS)
    v = F.col("VALUE1_CONDITION")
    return pairs.filter((F.col(AGE) < ADULT_YEARS) & (v > 0) & (v <= 200))


def height_weight(height: DataFrame, weight: DataFrame, child: bool, distinct_partners: bool = False) -> DataFrame:
    """Same-day height and weight pairs of adults or children."""
    return split_height_weight(height_weight_pairs(height, weight, distinct_partners), child)


def adult_height_weight(height: DataFrame, weight: DataFrame, distinct_partners: bool = False,
                        pairs: DataFrame | None = None) -> DataFrame:
    hw = split_height_weight(pairs, False) if pairs is not None else height_weight(
        height, weight, child=False, distinct_partners=distinct_partners)
    return (hw.withColumn(CAT, band(computed_bmi_rules(), INDETERMINABLE_BMI))
            .filter(~F.col(CAT).isin(UNUSABLE_ADULT_CATEGORIES)))


def child_journals(bmi_journal: DataFrame) -> DataFrame:
    return bmi_journal.filter(_age() < ADULT_YEARS)


def child_centile_codes(bmi_journal: DataFrame) -> DataFrame:
    """Child centile codes and the category each states."""
    return (child_journals(bmi_journal).filter(F.col("BMI_CAT") == "CHILD")
            .withColumn(CAT, band(child_code_rules("CODE"), "IDEAL"))
            .withColumn(AGE, _age()))


def centile_score(df: DataFrame, lms: DataFrame, value: str) -> DataFrame:
    """``centile_z`` and its category ``CENTILE_CLINICAL_BMI_CAT``."""
    return centile_z(df, lms, value).withColumn("CENTILE_CLINICAL_BMI_CAT", band(zscore_rules(), Z_ERROR_LABEL))


def centile_z(df: DataFrame, lms: DataFrame, value: str) -> DataFrame:
    """Months of age, growth-reference L/M/S at the bracketing months,
    interpolated L/M/S and the z-score of ``value``."""
    out = df.withColumn("AGE_MONTHS", age_months("DATE", "DATE_OF_BIRTH"))
    out = out.withColumns(age_months_bracket("AGE_MONTHS"))
    out = lms_lookup(out, lms)
    out = out.withColumns(lms_interpolate("AGE_DIFF"))
    return out.withColumn("BMI_Z_SCORE", lms_zscore(value))


def child_bmi_centiles(bmi_journal: DataFrame, lms: DataFrame) -> DataFrame:
    """Child BMI values that need a centile, scored."""
    child = child_journals(bmi_journal).withColumn(CAT, band(child_bmi_rules(), INDETERMINABLE_BMI))
    need = child.filter(F.col(CAT) == "CENTILE").withColumn("BMI", F.col("VALUE1_CONDITION"))
    return centile_score(need, lms, "VALUE1_CONDITION").withColumn(AGE, _age())


def child_height_weight_centiles(height: DataFrame, weight: DataFrame, lms: DataFrame,
                                 distinct_partners: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    hw = split_height_weight(pairs, True) if pairs is not None else height_weight(
        height, weight, child=True, distinct_partners=distinct_partners)
    hw = hw.select("DATE_OF_BIRTH", "SEX", KEY, "ETHNIC", "PRACTICE", "GP_SYSTEM_SUPPLIER",
                   "REPORTING_PERIOD_END_DATE", "JOURNAL_REPORTING_PERIOD_END_DATE", "DATE",
                   "RECORD_DATE", AGE, "H_VALUE", "W_VALUE", "BMI")
    return centile_score(hw, lms, "BMI")


def tag_bmi_lists(journal: DataFrame, bmi_codes: DataFrame, height_codes: DataFrame,
                  weight_codes: DataFrame) -> DataFrame:
    """One pass over the journal for all three lists: rows get ``LIST``
    ('bmi', 'height' or 'weight') and ``BMI_CAT`` (BMI list only)."""
    lists = union_sources([
        bmi_codes.select("code", "BMI_CAT", F.lit("bmi").alias("LIST")),
        height_codes.select("code", F.lit(None).cast("string").alias("BMI_CAT"), F.lit("height").alias("LIST")),
        weight_codes.select("code", F.lit(None).cast("string").alias("BMI_CAT"), F.lit("weight").alias("LIST")),
    ], distinct=False)
    return tag_codes(journal, lists, tags=["BMI_CAT", "LIST"])


def day_statuses(tagged: DataFrame, lms: DataFrame) -> DataFrame:
    """Category positions (``_lo`` = ``_hi``) of the BMI rows and of the distinct height and weight pairs of each
    patient-day, from narrow rows."""
    lst, V1 = F.col("LIST"), F.col("VALUE1_CONDITION")
    value = V1.isNotNull()
    pairs = measured(day_pairs(tagged, (lst == "height") & value, (lst == "weight") & value,
                               {"VALUE1_CONDITION": V1, "DATE_OF_BIRTH": F.col("DATE_OF_BIRTH"), "SEX": F.col("SEX")}, {"W_VALUE": V1}))
    bmi_j = tagged.filter(lst == "bmi").withColumn(AGE, _age())
    adult, child = F.col(AGE) >= ADULT_YEARS, F.col(AGE) < ADULT_YEARS

    def status(df: DataFrame, rules: list, default: str | None = None) -> DataFrame:
        at = band_index(rules, BMI_CATEGORIES)
        at = F.coalesce(at, F.lit(BMI_CATEGORIES.index(default) + 1)) if default else at
        return df.withColumn("_lo", at).select(KEY, "DATE", "_lo", F.col("_lo").alias("_hi"))

    need = bmi_j.filter(child).withColumn(CAT, band(child_bmi_rules(), INDETERMINABLE_BMI)).filter(F.col(CAT) == "CENTILE")
    return reduce(DataFrame.unionByName, [
        status(pairs.filter(adult), computed_bmi_rules()),
        status(centile_z(split_height_weight(pairs, True), lms, "BMI"), zscore_rules()),
        status(bmi_j.filter(adult), adult_bmi_rules()),
        status(centile_z(need, lms, "VALUE1_CONDITION"), zscore_rules()),
        status(bmi_j.filter(child & (F.col("BMI_CAT") == "CHILD")), child_code_rules("CODE"), "IDEAL"),
    ])


def bmi(journal: DataFrame | None, bmi_codes: DataFrame | None, height_codes: DataFrame | None,
        weight_codes: DataFrame | None, lms: DataFrame, stage: bool = True,
        tagged: DataFrame | None = None) -> DataFrame:
    """Distinct 14-column rows on each patient's latest date, for patients
    whose rows on that date agree on ``BMI_CATEGORY``.

    The journal is scanned once for all three code lists.  Categories are
    found first on narrow rows (``day_statuses``); the wide rows of the
    surviving patient-days, one a patient, are then brought back and paired.
    ``stage`` stores the tagged rows (read for either step) and those of the
    surviving days (read by seven branches).  ``tagged``: rows already tagged
    with ``BMI_CAT`` and ``LIST`` (see ``plans.combined``).
    """
    require(journal if tagged is None else tagged, "bmi")
    if tagged is None:
        tagged = materialise(tag_bmi_lists(journal, bmi_codes, height_codes, weight_codes), stage)
    days = agreeing_days(day_statuses(tagged, lms), len(BMI_CATEGORIES))
    latest = materialise(bring_back(tagged, days, [KEY, "DATE"]), stage)
    lst = F.col("LIST")
    bmi_j = latest.filter(lst == "bmi").drop("LIST")
    height = latest.filter(lst == "height").drop("LIST", "BMI_CAT")
    weight = latest.filter(lst == "weight").drop("LIST", "BMI_CAT")
    known = F.col("CENTILE_CLINICAL_BMI_CAT").isin(KNOWN_CHILD_CATEGORIES)
    pairs = height_weight_pairs(height, weight, distinct_partners=True)

    def shape(df, bmi_col, cat_col, origin):
        return df.select(*[c for c in RESULT_COLUMNS[:11]], F.col(bmi_col).alias("BMI"),
                         F.col(cat_col).alias("BMI_CATEGORY"), F.lit(origin).alias("TABLE_ORIGIN"))

    parts = [
        shape(adult_coded(bmi_j), "VALUE1_CONDITION", CAT, "BMI (ADULT)"),
        shape(adult_height_weight(height, weight, pairs=pairs)
              .withColumn("_b", F.coalesce("BMI", "VALUE1_CONDITION")), "_b", CAT, "HW (ADULT)"),
        shape(child_height_weight_centiles(height, weight, lms, pairs=pairs).filter(known),
              "BMI", "CENTILE_CLINICAL_BMI_CAT", "HW (CHILD) CENTILE"),
        shape(child_bmi_centiles(bmi_j, lms).filter(known), "BMI", "CENTILE_CLINICAL_BMI_CAT",
              "CHILD BMI CENTILE"),
        shape(child_centile_codes(bmi_j).filter(F.col(CAT).isin(KNOWN_CHILD_CATEGORIES)),
              "VALUE1_CONDITION", CAT, "BMI - CENTILE"),
    ]
    return union_sources(parts)
