"""Registered queries: every pipeline and every operator, run over the
synthetic inputs derived from a scale-factor directory.

Each query is ``(spark, sf_dir) -> DataFrame`` and reads the whole of the
test tables it derives from.  Results pass through ``portable`` (dates and
timestamps as ISO text, decimals as double) so that a value hash computed
on Spark's result and on the DuckDB oracle's agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.ages import age_by_year, age_months, age_months_bracket, age_years
from .functions.banding import (BP_INDETERMINABLE, GLUCOSE_INDETERMINABLE, INDETERMINABLE_BMI, band,
                                bp_text_rules, child_bmi_rules, child_code_rules, computed_bmi_rules,
                                adult_bmi_rules)
from .functions.measures import height_to_cm, lms_interpolate
from .operators.hospital import catalog_shard_years, join_halves, latest_shards, read_catalog_shards
from .operators.lms import lms_lookup
from .operators.pairing import pair_same_day
from .operators.selection import (best_priority, dedupe_observations, drop_conflicts, drop_indeterminable,
                                  drop_unknown_codes, keep_living, latest_per_patient,
                                  modal_category)
from .operators.staging import materialise, new_folder
from .operators.tagging import label_category, tag_codes
from .operators.union import union_sources
from .plans import body_mass as bmi_plan
from .plans import ethnicity as eth
from .plans.blood_pressure import blood_pressure, numeric_readings, text_readings
from .plans.glucose import blood_glucose, fasting_matched, fasting_status, non_fasting_status
from .plans.smoking import categorise_smoking, smoking
from .schemas import normalise_journal
from .sources import fixtures
from .sources.codelists import codelist_df, codelist_path, read_codelist
from .sources.shards import write_bucketed

KEY = "PATIENT_ID"


def portable(df: DataFrame) -> DataFrame:
    """Dates -> 'YYYY-MM-DD', timestamps -> 'YYYY-MM-DD HH:MM:SS.ffffff',
    decimals and integers -> double (exact for these values; pandas would
    otherwise turn a nullable integer column into float64 on one engine and
    a nullable Int32 on the other); other columns unchanged."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.DecimalType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------

def _journal(spark, sf, domains=None):
    return fixtures.journal(spark, sf, domains)


def _codes(spark, name):
    return codelist_df(spark, name)


def _hospital(spark, sf):
    return {eth.ADMITTED: fixtures.hospital_halves(spark, sf, "admitted"),
            eth.EMERGENCY: fixtures.hospital_halves(spark, sf, "emergency"),
            eth.OUTPATIENT: fixtures.hospital_halves(spark, sf, "outpatient")}


def _bmi_inputs(spark, sf):
    j = _journal(spark, sf)
    return (tag_codes(j, _codes(spark, "bmi"), tags=["BMI_CAT"]),
            tag_codes(j, _codes(spark, "height"), tags=[]),
            tag_codes(j, _codes(spark, "weight"), tags=[]),
            fixtures.lms_table(spark))


# ---------------------------------------------------------------------------
# Pipelines
# ---------------------------------------------------------------------------

def q_smoking(spark, sf):
    return smoking(_journal(spark, sf), _codes(spark, "smoking"))


def q_blood_glucose(spark, sf):
    return blood_glucose(_journal(spark, sf), _codes(spark, "glucose"))


def q_blood_pressure(spark, sf):
    return blood_pressure(_journal(spark, sf), _codes(spark, "bp"))


def q_bmi(spark, sf):
    return bmi_plan.bmi(_journal(spark, sf), _codes(spark, "bmi"), _codes(spark, "height"),
                        _codes(spark, "weight"), fixtures.lms_table(spark))


def q_ethnicity_recent_primary(spark, sf):
    return eth.ethnicity_recent_primary(_journal(spark, sf), _codes(spark, "ethnicity"))


def q_ethnicity_recent_all(spark, sf):
    return eth.ethnicity_recent_all(_journal(spark, sf), _codes(spark, "ethnicity"), _hospital(spark, sf))


def q_ethnicity_modal(spark, sf):
    return eth.ethnicity_modal(_journal(spark, sf), _codes(spark, "ethnicity"), _hospital(spark, sf))


def q_ethnicity_modal_living(spark, sf):
    return eth.ethnicity_modal(_journal(spark, sf), _codes(spark, "ethnicity"), _hospital(spark, sf),
                               living_only=True)


# ---------------------------------------------------------------------------
# Operators
# ---------------------------------------------------------------------------

def q_tag_codes(spark, sf):
    out = tag_codes(_journal(spark, sf), _codes(spark, "bp"))
    return out.select(KEY, "DATE", "CODE", "VALUE1_CONDITION", "VALUE2_CONDITION", "LINKS",
                      "INITIAL_BREAKDOWN", "TYPE_OF_JOURNAL")


def q_read_codelist(spark, sf):
    """Journal rows for each line of a code list read from its file; lines that the list repeats count again."""
    codes = read_codelist(spark, f"file://{codelist_path('smoking')}", key="SNOMED_concept_ID")
    tagged = tag_codes(_journal(spark, sf), codes)
    return tagged.groupBy("CODE", "Code_description", "CATEGORY").agg(F.count(F.lit(1)).alias("N_ROWS"))


def q_age_years(spark, sf):
    j = _journal(spark, sf)
    return j.select("LINKS", "DATE", "DATE_OF_BIRTH",
                    age_years("DATE", "DATE_OF_BIRTH").alias("AGE_YEARS"),
                    age_years("DATE", "DATE_OF_BIRTH", whole=True).alias("AGE_WHOLE_YEARS"))


def q_age_by_year(spark, sf):
    j = _journal(spark, sf)
    return j.select("LINKS", "DATE", "YEAR_OF_BIRTH", age_by_year("DATE", "YEAR_OF_BIRTH").alias("AGE_BY_YEAR"))


def q_age_months_bracket(spark, sf):
    j = _journal(spark, sf).filter(age_years("DATE", "DATE_OF_BIRTH") < 18)
    j = j.withColumn("AGE_MONTHS", age_months("DATE", "DATE_OF_BIRTH"))
    return j.select("LINKS", "AGE_MONTHS", *[v.alias(k) for k, v in age_months_bracket("AGE_MONTHS").items()])


def q_band_bmi_adult(spark, sf):
    b, _, _, _ = _bmi_inputs(spark, sf)
    return b.select("LINKS", "BMI_CAT", "VALUE1_CONDITION",
                    band(adult_bmi_rules(), INDETERMINABLE_BMI).alias("BMI_CATEGORISED_INITIAL"))


def q_band_bmi_child(spark, sf):
    b, _, _, _ = _bmi_inputs(spark, sf)
    return b.select("LINKS", "BMI_CAT", "VALUE1_CONDITION",
                    band(child_bmi_rules(), INDETERMINABLE_BMI).alias("BMI_CATEGORISED_INITIAL"))


def q_band_child_codes(spark, sf):
    b, _, _, _ = _bmi_inputs(spark, sf)
    return b.filter(F.col("BMI_CAT") == "CHILD").select(
        "LINKS", "CODE", band(child_code_rules("CODE"), "IDEAL").alias("BMI_CATEGORISED_INITIAL"))


def q_band_bp_values(spark, sf):
    num = numeric_readings(tag_codes(_journal(spark, sf), _codes(spark, "bp")))
    return num.select(KEY, "DATE", "LINKS", "VALUE1_CONDITION", "VALUE2_CONDITION", "FINAL_BP_CATS")


def q_band_bp_text(spark, sf):
    t = tag_codes(_journal(spark, sf), _codes(spark, "bp"))
    sys_ = t.filter((F.col("INITIAL_BREAKDOWN") == "SBP") & F.col("VALUE1_CONDITION").isNull()).select(
        "LINKS", "TYPE_OF_JOURNAL", band(bp_text_rules("Systolic"), BP_INDETERMINABLE).alias("TEXT_CATS"))
    dia = t.filter((F.col("INITIAL_BREAKDOWN") == "DBP") & F.col("VALUE1_CONDITION").isNull()).select(
        "LINKS", "TYPE_OF_JOURNAL", band(bp_text_rules("Diastolic"), BP_INDETERMINABLE).alias("TEXT_CATS"))
    return sys_.unionByName(dia)


def q_band_bp_combined(spark, sf):
    txt = text_readings(tag_codes(_journal(spark, sf), _codes(spark, "bp")))
    return txt.select(KEY, "DATE", "LINKS", "INITIAL_BREAKDOWN", "SBP_CATS", "DBP_CATS", "FINAL_BP_CATS")


def q_band_glucose(spark, sf):
    nf = non_fasting_status(tag_codes(_journal(spark, sf), _codes(spark, "glucose")))
    return nf.select("LINKS", "TYPE_OF_BLOOD_GLUCOSE_RECORD", "FASTING_STATUS", "VALUE1_CONDITION",
                     "CATEGORISED_BLOOD_GLUCOSE")


def q_band_glucose_fasting(spark, sf):
    fs = fasting_status(tag_codes(_journal(spark, sf), _codes(spark, "glucose")))
    return fs.select("LINKS", "VALUE1_CONDITION", "VALUE2_CONDITION", "CATEGORISED_BLOOD_GLUCOSE")


def q_band_smoking(spark, sf):
    c = categorise_smoking(_journal(spark, sf), _codes(spark, "smoking"))
    return c.select("LINKS", "CODE", "CATEGORY", "VALUE1_CONDITION", "SMOKING_CATS", "DATA_DICTIONARY_CATS")


def q_pair_same_day_inner(spark, sf):
    t = tag_codes(_journal(spark, sf), _codes(spark, "bp"))
    v = F.col("VALUE1_CONDITION").isNotNull()
    p = pair_same_day(t.filter((F.col("INITIAL_BREAKDOWN") == "SBP") & v),
                      t.filter((F.col("INITIAL_BREAKDOWN") == "DBP") & v),
                      {"VALUE1_CONDITION": "VALUE2_CONDITION", "LINKS": "PARTNER_LINKS"})
    return p.select(KEY, "DATE", "LINKS", "PARTNER_LINKS", "VALUE1_CONDITION", "VALUE2_CONDITION")


def q_pair_same_day_left(spark, sf):
    m = fasting_matched(tag_codes(_journal(spark, sf), _codes(spark, "glucose")))
    return m.select(KEY, "DATE", "LINKS", "VALUE1_CONDITION", "VALUE2_CONDITION")


def q_height_to_cm(spark, sf):
    _, h, _, _ = _bmi_inputs(spark, sf)
    return h.select("LINKS", "VALUE1_CONDITION", height_to_cm("VALUE1_CONDITION").alias("H_VALUE"))


def q_bmi_from_hw(spark, sf):
    _, h, w, _ = _bmi_inputs(spark, sf)
    hw = bmi_plan.height_weight(h, w, child=False)
    return hw.select("LINKS", "W_LINKS", "H_VALUE", "W_VALUE", "BMI",
                     band(computed_bmi_rules(), INDETERMINABLE_BMI).alias("BMI_CATEGORISED_INITIAL"))


def _child_centile_rows(spark, sf):
    b, _, _, lms = _bmi_inputs(spark, sf)
    child = bmi_plan.child_journals(b).withColumn(
        "BMI_CATEGORISED_INITIAL", band(child_bmi_rules(), INDETERMINABLE_BMI))
    need = child.filter(F.col("BMI_CATEGORISED_INITIAL") == "CENTILE")
    need = need.withColumn("AGE_MONTHS", age_months("DATE", "DATE_OF_BIRTH")).withColumns(
        age_months_bracket("AGE_MONTHS"))
    return lms_lookup(need, lms)


def q_lms_lookup(spark, sf):
    return _child_centile_rows(spark, sf).select(
        "LINKS", "SEX", "AGE_LOWER", "AGE_UPPER", "L_LOW", "M_LOW", "S_LOW", "L_HIGH", "M_HIGH", "S_HIGH")


def q_lms_interpolate(spark, sf):
    out = _child_centile_rows(spark, sf).withColumns(lms_interpolate("AGE_DIFF"))
    return out.select("LINKS", "AGE_DIFF", "L_TO_USE", "M_TO_USE", "S_TO_USE")


def q_lms_zscore(spark, sf):
    out = bmi_plan.centile_score(
        bmi_plan.child_journals(_bmi_inputs(spark, sf)[0]).withColumn(
            "BMI_CATEGORISED_INITIAL", band(child_bmi_rules(), INDETERMINABLE_BMI))
        .filter(F.col("BMI_CATEGORISED_INITIAL") == "CENTILE"),
        fixtures.lms_table(spark), "VALUE1_CONDITION")
    return out.select("LINKS", "VALUE1_CONDITION", F.round("BMI_Z_SCORE", 6).alias("BMI_Z_SCORE"),
                      "CENTILE_CLINICAL_BMI_CAT")


def q_drop_indeterminable(spark, sf):
    c = categorise_smoking(_journal(spark, sf), _codes(spark, "smoking"))
    return drop_indeterminable(c, "DATA_DICTIONARY_CATS", ["Indeterminable"]).select(
        "LINKS", "CODE", "DATA_DICTIONARY_CATS")


def q_union_sources(spark, sf):
    t = tag_codes(_journal(spark, sf), _codes(spark, "bp"))
    cols = [KEY, "DATE", "CODE", "VALUE1_CONDITION", "VALUE2_CONDITION", "SBP_CATS", "DBP_CATS", "FINAL_BP_CATS"]
    num = numeric_readings(t)
    txt = text_readings(t)
    return union_sources([num.filter(F.col("FINAL_BP_CATS") != BP_INDETERMINABLE),
                          txt.filter(F.col("FINAL_BP_CATS") != BP_INDETERMINABLE)], columns=cols)


def _glucose_status(spark, sf):
    t = tag_codes(_journal(spark, sf), _codes(spark, "glucose"))
    known = [s.filter(F.col("CATEGORISED_BLOOD_GLUCOSE") != GLUCOSE_INDETERMINABLE)
             for s in (non_fasting_status(t), fasting_status(t))]
    return union_sources(known, distinct=False)


def q_latest_per_patient(spark, sf):
    out = latest_per_patient(materialise(_glucose_status(spark, sf)), KEY, "DATE", salted=True)
    return out.select(KEY, "DATE", "LINKS", "CATEGORISED_BLOOD_GLUCOSE")


def q_drop_conflicts(spark, sf):
    """Latest rows, then conflict removal, as two separate operators."""
    c = categorise_smoking(_journal(spark, sf), _codes(spark, "smoking"))
    known = drop_indeterminable(c, "DATA_DICTIONARY_CATS", ["Indeterminable"])
    out = drop_conflicts(latest_per_patient(known, KEY, "DATE"), KEY, "DATA_DICTIONARY_CATS")
    return out.select(KEY, "DATE", "LINKS", "CODE", "DATA_DICTIONARY_CATS")


def q_dedupe_observations(spark, sf):
    je = eth.journal_ethnicity(_journal(spark, sf), _codes(spark, "ethnicity"))
    return dedupe_observations(je, KEY, "RECORD_DATE", "ETHNICITY", source_cat="PrimaryCode")


def q_best_priority(spark, sf):
    j = _journal(spark, sf)
    codes = _codes(spark, "ethnicity")
    jg = dedupe_observations(eth.journal_ethnicity(j, codes), KEY, "RECORD_DATE", "ETHNICITY", "PrimaryCode")
    pg = dedupe_observations(eth.patient_ethnicity(j), KEY, "REPORTING_PERIOD_END_DATE", "ETHNICITY", "ETHNIC")
    js = latest_per_patient(jg, KEY, "RECORD_DATE").select(
        KEY, "ETHNICITY", F.col("RECORD_DATE").alias("RECORDED_DATE"),
        F.lit(eth.RECENT_LABELS[eth.JOURNAL]).alias("SOURCE"), F.lit(1).alias("PRIORITY"))
    ps = latest_per_patient(pg, KEY, "REPORTING_PERIOD_END_DATE").select(
        KEY, "ETHNICITY", F.col("REPORTING_PERIOD_END_DATE").alias("RECORDED_DATE"),
        F.lit(eth.RECENT_LABELS[eth.PATIENT]).alias("SOURCE"), F.lit(2).alias("PRIORITY"))
    recent = latest_per_patient(union_sources([js, ps]), KEY, "RECORDED_DATE")
    return best_priority(recent, KEY, "PRIORITY")


def q_modal_category(spark, sf):
    je = eth.journal_ethnicity(_journal(spark, sf), _codes(spark, "ethnicity"))
    return modal_category(je.select(KEY, F.col("PrimaryCode").alias("ETHNICITY")), KEY, "ETHNICITY")


def q_keep_living(spark, sf):
    j = _journal(spark, sf)
    bp_patients = tag_codes(j, _codes(spark, "bp")).select(KEY).filter(F.col(KEY).isNotNull()).distinct()
    return keep_living(bp_patients, j)


def q_drop_unknown_codes(spark, sf):
    parts = [fixtures.hospital_halves(spark, sf, d)[1] for d in fixtures.HOSPITAL_DATASETS]
    allc = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return drop_unknown_codes(allc, "ETHNIC_CODE").select("EPISODE_KEY", "ETHNIC_CODE")


def q_join_halves(spark, sf):
    """All three datasets, each joined by itself."""
    parts = [join_halves(*fixtures.hospital_halves(spark, sf, d)).withColumn("DATASET", F.lit(d)) for d in fixtures.HOSPITAL_DATASETS]
    return union_sources(parts, distinct=False)


def q_latest_shards(spark, sf):
    """Both halves of all three datasets, stored in folders partitioned by year, each cut to its own newest years."""
    folder = new_folder(spark.range(0), "partitions")
    parts = []
    for d in fixtures.HOSPITAL_DATASETS:
        for half, shards in zip(("identifying", "clinical"), fixtures.hospital_partitions(spark, sf, d, folder)):
            parts.append(latest_shards(shards, n=6).select("EPISODE_KEY", "YEAR", F.lit(d).alias("DATASET"), F.lit(half).alias("HALF")))
    return union_sources(parts, distinct=False)


def q_bucketed_halves(spark, sf):
    """All three datasets, each half stored in buckets of (year, key), joined without a shuffle."""
    database, folder = f"phenoframe_{uuid.uuid4().hex}", new_folder(spark.range(0), "buckets")
    spark.sql(f"CREATE DATABASE {database}")
    try:
        parts = []
        for d in fixtures.HOSPITAL_DATASETS:
            halves = []
            for name, half in zip(("identifying", "clinical"), fixtures.hospital_halves(spark, sf, d)):
                table = write_bucketed(half, f"{database}.{d}_{name}", 8, path=f"{folder}/{d}-{name}")
                halves.append(table.read(table.years()))
            parts.append(join_halves(*halves).withColumn("DATASET", F.lit(d)))
        return union_sources(parts, distinct=False)
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def _year_tables(spark, sf, read):
    """Result of ``read(dataset, identifying, clinical)`` over the yearly tables of each dataset.  The tables leave the
    catalog at once (the result's plan knows their files), the files with the stages."""
    name = f"phenoframe_{uuid.uuid4().hex}"
    databases, folder = (f"{name}_sensitive", name), new_folder(spark.range(0), "year-tables")
    for database in databases:
        spark.sql(f"CREATE DATABASE {database}")
    try:
        parts = [read(d, *fixtures.year_tables(spark, sf, d, databases, folder)).withColumn("DATASET", F.lit(d)) for d in fixtures.HOSPITAL_DATASETS]
        return union_sources(parts, distinct=False)
    finally:
        for database in databases:
            spark.sql(f"DROP DATABASE {database} CASCADE")


def q_catalog_shards(spark, sf):
    """Yearly shard tables in the catalog: found by name per dataset, and the
    distinct rows of the newest six read back, their columns by the published names."""
    def read(_, ident, clinical):
        years = catalog_shard_years(spark, clinical.database, 6, clinical.kind)
        rows = read_catalog_shards(spark, clinical.database, clinical.kind, years, clinical.prefix, clinical.columns)
        return rows.select("EVENT_DATE", "ETHNIC_CODE", "YEAR").distinct()

    return _year_tables(spark, sf, read)


def q_catalog_episodes(spark, sf):
    """Distinct episodes with a known category, from the yearly tables of both halves, by their published names."""
    return _year_tables(spark, sf, lambda _, ident, clinical: eth.hospital_ethnicity(ident, clinical, 6).select(
        KEY, "EVENT_DATE", "ETHNIC_CODE", "YEAR").distinct())


def q_journal_by_name(spark, sf):
    """Blood pressure from a journal that is read by its name in the catalog."""
    database, folder = f"phenoframe_{uuid.uuid4().hex}", new_folder(spark.range(0), "journal")
    spark.sql(f"CREATE DATABASE {database}")
    try:
        _journal(spark, sf).write.option("path", folder).saveAsTable(f"{database}.journal")
        return blood_pressure(normalise_journal(spark.table(f"{database}.journal")), _codes(spark, "bp"))
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def q_fallback_source(spark, sf):
    j = _journal(spark, sf)
    return eth.ethnicity_with_fallback(j, _codes(spark, "ethnicity"), _hospital(spark, sf))


def q_label_category(spark, sf):
    modal = q_ethnicity_modal(spark, sf)
    return label_category(modal, _codes(spark, "ethnic_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # pipelines
    "smoking": q_smoking,
    "blood_glucose": q_blood_glucose,
    "blood_pressure": q_blood_pressure,
    "bmi": q_bmi,
    "ethnicity_recent_primary": q_ethnicity_recent_primary,
    "ethnicity_recent_all": q_ethnicity_recent_all,
    "ethnicity_modal": q_ethnicity_modal,
    "ethnicity_modal_living": q_ethnicity_modal_living,
    # operators
    "tag_codes": q_tag_codes,
    "read_codelist": q_read_codelist,
    "age_years": q_age_years,
    "age_by_year": q_age_by_year,
    "age_months_bracket": q_age_months_bracket,
    "band_bmi_adult": q_band_bmi_adult,
    "band_bmi_child": q_band_bmi_child,
    "band_child_codes": q_band_child_codes,
    "band_bp_values": q_band_bp_values,
    "band_bp_text": q_band_bp_text,
    "band_bp_combined": q_band_bp_combined,
    "band_glucose": q_band_glucose,
    "band_glucose_fasting": q_band_glucose_fasting,
    "band_smoking": q_band_smoking,
    "pair_same_day_inner": q_pair_same_day_inner,
    "pair_same_day_left": q_pair_same_day_left,
    "height_to_cm": q_height_to_cm,
    "bmi_from_hw": q_bmi_from_hw,
    "lms_lookup": q_lms_lookup,
    "lms_interpolate": q_lms_interpolate,
    "lms_zscore": q_lms_zscore,
    "drop_indeterminable": q_drop_indeterminable,
    "union_sources": q_union_sources,
    "latest_per_patient": q_latest_per_patient,
    "dedupe_observations": q_dedupe_observations,
    "best_priority": q_best_priority,
    "drop_conflicts": q_drop_conflicts,
    "modal_category": q_modal_category,
    "keep_living": q_keep_living,
    "drop_unknown_codes": q_drop_unknown_codes,
    "join_halves": q_join_halves,
    "bucketed_halves": q_bucketed_halves,
    "latest_shards": q_latest_shards,
    "catalog_shards": q_catalog_shards,
    "catalog_episodes": q_catalog_episodes,
    "journal_by_name": q_journal_by_name,
    "fallback_source": q_fallback_source,
    "label_category": q_label_category,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda f: (lambda spark, sf: portable(f(spark, sf))))(fn) for name, fn in QUERIES.items()}
