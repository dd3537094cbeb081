"""The journal schema and the adapter that brings a journal to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "PATIENT_ID"

JOURNAL_SCHEMA = T.StructType([
    T.StructField("DATE_OF_BIRTH", T.DateType()),
    T.StructField("YEAR_OF_BIRTH", T.IntegerType()),
    T.StructField("SEX", T.IntegerType()),
    T.StructField("LSOA", T.StringType()),
    T.StructField("DATE_OF_DEATH", T.DateType()),
    T.StructField("YEAR_OF_DEATH", T.IntegerType()),
    T.StructField(KEY, T.StringType()),
    T.StructField("ETHNIC", T.StringType()),
    T.StructField("PRACTICE", T.StringType()),
    T.StructField("GP_SYSTEM_SUPPLIER", T.StringType()),
    T.StructField("PROCESSED_TIMESTAMP", T.TimestampNTZType()),
    T.StructField("REPORTING_PERIOD_END_DATE", T.DateType()),
    T.StructField("JOURNAL_REPORTING_PERIOD_END_DATE", T.DateType()),
    T.StructField("DATE", T.DateType()),
    T.StructField("RECORD_DATE", T.DateType()),
    T.StructField("CODE", T.StringType()),
    T.StructField("SENSITIVE_CODE", T.StringType()),
    T.StructField("EPISODE_CONDITION", T.StringType()),
    T.StructField("EPISODE_PRESCRIPTION", T.StringType()),
    T.StructField("VALUE1_CONDITION", T.DoubleType()),
    T.StructField("VALUE2_CONDITION", T.DoubleType()),
    T.StructField("VALUE1_PRESCRIPTION", T.DoubleType()),
    T.StructField("VALUE2_PRESCRIPTION", T.DoubleType()),
    T.StructField("LINKS", T.StringType()),
])

# Columns the pipelines read; the rest are carried through.
REQUIRED = [KEY, "PRACTICE", "REPORTING_PERIOD_END_DATE", "JOURNAL_REPORTING_PERIOD_END_DATE",
            "DATE", "RECORD_DATE", "CODE", "VALUE1_CONDITION", "VALUE2_CONDITION"]


# What each pipeline needs besides; without it the result would be empty or wrong, so the pipeline raises.
NEEDED = {"smoking": ["DATE_OF_BIRTH"], "blood_glucose": [], "blood_pressure": ["YEAR_OF_BIRTH"],
          "bmi": ["DATE_OF_BIRTH", "SEX", "ETHNIC"], "ethnicity": ["ETHNIC"]}
ABSENT = {"absent": True}


def require(journal: DataFrame, pipeline: str) -> None:
    """Raise when a journal lacks a column that the pipeline needs."""
    have = {f.name for f in journal.schema.fields if not f.metadata.get("absent")}
    missing = [c for c in NEEDED[pipeline] if c not in have]
    if missing:
        raise ValueError(f"{pipeline} needs columns that the journal lacks: {missing}")


def normalise_journal(df: DataFrame, id_col: str = KEY) -> DataFrame:
    """Bring a journal to the canonical column names and types.

    * ``id_col`` (the patient identifier, whatever it is called) becomes
      ``PATIENT_ID``;
    * ``YEAR_OF_BIRTH`` / ``YEAR_OF_DEATH`` are derived from the dates when
      only the dates exist (never the other way round: a year does not give
      a date of birth);
    * missing columns are added as NULL (``require`` tells them from columns
      that the journal has), known columns are cast to
      the canonical type (``CODE`` is a string: codes have up to 16 digits).
    """
    if id_col != KEY:
        df = df.withColumnRenamed(id_col, KEY)
    cols = set(df.columns)
    missing = [c for c in REQUIRED if c not in cols]
    if missing:
        raise ValueError(f"journal lacks required columns: {missing}")
    if "YEAR_OF_BIRTH" not in cols and "DATE_OF_BIRTH" in cols:
        df = df.withColumn("YEAR_OF_BIRTH", F.year("DATE_OF_BIRTH"))
    if "YEAR_OF_DEATH" not in cols and "DATE_OF_DEATH" in cols:
        df = df.withColumn("YEAR_OF_DEATH", F.year("DATE_OF_DEATH"))
    if isinstance(df.schema["CODE"].dataType, (T.FloatType, T.DoubleType)):
        # A double prints as 1.23E14; go through an integral decimal for digits.
        df = df.withColumn("CODE", F.col("CODE").cast("decimal(38,0)"))
    out = []
    for f in JOURNAL_SCHEMA.fields:
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            # Marked, so that a pipeline that needs it can tell it from a column of NULLs.
            out.append(F.lit(None).cast(f.dataType).alias(f.name, metadata=ABSENT))
    extra = [c for c in df.columns if c not in JOURNAL_SCHEMA.fieldNames()]
    return df.select(*out, *extra)
