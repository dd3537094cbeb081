"""All four banded pipelines over one journal scan.

Run separately, smoking, blood glucose, blood pressure and BMI each scan the
journal to tag it with their lists.  ``banded_phenotypes`` tags it once with
every list (a ``DOMAIN`` column says which list matched; a code in two lists
yields one row per list), stages those rows partitioned by ``DOMAIN`` in the
checkpoint folder, and hands each pipeline its own partition, so the four
results cost one journal scan.  Results equal the separate runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import materialise
from ..operators.tagging import tag_codes
from ..operators.union import union_sources
from .blood_pressure import blood_pressure
from .body_mass import bmi
from .glucose import blood_glucose
from .smoking import smoking


def tags_of(codes: DataFrame) -> list[str]:
    """Description and tag columns of a list."""
    return [c for c in codes.columns if c not in ("code", "ix")]


def tag_all(journal: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Journal rows whose code is in any list, with ``DOMAIN`` and every
    list's columns (NULL where a list has no such column).  One broadcast join."""
    parts = [codes.select("code", *tags_of(codes), F.lit(name).alias("DOMAIN")) for name, codes in lists.items()]
    return tag_codes(journal, union_sources(parts, distinct=False))


def banded_phenotypes(journal: DataFrame, smoking_codes: DataFrame, glucose_codes: DataFrame,
                      bp_codes: DataFrame, bmi_codes: DataFrame, height_codes: DataFrame,
                      weight_codes: DataFrame, lms: DataFrame, stage: bool = True) -> dict[str, DataFrame]:
    """Results of the smoking, blood glucose, blood pressure and BMI
    pipelines, from one journal scan."""
    lists = {"smoking": smoking_codes, "glucose": glucose_codes, "bp": bp_codes, "bmi": bmi_codes,
             "height": height_codes, "weight": weight_codes}
    tagged = materialise(tag_all(journal, lists), stage, name="tagged", partition_by=["DOMAIN"])
    cols = list(journal.columns)

    def part(*domains: str, tags: list[str]) -> DataFrame:
        return tagged.filter(F.col("DOMAIN").isin(*domains)).select(*cols, *tags)

    bmi_rows = part("bmi", "height", "weight", tags=["BMI_CAT", "DOMAIN"]).withColumnRenamed("DOMAIN", "LIST")
    return {
        "smoking": smoking(None, None, stage=stage, tagged=part("smoking", tags=tags_of(smoking_codes))),
        "blood_glucose": blood_glucose(None, None, stage=stage, tagged=part("glucose", tags=tags_of(glucose_codes))),
        "blood_pressure": blood_pressure(None, None, stage=stage, tagged=part("bp", tags=tags_of(bp_codes))),
        "bmi": bmi(None, None, None, None, lms, stage=stage, tagged=bmi_rows),
    }
