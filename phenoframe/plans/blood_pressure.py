"""Most recent blood-pressure status per patient.

Readings come as a systolic and a diastolic value recorded the same day, a
single code carrying both values, a finding code stating a level for the
whole reading, or a systolic and a diastolic finding code on the same day.

Deliberate difference: text statuses of paired findings are kept in their own
columns (``SBP_CATS``, ``DBP_CATS``) instead of being written into the
numeric value columns, so ``VALUE1_CONDITION`` / ``VALUE2_CONDITION`` stay
numeric; all unions are by column name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ages import age_by_year
from ..functions.banding import (BP_BREAKS, BP_CATEGORIES, BP_INDETERMINABLE, BP_LEVELS, band, bp_combined_rules, bp_label,
                                 bp_text_rules, bp_value_rules)
from ..operators.day_classes import (Table, agreeing_days, band_index, bit, extremes, inner_values, known_keys, pair_table,
                                     piece, shifted)
from ..operators.heavy import bring_back
from ..operators.pairing import PAIR_KEYS, pair_same_day
from ..operators.selection import KEY
from ..operators.staging import materialise
from ..operators.tagging import tag_codes
from ..operators.union import union_sources
from ..schemas import require

CAT = "FINAL_BP_CATS"


def _cols():
    return F.col("VALUE1_CONDITION"), F.col("VALUE2_CONDITION"), F.col("INITIAL_BREAKDOWN")


def numeric_readings(tagged: DataFrame, distinct_partners: bool = False) -> DataFrame:
    """Same-day systolic/diastolic value pairs plus two-value codes, banded."""
    V1, V2, PART = _cols()
    sbp = tagged.filter((PART == "SBP") & V1.isNotNull())
    dbp = tagged.filter((PART == "DBP") & V1.isNotNull())
    paired = pair_same_day(sbp, dbp, {"VALUE1_CONDITION": "VALUE2_CONDITION",
                                      "VALUE1_PRESCRIPTION": "VALUE2_PRESCRIPTION"},
                           distinct_partners=distinct_partners)
    two_value = tagged.filter((PART == "ALL") & V1.isNotNull() & V2.isNotNull())
    return (union_sources([paired, two_value], distinct=False)
            .withColumn(CAT, band(bp_value_rules(), BP_INDETERMINABLE)))


def text_readings(tagged: DataFrame, distinct_partners: bool = False) -> DataFrame:
    """Whole-reading finding codes plus same-day systolic/diastolic finding
    pairs, combined into one level."""
    V1, V2, PART = _cols()
    sbp = (tagged.filter((PART == "SBP") & V1.isNull())
           .withColumn("SBP_CATS", band(bp_text_rules("Systolic"), BP_INDETERMINABLE)))
    dbp = (tagged.filter((PART == "DBP") & V1.isNull())
           .withColumn("DBP_CATS", band(bp_text_rules("Diastolic"), BP_INDETERMINABLE)))
    pairs = pair_same_day(sbp, dbp, {"VALUE1_CONDITION": "VALUE2_CONDITION",
                                     "VALUE1_PRESCRIPTION": "VALUE2_PRESCRIPTION",
                                     "DBP_CATS": "DBP_CATS"},
                          distinct_partners=distinct_partners)
    whole = tagged.filter((PART == "ALL") & V1.isNull() & V2.isNull())
    return (union_sources([whole, pairs], distinct=False)
            .withColumn(CAT, band(bp_combined_rules(), BP_INDETERMINABLE)))


def readings(tagged: DataFrame, distinct_partners: bool = False) -> tuple[DataFrame, DataFrame]:
    """(numeric, text) readings with one systolic x diastolic join.

    Value pairs (both values present) and text pairs (both absent) come from
    the same two sides with complementary filters, so they are produced by
    one same-day join whose keys include "has a value"; the pipeline then
    shuffles the systolic and diastolic rows once instead of twice.
    """
    V1, V2, PART = _cols()
    no_value = V1.isNull().alias("_no_value")
    sbp = (tagged.filter(PART == "SBP").withColumn("_no_value", no_value)
           .withColumn("SBP_CATS", band(bp_text_rules("Systolic"), BP_INDETERMINABLE)))
    dbp = (tagged.filter(PART == "DBP").withColumn("_no_value", no_value)
           .withColumn("DBP_CATS", band(bp_text_rules("Diastolic"), BP_INDETERMINABLE)))
    keys = PAIR_KEYS + ["_no_value"]
    pairs = pair_same_day(sbp, dbp, {"VALUE1_CONDITION": "VALUE2_CONDITION",
                                     "VALUE1_PRESCRIPTION": "VALUE2_PRESCRIPTION", "DBP_CATS": "DBP_CATS"},
                          keys=keys, distinct_partners=distinct_partners)
    none = F.lit(None).cast("string")
    value_pairs = pairs.filter(~F.col("_no_value")).withColumn("SBP_CATS", none).withColumn("DBP_CATS", none)
    two_value = tagged.filter((PART == "ALL") & V1.isNotNull() & V2.isNotNull())
    numeric = (union_sources([value_pairs.drop("_no_value"), two_value], distinct=False)
               .withColumn(CAT, band(bp_value_rules(), BP_INDETERMINABLE)))
    whole = tagged.filter((PART == "ALL") & V1.isNull() & V2.isNull())
    text = (union_sources([whole, pairs.filter(F.col("_no_value")).drop("_no_value")], distinct=False)
            .withColumn(CAT, band(bp_combined_rules(), BP_INDETERMINABLE)))
    return numeric, text


def _tables(spark: SparkSession) -> Table:
    """Categories of pairs: of values by their pieces, of findings by their levels, in one table."""
    values = pair_table(spark, bp_value_rules(), BP_CATEGORIES, *map(inner_values, BP_BREAKS), ("VALUE1_CONDITION", "VALUE2_CONDITION"), "DOUBLE")
    parts = [[bp_label(level, part) for level in BP_LEVELS] for part in ("Systolic", "Diastolic")]
    findings = bp_combined_rules(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    texts = pair_table(spark, findings, BP_CATEGORIES, *parts, ("SBP_CATS", "DBP_CATS"), "STRING")
    return values | shifted(texts, FINDING_BITS, FINDING_BITS)


#: First bit of the findings' levels in a side's mask, above the pieces of values.
FINDING_BITS = 16


def day_statuses(tagged: DataFrame) -> DataFrame:
    """Least and greatest status position of each patient-day, by one aggregation on the pairing keys.

    A side's readings of a day become a mask: the pieces of its values and
    the levels of its findings; values pair with values and findings with findings."""
    V1, V2, PART = _cols()

    def mask(side: str, part: str, breaks: list) -> Column:
        level = band_index(bp_text_rules(part), [bp_label(lvl, part) for lvl in BP_LEVELS]) + F.lit(FINDING_BITS - 1)
        own = F.when(V1.isNotNull(), piece(V1, breaks)).otherwise(level)
        return F.bit_or(F.when((PART == side) & known_keys(PAIR_KEYS), bit(own)))

    both = V1.isNotNull() & V2.isNotNull()
    none = F.lit(None).cast("string")
    whole = F.when(PART == "ALL", F.when(both, band_index(bp_value_rules(), BP_CATEGORIES))
                   .when(V1.isNull() & V2.isNull(), band_index(bp_combined_rules(sbp=none, dbp=none), BP_CATEGORIES)))
    days = tagged.withColumn("_whole", whole).groupBy(*PAIR_KEYS).agg(
        mask("SBP", "Systolic", BP_BREAKS[0]).alias("_s"), mask("DBP", "Diastolic", BP_BREAKS[1]).alias("_d"),
        F.min("_whole").alias("_least"), F.max("_whole").alias("_most"))
    low, high = extremes(_tables(tagged.sparkSession), F.col("_s"), F.col("_d"))
    return days.select(KEY, "DATE", F.least("_least", low).alias("_lo"), F.greatest("_most", high).alias("_hi"))


def blood_pressure(journal: DataFrame | None, codes: DataFrame | None, stage: bool = True,
                   tagged: DataFrame | None = None) -> DataFrame:
    """Distinct rows on each patient's latest date with a known status, for
    patients whose rows on that date agree, with the age by calendar year.

    Statuses are found first on narrow rows (``day_statuses``); the wide rows
    of the surviving patient-days, one a patient, are then brought back and
    paired.  ``stage`` stores the tagged rows (read for either step) and
    those of the surviving days (read by four branches)."""
    require(journal if tagged is None else tagged, "blood_pressure")
    # ``tagged``: rows already tagged with this list (see plans.combined).
    tagged = materialise(tag_codes(journal, codes), stage) if tagged is None else tagged
    days = agreeing_days(day_statuses(tagged), len(BP_CATEGORIES))
    latest = materialise(bring_back(tagged, days, [KEY, "DATE"]), stage)
    num, txt = readings(latest, distinct_partners=True)
    cols = list(tagged.columns) + ["SBP_CATS", "DBP_CATS", CAT]
    status = union_sources([num.filter(F.col(CAT) != BP_INDETERMINABLE),
                            txt.filter(F.col(CAT) != BP_INDETERMINABLE)], columns=cols)
    return status.withColumn("AGE_AT_TIME_OF_JOURNAL", age_by_year("DATE", "YEAR_OF_BIRTH"))
