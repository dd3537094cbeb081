"""Most recent blood-glucose status per patient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.banding import (GLUCOSE_BREAKS, GLUCOSE_CATEGORIES, GLUCOSE_INDETERMINABLE, band, glucose_fasting_rules,
                                 glucose_single_rules)
from ..operators.day_classes import agreeing_days, band_index, bit, extremes, inner_values, known_keys, pair_table, piece
from ..operators.heavy import bring_back
from ..operators.pairing import PAIR_KEYS, pair_same_day
from ..operators.selection import KEY
from ..operators.staging import materialise
from ..operators.tagging import tag_codes
from ..operators.union import union_sources
from ..schemas import require

CAT = "CATEGORISED_BLOOD_GLUCOSE"
FASTING = "FASTING_STATUS"


def non_fasting_status(tagged: DataFrame) -> DataFrame:
    """HbA1c, non-fasting and random readings, banded."""
    return (tagged.filter(F.col(FASTING).isin("NON-FASTING", "RANDOM"))
            .withColumn(CAT, band(glucose_single_rules(), GLUCOSE_INDETERMINABLE)))


def fasting_matched(tagged: DataFrame, distinct_partners: bool = False) -> DataFrame:
    """Fasting readings with the same-day two-hour (OGTT) value as
    ``VALUE2_CONDITION`` (NULL when there is none)."""
    fasting = tagged.filter(F.col(FASTING) == "FASTING")
    ogtt = tagged.filter(F.col(FASTING) == "OGTT")
    return pair_same_day(fasting, ogtt,
                         {"VALUE1_CONDITION": "VALUE2_CONDITION", "VALUE1_PRESCRIPTION": "VALUE2_PRESCRIPTION"},
                         how="left", distinct_partners=distinct_partners)


def fasting_status(tagged: DataFrame, distinct_partners: bool = False) -> DataFrame:
    matched = fasting_matched(tagged, distinct_partners).filter(F.col("VALUE1_CONDITION").isNotNull())
    return matched.withColumn(CAT, band(glucose_fasting_rules(), GLUCOSE_INDETERMINABLE))


def day_statuses(tagged: DataFrame) -> DataFrame:
    """Least and greatest status position of each patient-day, by one aggregation on the pairing keys.

    Fasting and two-hour values of a day become masks of their pieces; a
    two-hour value that is NULL, or none at all, is the last bit."""
    V1 = F.col("VALUE1_CONDITION")
    none = 2 * len(GLUCOSE_BREAKS[1]) + 1
    fasting = F.when(F.col(FASTING) == "FASTING", bit(piece(V1, GLUCOSE_BREAKS[0])))
    ogtt = F.when((F.col(FASTING) == "OGTT") & known_keys(PAIR_KEYS), F.coalesce(bit(piece(V1, GLUCOSE_BREAKS[1])), F.lit(1 << none)))
    single = F.when(F.col(FASTING).isin("NON-FASTING", "RANDOM"), band_index(glucose_single_rules(), GLUCOSE_CATEGORIES))
    days = tagged.withColumn("_single", single).groupBy(*PAIR_KEYS).agg(
        F.bit_or(fasting).alias("_f"), F.coalesce(F.bit_or(ogtt), F.lit(1 << none)).alias("_o"),
        F.min("_single").alias("_least"), F.max("_single").alias("_most"))
    table = pair_table(tagged.sparkSession, glucose_fasting_rules(), GLUCOSE_CATEGORIES, inner_values(GLUCOSE_BREAKS[0]),
                       [*inner_values(GLUCOSE_BREAKS[1]), None], ("VALUE1_CONDITION", "VALUE2_CONDITION"), "DOUBLE")
    low, high = extremes(table, F.col("_f"), F.col("_o"))
    return days.select(KEY, "DATE", F.least("_least", low).alias("_lo"), F.greatest("_most", high).alias("_hi"))


def blood_glucose(journal: DataFrame | None, codes: DataFrame | None, stage: bool = True,
                  tagged: DataFrame | None = None) -> DataFrame:
    """Distinct rows on each patient's latest date with a known status, for
    patients whose rows on that date agree.

    Statuses are found first on narrow rows (``day_statuses``); the wide rows
    of the surviving patient-days, one a patient, are then brought back and
    paired.  ``stage`` stores the tagged rows (read for either step) and
    those of the surviving days (read by three branches)."""
    require(journal if tagged is None else tagged, "blood_glucose")
    # ``tagged``: rows already tagged with this list (see plans.combined).
    tagged = materialise(tag_codes(journal, codes), stage) if tagged is None else tagged
    days = agreeing_days(day_statuses(tagged), len(GLUCOSE_CATEGORIES))
    latest = materialise(bring_back(tagged, days, [KEY, "DATE"]), stage)
    known = [s.filter(F.col(CAT) != GLUCOSE_INDETERMINABLE)
             for s in (non_fasting_status(latest), fasting_status(latest, distinct_partners=True))]
    return union_sources(known)
