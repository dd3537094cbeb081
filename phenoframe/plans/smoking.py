"""Most recent smoking status per patient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ages import age_years
from ..functions.banding import (SMOKING_CATEGORIES, SMOKING_INDETERMINABLE, band, smoking_dictionary_rules,
                                 smoking_rules)
from ..operators.selection import KEY, latest_consistent
from ..operators.staging import materialise
from ..operators.tagging import tag_codes
from ..schemas import require


def categorise_smoking(journal: DataFrame, codes: DataFrame | None, dedupe_codes: bool = False,
                       tagged: DataFrame | None = None) -> DataFrame:
    """Tag smoking codes, band them (``SMOKING_CATS``) and map to the data
    dictionary status (``DATA_DICTIONARY_CATS``).  ``tagged``: rows already
    tagged with ``CATEGORY`` (then ``journal``/``codes`` are not used)."""
    if tagged is None:
        tagged = tag_codes(journal, codes, dedupe_codes=dedupe_codes)
    return (tagged
            .withColumn("SMOKING_CATS", band(smoking_rules(), SMOKING_INDETERMINABLE))
            .withColumn("DATA_DICTIONARY_CATS", band(smoking_dictionary_rules(), "Ex-Smoker")))


def smoking(journal: DataFrame | None, codes: DataFrame | None, dedupe_codes: bool = False,
            stage: bool = True, tagged: DataFrame | None = None) -> DataFrame:
    """Rows on each patient's latest date with a known status, for patients
    whose rows on that date agree; plus the whole-year age at that date.

    There is no de-duplication: a code listed several times in ``codes``
    repeats its rows (``dedupe_codes`` avoids that).  ``stage`` checkpoints
    the known-status rows, which are read twice (see ``materialise``).
    ``tagged``: journal rows already tagged with the list's ``CATEGORY``
    (see ``plans.combined``).
    """
    require(journal if tagged is None else tagged, "smoking")
    cats = categorise_smoking(journal, codes, dedupe_codes, tagged)
    # The dictionary status is Indeterminable exactly when the smoking status
    # is, so filter on the latter: the optimizer pushes this filter through
    # the projection with the rule chain inlined, and the dictionary rules
    # would inline the smoking chain five times (once per reference).
    known = materialise(cats.filter(F.col("SMOKING_CATS") != SMOKING_INDETERMINABLE), stage)
    latest = latest_consistent(known, KEY, "DATE", "DATA_DICTIONARY_CATS", SMOKING_CATEGORIES, salted=True)
    return latest.withColumn("AGE_AT_TIME_OF_JOURNAL", age_years("DATE", "DATE_OF_BIRTH", whole=True))
