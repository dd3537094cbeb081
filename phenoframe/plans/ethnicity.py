"""Ethnic category per patient: most recent (primary care only, or all
sources) and modal.

Sources, in priority order: journal codes (1), the patient's ethnic field
(2), admitted (3), emergency (4) and outpatient (5) hospital care.

Most recent: per patient, the latest dated record over all sources; on a
tie the best-priority source; if that still leaves more than one category
the patient is dropped; finally only living patients are kept.  Because the
latest date over a union equals the latest over each source's own latest
rows, the per-source "latest" steps need no separate pass: one aggregation
per patient over the union finds the greatest and least of records packed
into longs, and the patient is kept when the two agree on the category.
That is a single hash aggregation, combined map-side, whatever the number
of records a patient has.

Modal: each source votes once for each category it holds for the patient;
the category with most votes wins and ties drop the patient.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hospital import join_halves, shard_years
from ..operators.joins import lookup_join
from ..operators.packed import both_votes, code_of, day_of, gathered, pack_record, priority_of, slot_of, unique_winner, unpack_code, vote
from ..operators.selection import KEY, drop_unknown_codes, fallback_source, keep_living, no_death
from ..operators.tagging import tag_codes
from ..schemas import require
from ..sources.codelists import UNKNOWN_ETHNIC_VALUES
from ..sources.shards import Shards

# Source labels and priorities (lower wins).  Labels are parameters of the
# pipelines; these are the defaults.
JOURNAL, PATIENT, ADMITTED, EMERGENCY, OUTPATIENT = "journal", "patient", "admitted", "emergency", "outpatient"
PRIORITY = {JOURNAL: 1, PATIENT: 2, ADMITTED: 3, EMERGENCY: 4, OUTPATIENT: 5}
RECENT_LABELS = {JOURNAL: "PRIMARY_CARE_JOURNAL", PATIENT: "PRIMARY_CARE_PATIENT",
                 ADMITTED: "HOSPITAL_ADMITTED", EMERGENCY: "HOSPITAL_EMERGENCY",
                 OUTPATIENT: "HOSPITAL_OUTPATIENT"}
MODAL_LABELS = {JOURNAL: "Journal", PATIENT: "Patient", ADMITTED: "APC", EMERGENCY: "AE",
                OUTPATIENT: "OP"}

RESULT_COLUMNS = [KEY, "ETHNIC_CATEGORY_CODE", "DATE_OF_ATTRIBUTION", "DATA_SOURCE"]


def journal_ethnicity(journal: DataFrame, codes: DataFrame) -> DataFrame:
    """Journal rows with an ethnicity code whose category is known:
    journal columns + ``PrimaryCode``."""
    return drop_unknown_codes(tag_codes(journal, codes, tags=["PrimaryCode"]), "PrimaryCode")


def patient_ethnicity(journal: DataFrame) -> DataFrame:
    """Journal rows whose ethnic field holds a known category."""
    return drop_unknown_codes(journal, "ETHNIC")


def hospital_ethnicity(ident: DataFrame | Shards, clinical: DataFrame | Shards, shards: int = 6, names: dict | None = None) -> DataFrame:
    """(PATIENT_ID, EVENT_DATE, ETHNIC_CODE) of the newest ``shards`` years of
    one hospital dataset, excluded practices and unknown categories
    removed.  The years are taken from the identifying half and become a
    filter on both halves, so both are pruned; of ``Shards`` they are read
    from names.  ``names`` gives a DataFrame's own column names as arguments
    of ``join_halves`` (key, patient, date, ethnic, practice, year); ``Shards`` have theirs."""
    names = {"key": "EPISODE_KEY", "patient": "PATIENT_ID", "date": "EVENT_DATE", "ethnic": "ETHNIC_CODE",
             "practice": "PRACTICE_CODE", "year": "YEAR"} | (names or {})
    years = shard_years(ident, names["year"], shards)

    def chosen(half: DataFrame | Shards) -> DataFrame:
        # A half of tables may lack a year that the other one has.
        if isinstance(half, Shards):
            return half.read([y for y in half.years() if y in years])
        return half.filter(F.col(names["year"]).isin(years))

    return join_halves(chosen(ident), drop_unknown_codes(chosen(clinical), names["ethnic"]), **names)


def _records(df: DataFrame, date: str, cat: str, source: str, labels: dict) -> DataFrame:
    return df.select(F.col(KEY), F.col(date).alias("DATE"), F.col(cat).alias("ETHNICITY"),
                     F.lit(labels[source]).alias("SOURCE"), F.lit(PRIORITY[source]).alias("PRIORITY"))


def source_records(journal: DataFrame, codes: DataFrame, hospital: dict | None = None,
                   labels: dict | None = None, shards: int = 6) -> DataFrame:
    """All dated ethnicity records: PATIENT_ID, DATE, ETHNICITY, SOURCE,
    PRIORITY.  ``hospital`` maps admitted/emergency/outpatient to
    (identifying, clinical) halves, or to (identifying, clinical, names) when
    the dataset has its own column names."""
    labels = labels or RECENT_LABELS
    parts = [
        _records(journal_ethnicity(journal, codes), "RECORD_DATE", "PrimaryCode", JOURNAL, labels),
        _records(patient_ethnicity(journal), "REPORTING_PERIOD_END_DATE", "ETHNIC", PATIENT, labels),
    ]
    for source in (ADMITTED, EMERGENCY, OUTPATIENT):
        if hospital and source in hospital:
            parts.append(_records(hospital_ethnicity(*hospital[source][:2], shards, *hospital[source][2:]), "EVENT_DATE", "ETHNIC_CODE",
                                  source, labels))
    return reduce(DataFrame.unionByName, parts)


def recent_category(records: DataFrame) -> DataFrame:
    """Latest date, then best priority, then a single category, per patient
    (see module docstring).  Returns RESULT_COLUMNS, one row per patient."""
    d, p, c, s = F.col("DATE"), F.col("PRIORITY"), F.col("ETHNICITY"), F.col("SOURCE")
    clean = records.filter(F.col(KEY).isNotNull() & d.isNotNull() & p.isNotNull() & c.isNotNull())
    per = clean.groupBy(KEY).agg(
        F.max(F.struct(d.alias("d"), (-p).alias("p"), c.alias("c"), s.alias("s"))).alias("_hi"),
        F.min(F.struct((-F.unix_date(d)).alias("d"), p.alias("p"), c.alias("c"))).alias("_lo"),
    )
    return per.filter(F.col("_hi.c") == F.col("_lo.c")).select(
        KEY, F.col("_hi.c").alias("ETHNIC_CATEGORY_CODE"), F.col("_hi.d").alias("DATE_OF_ATTRIBUTION"),
        F.col("_hi.s").alias("DATA_SOURCE"))


# ---------------------------------------------------------------------------
# One-pass forms used by the pipelines
# ---------------------------------------------------------------------------

#: Bit of each source in a category's votes.
SOURCE_BIT = {source: PRIORITY[source] - 1 for source in PRIORITY}
# FIXED VALUES: known ethnic category codes.
CATEGORIES = list("ABCDEFGHJKLMNPRSTW")


def _known(c):
    return F.when(c.isNotNull() & ~c.isin(UNKNOWN_ETHNIC_VALUES), c)


def primary_care_rows(journal: DataFrame, codes: DataFrame) -> DataFrame:
    """One pass over the journal: per row the patient, whether the row has no
    death date (``_alive``), and the known categories of its ethnicity code
    (``_code``) and of its ethnic field (``_field``)."""
    lookup = codes.select(F.col("code").cast("string").alias("CODE"), "PrimaryCode")
    j = lookup_join(journal, lookup, "CODE", "left", checked=codes).filter(F.col(KEY).isNotNull())
    return j.select(KEY, "RECORD_DATE", "REPORTING_PERIOD_END_DATE", no_death(journal).alias("_alive"),
                    _known(F.col("PrimaryCode")).alias("_code"), _known(F.col("ETHNIC")).alias("_field"))


def hospital_rows(hospital: dict | None, shards: int) -> list[tuple[str, DataFrame]]:
    """(source, rows) of the hospital datasets that there are."""
    return [(source, hospital_ethnicity(*hospital[source][:2], shards, *hospital[source][2:]))
            for source in (ADMITTED, EMERGENCY, OUTPATIENT) if hospital and source in hospital]


def recent_living(journal: DataFrame, codes: DataFrame, hospital: dict | None, labels: dict, shards: int) -> DataFrame:
    """Latest date, best priority, single category and at least one journal
    row without a death date, per patient.

    Every record is packed into two longs (see ``operators.packed``); a
    journal row gives the better of its two.  One hash aggregation per
    patient, combined map-side, then finds the best record and whether
    another one as good has another category."""
    primary = primary_care_rows(journal, codes)
    by_code = pack_record(F.col("RECORD_DATE"), PRIORITY[JOURNAL], F.col("_code"))
    by_field = pack_record(F.col("REPORTING_PERIOD_END_DATE"), PRIORITY[PATIENT], F.col("_field"))
    parts = [primary.select(KEY, "_alive", F.greatest(by_code[0], by_field[0]).alias("_top"), F.least(by_code[1], by_field[1]).alias("_low"))]
    for source, rows in hospital_rows(hospital, shards):
        top, low = pack_record(F.col("EVENT_DATE"), PRIORITY[source], F.col("ETHNIC_CODE"))
        parts.append(rows.filter(F.col(KEY).isNotNull()).select(KEY, F.lit(None).cast("boolean").alias("_alive"), top.alias("_top"), low.alias("_low")))
    per = reduce(DataFrame.unionByName, parts).groupBy(KEY).agg(F.max("_top").alias("_top"), F.min("_low").alias("_low"), F.max("_alive").alias("_alive"))
    best = per.filter((code_of(F.col("_top")) == code_of(F.col("_low"))) & F.col("_alive"))
    source = reduce(lambda e, s: e.when(priority_of(F.col("_top")) == PRIORITY[s], labels[s]), PRIORITY, F)
    return best.select(KEY, unpack_code(code_of(F.col("_top"))).alias("ETHNIC_CATEGORY_CODE"), day_of(F.col("_top")).alias("DATE_OF_ATTRIBUTION"),
                       source.alias("DATA_SOURCE"))


def ethnicity_recent_primary(journal: DataFrame, codes: DataFrame, labels: dict | None = None, long_codes: bool = False) -> DataFrame:
    """Most recent category from the primary-care journal codes and ethnic
    field, living patients only.  One journal scan, one aggregation.
    ``long_codes``: see ``ethnicity_recent_all``."""
    return ethnicity_recent_all(journal, codes, None, labels, long_codes=long_codes)


def ethnicity_with_fallback(journal: DataFrame, codes: DataFrame, hospital: dict, labels: dict | None = None,
                            shards: int = 6) -> DataFrame:
    """Most recent category from primary care, or from hospital care for
    patients of whom primary care holds no dated known category; living patients
    only.  A patient whose primary-care records conflict has one available,
    though unclear, and gets none."""
    require(journal, "ethnicity")
    labels = labels or RECENT_LABELS
    primary = source_records(journal, codes, None, labels)
    hospitals = reduce(DataFrame.unionByName, [
        _records(hospital_ethnicity(*hospital[s][:2], shards, *hospital[s][2:]), "EVENT_DATE", "ETHNIC_CODE", s, labels)
        for s in (ADMITTED, EMERGENCY, OUTPATIENT) if s in hospital])
    both = fallback_source(recent_category(primary), recent_category(hospitals), KEY,
                           available=primary.where(F.col(KEY).isNotNull() & F.col("DATE").isNotNull()))
    return keep_living(both, journal)


def ethnicity_recent_all(journal: DataFrame, codes: DataFrame, hospital: dict | None, labels: dict | None = None,
                         shards: int = 6, long_codes: bool = False) -> DataFrame:
    """Most recent category over primary care and hospital sources, living
    patients only (so hospital-only patients are dropped).

    Codes of more than five ASCII characters, which no published list has,
    fail the job unless ``long_codes`` is set; records are then compared as
    they are, which costs a sort."""
    require(journal, "ethnicity")
    labels = labels or RECENT_LABELS
    if long_codes:
        return keep_living(recent_category(source_records(journal, codes, hospital, labels, shards)), journal)
    return recent_living(journal, codes, hospital, labels, shards)


def ethnicity_modal(journal: DataFrame, codes: DataFrame, hospital: dict, labels: dict | None = None,
                    shards: int = 6, living_only: bool = False, categories: list[str] | None = None) -> DataFrame:
    """Modal category per patient (PATIENT_ID, ETHNIC_CATEGORY_CODE).
    Deceased patients are kept unless ``living_only``.

    Each source votes once per category: a patient's votes are a vector of
    five bits for each of ``categories`` (by default the known ones), merged
    by one hash aggregation with ``bit_or`` and read once for the category
    with most bits; ties drop the patient.  A patient may have one code
    outside ``categories``, which counts like them; two fail the job."""
    require(journal, "ethnicity")
    categories = categories or CATEGORIES
    primary = primary_care_rows(journal, codes)
    slots = {"_code_slot": slot_of(F.col("_code"), categories), "_field_slot": slot_of(F.col("_field"), categories)}
    votes = both_votes(vote(F.col("_code"), SOURCE_BIT[JOURNAL], categories, F.col("_code_slot")),
                       vote(F.col("_field"), SOURCE_BIT[PATIENT], categories, F.col("_field_slot")))
    if not living_only:
        primary = primary.filter(F.col("_code").isNotNull() | F.col("_field").isNotNull())  # the others only carry the alive flag
    # A patient's rows hold few different categories: the vectors are built from those.
    primary = primary.groupBy(KEY, "_code", "_field").agg(F.max("_alive").alias("_alive"))
    parts = [primary.withColumns(slots).select(KEY, "_alive", *[v.alias(n) for n, v in votes.items()])]
    for source, rows in hospital_rows(hospital, shards):
        own = vote(F.col("ETHNIC_CODE"), SOURCE_BIT[source], categories, F.col("_slot"))
        rows = rows.filter(F.col(KEY).isNotNull()).withColumn("_slot", slot_of(F.col("ETHNIC_CODE"), categories))
        parts.append(rows.select(KEY, F.lit(None).cast("boolean").alias("_alive"), *[v.alias(n) for n, v in own.items()]))
    per = reduce(DataFrame.unionByName, parts).groupBy(KEY).agg(*gathered(categories), F.max("_alive").alias("_alive"))
    winner, unique = unique_winner(categories)
    return per.filter(unique & F.col("_alive") if living_only else unique).select(KEY, winner.alias("ETHNIC_CATEGORY_CODE"))
