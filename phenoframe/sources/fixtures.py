"""Synthetic inputs derived from the driver's test tables.

The published jobs read a primary-care journal, hospital episode tables and a
growth-reference table, none of which is public.  For tests and the built-in
queries we derive all three from ``events`` and ``orders`` by integer rules,
so their size grows with the scale factor:

* journal  = ``events`` x five domains (blood pressure, glucose, BMI, smoking,
  ethnicity); one journal row per event and domain.
* hospital = ``orders``: one episode per order, split by ``o_orderkey % 3``
  into outpatient / emergency / admitted care, each in two halves
  (identifying and clinical) joined by an episode key.
* growth reference (LMS) = one row per month 0..240, a smooth rule.

Each column is one SQL expression that Spark SQL and DuckDB evaluate
identically (only ``%``, ``CASE``, casts and date minus integer), so the
oracle SQL builds the very same rows from the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codelists
from .shards import YearPartitions, YearTables

# Values drawn for the free-text ethnic field: known categories, then every
# "unknown" spelling, then NULL (25 in all).
ETHNIC_FIELD_VALUES = [
    "A", "B", "C", "D", "E", "F", "G", "H", "J", "K", "L", "M", "N", "P", "R", "S",
    "Z", "z", "X", "x", "99", "9", "", " ", None,
]

JOURNAL_COLUMNS = [
    "DATE_OF_BIRTH", "YEAR_OF_BIRTH", "SEX", "LSOA", "DATE_OF_DEATH", "YEAR_OF_DEATH",
    "PATIENT_ID", "ETHNIC", "PRACTICE", "GP_SYSTEM_SUPPLIER", "PROCESSED_TIMESTAMP",
    "REPORTING_PERIOD_END_DATE", "JOURNAL_REPORTING_PERIOD_END_DATE", "DATE", "RECORD_DATE",
    "CODE", "SENSITIVE_CODE", "EPISODE_CONDITION", "EPISODE_PRESCRIPTION",
    "VALUE1_CONDITION", "VALUE2_CONDITION", "VALUE1_PRESCRIPTION", "VALUE2_PRESCRIPTION", "LINKS",
]


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def _pick(index_expr: str, values: list) -> str:
    """CASE expression choosing ``values[index_expr]``."""
    arms = " ".join(f"WHEN {i} THEN {_sql_literal(v)}" for i, v in enumerate(values))
    return f"CASE {index_expr} {arms} END"


_DOB = "DATE '2024-01-01' - CAST((user_id * 487) % 30000 + (user_id % 2) * 9000 AS INT)"
_DOD = (
    "CASE WHEN user_id % 11 = 0 THEN DATE '2024-02-01' "
    "WHEN user_id % 13 = 0 AND event_id % 4 <> 0 THEN DATE '2024-02-01' END"
)
_PERIOD = ("CASE WHEN event_id % 17 = 0 THEN DATE '2023-12-31' "
           "WHEN user_id % 3 = 0 THEN DATE '2024-01-15' ELSE DATE '2024-01-31' END")

# Columns shared by every domain: (name, expression over events + code list).
COMMON_EXPRS = [
    ("DATE_OF_BIRTH", _DOB),
    ("YEAR_OF_BIRTH", f"CAST(year({_DOB}) AS INT)"),
    ("SEX", "CAST(CASE WHEN user_id % 29 = 0 THEN 9 ELSE 1 + user_id % 2 END AS INT)"),
    ("LSOA", "'E0' || CAST(user_id % 40 AS STRING)"),
    ("DATE_OF_DEATH", _DOD),
    ("YEAR_OF_DEATH", f"CAST(year({_DOD}) AS INT)"),
    ("PATIENT_ID", "CASE WHEN event_id % 997 = 0 THEN NULL ELSE CAST(user_id AS STRING) END"),
    ("ETHNIC", _pick("(user_id + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END "
                     "+ CASE WHEN event_id % 211 = 0 THEN 2 ELSE 0 END) % 25", ETHNIC_FIELD_VALUES)),
    ("PRACTICE", "'P' || CAST(user_id % 7 AS STRING)"),
    ("GP_SYSTEM_SUPPLIER", "'S' || CAST(user_id % 3 AS STRING)"),
    ("PROCESSED_TIMESTAMP", "ts"),
    ("REPORTING_PERIOD_END_DATE", _PERIOD),
    ("JOURNAL_REPORTING_PERIOD_END_DATE", _PERIOD),
    ("DATE", "CASE WHEN event_id % 499 = 0 THEN NULL ELSE CAST(ts AS DATE) END"),
    ("RECORD_DATE", "CASE WHEN event_id % 503 = 0 THEN NULL ELSE CAST(ts AS DATE) END"),
    ("CODE", "code"),
    ("SENSITIVE_CODE", "'N'"),
    ("EPISODE_CONDITION", "CAST(NULL AS STRING)"),
    ("EPISODE_PRESCRIPTION", "CAST(NULL AS STRING)"),
    # VALUE1_CONDITION / VALUE2_CONDITION come from the domain
    ("VALUE1_PRESCRIPTION", "CAST(NULL AS DOUBLE)"),
    ("VALUE2_PRESCRIPTION", "CAST(NULL AS DOUBLE)"),
    ("LINKS", "'J' || CAST(event_id AS STRING)"),
]


def _bp_text_finding_ix() -> list[int]:
    """Positions in the BP list of the six systolic/diastolic text findings."""
    findings = {"Low-Finding", "Ideal-Finding", "Pre-High Finding", "High-Finding"}
    return [ix for ix, _, _, part, kind in codelists.codelist_rows("bp")[0] if part in ("SBP", "DBP") and kind in findings]


_BP_TEXT = "CAST(FLOOR(event_id / 98) AS BIGINT) % 5 = 0"
_BP_NO_VALUE = f"({_BP_TEXT} OR CAST(FLOOR(event_id / 7) AS BIGINT) % 3 = 0)"
_D = "CAST({} AS DOUBLE)"

# One entry per domain: (code list, index expression, VALUE1, VALUE2, filter).
DOMAINS = {
    "bp": (
        "bp",
        f"CASE WHEN {_BP_TEXT} THEN {_pick('event_id % 6', _bp_text_finding_ix())} ELSE event_id % 98 END",
        f"CASE WHEN {_BP_NO_VALUE} THEN NULL WHEN INITIAL_BREAKDOWN = 'DBP' "
        f"THEN {_D.format('30 + (event_id * 53) % 90')} ELSE {_D.format('50 + (event_id * 37) % 150')} END",
        f"CASE WHEN {_BP_NO_VALUE} THEN NULL WHEN INITIAL_BREAKDOWN = 'ALL' "
        f"THEN {_D.format('30 + (event_id * 53) % 90')} END",
        None,
    ),
    "glucose": (
        "glucose",
        "event_id % 41",
        "CASE WHEN CAST(FLOOR(event_id / 7) AS BIGINT) % 6 = 0 THEN NULL "
        f"WHEN TYPE_OF_BLOOD_GLUCOSE_RECORD = 'HBA1C' THEN {_D.format('(event_id * 7) % 180')} "
        f"ELSE {_D.format('(event_id * 7) % 250')} / 10 END",
        "CAST(NULL AS DOUBLE)",
        None,
    ),
    "height": (
        "height",
        "CAST(FLOOR(event_id / 4) AS BIGINT) % 8",
        f"CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 97 = 0 THEN {_D.format(0)} "
        f"WHEN event_id % 40 = 0 THEN {_D.format('90 + (event_id * 13) % 110')} / 100 "
        f"ELSE {_D.format('90 + (event_id * 13) % 110')} END",
        "CAST(NULL AS DOUBLE)",
        "event_id % 4 = 0",
    ),
    "weight": (
        "weight",
        "CAST(FLOOR(event_id / 4) AS BIGINT) % 9",
        f"CASE WHEN event_id % 23 = 1 THEN NULL ELSE {_D.format('10 + (event_id * 29) % 110')} END",
        "CAST(NULL AS DOUBLE)",
        "event_id % 4 = 1",
    ),
    "bmi": (
        "bmi",
        "CAST(FLOOR(event_id / 4) AS BIGINT) % 51",
        f"CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 13 = 0 THEN {_D.format(0)} "
        f"ELSE {_D.format('8 + (event_id * 11) % 60')} END",
        "CAST(NULL AS DOUBLE)",
        "event_id % 4 >= 2",
    ),
    "smoking": (
        "smoking",
        f"event_id % {len(codelists.codelist_rows("smoking")[0])}",
        f"CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_id % 9 = 0 THEN {_D.format(0)} "
        f"ELSE {_D.format('(event_id * 3) % 120')} END",
        "CAST(NULL AS DOUBLE)",
        None,
    ),
    "ethnicity": (
        "ethnicity",
        f"(user_id * 31 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) % {len(codelists.codelist_rows("ethnicity")[0])}",
        "CAST(NULL AS DOUBLE)",
        "CAST(NULL AS DOUBLE)",
        None,
    ),
}


def journal_exprs(domain: str) -> list[tuple[str, str]]:
    """(column, expression) list of the journal for one domain, in order."""
    _, _, v1, v2, _ = DOMAINS[domain]
    out = []
    for name, expr in COMMON_EXPRS:
        out.append((name, expr))
        if name == "EPISODE_PRESCRIPTION":
            out.append(("VALUE1_CONDITION", v1))
            out.append(("VALUE2_CONDITION", v2))
    return out


def _domain_journal(spark: SparkSession, events: DataFrame, domain: str) -> DataFrame:
    listname, ix_expr, _, _, where = DOMAINS[domain]
    codes = codelists.codelist_df(spark, listname, with_ix=True)
    ev = events.select("event_id", "user_id", "ts")
    if where:
        ev = ev.filter(F.expr(where))
    # The code list has a few dozen rows: a broadcast hash join on its index.
    tagged = ev.join(F.broadcast(codes), F.expr(ix_expr) == codes["ix"], "inner")
    return tagged.select([F.expr(e).alias(n) for n, e in journal_exprs(domain)])


def journal(spark: SparkSession, sf_dir: str, domains: list[str] | None = None) -> DataFrame:
    """The synthetic journal (all domains unless ``domains`` is given).

    ``bmi`` stands for the three BMI-related lists (height, weight, BMI codes).
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    wanted = domains or ["bp", "glucose", "bmi", "smoking", "ethnicity"]
    parts = []
    for d in wanted:
        for sub in (["height", "weight", "bmi"] if d == "bmi" else [d]):
            parts.append(_domain_journal(spark, events, sub))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# Hospital episodes
# ---------------------------------------------------------------------------

HOSPITAL_DATASETS = {"outpatient": 0, "emergency": 1, "admitted": 2}

_EVENT_DATE = "CAST(CAST(o_orderdate AS DATE) + INTERVAL 23 YEAR AS DATE)"

HOSPITAL_IDENT_EXPRS = [
    ("EPISODE_KEY", "o_orderkey"),
    ("PATIENT_ID", "CAST(o_custkey % 200 AS STRING)"),
    ("YEAR", f"CAST(year({_EVENT_DATE}) AS INT)"),
]

HOSPITAL_CLINICAL_EXPRS = [
    ("EPISODE_KEY", "o_orderkey"),
    ("EVENT_DATE", _EVENT_DATE),
    ("ETHNIC_CODE", _pick(
        "(o_custkey % 200 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 25", ETHNIC_FIELD_VALUES)),
    ("PRACTICE_CODE",
     "CASE WHEN o_orderkey % 13 = 0 THEN 'Y' WHEN o_orderkey % 17 = 0 THEN 'Q99' "
     "WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'P1' END"),
    ("YEAR", f"CAST(year({_EVENT_DATE}) AS INT)"),
]

# Clinical halves lose a few episodes, so the halves do not match one to one.
HOSPITAL_CLINICAL_FILTER = "o_orderkey % 23 <> 0"


def hospital_halves(spark: SparkSession, sf_dir: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(identifying, clinical) halves of one hospital dataset; both carry a
    ``YEAR`` column, the shard the episode belongs to."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    mine = orders.filter(F.col("o_orderkey") % 3 == HOSPITAL_DATASETS[dataset])
    ident = mine.select([F.expr(e).alias(n) for n, e in HOSPITAL_IDENT_EXPRS])
    clinical = mine.filter(F.expr(HOSPITAL_CLINICAL_FILTER)).select(
        [F.expr(e).alias(n) for n, e in HOSPITAL_CLINICAL_EXPRS])
    return ident, clinical


# FIXED VALUES: names of the published yearly tables and of their columns:
# kind of table, episode key and date of each dataset; the others are common.
PUBLISHED_TABLES = {"outpatient": ("op", "ATTENDKEY", "APPTDATE"), "emergency": ("ae", "AEKEY", "ARRIVALDATE"), "admitted": ("apc", "EPIKEY", "EPIEND")}
PUBLISHED_PATIENT, PUBLISHED_ETHNIC, PUBLISHED_PRACTICE = "NEWNHSNO", "ETHNOS", "CR_GP_PRACTICE"


def published_columns(dataset: str) -> tuple[dict, dict]:
    """The library's names and the published ones, of the identifying and of the clinical half."""
    _, key, date = PUBLISHED_TABLES[dataset]
    return ({"EPISODE_KEY": key, "PATIENT_ID": PUBLISHED_PATIENT},
            {"EPISODE_KEY": key, "EVENT_DATE": date, "ETHNIC_CODE": PUBLISHED_ETHNIC, "PRACTICE_CODE": PUBLISHED_PRACTICE})


def year_tables(spark: SparkSession, sf_dir: str, dataset: str, databases: tuple[str, str], folder: str) -> tuple[YearTables, YearTables]:
    """Both halves of a dataset as yearly tables ``hes_<kind>_<year>`` with the published
    columns, the identifying ones in a database of their own."""
    kind, out = PUBLISHED_TABLES[dataset][0], []
    for half, columns, database in zip(hospital_halves(spark, sf_dir, dataset), published_columns(dataset), databases):
        path = f"{folder}/{dataset}-{database}"
        half.select("YEAR", *[F.col(name).alias(own) for name, own in columns.items()]).write.partitionBy("YEAR").parquet(path)
        for year in YearPartitions(spark, folder=path).years():
            spark.catalog.createTable(f"{database}.hes_{kind}_{year}", path=f"{path}/YEAR={year}", source="parquet")
        out.append(YearTables(spark, database, kind, "hes_", columns))
    return tuple(out)


def hospital_partitions(spark: SparkSession, sf_dir: str, dataset: str, folder: str) -> tuple[YearPartitions, YearPartitions]:
    """Both halves of a dataset, each stored in a folder partitioned by year."""
    out = []
    for name, half in zip(("identifying", "clinical"), hospital_halves(spark, sf_dir, dataset)):
        path = f"{folder}/{dataset}-{name}"
        half.write.partitionBy("YEAR").parquet(path)
        out.append(YearPartitions(spark, folder=path))
    return tuple(out)


# ---------------------------------------------------------------------------
# Growth reference (LMS)
# ---------------------------------------------------------------------------

LMS_MONTHS = 241


def lms_rows() -> list[tuple]:
    """Months_Calculated, BOYS_L/M/S, GIRLS_L/M/S.  L is 0 for months 120-131
    so that an interpolated L can be exactly 0 (zero divisor)."""
    rows = []
    for m in range(LMS_MONTHS):
        bl = 0.0 if 120 <= m <= 131 else -1.5 + m / 200
        gl = 0.0 if 120 <= m <= 131 else bl - 0.1
        rows.append((m, bl, 16 + m / 40, 0.08 + m / 4000, gl, 16.2 + m / 40, 0.085 + m / 4000))
    return rows


LMS_COLUMNS = ["Months_Calculated", "BOYS_L", "BOYS_M", "BOYS_S", "GIRLS_L", "GIRLS_M", "GIRLS_S"]


def lms_table(spark: SparkSession) -> DataFrame:
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("Months_Calculated", T.IntegerType(), False)] + [
        T.StructField(c, T.DoubleType(), False) for c in LMS_COLUMNS[1:]])
    return spark.createDataFrame(lms_rows(), schema)
