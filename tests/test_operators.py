"""Operators on hand-made inputs: NULL keys and dates, ties, conflicts,
fan-out, n x m pairing, priorities, votes, living patients, shards."""

import datetime as dt

from pyspark.sql import functions as F

from phenoframe.operators.hospital import join_halves, latest_shards
from phenoframe.operators.pairing import pair_same_day
from phenoframe.operators.selection import (best_priority, dedupe_observations, drop_conflicts, drop_unknown_codes,
                                            fallback_source, keep_living, latest_consistent, latest_per_patient,
                                            modal_category)
from phenoframe.operators.tagging import tag_codes
from phenoframe.operators.union import union_sources

D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)
ROWS = "PATIENT_ID string, DATE date, CATEGORY string, N int"


def _set(df, *cols):
    rows = df.select(*cols).collect() if cols else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_latest_keeps_ties_and_drops_nulls(spark):
    df = spark.createDataFrame([
        ("a", D1, "X", 1), ("a", D2, "X", 2), ("a", D2, "Y", 3),
        ("b", None, "X", 4),            # only a NULL date: patient disappears
        ("c", D1, "X", 5), ("c", None, "Y", 6),
        (None, D3, "X", 7),             # NULL patient never qualifies
    ], ROWS)
    assert _set(latest_per_patient(df), "N") == [(2,), (3,), (5,)]


def test_drop_conflicts(spark):
    df = spark.createDataFrame([
        ("a", D1, "X", 1), ("a", D2, "X", 2), ("b", D1, "X", 3), ("b", D1, "Y", 4),
        ("c", D1, None, 5), ("d", D1, None, 6), ("d", D1, "Z", 7), (None, D1, "X", 8)], ROWS)
    assert _set(drop_conflicts(df), "N") == [(1,), (2,), (6,), (7,)]


def test_latest_consistent_equals_two_steps(spark):
    rows = [(p, d, c, i) for i, (p, d, c) in enumerate([
        ("a", D1, "X"), ("a", D2, "X"), ("a", D2, "X"), ("b", D2, "X"), ("b", D2, "Y"), ("b", D1, "X"),
        ("c", D3, "Y"), ("c", D1, "X"), ("d", None, "X"), ("e", D1, None), ("e", D1, "Q"), ("f", D2, None)])]
    df = spark.createDataFrame(rows, ROWS)
    fused = _set(latest_consistent(df))
    two_step = _set(drop_conflicts(latest_per_patient(df)))
    assert fused == two_step
    assert sorted(r[3] for r in fused) == [1, 2, 6, 9, 10]


def test_best_priority(spark):
    df = spark.createDataFrame([("a", 2, "X"), ("a", 1, "Y"), ("a", 1, "Z"), ("b", 5, "X"), ("b", None, "Y")],
                               "PATIENT_ID string, PRIORITY int, ETHNICITY string")
    assert _set(best_priority(df), "PATIENT_ID", "ETHNICITY") == [("a", "Y"), ("a", "Z"), ("b", "X")]


def test_tag_codes_fans_out_on_duplicate_codes(spark):
    j = spark.createDataFrame([("1", "p"), ("2", "q"), ("3", "p")], "CODE string, PATIENT_ID string")
    codes = spark.createDataFrame([("1", "A"), ("1", "A"), ("3", "B")], "code string, CATEGORY string")
    assert j.transform(lambda d: tag_codes(d, codes)).count() == 3
    assert tag_codes(j, codes, dedupe_codes=True).count() == 2
    assert tag_codes(j, codes).columns == ["CODE", "PATIENT_ID", "CATEGORY"]


def test_pairing_is_n_by_m_and_null_keys_never_pair(spark):
    schema = ("PATIENT_ID string, DATE date, PRACTICE string, REPORTING_PERIOD_END_DATE date, "
              "JOURNAL_REPORTING_PERIOD_END_DATE date, V double")
    p = D3
    left = spark.createDataFrame([("a", D1, "P", p, p, 120.0), ("a", D1, "P", p, p, 130.0),
                                  ("b", D1, None, p, p, 110.0), ("c", D1, "P", p, p, 100.0)], schema)
    right = spark.createDataFrame([("a", D1, "P", p, p, 80.0), ("a", D1, "P", p, p, 85.0),
                                   ("a", D1, "P", p, p, 85.0), ("b", D1, None, p, p, 70.0),
                                   ("c", D2, "P", p, p, 60.0)], schema)
    inner = pair_same_day(left, right, {"V": "W"})
    assert inner.count() == 6
    assert pair_same_day(left, right, {"V": "W"}, distinct_partners=True).count() == 4
    outer = pair_same_day(left, right, {"V": "W"}, how="left")
    assert outer.count() == 8
    assert _set(outer.filter(F.col("W").isNull()), "PATIENT_ID") == [("b",), ("c",)]


def test_dedupe_and_modal(spark):
    votes = spark.createDataFrame([("a", "A"), ("a", "A"), ("a", "B"), ("b", "A"), ("b", "B"), ("c", "C"),
                                   (None, "A")], "PATIENT_ID string, ETHNICITY string")
    assert _set(modal_category(votes)) == [("a", "A"), ("c", "C")]
    d = dedupe_observations(votes.withColumn("DATE", F.lit(D1)))
    assert _set(d.filter(F.col("PATIENT_ID") == "a"), "ETHNICITY", "COUNT_RECORDS") == [("A", 2), ("B", 1)]


def test_keep_living_mixed_rows_count_as_alive(spark):
    journal = spark.createDataFrame([("a", D1), ("a", None), ("b", D1), ("c", None)],
                                    "PATIENT_ID string, DATE_OF_DEATH date")
    res = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "PATIENT_ID string")
    assert _set(keep_living(res, journal)) == [("a",), ("c",)]


def test_unknown_codes(spark):
    df = spark.createDataFrame([(v,) for v in ["A", "Z", "z", "X", "x", "99", "9", "", " ", None, "S"]], "E string")
    assert _set(drop_unknown_codes(df, "E")) == [("A",), ("S",)]


def test_union_sources_by_name_and_distinct(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([("x", 1)], "v string, k int")
    assert _set(union_sources([a, b])) == [(1, "x")]
    labelled = union_sources([a, b], labels=[{"SOURCE": "A"}, {"SOURCE": "B"}], distinct=True)
    assert _set(labelled, "SOURCE") == [("A",), ("B",)]


def test_join_halves_and_shards(spark):
    ident = spark.createDataFrame([(1, "p", 2019), (2, "q", 2020), (3, "r", 2020), (4, "s", 2021)],
                                  "EPISODE_KEY int, PATIENT_ID string, YEAR int")
    clin = spark.createDataFrame([(1, D1, "A", "P1", 2019), (2, D2, "B", "Y", 2020), (3, D3, "C", None, 2020),
                                  (4, D3, "D", "Q98", 2021)],
                                 "EPISODE_KEY int, EVENT_DATE date, ETHNIC_CODE string, PRACTICE_CODE string, YEAR int")
    assert _set(join_halves(ident, clin), "PATIENT_ID") == [("p",), ("s",)]
    assert _set(latest_shards(ident, n=2), "YEAR") == [(2020,), (2020,), (2021,)]


def test_fallback_source(spark):
    primary = spark.createDataFrame([("a", "A")], "PATIENT_ID string, C string")
    secondary = spark.createDataFrame([("a", "B"), ("b", "B")], "PATIENT_ID string, C string")
    assert _set(fallback_source(primary, secondary)) == [("a", "A"), ("b", "B")]


def test_hot_patient_latest_consistent_matches_brute_force(spark):
    """A third of the rows belong to one patient, on one day and spread
    over many days; the result must equal a plain Python computation."""
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            p, d = "hot", dt.date(2024, 1, 1 + (i % 7 if i % 2 else 20))
        else:
            p, d = f"p{i % 97}", dt.date(2024, 1, 1 + rnd.randrange(28))
        rows.append((p, d, rnd.choice(["A", "B"]) if p != "hot" or d.day != 21 else "A", i))
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    latest = {}
    for p, d, c, _ in rows:
        latest[p] = max(latest.get(p, d), d)
    cats = {}
    for p, d, c, _ in rows:
        if d == latest[p]:
            cats.setdefault(p, set()).add(c)
    want = sorted(n for p, d, c, n in rows if d == latest[p] and len(cats[p]) == 1)
    got = sorted(r[3] for r in latest_consistent(df).collect())
    got_encoded = sorted(r[3] for r in latest_consistent(df, categories=["A", "B"]).collect())
    assert got == want == got_encoded
    assert any(r[0] == "hot" for r in rows if r[3] in set(want))


def test_join_halves_with_source_column_names(spark):
    ident = spark.createDataFrame([(1, "p", 2020), (2, "q", 2020)], "EKEY int, PID string, SHARD int")
    clin = spark.createDataFrame([(1, D1, "A", "P1", 2020), (2, D2, "B", "Q99", 2020)],
                                 "EKEY int, ADMIDATE date, ETH string, PRAC string, SHARD int")
    out = join_halves(ident, clin, key="EKEY", patient="PID", date="ADMIDATE", ethnic="ETH",
                      practice="PRAC", year="SHARD")
    assert out.columns == ["PATIENT_ID", "EVENT_DATE", "ETHNIC_CODE", "YEAR"]
    assert _set(out) == [("p", D1, "A", 2020)]


def test_staged_run_removes_its_stages(spark):
    import os

    from phenoframe.operators.staging import checkpoint_folder, materialise, staged_run

    folder = checkpoint_folder(spark.range(1)).removeprefix("file:")

    def stages():
        return {x for x in os.listdir(folder) if x.startswith("phenoframe-stage-")}

    before = stages()
    with staged_run(spark):
        assert materialise(spark.range(3)).count() == 3 and stages() > before
    assert stages() == before


def test_living_needs_neither_date_nor_year_of_death(spark):
    from phenoframe.operators.selection import keep_living

    journal = spark.createDataFrame([("a", None, None), ("b", None, 2020), ("c", None, 2020), ("c", None, None)],
                                    "PATIENT_ID string, DATE_OF_DEATH date, YEAR_OF_DEATH int")
    patients = journal.select("PATIENT_ID").distinct()
    assert {r.PATIENT_ID for r in keep_living(patients, journal).collect()} == {"a", "c"}


def test_fallback_before_the_living_filter(spark):
    import datetime as dt

    from phenoframe.plans.ethnicity import ethnicity_with_fallback

    day, later = dt.date(2020, 1, 1), dt.date(2021, 1, 1)
    rows = [("dead", "1", day, "A", dt.date(2022, 1, 1)), ("alive", "1", day, "A", None), ("none", "9", day, None, None), ("torn", "1", day, "B", None),
            ("gone", "9", day, None, dt.date(2022, 1, 1))]
    journal = spark.createDataFrame([(p, c, d, d, e, x, None) for p, c, d, e, x in rows],
                                    "PATIENT_ID string, CODE string, RECORD_DATE date, REPORTING_PERIOD_END_DATE date, ETHNIC string, "
                                    "DATE_OF_DEATH date, YEAR_OF_DEATH int")
    # A second code on the same day makes the patient's own records conflict.
    journal = journal.union(spark.createDataFrame([("torn", "2", day, day, "B", None, None)], journal.schema))
    codes = spark.createDataFrame([("1", "A"), ("2", "C")], "code string, PrimaryCode string")
    ident = spark.createDataFrame([(i, p, 2021) for i, (p, *_) in enumerate(rows)], "k long, who string, y int")
    clinical = spark.createDataFrame([(i, later, "D", "P1", 2021) for i in range(len(rows))], "k long, day date, e string, gp string, y int")
    names = {"key": "k", "patient": "who", "date": "day", "ethnic": "e", "practice": "gp", "year": "y"}
    got = ethnicity_with_fallback(journal, codes, {"admitted": (ident, clinical, names)})
    assert {(r.PATIENT_ID, r.ETHNIC_CATEGORY_CODE) for r in got.collect()} == {("alive", "A"), ("none", "D")}


def test_pipelines_need_their_columns(spark):
    import pytest

    from phenoframe.schemas import normalise_journal, require

    df = spark.createDataFrame([("p",)], "PATIENT_ID string")
    for c in ("PRACTICE", "CODE"):
        df = df.withColumn(c, F.lit("x"))
    for c in ("REPORTING_PERIOD_END_DATE", "JOURNAL_REPORTING_PERIOD_END_DATE", "DATE", "RECORD_DATE", "DATE_OF_BIRTH"):
        df = df.withColumn(c, F.lit("2020-01-01").cast("date"))
    journal = normalise_journal(df.withColumn("VALUE1_CONDITION", F.lit(1.0)).withColumn("VALUE2_CONDITION", F.lit(1.0)))
    require(journal, "smoking")
    require(journal, "blood_pressure")
    for pipeline in ("bmi", "ethnicity"):
        with pytest.raises(ValueError):
            require(journal, pipeline)


def test_both_halves_are_pruned(spark, tmp_path):
    from phenoframe.plans.ethnicity import hospital_ethnicity
    from phenoframe.sources import fixtures

    halves = []
    for half, df in zip("ic", fixtures.hospital_halves(spark, "/root/testdata/sf0.001", "outpatient")):
        df.write.partitionBy("YEAR").parquet(str(tmp_path / half))
        halves.append(spark.read.parquet(str(tmp_path / half)))
    plan = hospital_ethnicity(*halves)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    parts = [f.split("PartitionFilters:")[1].split("PushedFilters")[0] for f in filters]
    assert len(parts) >= 2 and all("YEAR" in p and " IN " in p for p in parts), parts
