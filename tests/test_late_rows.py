"""Statuses from narrow rows, rows brought back under salts, packed records and votes."""

import datetime as dt
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from phenoframe.functions.banding import (BP_BREAKS, BP_CATEGORIES, GLUCOSE_BREAKS, GLUCOSE_CATEGORIES, band, bp_value_rules,
                                          glucose_fasting_rules)
from phenoframe.operators import heavy, packed, staging
from phenoframe.operators.day_classes import agreeing_days, bit, extremes, inner_values, pair_table, piece
from phenoframe.operators.heavy import bring_back
from phenoframe.operators.pairing import PAIR_KEYS, day_pairs, pair_same_day
from phenoframe.operators.selection import latest_consistent
from phenoframe.plans import blood_glucose, blood_pressure, bmi, ethnicity_modal
from phenoframe.sources import fixtures
from phenoframe.sources.codelists import codelist_df
from phenoframe.sources.shards import YearPartitions, YearTables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rules, labels, breaks", [(bp_value_rules, BP_CATEGORIES, BP_BREAKS), (glucose_fasting_rules, GLUCOSE_CATEGORIES, GLUCOSE_BREAKS)])
def test_masks_give_the_categories_of_all_pairs(spark, rules, labels, breaks):
    """Of random sets of values on, beside and far from the break points."""
    rng = random.Random(8)

    def value(of):
        return rng.choice([rng.uniform(-5, of[-1] * 1.2), float(rng.choice(of)), rng.choice(of) + 1e-9, rng.choice(of) - 1e-9, float("nan"), 0.0])

    rows = [(k, [value(breaks[0]) for _ in range(rng.randint(1, 3))], [value(breaks[1]) for _ in range(rng.randint(1, 3))]) for k in range(800)]
    df = spark.createDataFrame(rows, "k int, l array<double>, r array<double>")
    pairs = df.select("k", F.explode("l").alias("VALUE1_CONDITION"), "r").select("k", "VALUE1_CONDITION", F.explode("r").alias("VALUE2_CONDITION"))
    positions = F.array_position(F.array(*map(F.lit, labels)), band(rules(), "none"))
    want = {r.k: (r.lo, r.hi) for r in pairs.select("k", F.when(positions > 0, positions).alias("p")).groupBy("k").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).collect()}
    table = pair_table(spark, rules(), labels, *map(inner_values, breaks), ("VALUE1_CONDITION", "VALUE2_CONDITION"), "DOUBLE")
    masks = pairs.groupBy("k").agg(F.bit_or(bit(piece(F.col("VALUE1_CONDITION"), breaks[0]))).alias("a"), F.bit_or(bit(piece(F.col("VALUE2_CONDITION"), breaks[1]))).alias("b"))
    low, high = extremes(table, F.col("a"), F.col("b"))
    got = {r.k: (r.lo, r.hi) for r in masks.select("k", low.alias("lo"), high.alias("hi")).collect()}
    assert got == want and len({v for v in want.values()}) > 5


def test_agreeing_days(spark):
    d = dt.date(1969, 5, 1)
    rows = [("a", d, 1, 1), ("a", dt.date(2020, 1, 1), 2, 2), ("a", dt.date(2021, 1, 1), None, None), ("b", d, 1, 2), ("c", d, None, None), (None, d, 1, 1),
            ("e", d, 3, 3), ("e", d, 3, 3), ("f", d, 1, 1), ("f", d, 3, 3), ("g", None, 1, 1)]
    got = agreeing_days(spark.createDataFrame(rows, "PATIENT_ID string, DATE date, _lo int, _hi int"), 3).collect()
    assert sorted(map(tuple, got)) == [("a", dt.date(2020, 1, 1)), ("e", d)]


def hot_rows(spark, n):
    """Two thirds of the rows are one patient's, on one day; another patient's many rows disagree."""
    day = F.lit(dt.date(2024, 1, 2))
    who = F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id") % 97)).when(F.col("id") % 3 == 1, "hot").otherwise("torn")
    return spark.range(n).select(who.alias("PATIENT_ID"), day.alias("DATE"), F.col("id"),
                                 F.when((F.col("id") == 2), "x").otherwise("y").alias("cat"))


def test_a_hot_patient_day_is_spread_without_adaptive_splitting(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(heavy, "LEAST_ROWS", 100)
    for name, value in (("spark.sql.adaptive.skewJoin.enabled", "false"), ("spark.sql.adaptive.coalescePartitions.enabled", "false"),
                        ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(name, value)
    try:
        hot_rows(spark, 30_000).coalesce(1).write.parquet(str(tmp_path / "rows"))
        rows = spark.read.parquet(str(tmp_path / "rows"))  # one map task
        got = latest_consistent(rows, "PATIENT_ID", "DATE", "cat", ["x", "y"], salted=True)
        spread = got.groupBy("PATIENT_ID", F.spark_partition_id().alias("part")).count().where("PATIENT_ID = 'hot'").collect()
        assert sum(r["count"] for r in spread) == 10_000 and len(spread) >= 8 and max(r["count"] for r in spread) < 3_000
        assert {r[0] for r in got.select("PATIENT_ID").distinct().collect()} == {"hot"} | {f"p{i}" for i in range(97)}
        assert got.count() == 20_000
    finally:
        for name in ("spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bring_back_equals_a_semi_join(spark, monkeypatch):
    monkeypatch.setattr(heavy, "LEAST_ROWS", 1)
    rng = random.Random(9)
    rows = spark.createDataFrame([(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([1, 2, None]), i) for i in range(500)], "k string, v int, i int")
    found = rows.where("k is not null").groupBy("k").agg(F.max("v").alias("v"))
    got = bring_back(rows, found, ["k", "v"])
    assert got.columns == rows.columns
    assert sorted(r.i for r in got.collect()) == sorted(r.i for r in rows.join(found, ["k", "v"], "left_semi").collect())


def test_day_pairs_are_the_distinct_pairs(spark):
    rng = random.Random(10)
    day = [dt.date(2024, 1, d) for d in (1, 2)]
    rows = [(rng.choice(["a", "b", None]), rng.choice(day), rng.choice(["P", None]), day[0], day[0], rng.choice("LRX"), rng.choice([1.0, 2.0, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {'string' if k in ('PATIENT_ID', 'PRACTICE') else 'date'}" for k in ["PATIENT_ID", "DATE", "PRACTICE", *PAIR_KEYS[3:]]) + ", side string, v double")
    got = day_pairs(df, F.col("side") == "L", F.col("side") == "R", {"lv": F.col("v")}, {"rv": F.col("v")})
    left, right = df.where("side = 'L'").withColumn("lv", F.col("v")), df.where("side = 'R'")
    want = pair_same_day(left, right, {"v": "rv"}).select(*PAIR_KEYS, "lv", "rv").distinct()
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and got.count() > 5


@pytest.mark.parametrize("name", ["blood_pressure", "blood_glucose", "bmi"])
def test_a_hot_patient_day_goes_through_the_pipelines(spark, name, monkeypatch):
    """A third of the rows are copies of one patient-day: same result as without the copies, which repeat distinct rows."""
    monkeypatch.setattr(heavy, "LEAST_ROWS", 20)
    domain = {"blood_pressure": "bp", "blood_glucose": "glucose", "bmi": "bmi"}[name]
    j = fixtures.journal(spark, SMALL, [domain])
    c = lambda n: codelist_df(spark, n)
    run = {"blood_pressure": lambda x: blood_pressure(x, c("bp")), "blood_glucose": lambda x: blood_glucose(x, c("glucose")),
           "bmi": lambda x: bmi(x, c("bmi"), c("height"), c("weight"), fixtures.lms_table(spark))}[name]
    busiest = j.where("PATIENT_ID is not null").groupBy("PATIENT_ID", "DATE").count().orderBy(F.desc("count"), "PATIENT_ID", "DATE").first()
    day = j.where((F.col("PATIENT_ID") == busiest[0]) & (F.col("DATE") == busiest[1]))
    copies = -(-j.count() // 2 // day.count())
    hot = j.unionByName(day.crossJoin(spark.range(copies)).drop("id"))
    assert sorted(map(repr, run(hot).collect())) == sorted(map(repr, run(j).collect()))


def test_packed_codes_and_records(spark):
    codes = ["A", "99", "abcde", " ", "Z1", "~"]
    df = spark.createDataFrame([(c, dt.date(y, 1, 1)) for c in codes for y in (1800, 1969, 1970, 2024)], "c string, d date")
    best, least = packed.pack_record(F.col("d"), 3, F.col("c"))
    for col in (best, least):
        assert [r.c for r in df.collect()] == [r.x for r in df.select(packed.unpack_code(packed.code_of(col)).alias("x")).collect()]
    got = df.select("d", packed.day_of(best).alias("day"), packed.priority_of(best).alias("p")).collect()
    assert all(r.d == r.day and r.p == 3 for r in got)
    for wrong in ("abcdef", "é"):
        with pytest.raises(Exception, match="five ASCII"):
            spark.createDataFrame([(wrong,)], "c string").select(packed.pack_code(F.col("c"))).collect()


def test_votes(spark):
    """Against counting: patients with up to one code outside the list."""
    rng = random.Random(12)
    listed = [f"C{i}" for i in range(17)]
    votes = [(p, rng.randrange(5), rng.choice(listed[:rng.randint(1, 17)] + [f"R{p % 3}"])) for p in range(60) for _ in range(rng.randint(1, 12))]
    df = spark.createDataFrame(votes, "k int, s int, c string")
    parts = [df.where(F.col("s") == s).select("k", *[v.alias(n) for n, v in packed.vote(F.col("c"), s, listed).items()]) for s in range(5)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    winner, unique = packed.unique_winner(listed)
    got = {r.k: r.c for r in rows.groupBy("k").agg(*packed.gathered(listed)).where(unique).select("k", winner.alias("c")).collect()}
    want = {}
    for p, own in itertools.groupby(sorted(set(votes)), key=lambda v: v[0]):
        counts = {}
        for _, _, c in own:
            counts[c] = counts.get(c, 0) + 1
        top = [c for c, n in counts.items() if n == max(counts.values())]
        if len(top) == 1:
            want[p] = top[0]
    assert got == want and 10 < len(want) < 60
    two = spark.createDataFrame([(1, "Q"), (1, "V")], "k int, c string").select("k", *[v.alias(n) for n, v in packed.vote(F.col("c"), 0, listed).items()])
    with pytest.raises(Exception, match="not listed"):
        two.groupBy("k").agg(*packed.gathered(listed)).where(unique).select(winner).collect()


def test_modal_takes_other_lists_of_categories(spark):
    j, codes = fixtures.journal(spark, SMALL, ["ethnicity"]), codelist_df(spark, "ethnicity")
    want = sorted(map(tuple, ethnicity_modal(j, codes, {}).collect()))
    assert want and sorted(map(tuple, ethnicity_modal(j, codes, {}, categories=[f"U{i}" for i in range(40)] + list("ABCDEFGHJKLMNPRSTW")).collect())) == want


def jobs_of(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return f(), list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_years_come_from_names_without_a_job(spark, tmp_path):
    spark.range(60).selectExpr("id", "2010 + id % 9 YEAR").write.partitionBy("YEAR").parquet(str(tmp_path / "t"))
    assert jobs_of(spark, "folder", lambda: YearPartitions(spark, folder=str(tmp_path / "t")).years(2)) == ([2018, 2017], [])
    spark.sql("CREATE DATABASE IF NOT EXISTS years_db")
    try:
        spark.catalog.createTable("years_db.part", path=str(tmp_path / "t"), source="parquet")
        spark.sql("MSCK REPAIR TABLE years_db.part")
        table = YearPartitions(spark, table="years_db.part")
        assert jobs_of(spark, "table", lambda: table.years(3)) == ([2018, 2017, 2016], [])
        assert table.read([2018]).count() == 6
        for y, columns in ((2020, "1 A_KEY, 'x' OLD"), (2021, "2 A_KEY, 'y' NEW"), (2022, "3 A_KEY")):
            spark.sql(f"SELECT {columns}").write.option("path", str(tmp_path / str(y))).saveAsTable(f"years_db.hes_op_{y}")
        tables = YearTables(spark, "years_db", "op", "hes_", {"EPISODE_KEY": "A_KEY", "ETHNIC_CODE": "NEW", "PRACTICE_CODE": "GONE"}, {2020: {"ETHNIC_CODE": "OLD"}})
        assert jobs_of(spark, "tables", lambda: tables.years()) == ([2022, 2021, 2020], [])
        got = tables.read(tables.years())
        assert sorted((r.EPISODE_KEY, r.ETHNIC_CODE, r.YEAR, r.PRACTICE_CODE) for r in got.collect()) == [(1, "x", 2020, None), (2, "y", 2021, None), (3, None, 2022, None)]
    finally:
        spark.sql("DROP DATABASE years_db CASCADE")


def test_bucketed_halves_join_without_a_shuffle(spark, tmp_path):
    from phenoframe.operators.hospital import join_halves
    from phenoframe.sources.shards import write_bucketed

    spark.sql("CREATE DATABASE IF NOT EXISTS bucket_db")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        halves = fixtures.hospital_halves(spark, SMALL, "admitted")
        tables = [write_bucketed(h, f"bucket_db.half_{i}", 4, path=str(tmp_path / str(i))) for i, h in enumerate(halves)]
        years, jobs = jobs_of(spark, "buckets", lambda: tables[0].years(3))
        assert len(years) == 3 and not jobs
        got = join_halves(*[t.read(years) for t in tables])
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = join_halves(*halves).where(F.col("YEAR").isin(years))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucket_db CASCADE")


def test_runs_have_their_own_ledgers(spark):
    folder = staging.checkpoint_folder(spark.range(1))

    def there():
        return {f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("phenoframe-")}

    before = there()
    with staging.staged_run(spark):
        staging.materialise(spark.range(3))
        with staging.staged_run(spark):
            staging.materialise(spark.range(3))
            assert len(there() - before) == 2
        assert len(there() - before) == 1
    assert there() == before
