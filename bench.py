"""Benchmark: the seven pipelines at one scale factor.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (timed runs per query, default 3; one warm-up run
precedes them).

Set-up (not timed): the synthetic journal and hospital episode halves are
derived from the scale factor's ``events`` / ``orders`` and written once as
parquet (hospital halves partitioned by YEAR), the way the real inputs are
stored tables.  Each pipeline then reads those tables and is executed in
full into Spark's ``noop`` sink (nothing is collected to the driver).  The
pipelines checkpoint intermediate results into ``spark.checkpoint.dir``;
when the session names none, a fresh scratch folder is used.

Baseline: the same pipelines in the published plan shape -- a separate
journal scan per code list, no checkpoints, UNION (distinct) first, latest
record by MAX + join-back, conflicts by COUNT(DISTINCT) + IN, per-source
latest chains for ethnicity -- built from the same rule and branch
functions, run on the same machine and inputs (``BENCH_BASELINE=0`` skips
it).

Prints one JSON line; ``value`` is the sum over pipelines of the median
run time; ``baseline`` holds the published-shape medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from phenoframe.functions.banding import (BP_INDETERMINABLE, GLUCOSE_INDETERMINABLE,  # noqa: E402
                                          KNOWN_CHILD_CATEGORIES, SMOKING_INDETERMINABLE, band,
                                          smoking_dictionary_rules, smoking_rules)
from phenoframe.operators.selection import KEY, dedupe_observations  # noqa: E402
from phenoframe.operators.tagging import tag_codes  # noqa: E402
from phenoframe.operators.union import union_sources  # noqa: E402
from phenoframe.plans import (blood_glucose, blood_pressure, bmi, ethnicity_modal,  # noqa: E402
                              ethnicity_recent_all, ethnicity_recent_primary, smoking)
from phenoframe.plans import body_mass as B  # noqa: E402
from phenoframe.plans import ethnicity as E  # noqa: E402
from phenoframe.plans.blood_pressure import numeric_readings, text_readings  # noqa: E402
from phenoframe.plans.combined import banded_phenotypes  # noqa: E402
from phenoframe.plans.glucose import fasting_status, non_fasting_status  # noqa: E402
from phenoframe.session import get_session  # noqa: E402
from phenoframe.sources import fixtures  # noqa: E402
from phenoframe.sources.codelists import codelist_df  # noqa: E402
from phenoframe.sources.shards import YearPartitions  # noqa: E402


def prepare(spark, sf: str, scratch: str) -> dict:
    """Write the derived inputs once; return readers for them."""
    jpath = f"{scratch}/journal"
    fixtures.journal(spark, sf).write.mode("overwrite").parquet(jpath)
    hosp = {}
    for ds in fixtures.HOSPITAL_DATASETS:
        ident, clinical = fixtures.hospital_halves(spark, sf, ds)
        ident.write.mode("overwrite").partitionBy("YEAR").parquet(f"{scratch}/{ds}_ident")
        clinical.write.mode("overwrite").partitionBy("YEAR").parquet(f"{scratch}/{ds}_clinical")
        hosp[ds] = (f"{scratch}/{ds}_ident", f"{scratch}/{ds}_clinical")
    return {"journal": jpath, "hospital": hosp}


def pipelines(spark, paths: dict) -> dict:
    def j():
        return spark.read.parquet(paths["journal"])

    def hospital():
        return {k: tuple(YearPartitions(spark, folder=p) for p in halves) for k, halves in paths["hospital"].items()}

    def c(name):
        return codelist_df(spark, name)

    return {
        "smoking": lambda: smoking(j(), c("smoking")),
        "blood_glucose": lambda: blood_glucose(j(), c("glucose")),
        "blood_pressure": lambda: blood_pressure(j(), c("bp")),
        "bmi": lambda: bmi(j(), c("bmi"), c("height"), c("weight"), fixtures.lms_table(spark)),
        "ethnicity_recent_primary": lambda: ethnicity_recent_primary(j(), c("ethnicity")),
        "ethnicity_recent_all": lambda: ethnicity_recent_all(j(), c("ethnicity"), hospital()),
        "ethnicity_modal": lambda: ethnicity_modal(j(), c("ethnicity"), hospital()),
    }


# ---------------------------------------------------------------------------
# Published plan shape (baseline)
# ---------------------------------------------------------------------------

def _max_join_back(df, date="DATE", key=KEY):
    latest = df.groupBy(key).agg(F.max(date).alias("_d"))
    return df.join(latest, (df[key] == latest[key]) & (df[date] == latest["_d"])).drop(latest[key]).drop("_d")


def _count_distinct_in(df, cat, key=KEY, count=None):
    agg = F.count(F.lit(1)) if count == "rows" else F.countDistinct(cat)
    ok = df.groupBy(key).agg(agg.alias("_n")).filter("_n = 1").select(key)
    return df.join(ok, key, "left_semi")


def _in_list(journal, codes):
    """Tag, then CODE IN (SELECT DISTINCT code ...): the list is read twice."""
    tagged = tag_codes(journal, codes)
    listed = codes.select(F.col("code").alias("CODE")).distinct()
    return tagged.join(listed, "CODE", "left_semi")


def baseline_pipelines(spark, paths: dict) -> dict:
    def j():
        return spark.read.parquet(paths["journal"])

    def c(name):
        return codelist_df(spark, name)

    def hospital():
        return {k: (spark.read.parquet(paths["hospital"][k][0]), spark.read.parquet(paths["hospital"][k][1]))
                for k in ("admitted", "emergency", "outpatient")}

    def smoking_ref():
        t = _in_list(j(), c("smoking"))
        cats = (t.withColumn("SMOKING_CATS", band(smoking_rules(), SMOKING_INDETERMINABLE))
                .withColumn("DATA_DICTIONARY_CATS", band(smoking_dictionary_rules(), "Ex-Smoker")))
        known = cats.filter(F.col("DATA_DICTIONARY_CATS") != SMOKING_INDETERMINABLE)
        return _count_distinct_in(_max_join_back(known), "DATA_DICTIONARY_CATS")

    def glucose_ref():
        t = _in_list(j(), c("glucose"))
        known = [x.filter(F.col("CATEGORISED_BLOOD_GLUCOSE") != GLUCOSE_INDETERMINABLE)
                 for x in (non_fasting_status(t), fasting_status(t))]
        return _count_distinct_in(_max_join_back(union_sources(known)), "CATEGORISED_BLOOD_GLUCOSE")

    def bp_ref():
        t = _in_list(j(), c("bp"))
        num, txt = numeric_readings(t), text_readings(t)
        cols = list(num.columns[:-1]) + ["SBP_CATS", "DBP_CATS", "FINAL_BP_CATS"]
        status = union_sources([num.filter(F.col("FINAL_BP_CATS") != BP_INDETERMINABLE),
                                txt.filter(F.col("FINAL_BP_CATS") != BP_INDETERMINABLE)], columns=cols)
        return _count_distinct_in(_max_join_back(status), "FINAL_BP_CATS")

    def bmi_ref():
        bj = _in_list(j(), c("bmi"))
        h, w = _in_list(j(), c("height")), _in_list(j(), c("weight"))
        lms = fixtures.lms_table(spark)
        known = F.col("CENTILE_CLINICAL_BMI_CAT").isin(KNOWN_CHILD_CATEGORIES)

        def shape(df, bmi_col, cat_col, origin):
            return df.select(*B.RESULT_COLUMNS[:11], F.col(bmi_col).alias("BMI"),
                             F.col(cat_col).alias("BMI_CATEGORY"), F.lit(origin).alias("TABLE_ORIGIN"))
        parts = [
            shape(B.adult_coded(bj), "VALUE1_CONDITION", B.CAT, "BMI (ADULT)"),
            shape(B.adult_height_weight(h, w).withColumn("_b", F.coalesce("BMI", "VALUE1_CONDITION")), "_b",
                  B.CAT, "HW (ADULT)"),
            shape(B.child_height_weight_centiles(h, w, lms).filter(known), "BMI", "CENTILE_CLINICAL_BMI_CAT",
                  "HW (CHILD) CENTILE"),
            shape(B.child_bmi_centiles(bj, lms).filter(known), "BMI", "CENTILE_CLINICAL_BMI_CAT",
                  "CHILD BMI CENTILE"),
            shape(B.child_centile_codes(bj).filter(F.col(B.CAT).isin(KNOWN_CHILD_CATEGORIES)), "VALUE1_CONDITION",
                  B.CAT, "BMI - CENTILE"),
        ]
        return _count_distinct_in(_max_join_back(union_sources(parts)), "BMI_CATEGORY")

    def eth_sources(hosp):
        journal = j()
        codes = c("ethnicity")
        labels = E.RECENT_LABELS
        jg = dedupe_observations(E.journal_ethnicity(journal, codes), KEY, "RECORD_DATE", "ETHNICITY",
                                 "PrimaryCode")
        pg = dedupe_observations(E.patient_ethnicity(journal), KEY, "REPORTING_PERIOD_END_DATE", "ETHNICITY",
                                 "ETHNIC")
        srcs = [(jg, "RECORD_DATE", E.JOURNAL), (pg, "REPORTING_PERIOD_END_DATE", E.PATIENT)]
        for k in (hosp or {}):
            ident, clinical = hosp[k]
            h = E.hospital_ethnicity(ident, clinical).withColumnRenamed("ETHNIC_CODE", "ETHNICITY")
            srcs.append((dedupe_observations(h, KEY, "EVENT_DATE", "ETHNICITY"), "EVENT_DATE", k))
        out = []
        for df, date, source in srcs:
            latest = _max_join_back(df, date)
            out.append(latest.select(KEY, "ETHNICITY", F.col(date).alias("RECORDED_DATE"),
                                     F.lit(labels[source]).alias("SOURCE"), F.lit(E.PRIORITY[source]).alias("PRIORITY")))
        return out, journal

    def eth_recent_ref(hosp):
        parts, journal = eth_sources(hosp)
        recent = _max_join_back(union_sources(parts), "RECORDED_DATE")
        minp = recent.groupBy(KEY).agg(F.min("PRIORITY").alias("_p"))
        prio = recent.join(minp, (recent[KEY] == minp[KEY]) & (recent["PRIORITY"] == minp["_p"])).drop(minp[KEY])
        asset = _count_distinct_in(prio, "ETHNICITY", count="rows")
        alive = journal.filter(F.col("DATE_OF_DEATH").isNull()).select(KEY).distinct()
        return asset.join(alive, KEY, "left_semi")

    def eth_modal_ref():
        journal = j()
        codes = c("ethnicity")
        jg = dedupe_observations(E.journal_ethnicity(journal, codes), KEY, "RECORD_DATE", "ETHNICITY", "PrimaryCode")
        pg = dedupe_observations(E.patient_ethnicity(journal), KEY, "REPORTING_PERIOD_END_DATE", "ETHNICITY",
                                 "ETHNIC")
        votes = [jg.select(KEY, "ETHNICITY", F.lit("Journal").alias("SOURCE")),
                 pg.select(KEY, "ETHNICITY", F.lit("Patient").alias("SOURCE"))]
        for k, (ident, clinical) in hospital().items():
            votes.append(E.hospital_ethnicity(ident, clinical).select(
                KEY, F.col("ETHNIC_CODE").alias("ETHNICITY"), F.lit(k).alias("SOURCE")))
        counts = union_sources(votes).groupBy(KEY, "ETHNICITY").agg(F.count(F.lit(1)).alias("_n"))
        top = counts.groupBy(KEY).agg(F.max("_n").alias("_m"))
        modal = counts.join(top, (counts[KEY] == top[KEY]) & (counts["_n"] == top["_m"])).drop(top[KEY])
        return _count_distinct_in(modal, "ETHNICITY").select(KEY, F.col("ETHNICITY").alias("ETHNIC_CATEGORY_CODE"))

    return {
        "smoking": smoking_ref,
        "blood_glucose": glucose_ref,
        "blood_pressure": bp_ref,
        "bmi": bmi_ref,
        "ethnicity_recent_primary": lambda: eth_recent_ref(None),
        "ethnicity_recent_all": lambda: eth_recent_ref(hospital()),
        "ethnicity_modal": eth_modal_ref,
    }


BANDED = ["smoking", "blood_glucose", "blood_pressure", "bmi"]


def combined_banded(spark, paths: dict):
    """The four banded pipelines from one journal scan (plans.combined)."""
    def c(name):
        return codelist_df(spark, name)

    def run():
        res = banded_phenotypes(spark.read.parquet(paths["journal"]), c("smoking"), c("glucose"), c("bp"),
                                c("bmi"), c("height"), c("weight"), fixtures.lms_table(spark))
        for df in res.values():
            df.write.format("noop").mode("overwrite").save()
    return run


def run_once(build) -> float:
    t = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(f"local[{cpus}]", app="phenoframe-bench", shuffle_partitions=cpus * 2,
                        conf={"spark.driver.memory": "8g"})
    shared = spark.conf.get("spark.checkpoint.dir", None)
    scratch = shared or tempfile.mkdtemp(prefix="phenoframe-bench-", dir="/tmp")
    if not shared:
        spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
    paths = prepare(spark, sf, f"{scratch}/inputs")
    todo = pipelines(spark, paths)
    names = sys.argv[1:] or list(todo)
    times = {}
    for name in names:
        run_once(todo[name])  # warm-up: JIT, file listing, code generation
        times[name] = round(statistics.median(run_once(todo[name]) for _ in range(runs)), 3)
    combined = None
    if all(n in names for n in BANDED):
        run = combined_banded(spark, paths)
        t = time.perf_counter(); run()
        samples = []
        for _ in range(runs):
            t = time.perf_counter(); run(); samples.append(time.perf_counter() - t)
        combined = round(statistics.median(samples), 3)
    base = {}
    if os.environ.get("BENCH_BASELINE", "1") == "1":
        ref = baseline_pipelines(spark, paths)
        for name in names:
            run_once(ref[name])
            base[name] = round(statistics.median(run_once(ref[name]) for _ in range(runs)), 3)
    sf_value = os.path.basename(sf.rstrip("/")).replace("sf", "")
    out = {"metric": "pipelines_total_median_sec", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(sf_value) if sf_value else sf,
           "cpus": cpus, "runs": runs}
    if combined is not None:
        out["banded_one_scan"] = {"value": combined,
                                  "separate_sum": round(sum(times[n] for n in BANDED), 3)}
    if base:
        out["baseline"] = {"shape": "published (MAX + join-back, COUNT DISTINCT + IN, no checkpoints)",
                           "value": round(sum(base.values()), 3), "queries": base}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
