"""Scaling experiment: the pipelines and the published-shape baseline on
``events`` / ``orders`` replicated N times (patients and ids shifted per
copy, so each copy is a new set of patients with the same density).

Usage: python tools/scale.py N [SF_DIR]   -> one JSON line
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

import bench  # noqa: E402
from phenoframe.session import get_session  # noqa: E402


def replicate(spark, sf: str, n: int, out: str) -> None:
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_copy")
    ev = spark.read.parquet(f"{sf}/events.parquet").select("*", copy)
    ev.select((F.col("event_id") + F.col("_copy") * 10_000_000).alias("event_id"), "ts",
              (F.col("user_id") + F.col("_copy") * 1_000_000).alias("user_id"), "event_type", "value", "props") \
        .write.mode("overwrite").parquet(f"{out}/events.parquet")
    od = spark.read.parquet(f"{sf}/orders.parquet").select("*", copy)
    # o_custkey % 200 is the hospital patient; shift it by whole copies of 1,000,000.
    od.select((F.col("o_orderkey") + F.col("_copy") * 100_000_000).alias("o_orderkey"),
              (F.col("o_custkey") % 200 + F.col("_copy") * 1_000_000).alias("o_custkey"),
              "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority") \
        .write.mode("overwrite").parquet(f"{out}/orders.parquet")


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 10
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = get_session("local[8]", shuffle_partitions=32, conf={"spark.driver.memory": "8g"})
    scratch = tempfile.mkdtemp(prefix="phenoframe-scale-", dir="/tmp")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{scratch}/ck")
    replicate(spark, sf, n, f"{scratch}/sf")
    paths = bench.prepare(spark, f"{scratch}/sf", f"{scratch}/in")
    rows = spark.read.parquet(paths["journal"]).count()
    ours, ref = bench.pipelines(spark, paths), bench.baseline_pipelines(spark, paths)
    res = {"copies": n, "journal_rows": rows, "phenoframe": {}, "published_shape": {}}
    for name in ours:
        for label, todo in (("phenoframe", ours), ("published_shape", ref)):
            bench.run_once(todo[name])
            res[label][name] = round(statistics.median(bench.run_once(todo[name]) for _ in range(runs)), 2)
    run = bench.combined_banded(spark, paths)
    run()
    samples = []
    for _ in range(runs):
        t = time.perf_counter(); run(); samples.append(time.perf_counter() - t)
    res["banded_one_scan"] = round(statistics.median(samples), 2)
    res["phenoframe_total"] = round(sum(res["phenoframe"].values()), 2)
    res["published_shape_total"] = round(sum(res["published_shape"].values()), 2)
    print(json.dumps(res))


if __name__ == "__main__":
    main()
