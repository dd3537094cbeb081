"""Skew experiment: one patient holds a third of the journal, all on one date.

Writes the derived sf journal, reassigns a third of its rows to patient '0'
on the last day, runs pipelines with broadcast joins disabled and AQE skew
thresholds scaled to the small data, and reports whether the final adaptive
plan split the skewed (patient, date) join partition.

Usage: python tools/skew.py [SF_DIR]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

import bench  # noqa: E402
from phenoframe.plans import blood_pressure, ethnicity_recent_primary, smoking  # noqa: E402
from phenoframe.session import get_session  # noqa: E402
from phenoframe.sources.codelists import codelist_df  # noqa: E402


def hot_journal(j):
    h = F.xxhash64("LINKS") % 3 == 0
    return (j.withColumn("DATE", F.when(h, F.lit("2024-01-30").cast("date")).otherwise(F.col("DATE")))
             .withColumn("PATIENT_ID", F.when(h, F.lit("0")).otherwise(F.col("PATIENT_ID"))))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16, conf={
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        # Many small read tasks, as a large input would have: AQE splits a
        # skewed partition along map-output blocks, so a partition that one
        # map task produced (here: a domain's staged rows in one small file
        # with one row group) has nothing to split.  Small row groups and
        # read splits give the staged files many map tasks.
        "spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "16k",
        "spark.hadoop.parquet.block.size": str(256 * 1024)})
    scratch = tempfile.mkdtemp(prefix="phenoframe-skew-", dir="/tmp")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(scratch + "/ck")
    paths = bench.prepare(spark, sf, scratch + "/in")
    hot_journal(spark.read.parquet(paths["journal"])).write.parquet(scratch + "/hot")
    hot = spark.read.parquet(scratch + "/hot")
    print("hot patient share:", round(hot.filter("PATIENT_ID = '0'").count() / hot.count(), 3))
    for name, f in [("smoking", lambda: smoking(hot, codelist_df(spark, "smoking"))),
                    ("blood_pressure", lambda: blood_pressure(hot, codelist_df(spark, "bp"))),
                    ("ethnicity_recent_primary",
                     lambda: ethnicity_recent_primary(hot, codelist_df(spark, "ethnicity")))]:
        df = f()
        t = time.time()
        n = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [ln.strip() for ln in plan.splitlines() if re.search(r"Join", ln)]
        print(f"{name}: rows={n} {time.time() - t:.2f}s skew_split={'skew=true' in plan} "
              f"window={'Window' in plan}")
        for ln in joins[:3]:
            print("   ", ln[:110])


if __name__ == "__main__":
    main()
