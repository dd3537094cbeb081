"""Print plan statistics (exchanges, scans, pushed filters) per pipeline over
stored inputs.

Usage: python tools/plans.py SF_DIR SCRATCH [name ...] [--full | --markdown]

``--markdown`` prints, per pipeline, the operator tree of the final stage
(after the pipeline's checkpoints) and every scan's pushed filters,
partition filters and read schema -- the content of docs/PLANS.md.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import bench  # noqa: E402
from phenoframe.session import get_session  # noqa: E402


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    full = "--full" in sys.argv
    markdown = "--markdown" in sys.argv
    sf, scratch = args[0], args[1]
    spark = get_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setCheckpointDir(f"{scratch}/ckpt")
    paths = bench.prepare(spark, sf, f"{scratch}/inputs")
    todo = bench.pipelines(spark, paths)
    if markdown:
        from phenoframe.operators.tagging import tag_codes
        from phenoframe.sources.codelists import codelist_df
        # The stage every banded pipeline checkpoints first: one journal scan
        # and a broadcast hash join with the (size-checked) code list.
        todo = {"tagging stage (checkpointed by each banded pipeline)":
                lambda: tag_codes(spark.read.parquet(paths["journal"]), codelist_df(spark, "bp")), **todo}
    for name in args[2:] or list(todo):
        df = todo[name]()
        plan = df._jdf.queryExecution().executedPlan().toString()
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted") if full else plan
        ex = len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition|Exchange RoundRobin", plan))
        bx = len(re.findall(r"BroadcastExchange", plan))
        scans = len(re.findall(r"FileScan|Scan ExistingRDD|Scan parquet|Scan ", plan))
        if markdown:
            fmt = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            tree = [ln for ln in fmt.splitlines()
                    if re.match(r"^[ :+|-]*[A-Z][A-Za-z]+[^#]*\(\d+\)$", ln) and not ln.startswith("Arguments")]
            scan_info = [ln for ln in fmt.splitlines()
                         if re.match(r"^\(\d+\) Scan|^(PushedFilters|PartitionFilters|ReadSchema):", ln)]
            print(f"### {name}\n\nshuffles={ex}, broadcasts={bx}, scans={scans}\n\n```")
            print("\n".join(tree))
            print("```\n\n```")
            print("\n".join(scan_info))
            print("```\n")
            continue
        print(f"== {name}: shuffles={ex} broadcasts={bx} scans={scans}")
        if full:
            print(text)


if __name__ == "__main__":
    main()
