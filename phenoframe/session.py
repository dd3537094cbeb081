"""Session settings the library is designed for.

Library functions never create or configure a session; ``get_session`` is
for scripts, tests and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Long rule chains (the smoking and blood-pressure bands) generate Java
# methods above HotSpot's 8,000-byte JIT limit, which would then run in the
# bytecode interpreter (measured: 5.8 s -> 1.2 s for banding 1M smoking rows
# once they may be compiled).
JIT_OPTIONS = "-XX:-DontCompileHugeMethods"

# Adaptive execution re-plans at run time: it coalesces small shuffle
# partitions, turns a join into a broadcast when a side proves small, and
# splits a skewed join partition (a patient holding a large share of rows)
# into several tasks.  Skew splitting is allowed even where it costs an
# extra shuffle, because a single hot task is the worse outcome.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.extraJavaOptions": JIT_OPTIONS,
    "spark.executor.extraJavaOptions": JIT_OPTIONS,
}


def get_session(master: str | None = None, app: str = "phenoframe", shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(RECOMMENDED_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
