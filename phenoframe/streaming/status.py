"""Incremental status rows from a streaming journal.

Journal extracts arrive as new files.  The row-level stage of a pipeline --
tag with the code list (a stream-static broadcast join), band, drop the
indeterminable rows -- is stateless, so it runs unchanged on a streaming
DataFrame and appends status rows to a table.  The per-patient stage
(latest date, conflicts) depends on each patient's whole history; it runs as
a batch over that table with the same operator the pipelines use.

Only the single-reading pipelines are streamed this way (smoking, and the
HbA1c / non-fasting / random glucose readings); paired readings would need
stream-stream joins on the same-day keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.banding import (GLUCOSE_CATEGORIES, GLUCOSE_INDETERMINABLE, SMOKING_CATEGORIES,
                                 SMOKING_INDETERMINABLE)
from ..operators.selection import KEY, latest_consistent
from ..operators.tagging import tag_codes
from ..plans.glucose import non_fasting_status
from ..plans.smoking import categorise_smoking

# kind: (row-level stage, category column, column tested for the
# indeterminable label, that label, label set).  Smoking tests its first-level
# status, which is indeterminable exactly when the dictionary status is and
# keeps the pushed-down filter small (see plans.smoking).
KINDS = {
    "smoking": (lambda j, c: categorise_smoking(j, c), "DATA_DICTIONARY_CATS", "SMOKING_CATS",
                SMOKING_INDETERMINABLE, SMOKING_CATEGORIES),
    "glucose_single": (lambda j, c: non_fasting_status(tag_codes(j, c)), "CATEGORISED_BLOOD_GLUCOSE",
                       "CATEGORISED_BLOOD_GLUCOSE", GLUCOSE_INDETERMINABLE, GLUCOSE_CATEGORIES),
}


def status_rows(journal: DataFrame, codes: DataFrame, kind: str) -> DataFrame:
    """Known-status rows of one journal (streaming or batch)."""
    stage, _, tested, indeterminable, _ = KINDS[kind]
    return stage(journal, codes).filter(F.col(tested) != indeterminable)


def start_status_stream(journal_stream: DataFrame, codes: DataFrame, kind: str, path: str,
                        checkpoint_location: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append the status rows of a streaming journal to parquet at ``path``.

    The stream's progress is kept in ``checkpoint_location``, by default
    beside the output (one folder for each output), so a restarted query
    resumes where it stopped and another output starts from the beginning.
    """
    if checkpoint_location is None:
        checkpoint_location = f"{path.rstrip('/')}-progress"
    writer = (status_rows(journal_stream, codes, kind).writeStream.format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint_location).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest_from_status(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows on each patient's latest date, conflicts removed, from the
    accumulated status table."""
    _, cat, _, _, categories = KINDS[kind]
    return latest_consistent(spark.read.parquet(path), KEY, "DATE", cat, categories)
