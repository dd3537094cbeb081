import os
import tempfile

from phenoframe.plans import smoking
from phenoframe.sources import fixtures
from phenoframe.sources.codelists import codelist_df
from phenoframe.streaming.status import latest_from_status, start_status_stream, status_rows

from conftest import SF_SMALL


def test_streamed_status_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="phenoframe-stream-", dir="/tmp")
    journal = fixtures.journal(spark, SF_SMALL, ["smoking"])
    src = os.path.join(base, "journal")
    # Two extracts arriving one after the other.
    journal.filter("DATE < DATE '2024-01-15' OR DATE IS NULL") \
        .write.parquet(os.path.join(src, "part=1"))
    journal.filter("DATE >= DATE '2024-01-15'").write.parquet(os.path.join(src, "part=2"))
    codes = codelist_df(spark, "smoking")
    stream = spark.readStream.schema(journal.schema).parquet(src + "/*")
    out = os.path.join(base, "status")
    q = start_status_stream(stream, codes, "smoking", out, os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(out)
    batch = status_rows(journal, codes, "smoking")
    assert sorted(map(tuple, streamed.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    latest = latest_from_status(spark, out, "smoking")
    want = smoking(journal, codes).drop("AGE_AT_TIME_OF_JOURNAL")
    assert sorted(map(tuple, latest.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_two_outputs_of_one_journal_are_both_whole(spark, tmp_path):
    from phenoframe.sources import fixtures
    from phenoframe.sources.codelists import codelist_df

    fixtures.journal(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "journal"))
    schema = spark.read.parquet(str(tmp_path / "journal")).schema
    rows = []
    for out in ("one", "two"):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "journal"))
        start_status_stream(stream, codelist_df(spark, "smoking"), "smoking", str(tmp_path / out)).awaitTermination()
        rows.append(spark.read.parquet(str(tmp_path / out)).count())
    assert rows[0] == rows[1] > 0
