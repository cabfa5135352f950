import os

import pytest

from quern.streaming import progress

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "events.parquet").symlink_to(f"{SF}/events.parquet")
    stream = progress.event_stream(spark, str(folder))
    got = {(r.run_id, r.events, r.stage) for r in progress.run_to_end(progress.latest_by_run(stream), "latest", "complete", str(tmp_path / "c")).collect()}
    batch = spark.read.parquet(f"{SF}/events.parquet")
    assert got == {(r.run_id, r.events, r.stage) for r in progress.latest_by_run(batch.withColumn("ts", batch.ts.cast("timestamp"))).collect()}
