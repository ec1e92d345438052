"""The progress store: bounded files, restarts, batches that run twice."""

import pytest
from pyspark.sql import functions as F

from aeroframe.streaming import telemetry

SCHEMA = "plan_id long, line_index int, completion_pct double"


def names(path):
    return sorted(p.name for p in path.iterdir())


def test_files_stay_few_and_nothing_is_lost(spark, tmp_path):
    at = tmp_path / "progress"
    want = {}
    for batch in range(30):
        store = telemetry.ProgressStore(spark, f"file://{at}", every=4)  # a restart each time
        rows = [(batch % 5, batch % 3, float(batch)), (99, batch, 1.0)]
        store.save(spark.createDataFrame(rows, SCHEMA).coalesce(1), batch)
        want |= {(a, b): c for a, b, c in rows}
        if batch in (9, 17):  # the same batch again: after a log, and after its snapshot
            store.save(spark.createDataFrame(rows, SCHEMA), batch)
        if batch % 7 == 0 or batch > 26:
            got = {(r.plan_id, r.line_index): r.completion_pct for r in telemetry.saved_progress(spark, str(at)).collect()}
            assert got == want
        assert len(names(at)) <= 2 + 4
    assert names(at) == ["log-000000028", "log-000000029", "pointer-000000027", "snapshot-000000027"]
    telemetry.ProgressStore(spark, str(at), every=4).save(spark.createDataFrame([(1, 1, -5.0)], SCHEMA), 27)  # long since saved
    assert telemetry.saved_progress(spark, str(at)).where("completion_pct < 0").count() == 0


def test_torn_writes_are_ignored(spark, tmp_path):
    at = tmp_path / "progress"
    store = telemetry.ProgressStore(spark, str(at), every=3)
    for batch in range(2):
        store.save(spark.createDataFrame([(1, batch, 10.0)], SCHEMA), batch)
    # a snapshot without its pointer, and a log that was not finished
    spark.createDataFrame([(7, 7, 7.0)], SCHEMA).withColumn("batch", F.lit(2).cast("long")).write.parquet(str(at / "snapshot-000000002"))
    spark.createDataFrame([(8, 8, 8.0)], SCHEMA).withColumn("batch", F.lit(2).cast("long")).write.parquet(str(at / "log-000000002"))
    (at / "log-000000002" / "_SUCCESS").unlink()
    assert {r.plan_id for r in telemetry.saved_progress(spark, str(at)).collect()} == {1}
    store.save(spark.createDataFrame([(2, 2, 20.0)], SCHEMA), 2)  # the batch runs again
    assert {r.plan_id for r in telemetry.saved_progress(spark, str(at)).collect()} == {1, 2}
    assert telemetry.saved_progress(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("n", [13])
def test_a_stream_over_many_triggers(spark, tmp_path, n):
    flown = spark.range(n * 40).selectExpr("id % 6 as plan_id", "cast(id % 4 as int) as line_index", "cast(id % 50 as int) as wp_index", "50 as n_wp")
    flown.repartition(n).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flown.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress = telemetry.line_progress(stream)
    telemetry.persist_progress(progress, str(tmp_path / "out"), str(tmp_path / "check"), every=None, snapshot_every=5).awaitTermination()
    want = {(r[0], r[1]): r[2] for r in telemetry.line_progress(flown).collect()}
    assert {(r[0], r[1]): r[2] for r in telemetry.saved_progress(spark, str(tmp_path / "out")).collect()} == want
    assert len(names(tmp_path / "out")) <= 2 + 5
