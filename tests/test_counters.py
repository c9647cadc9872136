"""Counting in the pass, sessions merged early, and answers from the buckets that a batch touches."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff
from tidemark.sources import stores
from tidemark.streaming import counters, session_streams as ss, state_streams as st
from tidemark.streaming.runs import append_available, read_stream

OFFER = "file_id bigint, path array<string>, size bigint, mtime bigint, mode int, hash string"


def test_counters_add_up_over_batches(spark, data, tmp_path):
    seen = counters.Counters()
    spark.streams.addListener(seen)
    try:
        root = str(tmp_path / "in")
        for i in range(3):
            spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(root)
        rows = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(root)
        running = append_available(counters.counted(rows, ids=F.col("id")), str(tmp_path / "out"), str(tmp_path / "check"), {"processingTime": "1 second"})
        running.processAllAvailable()
        while len(seen._batches) < 3:
            running.processAllAvailable()
        assert seen.totals(str(running.id)) == {"files": 30, "ids": sum(range(30))} == seen.totals()
        assert seen.totals("another") == {}
        running.stop()
    finally:
        spark.streams.removeListener(seen)


def test_a_busy_key_is_merged_before_the_shuffle(spark, data, tmp_path):
    events = read_stream(spark, data, "events").select(F.lit("hot").alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    with ss.merging_early(spark):
        query = ss.stream_idle_sessions(events, ["k"], "6 hours").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c"))
        running = query.trigger(availableNow=True).start()
        running.awaitTermination()
        assert spark.conf.get(ss.MERGE_EARLY) == "true"
        plan = running._jsq.explainInternal(False)
    assert spark.conf.get(ss.MERGE_EARLY) == "false"
    before_the_shuffle = plan[plan.rindex("Exchange") :]
    assert "MergingSessions" in before_the_shuffle


def test_a_batch_reads_the_buckets_that_it_touches(spark, tmp_path):
    held = spark.createDataFrame([([f"f{i}"], 10, 5, None) for i in range(400)], "path array<string>, size bigint, mtime bigint, hash string")
    dest = str(tmp_path / "held")
    st.publish_listing(held, dest, 64)
    layout = stores.bucket_map(spark, dest)
    one = spark.createDataFrame([(["f7"],), (["none"],)], "path array<string>")
    near = st.listing_near(spark, dest, one)
    assert len(layout.held) == 64 and len(near.inputFiles()) <= 2 and near.filter("path[0] = 'f7'").count() == 1
    root = str(tmp_path / "in")
    offers = [(i, [f"f{i * 3}"], 10 + i % 2, 5, 0, None) for i in range(200)]
    for part in range(4):
        spark.createDataFrame(offers[part * 50 : part * 50 + 50], OFFER).coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(OFFER).option("maxFilesPerTrigger", 1).parquet(root)
    st.run_sync(stream, dest, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    expected = diff.decide(spark.createDataFrame(offers, OFFER), held)
    assert got.select(*expected.columns).exceptAll(expected).count() == 0 and got.count() == 200


@pytest.mark.parametrize("rows", [0, 1])
def test_a_listing_that_was_never_published_holds_nothing(spark, tmp_path, rows):
    offered = spark.createDataFrame([(["a"],)] * rows, "path array<string>")
    assert st.listing_near(spark, str(tmp_path / "none"), offered).count() == 0
