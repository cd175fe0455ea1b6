"""Every live job, fed in several micro-batches, equals its batch twin."""

import tempfile

import pytest
from pyspark.sql import functions as F

from waymeld.operators.intervals import interval_union
from waymeld.plans.catalogue import QUERIES
from waymeld.plans.live import live_trace
from waymeld.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tables):
    """The trace in three files by time, so a stream sees three ordered batches."""
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = live_trace(tables)
    for part in range(3):
        lo, hi = part * 30, part * 30 + 30 if part < 2 else 10_000
        rows.where(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").parquet(folder)
    return folder, rows.schema


def drain(spark, stream):
    out, marks = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.read.schema(stream.schema).parquet(out)


def rows_of(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.mark.parametrize("job, name", [(jobs.trip_starts, "st02_trip_starts"), (jobs.station_events, None), (jobs.context_events, "st06_context_events"),
                                       (jobs.place_departures, "st07_place_departures"), (jobs.origins, "st12_origin_recovery")])
def test_machine_jobs_equal_batch(spark, feed, job, name):
    folder, schema = feed
    live = drain(spark, job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)))
    if name is None:
        assert live.where("event = 'arrival'").count() > 0
        return
    assert rows_of(live, live.columns) == rows_of(QUERIES[name](spark, SF), live.columns)


def test_stops_close_as_they_end(spark, feed):
    folder, schema = feed
    live = drain(spark, jobs.venue_stops(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)))
    batch = set(rows_of(QUERIES["st04_venue_stops"](spark, SF), live.columns))
    got = set(rows_of(live, live.columns))
    assert got and got <= batch


def test_accepted_fixes_drop_repeats(spark, feed):
    folder, schema = feed
    doubled = tempfile.mkdtemp(prefix="spark-")
    rows = spark.read.schema(schema).parquet(folder)
    rows.unionByName(rows).coalesce(1).write.mode("append").parquet(doubled)
    live = drain(spark, jobs.accept_fixes(spark.readStream.schema(schema).parquet(doubled)))
    assert rows_of(live, ["journey_id", "t_ms"]) == rows_of(QUERIES["st01_accepted_fixes"](spark, SF), ["journey_id", "t_ms"])


def test_sessions_match_batch_once_closed(spark, feed):
    folder, schema = feed
    live = drain(spark, jobs.sessions(spark.readStream.schema(schema).parquet(folder)))
    batch = set(rows_of(QUERIES["st08_sessions"](spark, SF), live.columns))
    assert set(rows_of(live, live.columns)) <= batch


def test_recognition_happens_once(spark, feed):
    folder, schema = feed
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).select(F.col("user_id").alias("id"), "ts")
    live = drain(spark, jobs.recognise_once(s, "30 days"))
    assert live.count() == live.select("id").distinct().count() > 0


def test_late_dwell_join(spark, feed):
    folder, schema = feed
    rows = spark.read.schema(schema).parquet(folder)
    a = rows.groupBy("journey_id").agg(F.timestamp_millis(F.min("t_ms") + 400_000).alias("arrived"))
    at = tempfile.mkdtemp(prefix="spark-")
    a.coalesce(1).write.mode("append").parquet(at)
    live = drain(spark, jobs.late_dwell(spark.readStream.schema(schema).parquet(folder), spark.readStream.schema(a.schema).parquet(at)))
    assert rows_of(live, ["journey_id", "event_id"]) == rows_of(QUERIES["st10_late_dwell"](spark, SF), ["journey_id", "event_id"])


def test_ledger_batches_replace_and_remove(spark, tables):
    spans, totals = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    base = tables.spans.select("edge_id", "journey_id", F.col("start_mm").alias("lo"), F.col("end_mm").alias("hi"))
    apply = jobs.ledger_batch(spans, totals)
    apply(base, 1)
    moved = base.where("journey_id % 3 = 0").withColumns({"lo": F.col("lo") + 50, "hi": F.col("hi") + 50})
    gone = base.where("journey_id % 3 = 1").select(F.lit(None).cast("long").alias("edge_id"), "journey_id", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")).distinct()
    second = moved.unionByName(gone)
    apply(second, 2)
    apply(second, 2)  # a replayed batch changes nothing
    now = base.where("journey_id % 3 = 2").unionByName(moved)
    want = interval_union(now, ["edge_id"]).groupBy("edge_id").agg(F.sum(F.expr("hi - lo")).alias("unique_mm"))
    assert rows_of(jobs.ledger_totals(spark, totals).where("unique_mm > 0"), ["edge_id", "unique_mm"]) == rows_of(want, ["edge_id", "unique_mm"])
