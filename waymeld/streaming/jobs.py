"""Live jobs: acceptance, trip boundaries, sessions, ledgers and recognition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import machines as M
from ..operators.intervals import interval_union
from .state import run_machine

FIX = ["journey_id", "t_ms", "lat", "lng", "accuracy_m"]


def _key(fixes: DataFrame) -> str:
    """Journey ids keep the type they come with: whole numbers or text."""
    return f"journey_id {dict(fixes.dtypes)['journey_id']}, "


def accept_fixes(fixes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Watermark, drop repeats of an event, then keep fresh plausible fixes (needs `ts`)."""
    once = fixes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return run_machine(once, ["journey_id"], ["t_ms"], [*FIX, "speed_mps", "mode", "received_ms"], M.Accept,
                       _key(fixes) + "t_ms long, lat double, lng double, accuracy_m double")


def trip_starts(fixes: DataFrame) -> DataFrame:
    return run_machine(fixes, ["journey_id"], ["t_ms"], [*FIX, "mode"], M.StartGate,
                       _key(fixes) + "since_ms long, confirmed_ms long, moved_m double")


def trip_ends(fixes: DataFrame) -> DataFrame:
    return run_machine(fixes, ["journey_id"], ["t_ms"], [*FIX, "speed_mps"], M.Stillness, _key(fixes) + "since_ms long, confirmed_ms long")


def venue_stops(fixes: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Stops as they end. Give the stream a watermark and `idle_ms` to close the last one."""
    return run_machine(fixes, ["journey_id"], ["t_ms"], [*FIX, "speed_mps", "venue"], M.Stops,
                       _key(fixes) + "venue_id long, from_ms long, to_ms long, accuracy_m double", idle_ms)


def station_events(fixes: DataFrame) -> DataFrame:
    return run_machine(fixes, ["journey_id"], ["t_ms"], [*FIX, "speed_mps", "station", "on_rail"], M.StationDwell,
                       _key(fixes) + "t_ms long, event string, station_id long")


def context_events(fixes: DataFrame) -> DataFrame:
    return run_machine(fixes, ["journey_id"], ["t_ms"], [*FIX, "speed_mps", "mode", "destination", "site", "road", "rail"], M.ContextPause,
                       _key(fixes) + "t_ms long, event string, mode string")


def place_departures(fixes: DataFrame) -> DataFrame:
    return run_machine(fixes, ["journey_id"], ["t_ms"], [*FIX, "speed_mps"], M.PlaceDeparture, _key(fixes) + "inside_ms long, outside_ms long")


def origins(fixes: DataFrame) -> DataFrame:
    return run_machine(fixes, ["journey_id"], ["t_ms"], [*FIX, "speed_mps", "started"], M.OriginRecovery, _key(fixes) + "t_ms long, start_ms long")


def sessions(fixes: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Sections by inactivity gap (built-in session windows)."""
    w = F.session_window("ts", gap)
    live = fixes.withWatermark("ts", late) if fixes.isStreaming else fixes
    return live.groupBy("journey_id", w.alias("w")).agg(F.count("*").alias("fixes")).select(
        "journey_id", F.unix_millis("w.start").alias("from_ms"), F.unix_millis("w.end").alias("to_ms"), "fixes")


def day_counts(fixes: DataFrame, late: str = "1 day") -> DataFrame:
    live = fixes.withWatermark("ts", late) if fixes.isStreaming else fixes
    return live.groupBy("mode", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("fixes")).select(
        "mode", F.unix_millis("w.start").alias("day_ms"), "fixes")


def sliding_motion(fixes: DataFrame, late: str = "10 minutes") -> DataFrame:
    live = fixes.withWatermark("ts", late) if fixes.isStreaming else fixes
    return live.groupBy("journey_id", F.window("ts", "90 seconds", "15 seconds").alias("w")).agg(
        F.count("*").alias("fixes"), F.count_if(F.col("speed_mps") >= 0.5).alias("moving")).select(
        "journey_id", F.unix_millis("w.start").alias("from_ms"), "fixes", "moving")


def late_dwell(fixes: DataFrame, arrivals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Fixes up to ten minutes after their journey's arrival (stream-stream interval join)."""
    f, a = fixes, arrivals
    if fixes.isStreaming:
        f, a = fixes.withWatermark("ts", late), arrivals.withWatermark("arrived", late)
    f = f.alias("f")
    a = a.select(F.col("journey_id").alias("a_id"), "arrived")
    return f.join(a, F.expr("journey_id = a_id AND ts >= arrived AND ts <= arrived + INTERVAL 10 MINUTES")).drop("a_id")


def recognise_once(earned: DataFrame, late: str = "1 day") -> DataFrame:
    """Each id passes at most once; the state is the id, kept for the watermark's span."""
    if earned.isStreaming:
        return earned.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return earned.groupBy("id").agg(F.min("ts").alias("ts"))


def ledger_batch(spans_folder: str, totals_folder: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch step: a journey's new spans replace its old ones, touched edges are recomputed.

    Spans are one folder per journey bucket, and only the buckets of a batch are
    rewritten; versions are batch numbers, so a replayed batch changes nothing.
    """
    buckets = 64

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumns({"version": F.lit(number), "bucket": F.pmod(F.xxhash64("journey_id"), F.lit(buckets))})
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{spans_folder}/v={number}")
        every = spark.read.parquet(spans_folder)
        # The newest version of a journey is its contribution; a removal is a version with null edges.
        newest = every.groupBy("bucket", "journey_id").agg(F.max("version").alias("version"))
        live = every.join(newest, ["bucket", "journey_id", "version"]).where("edge_id IS NOT NULL")
        moved = every.join(new.select("journey_id").distinct(), "journey_id", "left_semi").select("edge_id").distinct()
        touched = live.join(moved, "edge_id", "left_semi")
        lengths = interval_union(touched, ["edge_id"]).groupBy("edge_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("unique_mm"))
        totals = moved.where("edge_id IS NOT NULL").join(lengths, "edge_id", "left").select("edge_id", F.coalesce("unique_mm", F.lit(0)).alias("unique_mm"))
        totals.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{totals_folder}/v={number}")

    return apply


def ledger_totals(spark, totals_folder: str) -> DataFrame:
    """Latest total per edge."""
    t = spark.read.option("basePath", totals_folder).parquet(totals_folder)
    return t.groupBy("edge_id").agg(F.max(F.struct("version", "unique_mm")).alias("b")).select("edge_id", "b.unique_mm")
