"""Batch twins of the live jobs: same machines, same rows, over whole tables."""

import uuid

from pyspark.sql import functions as F

from ..operators import machines as M
from ..operators import traces as T
from ..operators.scans import scan_sorted
from ..session import shared_folder
from ..streaming import jobs
from ..streaming.ledger import ExactlyOnce
from .registry import query


def scan(t, df, columns, machine, schema, order="t_ms"):
    """A pause of 15 minutes is a recording boundary: each recording starts afresh."""
    rows, _gaps = T.time_sections(df, ["journey_id"], 900_000, least=1)
    return scan_sorted(rows, ["journey_id", "section"], [order], columns, machine, schema)


def live_trace(t):
    return t.trace.withColumns({"ts": F.timestamp_millis("t_ms"), "venue": F.floor(F.col("x") / 400), "received_ms": F.expr("t_ms + event_id % 90 * 1000"),
                                "destination": F.expr("x % 700 < 300"), "site": F.expr("x % 700 < 150"), "road": F.lit(True), "rail": F.expr("journey_id % 5 = 4"),
                                "station": F.floor(F.col("x") / 700), "on_rail": F.expr("journey_id % 5 = 4"), "started": F.expr("seq >= 30")})


@query("st01_accepted_fixes")
def _(t):
    return scan(t, live_trace(t), [*jobs.FIX, "speed_mps", "mode", "received_ms"], M.Accept, "journey_id long, t_ms long, lat double, lng double, accuracy_m double")


@query("st02_trip_starts")
def _(t):
    return scan(t, t.trace, [*jobs.FIX, "mode"], M.StartGate, "journey_id long, since_ms long, confirmed_ms long, moved_m double")


@query("st03_trip_ends")
def _(t):
    slow = t.trace.withColumn("t_ms", F.expr("t_ms + seq * 12000"))
    return scan(t, slow, [*jobs.FIX, "speed_mps"], M.Stillness, "journey_id long, since_ms long, confirmed_ms long")


@query("st04_venue_stops")
def _(t):
    return scan(t, live_trace(t), [*jobs.FIX, "speed_mps", "venue"], M.Stops, "journey_id long, venue_id long, from_ms long, to_ms long, accuracy_m double")


@query("st05_station_events")
def _(t):
    fast = live_trace(t).withColumn("speed_mps", F.expr("CASE WHEN seq % 36 < 12 AND journey_id % 5 = 4 THEN speed_mps + 7 ELSE speed_mps END"))
    return scan(t, fast, [*jobs.FIX, "speed_mps", "station", "on_rail"], M.StationDwell, "journey_id long, t_ms long, event string, station_id long")


@query("st06_context_events")
def _(t):
    return scan(t, live_trace(t), [*jobs.FIX, "speed_mps", "mode", "destination", "site", "road", "rail"], M.ContextPause, "journey_id long, t_ms long, event string, mode string")


@query("st07_place_departures")
def _(t):
    return scan(t, t.trace, [*jobs.FIX, "speed_mps"], M.PlaceDeparture, "journey_id long, inside_ms long, outside_ms long")


@query("st08_sessions", "trace", """WITH s AS (SELECT *, sum(CASE WHEN t_ms - pt >= 120000 THEN 1 ELSE 0 END) OVER (PARTITION BY journey_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(t_ms) OVER (PARTITION BY journey_id ORDER BY t_ms) AS pt FROM trace))
SELECT journey_id, min(t_ms) AS from_ms, max(t_ms) + 120000 AS to_ms, count(*) AS fixes FROM s GROUP BY journey_id, k""")
def _(t):
    return jobs.sessions(live_trace(t))


@query("st08_day_counts", "fixes", "SELECT mode, t_ms // 86400000 * 86400000 AS day_ms, count(*) AS fixes FROM fixes GROUP BY 1, 2")
def _(t):
    return jobs.day_counts(t.fixes)


@query("st08_sliding_motion", "trace", "SELECT journey_id, (t_ms // 15000 - k) * 15000 AS from_ms, count(*) AS fixes, count(*) FILTER (speed_mps >= 0.5) AS moving FROM trace, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) GROUP BY 1, 2")
def _(t):
    return jobs.sliding_motion(live_trace(t))


@query("st10_late_dwell", "trace", "WITH a AS (SELECT journey_id, min(t_ms) + 400000 AS arrived FROM trace GROUP BY 1) SELECT t.journey_id, t.event_id FROM trace t JOIN a ON t.journey_id = a.journey_id AND t.t_ms BETWEEN arrived AND arrived + 600000")
def _(t):
    tr = live_trace(t)
    a = tr.groupBy("journey_id").agg(F.timestamp_millis(F.min("t_ms") + 400_000).alias("arrived"))
    return jobs.late_dwell(tr, a).select("journey_id", "event_id")


@query("st11_recognised_once", "fixes", "SELECT user_id AS id, min(t_ms) AS first_ms FROM fixes GROUP BY 1")
def _(t):
    return jobs.recognise_once(t.fixes.select(F.col("user_id").alias("id"), "ts")).select("id", F.unix_millis("ts").alias("first_ms"))


@query("st11_exactly_once", "fixes", "SELECT user_id AS id, min(CAST(epoch_ms(ts) // 86400000 % 5 AS BIGINT)) AS batch FROM fixes GROUP BY 1")
def _(t):
    f = t.fixes.select(F.col("user_id").alias("id"), F.floor(F.unix_millis("ts") / 86_400_000 % 5).alias("part"))
    once = ExactlyOnce(f"{shared_folder(t.spark)}/recognised-{uuid.uuid4().hex}")
    # Every id comes back in later batches, and the third batch is replayed.
    for number in (0, 1, 2, 2, 3, 4):
        once(f.where(F.col("part") == number), number)
    return once.recognised(t.spark)


@query("st12_origin_recovery")
def _(t):
    return scan(t, live_trace(t), [*jobs.FIX, "speed_mps", "started"], M.OriginRecovery, "journey_id long, t_ms long, start_ms long")
