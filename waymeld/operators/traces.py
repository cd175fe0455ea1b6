"""Cleaning, segmentation and thinning of recorded traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, interpolate
from ..session import cut_lineage
from .jumps import first_from, reached
from .ordered import islands, keep_parallel, neighbours, running, seq_chunk

REVIEW_POINTS = 20_000


def size_guard(points: DataFrame, keys: list[str], limit: int = REVIEW_POINTS) -> DataFrame:
    """Journeys above the limit are set aside for review, never cut."""
    return (points.groupBy(*keys).agg(F.count("*").alias("points"))
            .withColumn("decision", F.when(F.col("points") > limit, "review").otherwise("process")))


def stations(segments: DataFrame, keys: list[str], order: str, every_m: float | str) -> DataFrame:
    """Positions at exact multiples of `every_m` (metres or a column) along each path.

    `segments` holds ax, ay, cx, cy. The running length is carried over chunk
    borders, and each segment then yields the station numbers it contains.
    """
    d = segments.withColumn("_d", haversine_m("ay", "ax", "cy", "cx"))
    run = running(d, keys, seq_chunk(order), [order], {"_sum": ("sum", "_d")})
    # Both ends are rounded the same way, so neighbouring segments share them.
    hi = neighbours(run.withColumn("_hi", F.round("_sum", 6)), keys, order, {"_lo": ("_hi", -1)})
    hi = hi.withColumn("_lo", F.coalesce("_lo", F.lit(0.0))).where("_hi > _lo")
    gap = F.col(every_m) if isinstance(every_m, str) else F.lit(float(every_m))
    first, last = F.ceil(F.col("_lo") / gap).cast("long"), F.ceil(F.col("_hi") / gap).cast("long") - 1
    out = hi.where(last >= first).withColumn("station", F.explode(F.sequence(first, last)))
    f = (F.col("station") * gap - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return out.select(*keys, order, "station", interpolate("ax", "cx", f).alias("lng"), interpolate("ay", "cy", f).alias("lat"))


def foot_plausible(d: Column, seconds: Column, speed_a: Column, speed_b: Column, acc_a: Column, acc_b: Column) -> Column:
    limit = F.greatest(F.lit(4.5), F.least(F.lit(10.0), F.greatest(speed_a, speed_b) * 1.5))
    slack = F.least(F.lit(20.0), (F.greatest(F.lit(0.0), acc_a) + F.greatest(F.lit(0.0), acc_b)) * 0.3)
    return d <= limit * seconds + slack


def with_reliability(fixes: DataFrame, keys: list[str] = ["journey_id"]) -> DataFrame:
    """Adds `reliable`: accuracy, rising time and plausible movement from the fix before."""
    c = F.col
    p = neighbours(fixes, keys, "seq", {"_lat": ("lat", -1), "_lng": ("lng", -1), "_t": ("t_ms", -1),
                                        "_acc": ("accuracy_m", -1), "_spd": ("speed_mps", -1)})
    d = haversine_m("_lat", "_lng", "lat", "lng")
    seconds = (c("t_ms") - c("_t")) / 1000
    foot = c("mode").isin("walking", "running")
    vehicle = d <= seconds * 70 + F.least(F.lit(50.0), c("_acc") + c("accuracy_m"))
    moved = F.when(foot, foot_plausible(d, seconds, c("_spd"), c("speed_mps"), c("_acc"), c("accuracy_m"))).otherwise(vehicle)
    own = (c("accuracy_m") > 0) & (c("accuracy_m") <= F.when(foot, 50).otherwise(100)) & (c("t_ms") > 0)
    ok = F.coalesce(own & (c("_t").isNull() | ((c("t_ms") > c("_t")) & moved)), F.lit(False))
    return p.withColumn("reliable", ok).drop("_lat", "_lng", "_acc", "_spd").withColumnRenamed("_t", "prev_t_ms")


def partial_match(n: str, hit: str, missed: str) -> dict[str, Column]:
    """Acceptance of a partial match from its index lists (n inputs, each exactly once)."""
    c, hits, misses = F.col(n), F.col(hit), F.col(missed)
    whole = ((F.size(hits) + F.size(misses) == c)
             & (F.size(F.array_distinct(F.concat(hits, misses))) == c)
             & F.forall(F.concat(hits, misses), lambda i: (i >= 0) & (i < c)))
    some, partial = F.size(hits) >= 2, F.size(hits) < c
    solid = F.size(hits) == F.array_max(hits) - F.array_min(hits) + 1
    return {"endpoint_partial": whole & some & partial & (F.size(hits) >= F.ceil(c * 0.75)) & solid,
            "import_partial": whole & some & (F.size(misses) > 0),
            "verified_partial": whole & some & partial}


def time_sections(fixes: DataFrame, keys: list[str], gap_ms: int, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows with `section`, gaps): a journey breaks where the time gap exceeds the limit.

    Sections with fewer than `least` points drop out; gaps name the point before.
    """
    p = neighbours(fixes, keys, "seq", {"_pt": ("t_ms", -1), "_nt": ("t_ms", 1)})
    wide = F.coalesce(F.col("t_ms") - F.col("_pt") > gap_ms, F.lit(False))
    cut = islands(p, keys, seq_chunk(), ["seq"], wide, "section")
    if least == 2:
        # A point alone in its section has a break on both sides.
        ahead = F.coalesce(F.col("_nt") - F.col("t_ms") > gap_ms, F.lit(True))
        cut = cut.where(~((F.col("_pt").isNull() | wide) & ahead))
    elif least > 2:
        sizes = cut.groupBy(*keys, "section").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
        cut = cut.join(sizes, [*keys, "section"], "left_semi")
    gaps = p.where(wide).select(*keys, (F.col("seq") - 1).alias("after_seq"), (F.col("t_ms") - F.col("_pt")).alias("duration_ms"))
    return cut.drop("_pt", "_nt"), gaps


def grouped_keep(points: DataFrame, keys: list[str], columns: list[str], choose) -> DataFrame:
    """(keys, seq) of the rows `choose` keeps from each ordered section. Every section is worked on, whatever its size."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        kept = choose(list(zip(*(frame[c].tolist() for c in columns))))
        return frame.iloc[kept][[*keys, "seq"]]

    types = dict(points.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "seq"])
    narrow = points.select(*keys, "seq", *columns)
    return keep_parallel(narrow, keys).groupBy(*keys).applyInPandas(run, schema)


def uncorroborated(fixes: DataFrame, keys: list[str] = ["journey_id"]) -> DataFrame:
    """Interior fixes without speed that the measured fixes around them contradict."""
    c = F.col
    measured = (c("accuracy_m") > 0) & (c("accuracy_m") <= 25) & (c("speed_mps") >= 3)
    pick = F.when(measured, F.struct("t_ms", "lat", "lng", "accuracy_m", "speed_mps"))
    rows = running(fixes, keys, seq_chunk(), ["seq"], {"a": ("last", pick), "b": ("next", pick)}, exclusive=True)
    from ..functions.geo import point_segment_m
    near = F.greatest("a.accuracy_m", "b.accuracy_m")
    reach = F.greatest(F.lit(15.0), F.greatest("a.speed_mps", "b.speed_mps") * 1.5) * (c("b.t_ms") - c("a.t_ms")) / 1000
    return rows.where(
        (c("speed_mps") < 0) & c("a").isNotNull() & c("b").isNotNull() & (c("t_ms") > c("a.t_ms")) & (c("t_ms") < c("b.t_ms"))
        & (c("b.t_ms") - c("a.t_ms") <= 30_000) & (c("accuracy_m") > near * 2)
        & (haversine_m("a.lat", "a.lng", "b.lat", "b.lng") <= reach + c("a.accuracy_m") + c("b.accuracy_m"))
        & (point_segment_m("lng", "lat", "a.lng", "a.lat", "b.lng", "b.lat") > c("accuracy_m") + near)).select(*keys, "seq")


def sustained_runs(fixes: DataFrame, keys: list[str], moving: Column, least: int, span_ms: int, path_m: float,
                   gap_ms: int = 60_000) -> DataFrame:
    """Runs of consecutive moving fixes, reset by a still fix, a gap or an unreliable step."""
    c = F.col
    p = with_reliability(fixes, keys).withColumn("_mv", F.coalesce(moving, F.lit(False)))
    p = neighbours(p, keys, "seq", {"_pm": ("_mv", -1), "_plat": ("lat", -1), "_plng": ("lng", -1), "_pa": ("accuracy_m", -1)})
    joins = F.coalesce(c("_pm") & c("reliable") & (c("t_ms") - c("prev_t_ms") <= gap_ms), F.lit(False))
    step = haversine_m("_plat", "_plng", "lat", "lng")
    credit = F.greatest(F.lit(0.0), step - F.least(F.lit(8.0), (c("_pa") + c("accuracy_m")) * 0.25))
    p = p.withColumn("_credit", F.when(joins, credit).otherwise(0.0))
    runs = islands(p, keys, seq_chunk(), ["seq"], c("_mv") & ~joins, "run").where("_mv")
    return (runs.groupBy(*keys, "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("fixes"),
                                           F.min("t_ms").alias("from_ms"), F.max("t_ms").alias("to_ms"), F.sum("_credit").alias("path_m"))
            .where((c("fixes") >= least) & (c("to_ms") - c("from_ms") >= span_ms) & (c("path_m") >= path_m)))


def supported_sections(legs: DataFrame, keys: list[str], observed: str, distance: str) -> DataFrame:
    """Flags legs within max(1.4x, +300 m) of the observed length and numbers the supported runs."""
    limit = F.greatest(F.col(observed) * 1.4, F.col(observed) + 300)
    p = legs.withColumns({"limit_m": limit, "ok": F.col(distance) <= limit})
    p = neighbours(p, keys, "seq", {"_was": ("ok", -1)})
    return islands(p, keys, seq_chunk(), ["seq"], F.col("ok") & ~F.coalesce("_was", F.lit(False)), "section").drop("_was")


def run_lengths(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Consecutive equal values of an ordered key as [first, last] spans."""
    p = neighbours(rows, keys, "seq", {"_was": (value, -1)})
    spans = islands(p, keys, seq_chunk(), ["seq"], F.col("_was").isNull() | (F.col("_was") != F.col(value)), "span")
    return spans.groupBy(*keys, "span", value).agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"))


def thin_trace(fixes: DataFrame, key: str = "journey_id", far_m: float = 25.0, near_m: float = 8.0, bend: float = 0.35) -> DataFrame:
    """(key, seq) of the fixes kept: `far_m` behind the last kept one along the path, or `near_m` at a turn, and both ends.

    A step of `far_m` or more always keeps its fix, so a journey parts there. Within
    a part the fix that would follow is looked up for every fix, and the kept ones are those reached
    from the first.
    """
    c = F.col
    p = neighbours(fixes, [key], "seq", {"blat": ("lat", -1), "blng": ("lng", -1), "alat": ("lat", 1), "alng": ("lng", 1)})
    k = F.cos(F.radians("lat"))
    ux, uy, vx, vy = (c("lng") - c("blng")) * k, c("lat") - c("blat"), (c("alng") - c("lng")) * k, c("alat") - c("lat")
    nu, nv = F.hypot(ux, uy), F.hypot(vx, vy)
    turn = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ux * vx + uy * vy, nu * nv)))
    rows = p.select(key, "seq", F.coalesce(haversine_m("blat", "blng", "lat", "lng", 6_371_008.8), F.lit(0.0)).alias("step"),
                    F.coalesce((nu > 2e-5) & (nv > 2e-5) & (turn > bend), F.lit(False)).alias("turns"),
                    c("blat").isNull().alias("opens"), c("alat").isNull().alias("closes"))
    rows = rows.withColumn("head", c("opens") | (c("step") >= far_m))
    cut = running(rows, [key], seq_chunk(), ["seq"], {"part": ("sum", c("head").cast("int"))})
    inner = F.when(c("head"), 0.0).otherwise(c("step"))
    run = cut_lineage(running(cut.withColumn("_step", inner), [key, "part"], seq_chunk(), ["seq"], {"_run": ("sum", "_step")}))
    found = first_from(run, [key, "part"], "_run", "seq", 16 * 1024 * far_m,
                       {"_far": (c("_run") + far_m, F.lit(True)), "_turn": (c("_run") + near_m, c("turns"))})
    steps = found.withColumn("_next", F.least("_far", "_turn"))
    return reached(steps, [key, "part"], "seq", "_next", "head").select(key, "seq").unionByName(rows.where("closes").select(key, "seq")).distinct()


def visit_sessions(visits: DataFrame, key: str, start: str, window: int, chunk: int = 10_080) -> DataFrame:
    """Add `session`, numbered from 1 per key: a visit within `window` of its session's first start belongs to it.

    `start` is a whole number, unique within its key. A gap above the window is a sure break, so followers are sought between such gaps only.
    """
    at = F.floor(F.col(start) / chunk)
    p = running(visits, [key], at, [start], {"_prev": ("last", start)}, exclusive=True)
    head = F.col("_prev").isNull() | (F.col(start) - F.col("_prev") > window)
    cut = cut_lineage(islands(p.withColumn("_head", head), [key], at, [start], F.col("_head"), "_island").drop("_prev"))
    found = first_from(cut.withColumn("_at", F.col(start)), [key, "_island"], "_at", start, chunk, {"_next": (F.col(start) + window + 1, F.lit(True))})
    opening = reached(found, [key, "_island"], start, "_next", "_head").select(key, start, F.lit(True).alias("_opens"))
    return islands(cut.join(opening, [key, start], "left"), [key], at, [start], F.coalesce("_opens", F.lit(False)), "session").drop("_opens", "_head", "_island")


def drop_redundant(fixes: DataFrame, key: str = "journey_id") -> DataFrame:
    """(key, seq) of the fixes left after the redundant ones are dropped.

    A dropped fix lies within 15 m of a kept one, so after a step above 30 m the
    next fix is kept whatever came before: journeys split there exactly.
    """
    from .machines import Redundant
    from .scans import scan_sorted
    p = neighbours(fixes, [key], "seq", {"blat": ("lat", -1), "blng": ("lng", -1), "alat": ("lat", 1), "alng": ("lng", 1)})
    cut = islands(p, [key], seq_chunk(), ["seq"], F.coalesce(haversine_m("blat", "blng", "lat", "lng", 6_371_008.8) > 30, F.lit(True)), "part")
    kind = dict(fixes.dtypes)[key]
    return scan_sorted(cut, [key, "part"], ["seq"], [key, "seq", "lat", "lng", "alat", "alng"], lambda k: Redundant(k), f"{key} {kind}, seq long")
