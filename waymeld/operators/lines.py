"""Simplification of recorded lines, all spans of a round at once."""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .ordered import dense_seq, seq_chunk
from .scans import scan_sorted

# Points of a span that one task finishes; longer spans are parted by rounds over all of them.
SPAN_POINTS = 1 << 15


def simplify(points: DataFrame, keys: list[str], tolerance: float, long_m: float, most_points: int | None = None, scale: float = 111_320.0,
             most: int = SPAN_POINTS) -> DataFrame:
    """(keys, seq) of the points that stay of each line (lat, lng by whole-number `seq`, unique within its key).

    A span is parted at the point farthest from its chord if that is above
    `tolerance` metres (the first of several), else in the middle if its chord is above `long_m` metres or it
    passes `most_points` steps. Ends always stay; points without a finite position are left out.

    A span of up to `most` points is finished by one task, which holds no more than that. Every longer
    span of every line is judged in one round, as partial maxima; a point only carries the ends of its span,
    so a line is never held by one task. Rounds follow the depth of the splits down to `most`.
    """
    c = F.col
    finite = (F.abs("lat") < math.inf) & (F.abs("lng") < math.inf)
    ranked = written(dense_seq(points.where(finite).select(*keys, "seq", "lat", "lng"), keys, ["seq"], seq_chunk(), "_k"), "ranked")
    point = F.struct("_k", "lat", "lng")
    spot = F.struct("_k", "lat", "lng", "seq")
    ends = ranked.groupBy(*keys).agg(F.min(spot).alias("_a"), F.max(spot).alias("_z"))
    outer = ends.select(*keys, F.explode(F.array_distinct(F.array("_a.seq", "_z.seq"))).alias("seq"))
    long_lines = cut_lineage(ends.where(c("_z._k") >= most).withColumns({e: c(e).dropFields("seq") for e in ("_a", "_z")}))
    rule = partial(_Span, len(keys), tolerance=tolerance, long_m=long_m, most_points=most_points, scale=scale)
    columns = ["_k", "seq", "lat", "lng"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*keys, "seq").schema)
    if long_lines.isEmpty():
        return outer.unionByName(scan_sorted(ranked, keys, ["_k"], columns, rule, schema))
    short = scan_sorted(ranked.join(long_lines.select(*keys), keys, "left_anti"), keys, ["_k"], columns, rule, schema)
    open_ = cut_lineage(ranked.join(long_lines, keys).where((c("_k") > c("_a._k")) & (c("_k") < c("_z._k"))))
    kept = outer.unionByName(short)
    east = lambda a, b: (b["lng"] - a["lng"]) * F.cos(F.radians((a["lat"] + b["lat"]) / 2)) * scale
    north = lambda a, b: (b["lat"] - a["lat"]) * scale
    # Off the chord on the plane halfway between its ends.
    flat = F.cos(F.radians((c("_a.lat") + c("_z.lat")) / 2)) * scale
    dx, dy, px, py = (c("_z.lng") - c("_a.lng")) * flat, north(c("_a"), c("_z")), (c("lng") - c("_a.lng")) * flat, (c("lat") - c("_a.lat")) * scale
    share = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(px * dx + py * dy, dx * dx + dy * dy))), F.lit(0.0))
    off = F.hypot(px - share * dx, py - share * dy)
    steps = c("_z._k") - c("_a._k")
    long = F.hypot(east(c("_a"), c("_z")), north(c("_a"), c("_z"))) > long_m
    if most_points is not None:
        long = long | (steps > most_points)
    middle = F.floor((c("_a._k") + c("_z._k")) / 2)
    small = c("_z._k") - c("_a._k") < most
    parts = []
    while not open_.isEmpty():
        judged = open_.withColumns({"_off": off, "_mid": F.when(long & (c("_k") == middle), point)})
        cut = judged.groupBy(*keys, c("_a._k").alias("_from")).agg(
            F.max_by(point, F.when(c("_off") > tolerance, F.struct("_off", -c("_k")))).alias("_far"), F.max("_mid").alias("_mid"))
        cut = cut.select(*keys, "_from", F.coalesce("_far", "_mid").alias("_cut")).where("_cut IS NOT NULL")
        parted = cut_lineage(open_.withColumn("_from", c("_a._k")).join(cut, [*keys, "_from"]).drop("_from"))
        kept = kept.unionByName(parted.where("_k = _cut._k").select(*keys, "seq"))
        halves = parted.where("_k <> _cut._k").select(
            *keys, "seq", "_k", "lat", "lng", F.when(c("_k") < c("_cut._k"), c("_a")).otherwise(c("_cut")).alias("_a"),
            F.when(c("_k") < c("_cut._k"), c("_cut")).otherwise(c("_z")).alias("_z"))
        parts.append(halves.where(small))
        open_ = halves.where(~small)
    if parts:
        inner = reduce(DataFrame.unionByName, parts).withColumn("_from", c("_a._k"))
        # The ends of a span stand on both sides of its points, once.
        rims = inner.groupBy(*keys, "_from").agg(F.min("_a").alias("_a"), F.min("_z").alias("_z"))
        rims = rims.select(*keys, "_from", F.explode(F.array("_a", "_z")).alias("_e")).select(*keys, "_from", F.lit(0).cast(ranked.schema["seq"].dataType).alias("seq"), "_e.*")
        rows = inner.select(*keys, "_from", *columns).unionByName(rims)
        kept = kept.unionByName(scan_sorted(rows, [*keys, "_from"], ["_k"], columns, rule, schema))
    return kept


class _Span:
    """The points kept between the two ends of one span."""

    def __init__(self, width: int, head: tuple, tolerance: float, long_m: float, most_points: int | None, scale: float):
        self.head, self.rows = head[:width], []
        self.tolerance, self.long_m, self.most_points, self.scale = tolerance, long_m, most_points, scale

    def row(self, *values):
        self.rows.append(values)
        return ()

    def end(self):
        _, seq, lat, lng = zip(*self.rows)
        lat, lng = np.array(lat), np.array(lng)
        todo = [(0, len(seq) - 1)]
        while todo:
            a, z = todo.pop()
            if z - a < 2:
                continue
            at = self._cut(lat[a:z + 1], lng[a:z + 1])
            if at is not None:
                yield (*self.head, seq[a + at])
                todo += [(a, a + at), (a + at, z)]

    def _cut(self, lat, lng):
        # Off the chord on the plane halfway between its ends.
        flat = math.cos(math.radians((lat[0] + lat[-1]) / 2)) * self.scale
        px, py = (lng[1:] - lng[0]) * flat, (lat[1:] - lat[0]) * self.scale
        dx, dy = px[-1], py[-1]
        n = dx * dx + dy * dy
        share = np.clip((px * dx + py * dy) / n, 0.0, 1.0) if n else 0.0
        off = np.hypot(px - share * dx, py - share * dy)[:-1]
        far = int(off.argmax())
        if off[far] > self.tolerance:
            return far + 1
        steps = len(lat) - 1
        if math.hypot(dx, dy) > self.long_m or (self.most_points is not None and steps > self.most_points):
            return steps // 2
        return None
