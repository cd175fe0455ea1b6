"""Lines beside lines: how much of one runs near another, and which stretch corresponds to which."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .gridjoin import planar_cell, segment_cells

ENDS = ("ax", "ay", "bx", "by")


def line_samples(segments: DataFrame, ids: list[str], spacing: float) -> DataFrame:
    """(ids, x, y, weight): midpoints of equal parts of at most `spacing` metres; weights add up to the length.

    Equal positions of an id collapse, so repeated travel costs one row with the summed weight.
    """
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    parts = segments.select(*ids, *ENDS, length.alias("_len")).where("_len > 0").withColumn("_n", F.ceil(F.col("_len") / spacing).cast("long"))
    each = parts.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = (F.col("_i") + 0.5) / F.col("_n")
    return (each.select(*ids, geo.interpolate("ax", "bx", at).alias("x"), geo.interpolate("ay", "by", at).alias("y"), (F.col("_len") / F.col("_n")).alias("weight"))
            .groupBy(*ids, "x", "y").agg(F.sum("weight").alias("weight")))


def corridor_shares(source: DataFrame, target: DataFrame, ids: list[str], radii: tuple[float, ...] = (3.0, 10.0, 25.0), spacing: float = 5.0,
                    on: list[str] | None = None) -> DataFrame:
    """(ids, length_m, share_<radius>...): the part of each source line's length within each radius of the target lines.

    Both sides hold planar segments (ax, ay, bx, by). With `on`, columns of both sides and a
    part of `ids`, a source is only held against targets of its own. All radii come from one grid join:
    the least distance of a sample within the largest radius serves every smaller one. Segments without length count nothing; sources of
    no length at all give no row.
    """
    on, most = on or [], max(radii)
    samples = line_samples(source, ids, spacing)
    near = segment_cells(target.select(*on, *ENDS).distinct(), *ENDS, 2 * most, most)
    at = planar_cell(samples, "x", "y", 2 * most)
    # Positions that several sources share are measured once.
    measured = (at.select(*on, "x", "y", "_cx", "_cy").distinct().join(near, [*on, "_cx", "_cy"])
                .groupBy(*on, "x", "y").agg(F.min(geo.point_segment("x", "y", *ENDS)).alias("_d")).where(F.col("_d") <= most))
    shares = [F.round(F.coalesce(F.sum(F.when(F.round("_d", 6) <= r, F.col("weight"))), F.lit(0.0)) / F.sum("weight"), 6).alias(f"share_{r:g}") for r in radii]
    return samples.join(measured, [*on, "x", "y"], "left").groupBy(*ids).agg(F.round(F.sum("weight"), 3).alias("length_m"), *shares)


def edge_correspondence(source: DataFrame, target: DataFrame, src: str, tgt: str, reach_m: float = 10.0, angle: float = 15.0, cell: float = 40.0) -> DataFrame:
    """(src, from_m, to_m, rivals, tgt, tgt_from_m, tgt_to_m): source edges as pieces with offsets on both sides.

    A source edge is cut where the ends of aligned targets within reach project onto it. A piece is bound where exactly one
    target within `angle` degrees, either way round, lies within `reach_m` of its middle, which must project inside that target; otherwise its target is null
    and `rivals` says how many there were. Pieces cover every source edge exactly once; offsets on a
    target that runs the other way fall. Edges without length are left out on both sides. Ids are unique; a source's pieces are few, as many as targets beside it.
    """
    c = F.col
    s = source.select(src, c("ax").alias("sx"), c("ay").alias("sy"), c("bx").alias("tx"), c("by").alias("ty")).withColumn("_len", F.hypot(c("tx") - c("sx"), c("ty") - c("sy"))).where("_len > 0")
    e = target.select(tgt, *ENDS).where("ax <> bx OR ay <> by")
    cells = segment_cells(s.select(src, "sx", "sy", "tx", "ty"), "sx", "sy", "tx", "ty", cell, 0.0).select(src, "_cx", "_cy")
    pairs = cells.join(segment_cells(e, *ENDS, cell, reach_m).select(tgt, "_cx", "_cy"), ["_cx", "_cy"]).select(src, tgt).distinct()
    aligned = geo.angle_deg(c("tx") - c("sx"), c("ty") - c("sy"), c("bx") - c("ax"), c("by") - c("ay"), directed=False) <= angle
    side = lambda a, b, p: (c(b[0]) - c(a[0])) * (c(p[1]) - c(a[1])) - (c(b[1]) - c(a[1])) * (c(p[0]) - c(a[0]))
    s0, s1, e0, e1 = ("sx", "sy"), ("tx", "ty"), ("ax", "ay"), ("bx", "by")
    crossing = (side(s0, s1, e0) * side(s0, s1, e1) < 0) & (side(e0, e1, s0) * side(e0, e1, s1) < 0)
    apart = F.least(*[geo.point_segment(*q, *s0, *s1) for q in (e0, e1)], *[geo.point_segment(*q, *e0, *e1) for q in (s0, s1)])
    pairs = pairs.join(s, src).join(e, tgt).where(aligned & (crossing | (F.round(apart, 6) <= reach_m)))
    on_source = lambda x, y: F.round(geo.segment_fraction(x, y, "sx", "sy", "tx", "ty"), 9)
    ends = F.array(F.lit(0.0), F.lit(1.0))
    cuts = (pairs.select(src, F.explode(F.array(on_source("ax", "ay"), on_source("bx", "by"))).alias("f0"))
            .unionByName(s.select(src, F.explode(ends).alias("f0"))).distinct())
    pieces = cuts.withColumn("f1", F.lead("f0").over(Window.partitionBy(src).orderBy("f0"))).where("f1 IS NOT NULL")
    place = lambda f: (geo.interpolate("sx", "tx", f), geo.interpolate("sy", "ty", f))
    middle = place((c("f0") + c("f1")) / 2)
    beside = pieces.join(pairs, src).where(
        (F.round(geo.point_segment(*middle, *ENDS), 6) <= reach_m) & F.round(geo.segment_fraction(*middle, *ENDS, clamped=False), 9).between(0, 1))
    long = F.hypot(c("bx") - c("ax"), c("by") - c("ay"))
    offset = lambda f: F.round(geo.segment_fraction(*place(f), *ENDS) * long, 3)
    bound = beside.groupBy(src, "f0").agg(F.count("*").alias("n"), F.min(F.struct(tgt, offset(c("f0")).alias("a"), offset(c("f1")).alias("b"))).alias("_t"))
    one = lambda field: F.when(c("n") == 1, c(f"_t.{field}"))
    return (pieces.join(s.select(src, "_len"), src).join(bound, [src, "f0"], "left")
            .select(src, F.round(c("f0") * c("_len"), 3).alias("from_m"), F.round(c("f1") * c("_len"), 3).alias("to_m"), F.coalesce("n", F.lit(0)).alias("rivals"),
                    one(tgt).alias(tgt), one("a").alias("tgt_from_m"), one("b").alias("tgt_to_m")))
