"""Coverage of a reference network: alignment, ledgers, anchors and completion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, observed_overlap
from .gridjoin import box_cells, nearest_within, segment_cells
from .intervals import interval_union, overlap_join
from .ordered import islands, neighbours, seq_chunk


@dataclass(frozen=True)
class AlignPolicy:
    """Gates of the observed-pair rule; every limit is a parameter."""
    accuracy_m: float = 5.0
    gap_ms: int = 8_000
    least_motion_m: float = 2.0
    speed_m_per_ms: float = 0.06
    density_m: float = 35.0
    radius_m: float = 7.0
    seam_m: float = 0.5
    cell_m: float = 40.0


def observation_pairs(fixes: DataFrame, policy: AlignPolicy = AlignPolicy()) -> DataFrame:
    """Consecutive fix pairs of a journey with the first gate that holds them, or null."""
    cols = ["x", "y", "t_ms", "accuracy_m"]
    rows = neighbours(fixes, ["journey_id"], "seq", {f"_{c}": (c, 1) for c in cols}).where("_t_ms IS NOT NULL")
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c))
    moved, dt = F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")), F.col("_t_ms") - F.col("t_ms")
    accurate = lambda c: (F.col(c) > 0) & (F.col(c) <= policy.accuracy_m)
    reason = (F.when(bad("x") | bad("y") | bad("accuracy_m") | bad("_x") | bad("_y") | bad("_accuracy_m"), "invalid_fix")
              .when(~(accurate("accuracy_m") & accurate("_accuracy_m")), "fix_accuracy")
              .when(~((dt > 0) & (dt <= policy.gap_ms)), "time_gap")
              .when((moved < policy.least_motion_m) | (moved <= F.col("accuracy_m") + F.col("_accuracy_m")), "insufficient_motion")
              .when(F.try_divide(moved, dt) > policy.speed_m_per_ms, "implausible_speed"))
    return rows.select("journey_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("_x").alias("bx"),
                       F.col("_y").alias("by"), F.greatest("accuracy_m", "_accuracy_m").alias("u"), moved.alias("step_m"),
                       reason.alias("reason"))


def align_pairs(pairs: DataFrame, edges: DataFrame, policy: AlignPolicy = AlignPolicy(),
                extent: tuple[float, float] | None = None) -> DataFrame:
    """Each pair with its hold reason, or with its covered edge spans.

    One row per (pair, span) when aligned and one row per held pair. Edges are
    cut into grid pieces, pairs fill the cells of their box, and the exact
    overlap follows the equi-join.
    """
    gated = pairs.withColumn("reason", F.coalesce(
        "reason", F.when(~((F.col("step_m") > 0) & (F.col("step_m") <= policy.density_m)), "distance_gap")))
    if extent is not None:
        margin = F.col("u") + policy.radius_m
        inside = lambda x, y: F.col(x).between(margin, extent[0] - margin) & F.col(y).between(margin, extent[1] - margin)
        gated = gated.withColumn("reason", F.coalesce(
            "reason", F.when(~(inside("ax", "ay") & inside("bx", "by")), "catalogue_boundary")))
    open_pairs = gated.where("reason IS NULL").drop("reason")
    margin = F.col("u") + policy.radius_m
    left = box_cells(open_pairs, F.least("ax", "bx") - margin, F.least("ay", "by") - margin,
                     F.greatest("ax", "bx") + margin, F.greatest("ay", "by") + margin, policy.cell_m)
    named = edges.select("edge_id", "a_node", "b_node", "direction", "eligible", "length_mm",
                         *[F.col(c).alias(f"e{c}") for c in ("ax", "ay", "bx", "by")])
    right = segment_cells(named, "eax", "eay", "ebx", "eby", policy.cell_m)
    met = left.join(right, ["_cx", "_cy"]).drop("_cx", "_cy")
    # Boxes first: plain comparisons in generated code thin the pairs out.
    for axis in ("x", "y"):
        met = met.where((F.greatest(f"ea{axis}", f"eb{axis}") >= F.least(f"a{axis}", f"b{axis}") - margin)
                        & (F.least(f"ea{axis}", f"eb{axis}") <= F.greatest(f"a{axis}", f"b{axis}") + margin))
    overlaps = observed_overlap([F.col(c) for c in ("eax", "eay", "ebx", "eby")], [F.col(c) for c in ("ax", "ay", "bx", "by")],
                                [F.lit(policy.radius_m), F.col("u") + policy.radius_m])
    kept = lambda o: o[0].isNotNull() | ((o[1]["end"] - o[1]["start"]) * F.col("step_m") > policy.seam_m)
    # The test sits inside the generator, so the overlap is computed once per pair.
    met = (met.withColumn("o", F.explode(F.filter(F.array(overlaps), kept)))
           .withColumn("hit", F.col("o")[0]).withColumn("rival", F.col("o")[0].isNull()).drop("o")
           .dropDuplicates(["journey_id", "seq", "edge_id"]))
    # Few edges lie within reach of a step of at most `density_m`, so a window
    # per pair is small however hot the journey or the edge is.
    w = Window.partitionBy("journey_id", "seq").orderBy(F.col("hit.start"), F.col("hit.end"), "edge_id")
    whole = Window.partitionBy("journey_id", "seq")
    end_node = lambda at: F.when(F.round(at) == 0, F.col("a_node")).otherwise(F.col("b_node"))
    off_node = lambda at: F.abs(at - F.round(at)) * F.col("length_mm") / 1000
    tagged = (met.withColumn("rivals", F.max("rival").over(whole)).where("hit IS NOT NULL OR rivals")
              .withColumn("out_node", end_node(F.col("hit.exit"))).withColumn("out_off", off_node(F.col("hit.exit")))
              .withColumn("in_node", end_node(F.col("hit.entry"))).withColumn("in_off", off_node(F.col("hit.entry"))))
    prev = lambda c: F.lag(c).over(w)
    seam = (F.col("hit.start") - prev(F.col("hit.end"))) * F.col("step_m")
    joined = ((prev("out_node") == F.col("in_node")) & (prev("out_off") <= policy.seam_m)
              & (F.col("in_off") <= policy.seam_m))
    fault = (F.when(prev("edge_id").isNull(), 0)
             .when((seam < -policy.seam_m) | ((seam < 0) & ~joined), 1)
             .when((seam > policy.seam_m) | ~joined, 2).otherwise(0))
    forward = F.when(F.col("hit.entry") < F.col("hit.exit"), 1).otherwise(-1)
    wrong = (F.col("direction") != 0) & (F.col("direction") != forward)
    judged = (tagged.withColumn("fault", fault)
              .withColumn("place", F.row_number().over(w))
              .withColumn("wrong", wrong)
              .withColumn("lo", F.round(F.least("hit.entry", "hit.exit") * F.col("length_mm")).cast("long"))
              .withColumn("hi", F.round(F.greatest("hit.entry", "hit.exit") * F.col("length_mm")).cast("long")))
    # The first fault along the step decides between the two chain reasons.
    first_fault = F.min(F.when(F.col("fault") > 0, F.struct("place", "fault"))).over(whole)["fault"]
    slack = F.greatest(F.min("hit.start").over(whole), 1 - F.max_by("hit.end", F.struct("hit.start", "hit.end", "edge_id")).over(whole))
    verdict = (F.when(F.col("rivals"), "competing_sections")
               .when(first_fault == 1, "competing_sections").when(first_fault == 2, "disconnected_sections")
               .when(slack * F.col("step_m") > policy.seam_m, "incomplete_alignment")
               .when(F.max("wrong").over(whole), "unsupported_direction")
               .when(F.max((F.col("hi") > F.col("lo")) & F.col("hit").isNotNull()).over(whole) == F.lit(False), "no_alignment")
               .when(~F.min("eligible").over(whole), "out_of_scope_road"))
    decided = (judged.withColumn("verdict", verdict)
               .where("(verdict IS NULL AND hi > lo) OR (verdict IS NOT NULL AND place = 1)")
               .select("journey_id", "seq", "verdict", "edge_id", "lo", "hi"))
    kept = lambda c: F.when(F.col("verdict").isNull(), F.col(c)).alias(c)
    missed = F.when(F.col("edge_id").isNull(), "no_alignment")
    return (gated.select("journey_id", "seq", "reason").join(decided, ["journey_id", "seq"], "left")
            .select("journey_id", "seq", F.coalesce("reason", "verdict", missed).alias("reason"),
                    kept("edge_id"), kept("lo"), kept("hi")))


def ledger_by_edge(spans: DataFrame, edges: DataFrame) -> DataFrame:
    """Unique and total covered millimetres per edge, with contributing journeys."""
    totals = spans.groupBy("edge_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("total_mm"),
                                          F.countDistinct("journey_id").alias("journeys"))
    unique = (interval_union(spans, ["edge_id"]).groupBy("edge_id")
              .agg(F.sum(F.col("hi") - F.col("lo")).alias("unique_mm"), F.count("*").alias("pieces")))
    return (edges.join(totals, "edge_id").join(unique, "edge_id")
            .withColumn("percent", F.round(F.col("unique_mm") * 100.0 / F.col("length_mm"), 6)))


def contributors_at(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Journeys whose evidence covers an offset of an edge, in long form."""
    hit = spans.join(points, "edge_id").where(F.col("at_mm").between(F.col("lo"), F.col("hi")))
    return hit.select("edge_id", "at_mm", "journey_id").distinct()


def bind_spans(spans: DataFrame, bindings: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Re-map source spans onto target offsets.

    Repeated source evidence is united per (route, way, mode) before it meets
    the catalogue, so a commute travelled 1 000 times is bound once.
    """
    united = interval_union(spans, ["route_id", "way_id", "mode"])
    met = overlap_join(united, bindings, ["route_id", "way_id"], ("lo", "hi"), ("start_mm", "end_mm"), width)
    a, z = F.greatest("lo", "start_mm"), F.least("hi", "end_mm")
    scale = (F.col("high_mm") - F.col("low_mm")) / (F.col("end_mm") - F.col("start_mm"))
    at = lambda v: F.round(F.col("low_mm") + (v - F.col("start_mm")) * scale).cast("long")
    return (met.where(F.array_contains(F.split("modes", ","), F.col("mode")))
            .select("route_id", "way_id", "target_id", "mode", a.alias("src_lo"), z.alias("src_hi"),
                    at(a).alias("lo"), at(z).alias("hi")))


def by_mode_and_combined(bound: DataFrame) -> DataFrame:
    """Each row once under its own mode and once under 'combined'."""
    return bound.withColumn("mode", F.explode(F.array(F.col("mode"), F.lit("combined"))))


def replace_journeys(ledger: DataFrame, spans: DataFrame, changed: DataFrame, removed: DataFrame,
                     keys: list[str] | None = None) -> DataFrame:
    """New spans after replacing or removing journeys: the old contribution goes, the new one enters."""
    touched = changed.select("journey_id").distinct().unionByName(removed.select("journey_id").distinct()).distinct()
    return ledger.join(touched, "journey_id", "left_anti").unionByName(spans)


def covered_anchors(fixes: DataFrame, anchors: DataFrame, radius_m: float, keys: list[str],
                    strict: bool = True, removed: DataFrame | None = None) -> DataFrame:
    """Anchors credited by the nearest-anchor rule; corrections outrank evidence."""
    places = anchors.select(*keys, "anchor_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    hit = nearest_within(fixes, places, radius_m, "anchor_id", keys, strict=strict).select(*keys, "anchor_id").distinct()
    return hit if removed is None else hit.join(removed, [*keys, "anchor_id"], "left_anti")


def completion(covered: DataFrame, anchors: DataFrame, keys: list[str], total_m: Column) -> DataFrame:
    """Covered share of each road's anchors, and the unique length it stands for."""
    sizes = anchors.groupBy(*keys).agg(F.count("*").alias("anchors"), total_m.alias("total_m"))
    done = covered.groupBy(*keys).agg(F.count("*").alias("covered"))
    share = F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.col("anchors"))
    return (sizes.join(done, keys, "left")
            .select(*keys, "anchors", F.coalesce("covered", F.lit(0)).alias("covered"),
                    F.round(share * 100, 6).alias("percent"), F.round(share * F.col("total_m"), 6).alias("unique_m")))


def map_sections(anchors: DataFrame, keys: list[str], order: str, covered: Column, limit_m: float = 250.0,
                 before: Column | None = None) -> DataFrame:
    """Runs of consecutive anchor pairs with one state, broken where anchors lie apart.

    With `before` (covered in the prior snapshot) only newly covered runs remain.
    `order` is the dense position of the anchor on its road.
    """
    flags = anchors.withColumn("_cov", covered).withColumn("_old", before if before is not None else F.lit(False))
    pairs = neighbours(flags, keys, order, {"_lat": ("lat", 1), "_lng": ("lng", 1), "_c2": ("_cov", 1), "_o2": ("_old", 1)})
    pairs = pairs.where("_lat IS NOT NULL").withColumn("_d", haversine_m("lat", "lng", "_lat", "_lng", 6_371_000.0))
    state = F.col("_cov") | F.col("_c2")
    if before is not None:
        state = state & ~F.col("_old") & ~F.col("_o2")
    pairs = pairs.withColumn("_near", F.col("_d") <= limit_m).withColumn("state", state)
    tagged = neighbours(pairs, keys, order, {"_n0": ("_near", -1), "_s0": ("state", -1)})
    opens = F.col("_n0").isNull() | ~F.col("_n0") | (F.col("_s0") != F.col("state"))
    runs = islands(tagged, keys, seq_chunk(order), [order], opens, "section").where("_near")
    if before is not None:
        runs = runs.where("state")
    return (runs.groupBy(*keys, "section", "state")
            .agg(F.min(order).alias("first_pos"), (F.max(order) + 1).alias("last_pos"),
                 F.round(F.sum("_d"), 3).alias("length_m")))
