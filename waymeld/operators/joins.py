"""Spatial, temporal and identity joins of journeys with reference catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage
from .gridjoin import box_cells, planar_cell, segment_cells, within_radius


def polygon_pairs(points: DataFrame, sites: DataFrame, cell: float, x: str = "lng", y: str = "lat") -> DataFrame:
    """(point, site) pairs with the point inside the site's rings.

    `sites` holds rings and the box columns west, south, east, north. A site is
    copied into the cells of its box; the box test runs before the ring test.
    """
    left = planar_cell(points, x, y, cell)
    right = box_cells(sites, F.col("west"), F.col("south"), F.col("east"), F.col("north"), cell)
    near = left.join(right, ["_cx", "_cy"]).where(F.col(x).between(F.col("west"), F.col("east")) & F.col(y).between(F.col("south"), F.col("north")))
    return near.where(geo.in_polygon(x, y, "rings")).drop("_cx", "_cy", "rings", "west", "south", "east", "north")


def lines_in_sites(lines: DataFrame, sites: DataFrame, ids: list[str], site: str, cell: float) -> DataFrame:
    """(line, site, share): lines with a stretch of positive length inside a site."""
    left = segment_cells(lines, "ax", "ay", "cx", "cy", cell).dropDuplicates([*ids, "_cx", "_cy"])
    right = box_cells(sites.select(site, "west", "south", "east", "north"), F.col("west"), F.col("south"), F.col("east"), F.col("north"), cell)
    near = (left.join(right, ["_cx", "_cy"])
            .where((F.greatest("ax", "cx") >= F.col("west")) & (F.least("ax", "cx") <= F.col("east"))
                   & (F.greatest("ay", "cy") >= F.col("south")) & (F.least("ay", "cy") <= F.col("north")))
            .dropDuplicates([*ids, site]).drop("_cx", "_cy", "west", "south", "east", "north"))
    # Rings ride in after the dedupe, so the wide column is shuffled once per real pair.
    share = near.join(sites.select(site, "rings"), site).withColumn("share", geo.inside_share("ax", "ay", "cx", "cy", "rings"))
    return share.where("share > 0").drop("rings")


def segments_near(segments: DataFrame, places: DataFrame, ids: list[str], place_id: str, reach_m: float, distinct: bool = True) -> DataFrame:
    """(segment, place) pairs whose distance is within the place's own radius (<= reach_m).

    A pair that meets in several cells comes once, or without `distinct` once a cell.
    """
    cell = reach_m / 60_000.0
    left = segment_cells(segments, "ax", "ay", "cx", "cy", cell)
    left = left.dropDuplicates([*ids, "_cx", "_cy"]) if distinct else left
    k = reach_m / 111_195.0 * 1.01
    wide = k / F.cos(F.radians(F.least(F.lit(89.0), F.abs("p_lat") + k)))
    right = box_cells(places, F.col("p_lng") - wide, F.col("p_lat") - k, F.col("p_lng") + wide, F.col("p_lat") + k, cell)
    d = geo.point_segment_m("p_lng", "p_lat", "ax", "ay", "cx", "cy")
    near = left.join(right, ["_cx", "_cy"]).drop("_cx", "_cy").where(d <= F.col("radius_m"))
    return near.dropDuplicates([*ids, place_id]) if distinct else near


def owners_near(segments: DataFrame, places: DataFrame, ids: list[str], owner: str, place_id: str, reach_m: float) -> DataFrame:
    """(place, n): different owners of the segments within each place's own radius; places without one are left out.

    Equal places of one radius are met once, and owners are counted once a place.
    """
    site = ["p_lat", "p_lng", "radius_m"]
    met = segments_near(segments, places.select(*site).distinct().withColumn("_site", F.struct(*site)), ids, "_site", reach_m, distinct=False)
    n = met.select(owner, *site).distinct().groupBy(*site).agg(F.count(owner).alias("n"))
    return places.join(n, site).select(place_id, "n")


def dated_markers_near(segments: DataFrame, markers: DataFrame, ids: list[str], marker: str, at: str, reach_m: float = 100.0) -> DataFrame:
    """(ids, marker, distance_m): segments within `reach_m` ground metres of a marker that is valid at their time.

    Segments (ax, ay, cx, cy in degrees, `at`) are unique by `ids`; markers hold p_lat, p_lng, valid_from and valid_until, either of which may be
    null for no bound. The spherical grid join takes a margin for the ellipsoid, whose metres then decide.
    """
    c = F.col
    wide = segments_near(segments, markers.withColumn("radius_m", F.lit(reach_m * 1.02)), ids, marker, reach_m * 1.02)
    valid = F.coalesce(c(at) >= c("valid_from"), c("valid_from").isNull()) & F.coalesce(c(at) <= c("valid_until"), c("valid_until").isNull())
    d = F.round(geo.geodesic_to_segment_m("p_lng", "p_lat", "ax", "ay", "cx", "cy"), 6)
    return wide.where(valid).select(*ids, marker, d.alias("distance_m")).where(c("distance_m") <= reach_m)


BOUNDS = ["valid_from", "valid_until"]


def dated_reach(points: DataFrame, markers: DataFrame, radius_m: float, *found: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(lat, lng, valid_from, valid_until, by, found): aggregates over the markers within `radius_m` of each distinct position, by their dates.

    Pairs follow the distinct positions, not the points: a marker's dates are no part of the distance, so points of all
    times share them, and what is `found` combines map-side. Join points back by `at_their_time`.
    """
    pairs = within_radius(points.select("lat", "lng").distinct(), markers, radius_m)
    groups = ["lat", "lng", *BOUNDS, *by]
    return pairs.groupBy(*groups).agg(*found) if found else pairs.select(*groups).distinct()


def at_their_time(points: DataFrame, reach: DataFrame, at: str) -> DataFrame:
    """Points with the rows of `dated_reach` that are valid at their time (both bounds count)."""
    return points.join(reach, ["lat", "lng"]).where(F.col(at).between(F.col(BOUNDS[0]), F.col(BOUNDS[1])))


def first_markers(points: DataFrame, markers: DataFrame, radius_m: float, owner: str, at: str, marker: str, kind: str, wanted: int) -> tuple[DataFrame, DataFrame]:
    """(owner, kind, at) of the first point within reach of a valid marker of each kind, and (owner, at) when the owner had reached `wanted` different markers.

    A point with `wanted` markers of one pair of dates settles its owner, so markers are only told apart for points before the first such one,
    each of which has fewer of them. `marker` is unique.
    """
    sites = markers.groupBy("p_lat", "p_lng", *BOUNDS, kind).agg(F.count("*").alias("_n"))
    kinds = dated_reach(points, sites, radius_m, F.sum("_n").alias("_n"), by=(kind,))
    # Kinds are few; a row for each pair of dates, not for each kind, meets the points.
    reach = cut_lineage(kinds.groupBy("lat", "lng", *BOUNDS).agg(F.sum("_n").alias("_n"), F.collect_set(kind).alias("_kinds")))
    hits = at_their_time(points.select(owner, at, "lat", "lng"), reach, at)
    first = hits.select(owner, at, F.explode("_kinds").alias(kind)).groupBy(owner, kind).agg(F.min(at).alias(at))
    full = hits.where(F.col("_n") >= wanted).groupBy(owner).agg(F.min(at).alias("_full"))
    early = (hits.where(F.col("_n") < wanted).join(full, owner, "left").where(F.col("_full").isNull() | (F.col(at) < F.col("_full")))
             .select(owner, at, "lat", "lng", *BOUNDS).distinct())
    early = cut_lineage(early)  # read twice
    named = within_radius(early.select("lat", "lng", *BOUNDS).distinct(), markers, radius_m, BOUNDS).select("lat", "lng", *BOUNDS, marker)
    facts = early.join(named, ["lat", "lng", *BOUNDS]).groupBy(owner, marker).agg(F.min(at).alias(at))
    w = Window.partitionBy(owner).orderBy(at, marker)
    late = facts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= wanted).groupBy(owner).agg(F.count("*").alias("_k"), F.max(at).alias("_late"))
    reached = full.join(late.where(F.col("_k") == wanted), owner, "full_outer")
    return first, reached.select(owner, F.least("_full", "_late").alias(at))


def nearest_own_radius(points: DataFrame, places: DataFrame, most_m: float, point_id: str, place_id: str) -> DataFrame:
    """Nearest place among those whose own radius holds the point.

    Equal positions, and equal places of one radius (the lowest id, as in a tie), collapse before pairs form.
    """
    spots = points.select("lat", "lng").distinct()
    sites = places.groupBy("p_lat", "p_lng", "radius_m").agg(F.min(place_id).alias(place_id))
    pairs = within_radius(spots, sites, most_m).where("distance_m <= radius_m")
    best = pairs.groupBy("lat", "lng").agg(F.min(F.struct(F.round("distance_m", 6).alias("d"), F.col(place_id).alias("id"))).alias("b"))
    return (points.select(point_id, "lat", "lng").join(best, ["lat", "lng"]).groupBy(point_id).agg(F.min("b").alias("b"))
            .select(point_id, F.col("b.id").alias(place_id), F.col("b.d").alias("distance_m")))


def unique_match(pairs: DataFrame, point_id: str, place_id: str) -> DataFrame:
    """Keep a point's match only where exactly one place fits."""
    return (pairs.groupBy(point_id).agg(F.count("*").alias("_n"), F.min(place_id).alias(place_id))
            .where("_n = 1").drop("_n"))


def smallest_area(pairs: DataFrame, point_id: str, site: str, area: str) -> DataFrame:
    return (pairs.groupBy(point_id).agg(F.min(F.struct(area, site)).alias("b"))
            .select(point_id, F.col(f"b.{site}").alias(site)))


def set_comparison(old: DataFrame, new: DataFrame, key: str, item: str) -> DataFrame:
    """added / removed / unchanged items per key by one full outer join."""
    o = old.select(key, item).distinct().withColumn("_o", F.lit(1))
    n = new.select(key, item).distinct().withColumn("_n", F.lit(1))
    return (o.join(n, [key, item], "full_outer").groupBy(key)
            .agg(F.count_if(F.col("_o").isNull()).alias("added"), F.count_if(F.col("_n").isNull()).alias("removed"),
                 F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("unchanged")))


def identity_join(travelled: DataFrame, paths: DataFrame) -> DataFrame:
    """Travelled ways bound to reference paths by way id, geometry hash and mode - never by proximity."""
    return travelled.join(paths, ["way_id", "geometry_sha"]).where(F.array_contains(F.split("modes", ","), F.col("mode")))


def members_of_relations(relations: DataFrame, root: str = "root") -> DataFrame:
    """Expand nested relations to their leaf members: (root, member, depth).

    `relations` holds parent, child, kind ('relation' or 'way'). Each round is
    one equi-join on the frontier; a child met on its own path is a cycle and
    is reported, not followed.
    """
    from ..session import cut_lineage
    step = relations.select(F.col("parent").alias("_p"), F.col("child").alias("_c"), F.col("kind").alias("_k"))
    front = cut_lineage(relations.join(relations.where("kind = 'relation'").select(F.col("child").alias("parent")).distinct(), "parent", "left_anti")
                        .select(F.col("parent").alias("root"), F.array("parent").alias("path"), "child", "kind", F.lit(1).alias("depth")))
    done = front.where("kind = 'way'").select("root", F.col("child").alias("member"), "depth", F.lit(False).alias("cycle"))
    while True:
        nested = front.where("kind = 'relation'")
        looped = nested.where(F.array_contains("path", F.col("child")))
        done = done.unionByName(looped.select("root", F.col("child").alias("member"), "depth", F.lit(True).alias("cycle")))
        ahead = nested.where(~F.array_contains("path", F.col("child")))
        front = cut_lineage(ahead.join(step, F.col("child") == F.col("_p"))
                            .select("root", F.concat("path", F.array("child")).alias("path"), F.col("_c").alias("child"), F.col("_k").alias("kind"), (F.col("depth") + 1).alias("depth")))
        if front.isEmpty():
            return done
        done = done.unionByName(front.where("kind = 'way'").select("root", F.col("child").alias("member"), "depth", F.lit(False).alias("cycle")))


def asof_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, take: list[str],
               chunk_ms: int = 3_600_000) -> DataFrame:
    """Earliest right row with the same key at or after each left row.

    One pass over the union: rows of both sides are ordered by time and the next
    right row is carried back over chunk borders, so a hot key stays spread.
    """
    from .ordered import running
    picked = F.struct(F.col("_at").alias("at"), *take)
    r = right.withColumn("_at", F.col(right_at)).select(*keys, "_at", F.lit(1).alias("_side"), picked.alias("_pick"), F.lit(None).cast("struct<%s>" % ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in left.schema.fields)).alias("_row"))
    lrow = left.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(r.schema["_pick"].dataType).alias("_pick"), F.struct(*left.columns).alias("_row"))
    # A right row at the same time counts: it sorts after the left row.
    both = r.select(lrow.columns).unionByName(lrow)
    run = running(both, keys, F.floor(F.col("_at") / chunk_ms), ["_at", "_side"], {"_next": ("next", "_pick")})
    return run.where("_side = 0").select("_row.*", *[F.col(f"_next.{c}").alias(c) for c in ["at", *take]])
