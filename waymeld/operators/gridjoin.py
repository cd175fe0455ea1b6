"""Spatial joins as equi-joins on grid cells.

The reference side is copied into the cells within reach, the moving side sits in
one cell, and the exact predicate follows the equi-join. No side is broadcast by
hint: AQE broadcasts below its measured threshold and splits skewed cells above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m

METRES_PER_DEGREE = 111_195.0


def _row(lat: Column, height: float) -> Column:
    return F.floor(lat / F.lit(height))


def _width(row: Column, height: float, reach_deg: float) -> Column:
    """Cell width of a latitude row, widened so `reach_deg` never spans two cells."""
    far = F.least(F.lit(89.9), F.greatest(F.abs(row), F.abs(row + 1)) * height + height)
    return F.lit(reach_deg) / F.cos(F.radians(far))


def with_cell(df: DataFrame, lat: str, lng: str, radius_m: float) -> DataFrame:
    """One cell per point, on a grid whose cells are at least `radius_m` wide."""
    reach = radius_m / METRES_PER_DEGREE * 1.001
    row = _row(F.col(lat), reach)
    return df.withColumn("_row", row).withColumn("_colno", F.floor(F.col(lng) / _width(row, reach, reach)))


def with_reach_cells(df: DataFrame, lat: str, lng: str, radius_m: float) -> DataFrame:
    """Every cell a point within `radius_m` can fall in; exact at any latitude."""
    reach = radius_m / METRES_PER_DEGREE * 1.001
    home = _row(F.col(lat), reach)
    rows = df.withColumn("_row", F.explode(F.array(home - 1, home, home + 1)))
    w = _width(F.col("_row"), reach, reach)
    return rows.withColumn("_colno", F.explode(F.sequence(
        F.floor((F.col(lng) - w) / w), F.floor((F.col(lng) + w) / w))))


def within_radius(points: DataFrame, places: DataFrame, radius_m: float, keys: list[str] | None = None,
                  point: tuple[str, str] = ("lat", "lng"), place: tuple[str, str] = ("p_lat", "p_lng"),
                  strict: bool = False, earth_m: float = 6_371_000.0, name: str = "distance_m") -> DataFrame:
    """All (point, place) pairs within a radius, with their great-circle distance."""
    left = with_cell(points, *point, radius_m)
    right = with_reach_cells(places, *place, radius_m)
    d = haversine_m(F.col(point[0]), F.col(point[1]), F.col(place[0]), F.col(place[1]), earth_m)
    joined = left.join(right, [*(keys or []), "_row", "_colno"])
    # The latitude box is far cheaper than trigonometry; Catalyst keeps this order.
    near = joined.where(F.abs(F.col(point[0]) - F.col(place[0])) <= radius_m / METRES_PER_DEGREE * 1.001)
    near = near.withColumn(name, d).drop("_row", "_colno")
    return near.where(F.col(name) < radius_m if strict else F.col(name) <= radius_m)


def nearest_within(points: DataFrame, places: DataFrame, radius_m: float, place_id: str,
                   keys: list[str] | None = None, point: tuple[str, str] = ("lat", "lng"),
                   place: tuple[str, str] = ("p_lat", "p_lng"), strict: bool = False,
                   earth_m: float = 6_371_000.0) -> DataFrame:
    """Nearest place of each distinct position: keys, position, place_id, distance_m.

    Positions and places are deduplicated first (equal places keep the lowest
    id, which is also the tie rule), so repeats never multiply the pairs. The
    minimum combines map-side. Join the result back on the position.
    """
    keys = keys or []
    spots = points.select(*keys, *point).distinct()
    sites = places.groupBy(*keys, *place).agg(F.min(place_id).alias(place_id))
    pairs = within_radius(spots, sites, radius_m, keys, point, place, strict, earth_m)
    best = F.min(F.struct(F.round("distance_m", 6).alias("d"), F.col(place_id).alias("id"))).alias("best")
    return (pairs.groupBy(*keys, *point).agg(best)
            .select(*keys, *point, F.col("best.id").alias(place_id), F.col("best.d").alias("distance_m")))


def near_any(points: DataFrame, places: DataFrame, radius_m: float, keys: list[str] | None = None,
             point: tuple[str, str] = ("lat", "lng"), place: tuple[str, str] = ("p_lat", "p_lng"),
             strict: bool = False, earth_m: float = 6_371_000.0) -> DataFrame:
    """Semi join: points with at least one place within the radius."""
    keys = keys or []
    left = with_cell(points, *point, radius_m)
    right = with_reach_cells(places.select(*keys, *place).distinct(), *place, radius_m)
    d = haversine_m(left[point[0]], left[point[1]], right[place[0]], right[place[1]], earth_m)
    cond = (left["_row"] == right["_row"]) & (left["_colno"] == right["_colno"])
    for k in keys:
        cond = cond & (left[k] == right[k])
    cond = cond & ((d < radius_m) if strict else (d <= radius_m))
    return left.join(right, cond, "left_semi").drop("_row", "_colno")


def planar_cell(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / F.lit(cell))).withColumn("_cy", F.floor(F.col(y) / F.lit(cell)))


def box_cells(df: DataFrame, west: Column, south: Column, east: Column, north: Column,
              cell: float) -> DataFrame:
    """Copy a row into every planar cell its box touches. Split long shapes first."""
    return (df.withColumn("_cx", F.explode(F.sequence(F.floor(west / F.lit(cell)), F.floor(east / F.lit(cell)))))
            .withColumn("_cy", F.explode(F.sequence(F.floor(south / F.lit(cell)), F.floor(north / F.lit(cell))))))


def segment_cells(df: DataFrame, ax: str, ay: str, bx: str, by: str, cell: float,
                  margin: float = 0.0) -> DataFrame:
    """A row for each cell a segment passes near; cut to cell-length pieces, so that a long
    diagonal does not fill its whole box. Cells are made distinct inside the row, before
    they are copied, so rows need no shuffle to be unique."""
    c = F.col
    size, pad = F.lit(cell), F.lit(margin)
    pieces = F.greatest(F.lit(1), F.ceil(F.hypot(c(bx) - c(ax), c(by) - c(ay)) / size)).cast("long")

    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor((F.least(low, high) - pad) / size), F.floor((F.greatest(low, high) + pad) / size))

    def piece(i: Column) -> Column:
        at = lambda a, b, k: c(a) + (c(b) - c(a)) * k / pieces
        ys = span(at(ay, by, i), at(ay, by, i + 1))
        return F.flatten(F.transform(span(at(ax, bx, i), at(ax, bx, i + 1)), lambda x: F.transform(
            ys, lambda y: F.struct(x.alias("_cx"), y.alias("_cy")))))

    cells = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), piece)))
    return df.withColumn("_cell", F.explode(cells)).select(*df.columns, "_cell._cx", "_cell._cy")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell_deg: float,
                    point: tuple[str, str] = ("lng", "lat"),
                    box: tuple[str, str, str, str] = ("west", "south", "east", "north")) -> DataFrame:
    """Inner join of points to boxes holding them (west/south closed, east/north open)."""
    left = planar_cell(points, *point, cell_deg)
    right = box_cells(boxes, *(F.col(c) for c in box), cell_deg)
    x, y = F.col(point[0]), F.col(point[1])
    return (left.join(right, ["_cx", "_cy"])
            .where((x >= F.col(box[0])) & (x < F.col(box[2])) & (y >= F.col(box[1])) & (y < F.col(box[3])))
            .drop("_cx", "_cy"))
