"""Scalar geometry, text and filter operators over the given tables."""

from pyspark.sql import functions as F

from ..functions import geo, modes, text
from ..operators.ordered import neighbours
from .coverage import hav
from .registry import query

LINE_SQL = """legs AS (SELECT journey_id, seq, lat AS ay, lng AS ax, lead(lat) OVER w AS cy, lead(lng) OVER w AS cx, lead(t_ms) OVER w AS t2, t_ms
  FROM trace WINDOW w AS (PARTITION BY journey_id ORDER BY seq))"""


def legs(t, keep=()):
    """Consecutive positions of a recording as segments."""
    rows = neighbours(t.trace, ["journey_id"], "seq", {"cy": ("lat", 1), "cx": ("lng", 1), "t2": ("t_ms", 1)})
    return rows.where("cy IS NOT NULL").select("journey_id", "seq", F.col("lat").alias("ay"), F.col("lng").alias("ax"),
                                               "cy", "cx", "t_ms", "t2", *keep)


def ring(t):
    """A five-corner site per box: one corner is pushed outwards."""
    c = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    shape = F.array(c("west", "south"), c("east", "south"), c("east + 0.01D", "(south + north) / 2"), c("east", "north"), c("west", "north"), c("west", "south"))
    return t.boxes.select("box_id", "name", "west", "south", "east", "north", F.array(shape).alias("rings"))


# The same ring as an edge list.
RING_SQL = """redges AS (
 SELECT box_id, west AS ex, south AS ey, east AS fx, south AS fy FROM boxes UNION ALL SELECT box_id, east, south, east + 0.01::DOUBLE, (south + north) / 2 FROM boxes
 UNION ALL SELECT box_id, east + 0.01::DOUBLE, (south + north) / 2, east, north FROM boxes UNION ALL SELECT box_id, east, north, west, north FROM boxes
 UNION ALL SELECT box_id, west, north, west, south FROM boxes)"""


@query("geo01_haversine", "trace", f"WITH {LINE_SQL} SELECT journey_id, seq, round({hav('ay', 'ax', 'cy', 'cx')}, 3) AS d1, round({hav('ay', 'ax', 'cy', 'cx', '6371008.8')}, 3) AS d2 FROM legs WHERE t2 IS NOT NULL")
def _(t):
    d = lambda r: F.round(geo.haversine_m("ay", "ax", "cy", "cx", r), 3)
    return legs(t).select("journey_id", "seq", d(geo.EARTH_M).alias("d1"), d(geo.EARTH_MEAN_M).alias("d2"))


@query("geo02_mercator", "fixes", """SELECT event_id, round(radians(lng) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y,
 round(lat, 9) AS back_lat, round(lng, 9) AS back_lng FROM fixes""")
def _(t):
    m = t.fixes.select("event_id", geo.mercator_x("lng").alias("x"), geo.mercator_y("lat").alias("y"))
    return m.select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
                    F.round(geo.mercator_lat("y"), 9).alias("back_lat"), F.round(geo.mercator_lng("x"), 9).alias("back_lng"))


@query("geo03_local_metres", "fixes", """SELECT event_id, round((lng + 1.0) * 111195.08 * cos(radians(51.2)), 3) AS x, round((lat - 51.0) * 111195.08, 3) AS y,
 round(lng, 9) AS back_lng, round(lat, 9) AS back_lat FROM fixes""")
def _(t):
    m = t.fixes.select("event_id", geo.local_x("lng", F.lit(-1.0), F.lit(51.2)).alias("x"), geo.local_y("lat", F.lit(51.0)).alias("y"))
    return m.select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
                    F.round(geo.local_lng("x", F.lit(-1.0), F.lit(51.2)), 9).alias("back_lng"), F.round(geo.local_lat("y", F.lit(51.0)), 9).alias("back_lat"))


@query("geo04_utm_zone30", "anchors", """WITH k AS (SELECT 0.0016792203863836474::DOUBLE AS n, 6378137.0::DOUBLE AS a),
p AS (SELECT anchor_id, radians(lat) AS phi, radians(lng + 3) AS lam, sqrt(0.00669437999014132) AS e FROM anchors),
s AS (SELECT anchor_id, lam, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM p),
x AS (SELECT anchor_id, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM s)
SELECT anchor_id,
 round(500000 + 0.9996 * a / (1 + n) * (1 + n*n/4 + n*n*n*n/64) * (eta + (n/2 - 2*n*n/3 + 5*n*n*n/16) * cos(2*xi) * sinh(2*eta) + (13*n*n/48 - 3*n*n*n/5) * cos(4*xi) * sinh(4*eta) + 61*n*n*n/240 * cos(6*xi) * sinh(6*eta)), 2) AS easting,
 round(0.9996 * a / (1 + n) * (1 + n*n/4 + n*n*n*n/64) * (xi + (n/2 - 2*n*n/3 + 5*n*n*n/16) * sin(2*xi) * cosh(2*eta) + (13*n*n/48 - 3*n*n*n/5) * sin(4*xi) * cosh(4*eta) + 61*n*n*n/240 * sin(6*xi) * cosh(6*eta)), 2) AS northing
FROM x, k""")
def _(t):
    return t.anchors.select("anchor_id", geo.utm30("lat", "lng").alias("p")).select(
        "anchor_id", F.round("p.x", 2).alias("easting"), F.round("p.y", 2).alias("northing"))


@query("geo04_british_grid")
def _(t):
    # Inverse grid has no short SQL form; tests/test_spatial.py checks known points.
    g = t.anchors.select("anchor_id", F.expr("400000 + anchor_id % 2000 * 100D").alias("e"), F.expr("200000 + anchor_id % 3000 * 100D").alias("n"))
    return g.select("anchor_id", geo.british_grid_to_wgs84("e", "n").alias("p")).select(
        "anchor_id", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


PT = """pt AS (SELECT *, (ax - px) * k AS x0, ay - py AS y0, (cx - px) * k AS x1, cy - py AS y1 FROM
  (SELECT *, -0.6 AS px, 51.02 AS py, cos(radians(51.02)) AS k FROM legs WHERE t2 IS NOT NULL)),
fr AS (SELECT *, CASE WHEN (x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) = 0 THEN 0 ELSE greatest(0, least(1, (-x0*(x1-x0) - y0*(y1-y0)) / ((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)))) END AS f FROM pt)"""


@query("geo05_point_segment", "trace", f"WITH {LINE_SQL}, {PT} SELECT journey_id, seq, round(sqrt(pow(x0 + f*(x1-x0), 2) + pow(y0 + f*(y1-y0), 2)) * 111195, 2) AS d, round(f, 5) AS f FROM fr")
def _(t):
    p, q = F.lit(-0.6), F.lit(51.02)
    k = F.cos(F.radians(q))
    f = geo.segment_fraction(F.lit(0.0), F.lit(0.0), (F.col("ax") - p) * k, F.col("ay") - q, (F.col("cx") - p) * k, F.col("cy") - q)
    return legs(t).select("journey_id", "seq", F.round(geo.point_segment_m(p, q, "ax", "ay", "cx", "cy"), 2).alias("d"), F.round(f, 5).alias("f"))


@query("geo06_interpolate", "trace", f"WITH {LINE_SQL} SELECT journey_id, seq, round(ax + (cx - ax) * 0.25, 9) AS lng, round(ay + (cy - ay) * 0.25, 9) AS lat FROM legs WHERE t2 IS NOT NULL")
def _(t):
    return legs(t).select("journey_id", "seq", F.round(geo.interpolate("ax", "cx", F.lit(0.25)), 9).alias("lng"), F.round(geo.interpolate("ay", "cy", F.lit(0.25)), 9).alias("lat"))


@query("geo07_length_and_positions", "trace", f"""WITH {LINE_SQL} SELECT journey_id, seq, round(sum({hav('ay', 'ax', 'cy', 'cx', '6371008.8')}) OVER (PARTITION BY journey_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 2) AS position_m
FROM legs WHERE t2 IS NOT NULL""")
def _(t):
    from ..operators.ordered import running, seq_chunk
    d = legs(t).withColumn("d", geo.haversine_m("ay", "ax", "cy", "cx", geo.EARTH_MEAN_M))
    return running(d, ["journey_id"], seq_chunk(), ["seq"], {"position_m": ("sum", "d")}).select("journey_id", "seq", F.round("position_m", 2).alias("position_m"))


# Features as short polylines: four vertices per order line.
POLY = """lines AS (SELECT l_orderkey AS journey_id, l_linenumber AS feature_idx,
  list_transform([0, 1, 2, 3], lambda k: -1.0::DOUBLE + ((l_partkey * 37 + k * 3 * (1 + l_partkey % 4)) % 6000)::DOUBLE / 10000) AS xs,
  list_transform([0, 1, 2, 3], lambda k: 51.0::DOUBLE + ((l_partkey * 53 + k * (2 + l_partkey % 3)) % 4000)::DOUBLE / 10000) AS ys FROM lineitem),
seg AS (SELECT journey_id, feature_idx, k AS i, xs[k + 1] AS ax, ys[k + 1] AS ay, xs[k + 2] AS cx, ys[k + 2] AS cy FROM lines, (SELECT unnest([0, 1, 2]) AS k)),
texts AS (SELECT journey_id, feature_idx, list_transform([1, 2, 3, 4], lambda k: CAST(round(xs[k] * 10000000) AS BIGINT) || ',' || CAST(round(ys[k] * 10000000) AS BIGINT)) AS v FROM lines)"""


def polylines(t):
    vertex = lambda k: F.struct(
        F.expr(f"-1.0D + CAST((l_partkey * 37 + {k * 3} * (1 + l_partkey % 4)) % 6000 AS DOUBLE) / 10000").alias("x"),
        F.expr(f"51.0D + CAST((l_partkey * 53 + {k} * (2 + l_partkey % 3)) % 4000 AS DOUBLE) / 10000").alias("y"))
    from ..operators.ordered import spread
    rows = spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"))
    return rows.select(F.col("l_orderkey").alias("journey_id"), F.col("l_linenumber").alias("feature_idx"),
                       F.array(*[vertex(k) for k in range(4)]).alias("line"))


def poly_segments(t):
    return polylines(t).select("journey_id", "feature_idx", F.explode(geo.steps("line")).alias("e")).select(
        "journey_id", "feature_idx", F.col("e.i").alias("i"), F.col("e.ax").alias("ax"), F.col("e.ay").alias("ay"), F.col("e.bx").alias("cx"), F.col("e.by").alias("cy"))


@query("geo08_explode_segments", "", f"WITH {POLY} SELECT journey_id, feature_idx, i, round(ax, 6) AS ax, round(ay, 6) AS ay, round(cx, 6) AS cx, round(cy, 6) AS cy FROM seg")
def _(t):
    r = lambda c: F.round(c, 6).alias(c)
    return poly_segments(t).select("journey_id", "feature_idx", "i", r("ax"), r("ay"), r("cx"), r("cy"))


@query("geo09_densify", "trace", f"""WITH {LINE_SQL}, n AS (SELECT *, greatest(1, CAST(ceil({hav('ay', 'ax', 'cy', 'cx')} / 10) AS BIGINT)) AS parts FROM legs WHERE t2 IS NOT NULL)
SELECT journey_id, seq, k, round(ax + (cx - ax) * k / parts, 8) AS lng, round(ay + (cy - ay) * k / parts, 8) AS lat FROM (SELECT *, unnest(range(0, parts)) AS k FROM n)""")
def _(t):
    n = legs(t).withColumn("parts", geo.samples_for(geo.haversine_m("ay", "ax", "cy", "cx"), 10))
    k = n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    f = F.col("k") / F.col("parts")
    return k.select("journey_id", "seq", "k", F.round(geo.interpolate("ax", "cx", f), 8).alias("lng"), F.round(geo.interpolate("ay", "cy", f), 8).alias("lat"))


@query("geo10_stations_with_carry", "trace", f"""WITH {LINE_SQL}, d AS (SELECT *, {hav('ay', 'ax', 'cy', 'cx')} AS d FROM legs WHERE t2 IS NOT NULL),
c AS (SELECT *, round(sum(d) OVER (PARTITION BY journey_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS hi FROM d),
s AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY journey_id ORDER BY seq), 0) AS lo FROM c),
k AS (SELECT *, unnest(range(CAST(ceil(lo / 100) AS BIGINT), CAST(ceil(hi / 100) AS BIGINT))) AS station FROM s WHERE hi > lo)
SELECT journey_id, station, round(ax + (cx - ax) * (station * 100 - lo) / (hi - lo), 6) AS lng, round(ay + (cy - ay) * (station * 100 - lo) / (hi - lo), 6) AS lat FROM k""")
def _(t):
    from ..operators.traces import stations
    return stations(legs(t), ["journey_id"], "seq", 100.0).select("journey_id", "station", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


@query("geo11_segment_keys", "", f"""WITH {POLY}, k AS (SELECT CAST(round(ax * 100000) AS BIGINT) || ',' || CAST(round(ay * 100000) AS BIGINT) AS a, CAST(round(cx * 100000) AS BIGINT) || ',' || CAST(round(cy * 100000) AS BIGINT) AS b, * FROM seg)
SELECT least(a, b) || '|' || greatest(a, b) AS seg_key, count(*) AS uses, count(DISTINCT journey_id) AS journeys FROM k GROUP BY 1""")
def _(t):
    return poly_segments(t).groupBy(geo.segment_key("ax", "ay", "cx", "cy").alias("seg_key")).agg(F.count("*").alias("uses"), F.countDistinct("journey_id").alias("journeys"))


@query("geo12_cells_and_neighbours", "fixes", """SELECT CAST(floor(lng / 0.01) AS BIGINT) + dx AS cx, CAST(floor(lat / 0.01) AS BIGINT) + dy AS cy, count(*) AS fixes
FROM fixes, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) GROUP BY 1, 2""")
def _(t):
    # Count once per own cell, then copy the counts (not the fixes) to the neighbours.
    own = t.fixes.groupBy(F.floor(F.col("lng") / F.lit(0.01)).alias("x"), F.floor(F.col("lat") / F.lit(0.01)).alias("y")).agg(F.count("*").alias("n"))
    around = own.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    return around.groupBy((F.col("x") + F.col("dx")).alias("cx"), (F.col("y") + F.col("dy")).alias("cy")).agg(F.sum("n").alias("fixes"))


@query("geo13_bounding_boxes", "", f"WITH {POLY} SELECT journey_id, feature_idx, round(list_min(xs), 6) AS west, round(list_min(ys), 6) AS south, round(list_max(xs), 6) AS east, round(list_max(ys), 6) AS north, list_min(xs) <= -0.7 AND list_max(xs) >= -0.8 AND list_min(ys) <= 51.3 AND list_max(ys) >= 51.1 AS overlaps FROM lines")
def _(t):
    b = polylines(t).withColumn("b", geo.bbox("line"))
    view = F.struct(F.lit(-0.8).alias("west"), F.lit(51.1).alias("south"), F.lit(-0.7).alias("east"), F.lit(51.3).alias("north"))
    return b.select("journey_id", "feature_idx", *[F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")], geo.boxes_overlap(F.col("b"), view).alias("overlaps"))


INRING = """cross_ AS (SELECT v.venue_id, e.box_id, count(*) FILTER (((ey > v.lat) <> (fy > v.lat)) AND v.lng < (fx - ex) * (v.lat - ey) / (fy - ey) + ex) AS n,
 min(sqrt(pow((ex - v.lng) * cos(radians(v.lat)) + f * ((fx - ex) * cos(radians(v.lat))), 2) + pow(ey - v.lat + f * (fy - ey), 2))) * 111195 AS clear
 FROM venues v JOIN LATERAL (SELECT *, greatest(0, least(1, (-(ex - v.lng) * (fx - ex) * pow(cos(radians(v.lat)), 2) - (ey - v.lat) * (fy - ey)) / (pow((fx - ex) * cos(radians(v.lat)), 2) + pow(fy - ey, 2)))) AS f FROM redges) e ON TRUE GROUP BY ALL)"""


def _near_ring(t):
    """Venues beside every site whose grown box holds them (grid join, then exact)."""
    from ..operators.gridjoin import points_in_boxes
    sites = ring(t).select("box_id", "rings", F.expr("west - 0.001D").alias("west"), F.expr("south - 0.001D").alias("south"), F.expr("east + 0.02D").alias("east"), F.expr("north + 0.001D").alias("north"))
    return points_in_boxes(t.venues.drop("box_id"), sites, 0.1)


@query("geo14_point_in_polygon", "venues boxes", f"WITH {RING_SQL}, {INRING} SELECT venue_id, box_id FROM cross_ WHERE n % 2 = 1")
def _(t):
    return _near_ring(t).where(geo.in_polygon("lng", "lat", "rings")).select("venue_id", "box_id")


@query("geo15_accuracy_containment", "venues boxes", f"WITH {RING_SQL}, {INRING} SELECT venue_id, box_id, round(clear, 1) AS clearance_m FROM cross_ WHERE n % 2 = 1 AND clear >= 150 + venue_id % 50")
def _(t):
    rows = _near_ring(t).where(geo.supports_inside("lng", "lat", F.expr("150 + venue_id % 50"), "rings"))
    return rows.select("venue_id", "box_id", F.round(geo.rings_clearance_m("lng", "lat", "rings"), 1).alias("clearance_m"))


# Long segments against the sites: cut fractions by brute force.
CUT_SQL = RING_SQL + """, long_ AS (SELECT p_partkey AS line_id, -1.0 + ((p_partkey * 37) % 600)::DOUBLE / 1000 + 0.00013 AS ax, 51.0 + ((p_partkey * 53) % 400)::DOUBLE / 1000 + 0.00017 AS ay,
  -1.0 + ((p_partkey * 37) % 600)::DOUBLE / 1000 + 0.00013 + (p_partkey % 7 + 1)::DOUBLE / 50 AS cx, 51.0 + ((p_partkey * 53) % 400)::DOUBLE / 1000 + 0.00017 + (p_partkey % 5)::DOUBLE / 50 + 0.0001 AS cy FROM part),
hits AS (SELECT line_id, box_id, ((ex - ax) * (fy - ey) - (ey - ay) * (fx - ex)) / ((cx - ax) * (fy - ey) - (cy - ay) * (fx - ex)) AS t,
  ((ex - ax) * (cy - ay) - (ey - ay) * (cx - ax)) / ((cx - ax) * (fy - ey) - (cy - ay) * (fx - ex)) AS u FROM long_, redges),
cuts AS (SELECT line_id, box_id, t FROM hits WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 UNION SELECT line_id, box_id, z FROM long_, boxes, (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS z)),
parts AS (SELECT * FROM (SELECT line_id, box_id, t AS t0, lead(t) OVER (PARTITION BY line_id, box_id ORDER BY t) AS t1 FROM cuts) WHERE t1 > t0),
inside AS (SELECT p.line_id, p.box_id, t0, t1, count(*) FILTER (((ey > y) <> (fy > y)) AND x < (fx - ex) * (y - ey) / (fy - ey) + ex) AS n FROM
  (SELECT p.*, ax + (cx - ax) * (t0 + t1) / 2 AS x, ay + (cy - ay) * (t0 + t1) / 2 AS y FROM parts p JOIN long_ USING (line_id)) p JOIN redges r USING (box_id) GROUP BY ALL)"""


def _long_lines(t):
    return t.part.selectExpr(
        "p_partkey AS line_id", "-1.0D + CAST((p_partkey * 37) % 600 AS DOUBLE) / 1000 + 0.00013D AS ax", "51.0D + CAST((p_partkey * 53) % 400 AS DOUBLE) / 1000 + 0.00017D AS ay",
        "-1.0D + CAST((p_partkey * 37) % 600 AS DOUBLE) / 1000 + 0.00013D + CAST(p_partkey % 7 + 1 AS DOUBLE) / 50 AS cx",
        "51.0D + CAST((p_partkey * 53) % 400 AS DOUBLE) / 1000 + 0.00017D + CAST(p_partkey % 5 AS DOUBLE) / 50 + 0.0001D AS cy")


def lines_on_sites(t):
    """Candidate (line, site) pairs by grid cells, once each."""
    from ..operators.gridjoin import box_cells, segment_cells
    left = segment_cells(_long_lines(t), "ax", "ay", "cx", "cy", 0.1)
    sites = ring(t)
    right = box_cells(sites.select("box_id", "west", "south", F.expr("east + 0.01D").alias("east"), "north"), F.col("west"), F.col("south"), F.col("east"), F.col("north"), 0.1)
    pairs = left.join(right.select("box_id", "_cx", "_cy"), ["_cx", "_cy"]).drop("_cx", "_cy").distinct()
    return pairs.join(sites.select("box_id", "rings"), "box_id")


@query("geo16_inside_share", "boxes", f"WITH {CUT_SQL} SELECT line_id, box_id, round(sum(t1 - t0), 6) AS share FROM inside WHERE n % 2 = 1 GROUP BY line_id, box_id")
def _(t):
    rows = lines_on_sites(t).withColumn("share", F.round(geo.inside_share("ax", "ay", "cx", "cy", "rings"), 6))
    return rows.where("share > 0").select("line_id", "box_id", "share")


@query("geo17_clip_lines", "boxes", f"WITH {CUT_SQL} SELECT line_id, box_id, round(ax + (cx - ax) * t0, 6) AS x0, round(ay + (cy - ay) * t0, 6) AS y0, round(ax + (cx - ax) * t1, 6) AS x1, round(ay + (cy - ay) * t1, 6) AS y1 FROM inside JOIN long_ USING (line_id) WHERE n % 2 = 1")
def _(t):
    p = lines_on_sites(t).withColumn("p", F.explode(geo.inside_pieces("ax", "ay", "cx", "cy", "rings")))
    at = lambda a, b, f: F.round(geo.interpolate(a, b, F.col(f)), 6)
    return p.select("line_id", "box_id", at("ax", "cx", "p.t0").alias("x0"), at("ay", "cy", "p.t0").alias("y0"), at("ax", "cx", "p.t1").alias("x1"), at("ay", "cy", "p.t1").alias("y1"))


@query("geo18_passes_zone", "trace", f"""WITH {LINE_SQL}, n AS (SELECT *, greatest(1, CAST(ceil({hav('ay', 'ax', 'cy', 'cx')} / 100) AS BIGINT)) AS parts FROM legs WHERE t2 IS NOT NULL)
SELECT journey_id, count(DISTINCT seq) AS segments FROM (SELECT *, unnest(range(0, parts + 1)) AS k FROM n) WHERE ax + (cx - ax) * k / parts BETWEEN -0.995 AND -0.985 AND ay + (cy - ay) * k / parts BETWEEN 51.005 AND 51.02 GROUP BY journey_id""")
def _(t):
    parts = geo.samples_for(geo.haversine_m("ay", "ax", "cy", "cx"), 100)
    inside = F.exists(F.sequence(F.lit(0).cast("long"), parts), lambda k: geo.interpolate("ax", "cx", k / parts).between(-0.995, -0.985) & geo.interpolate("ay", "cy", k / parts).between(51.005, 51.02))
    return legs(t).where(inside).groupBy("journey_id").agg(F.count("*").alias("segments"))


@query("geo19_ring_validity", "boxes", "SELECT box_id, CAST(box_id % 3 <> 0 AS BOOLEAN) AS valid FROM boxes")
def _(t):
    # Every third site loses its closing vertex and must be refused.
    r = ring(t).withColumn("r", F.when(F.expr("box_id % 3 = 0"), F.slice(F.col("rings")[0], 1, 5)).otherwise(F.col("rings")[0]))
    return r.select("box_id", geo.ring_valid("r").alias("valid"))


@query("geo21_angles", "trace", f"""WITH {LINE_SQL}, v AS (SELECT journey_id, seq, cx - ax AS ux, cy - ay AS uy, lead(cx - ax) OVER w AS vx, lead(cy - ay) OVER w AS vy FROM legs WHERE t2 IS NOT NULL WINDOW w AS (PARTITION BY journey_id ORDER BY seq))
SELECT journey_id, seq, round(degrees(acos(greatest(-1, least(1, (ux*vx + uy*vy) / (sqrt(ux*ux + uy*uy) * sqrt(vx*vx + vy*vy)))))), 2) AS turn FROM v WHERE vx IS NOT NULL AND ux*ux + uy*uy > 0 AND vx*vx + vy*vy > 0""")
def _(t):
    v = legs(t).select("journey_id", "seq", F.expr("cx - ax").alias("ux"), F.expr("cy - ay").alias("uy"))
    p = neighbours(v, ["journey_id"], "seq", {"vx": ("ux", 1), "vy": ("uy", 1)}).where("vx IS NOT NULL AND ux*ux + uy*uy > 0 AND vx*vx + vy*vy > 0")
    return p.select("journey_id", "seq", F.round(geo.angle_deg("ux", "uy", "vx", "vy"), 2).alias("turn"))


@query("geo23_polygon_area", "boxes", f"WITH {RING_SQL} SELECT box_id, round(abs(sum(ex * fy - fx * ey)) / 2, 8) AS area FROM redges GROUP BY box_id")
def _(t):
    return ring(t).select("box_id", F.round(geo.polygon_area("rings"), 8).alias("area"))


@query("geo24_geodesic_segment", "trace", f"""WITH {LINE_SQL}, m AS (SELECT *, 6378137.0 * (1 - 0.0066943799901413165) * pi() / 180 / pow(1 - pow(sin(radians(ay)), 2) * 0.0066943799901413165, 1.5) AS ky, 6378137.0 * pi() / 180 * cos(radians(ay)) / sqrt(1 - pow(sin(radians(ay)), 2) * 0.0066943799901413165) AS kx FROM legs WHERE t2 IS NOT NULL),
q AS (SELECT *, 0.0005 * kx AS x0, 0.0004 * ky AS y0, (cx - ax + 0.0005) * kx AS x1, (cy - ay + 0.0004) * ky AS y1 FROM m),
f AS (SELECT *, CASE WHEN (x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) = 0 THEN 0 ELSE greatest(0, least(1, (-x0*(x1-x0) - y0*(y1-y0)) / ((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)))) END AS f FROM q)
SELECT journey_id, seq, round(sqrt(pow(x0 + f*(x1-x0), 2) + pow(y0 + f*(y1-y0), 2)), 2) AS d FROM f""")
def _(t):
    return legs(t).select("journey_id", "seq", F.round(geo.geodesic_to_segment_m("ax", "ay", F.col("ax") + 0.0005, F.col("ay") + 0.0004, F.col("cx") + 0.0005, F.col("cy") + 0.0004), 2).alias("d"))


@query("geo25_search_boxes", "venues", """SELECT venue_id, round(lng - degrees(asin(sin(650 / 6371000.0) / cos(radians(lat)))), 7) AS west, round(lat - degrees(650 / 6371000.0), 7) AS south,
 round(lng + degrees(asin(sin(650 / 6371000.0) / cos(radians(lat)))), 7) AS east, round(lat + degrees(650 / 6371000.0), 7) AS north FROM venues""")
def _(t):
    return t.venues.select("venue_id", geo.search_box("lat", "lng", 650.0).alias("b")).select("venue_id", *[F.round(f"b.{c}", 7).alias(c) for c in ("west", "south", "east", "north")])


@query("geo26_stride_reduction", "", f"WITH {POLY} SELECT journey_id, feature_idx, array_to_string(list_transform([1, 3, 4], lambda k: CAST(CAST(round(xs[k] * 10000) AS BIGINT) AS VARCHAR)), ' ') AS xs FROM lines")
def _(t):
    kept = F.transform(geo.stride("line", 2), lambda p: F.round(p["x"] * 10000).cast("long").cast("string"))
    return polylines(t).select("journey_id", "feature_idx", F.array_join(kept, " ").alias("xs"))


# --- text ----------------------------------------------------------------

PARTS_SQL = "parts AS (SELECT feature_id, distance_m, regexp_replace(unnest(string_split_regex(upper(road_ref), '[;,/]')), '\\s+', '', 'g') AS p FROM road_refs)"


@query("fn01_split_refs", "road_refs", f"""WITH {PARTS_SQL} SELECT feature_id, 'motorway' AS kind, CASE WHEN p IN ('M6T', 'M6TOLL') THEN 'M6 Toll' ELSE p END AS ref FROM parts WHERE p IN ('M6T', 'M6TOLL') OR regexp_full_match(p, 'M[0-9]+[A-Z]?') OR regexp_full_match(p, 'A[0-9]+\\(M\\)')
UNION ALL SELECT feature_id, 'a_road', p FROM parts WHERE regexp_full_match(p, 'A[0-9]+[A-Z]?')""")
def _(t):
    tag = lambda kind, refs: F.transform(refs, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))
    both = F.concat(tag("motorway", text.motorway_refs("road_ref")), tag("a_road", text.a_road_refs("road_ref")))
    return t.road_refs.select("feature_id", F.explode(both).alias("r")).select("feature_id", "r.kind", "r.ref")


@query("fn02_regions", "fixes", "SELECT event_id, CASE WHEN lng - 6 BETWEEN -8.5 AND -5.0 AND lat + 3 BETWEEN 53.8 AND 55.5 THEN 'NI' ELSE 'GB' END AS region, lng - 6.0 BETWEEN -7.0 AND -6.6 AND lat + 3.0 BETWEEN 54.0 AND 54.2 AS other_box FROM fixes")
def _(t):
    lng, lat = F.col("lng") - 6, F.col("lat") + 3
    return t.fixes.select("event_id", text.region_of(lng, lat).alias("region"), (text.region_of(lng, lat, (-7.0, 54.0, -6.6, 54.2)) == "NI").alias("other_box"))


DISC_SQL = r"""dk0 AS (SELECT *, upper(trim(road_ref)) AS r, trim(road_name) AS n, lower(highway) AS h FROM {src}),
dk1 AS (SELECT *, regexp_full_match(r, '[0-9]+([.,][0-9]+)?') AS nr, regexp_full_match(n, '[0-9]+([.,][0-9]+)?') AS nn, regexp_replace(r, '\s+', '', 'g') AS tight FROM dk0),
dk2 AS (SELECT *, CASE WHEN nr THEN '' WHEN tight IN ('M6T', 'M6TOLL') THEN 'M6 Toll' ELSE tight END AS shown FROM dk1
 WHERE NOT ((r = '' AND n = '') OR regexp_matches(h, '_link$|^(service|footway|path|steps|cycleway)$') OR (r = '' AND nn) OR (nr AND (n = '' OR nn)))),
disc AS (SELECT *, CASE WHEN shown <> '' THEN 'ref:' || shown ELSE 'name:' || lower(n) END AS road_id, CASE WHEN shown <> '' THEN shown ELSE n END AS label,
 CASE WHEN regexp_full_match(shown, 'M[0-9]+|A[0-9]+\(M\)|M6 Toll') THEN 'Motorways' WHEN regexp_full_match(shown, 'A[0-9]+') THEN 'A roads' WHEN regexp_full_match(shown, 'B[0-9]+') THEN 'B roads' ELSE 'Local roads' END AS category FROM dk2)"""


@query("fn03_discovery_keys", "road_refs", "WITH " + DISC_SQL.replace("{src}", "road_refs") + " SELECT feature_id, road_id, label, category FROM disc")
def _(t):
    k = t.road_refs.withColumn("k", text.discovery_key("road_ref", "road_name", "highway")).where("k IS NOT NULL")
    return k.select("feature_id", F.col("k.id").alias("road_id"), F.col("k.label").alias("label"), F.col("k.category").alias("category"))


@query("fn04_squeeze_names", "", "SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS name FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", text.squeeze("text").alias("name"))


@query("fn05_fold_names", "", """SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '&', ' and ', 'g'), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')), '^the ', '') AS folded FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", text.fold_name("text").alias("folded"))


@query("fn06_service_keys", "road_refs", """SELECT feature_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(road_name || CASE feature_id % 3 WHEN 0 THEN ' Services Northbound' WHEN 1 THEN ' service area' ELSE '' END), '\\b(north|south|east|west)bound\\b', ' ', 'g'), '\\b(motorway|services?|service area|north|south|east|west)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM road_refs""")
def _(t):
    name = F.concat("road_name", F.expr("CASE feature_id % 3 WHEN 0 THEN ' Services Northbound' WHEN 1 THEN ' service area' ELSE '' END"))
    return t.road_refs.select("feature_id", text.service_key(name).alias("key"))


@query("fn07_natural_order", "road_refs", f"""WITH {PARTS_SQL}, r AS (SELECT p AS ref, count(*) AS uses FROM parts WHERE p <> '' GROUP BY p)
SELECT ref, uses, regexp_extract(ref, '^([A-Za-z]*)', 1) AS letters, coalesce(try_cast(regexp_extract(ref, '([0-9]+)', 1) AS INT), 0) AS number FROM r""")
def _(t):
    refs = t.road_refs.select(F.explode(text.ref_parts("road_ref")).alias("ref")).groupBy("ref").agg(F.count("*").alias("uses"))
    letters, number, _whole = text.natural_ref("ref")
    return refs.select("ref", "uses", letters.alias("letters"), number.alias("number")).orderBy("letters", "number", "ref")


@query("fn08_local_dates", "", "SELECT event_id, CAST(strftime(timezone('America/New_York', ts::TIMESTAMP AT TIME ZONE 'UTC'), '%Y%m%d') AS BIGINT) AS local_day, CAST(isodow(timezone('America/New_York', ts::TIMESTAMP AT TIME ZONE 'UTC')) AS INTEGER) AS weekday FROM events")
def _(t):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    return t.events.select("event_id", F.date_format(local, "yyyyMMdd").cast("long").alias("local_day"), (F.weekday(local) + 1).alias("weekday"))


@query("fn09_geometry_hash", "", f"""WITH {POLY}, v AS (SELECT journey_id, feature_idx, array_to_string(v, ';') AS f, array_to_string(list_reverse(v), ';') AS b FROM texts)
SELECT journey_id, feature_idx, sha256(least(f, b)) AS free_hash, sha256(f) AS exact_hash FROM v""")
def _(t):
    return polylines(t).select("journey_id", "feature_idx", geo.line_hash("line").alias("free_hash"), geo.line_hash("line", directed=True).alias("exact_hash"))


@query("fn10_tag_access", "", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.ref'), json_extract_string(props, '$.k')) AS BIGINT) AS k FROM events")
def _(t):
    j = lambda key: F.get_json_object("props", f"$.{key}")
    return t.events.select("event_id", F.coalesce(j("ref"), j("k")).cast("long").alias("k"))


@query("fn11_index_sets", "", """SELECT o_orderkey AS journey_id, array_to_string(list_filter(range(0, o_orderkey % 12), lambda i: NOT list_contains([0, 2, 3, o_orderkey % 5], i)), ' ') AS unmatched FROM orders""")
def _(t):
    hit = F.array(F.lit(0), F.lit(2), F.lit(3), F.expr("CAST(o_orderkey % 5 AS INT)"))
    return t.orders.select(F.col("o_orderkey").alias("journey_id"), F.array_join(text.index_complement(hit, F.expr("o_orderkey % 12")), " ").alias("unmatched"))


@query("fn12_units_and_percent", "", "SELECT o_orderkey AS journey_id, round(o_totalprice / 1000 / 1.609344, 6) AS miles, round(least(100.0, o_totalprice * 100.0 / 300000), 6) AS pct FROM orders")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("journey_id"), F.round(F.col("o_totalprice") / 1000 / text.KM_PER_MILE, 6).alias("miles"), F.round(text.percent("o_totalprice", F.lit(300000.0)), 6).alias("pct"))


@query("fn13_repeat_fingerprint", "journeys", """WITH c AS (SELECT *, CAST(floor(lat0 * 500 + 0.5) AS BIGINT) || ',' || CAST(floor(lng0 * 500 + 0.5) AS BIGINT) AS a, CAST(floor(lat1 * 500 + 0.5) AS BIGINT) || ',' || CAST(floor(lng1 * 500 + 0.5) AS BIGINT) AS b FROM journeys)
SELECT journey_id, mode || '|' || least(a, b) || '|' || greatest(a, b) || '|' || CAST(floor(distance_m / 100000.0::DOUBLE * 2 + 0.5) AS BIGINT) AS fp FROM c""")
def _(t):
    a, b = text.repeat_cell("lat0", "lng0"), text.repeat_cell("lat1", "lng1")
    return t.journeys.select("journey_id", text.road_fingerprint("mode", a, b, F.col("distance_m") / F.lit(100000.0)).alias("fp"))


@query("fn15_speed_fallback", "trace", f"""WITH p AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(t_ms) OVER w AS pt, lag(accuracy_m) OVER w AS pacc FROM trace WINDOW w AS (PARTITION BY journey_id ORDER BY seq))
SELECT journey_id, seq, round(CASE WHEN speed_mps >= 0 THEN speed_mps WHEN pt IS NOT NULL AND t_ms - pt BETWEEN 1 AND 60000 AND accuracy_m <= 25 AND pacc <= 25 THEN {hav('plat', 'plng', 'lat', 'lng')} / ((t_ms - pt) / 1000.0::DOUBLE) END, 6) AS speed FROM p""")
def _(t):
    p = neighbours(t.trace, ["journey_id"], "seq", {"plat": ("lat", -1), "plng": ("lng", -1), "pt": ("t_ms", -1), "pacc": ("accuracy_m", -1)})
    gap = F.col("t_ms") - F.col("pt")
    derived = F.when(gap.between(1, 60_000) & (F.col("accuracy_m") <= 25) & (F.col("pacc") <= 25), geo.haversine_m("plat", "plng", "lat", "lng") / (gap / 1000))
    return p.select("journey_id", "seq", F.round(F.coalesce(F.when(F.col("speed_mps") >= 0, F.col("speed_mps")), derived), 6).alias("speed"))


@query("fn16_quantised_keys", "fixes", "SELECT event_id, CAST(round(lat * 1000) AS BIGINT) || ',' || CAST(round(lng * 1000) AS BIGINT) AS place, CAST(floor(lat * 10) AS BIGINT) || ',' || CAST(floor(lng * 10) AS BIGINT) AS area, CAST(round(lat * 10000000) AS BIGINT) AS node_lat FROM fixes")
def _(t):
    return t.fixes.select("event_id", geo.point_key("lat", "lng", 3).alias("place"),
                          F.concat_ws(",", F.floor(F.col("lat") * 10).cast("string"), F.floor(F.col("lng") * 10).cast("string")).alias("area"),
                          F.round(F.col("lat") * 10_000_000).cast("long").alias("node_lat"))


# --- filters -------------------------------------------------------------

@query("flt01_parse_location", "fixes", "SELECT event_id, round(lat, 5) AS lat, round(lng, 5) AS lng FROM fixes")
def _(t):
    # The positions are spelt five ways, then parsed back.
    f = t.fixes.withColumn("a", F.format_string("%.7f", "lat")).withColumn("o", F.format_string("%.7f", "lng"))
    spelt = F.expr("""CASE event_id % 5 WHEN 0 THEN concat(a, '°, ', o, '°') WHEN 1 THEN concat('geo:', a, ',', o)
      WHEN 2 THEN concat('{"latitude":', a, ',"longitude":', o, '}') WHEN 3 THEN concat('{"location":{"lat":', a, ',"lon":', o, '}}')
      ELSE concat('{"latitudeE7":', cast(round(lat * 10000000) AS bigint), ',"longitudeE7":', cast(round(lng * 10000000) AS bigint), '}') END""")
    p = f.select("event_id", text.parse_location(spelt).alias("p"))
    return p.select("event_id", F.round("p.lat", 5).alias("lat"), F.round("p.lng", 5).alias("lng"))


@query("flt02_valid_points", "fixes", "SELECT event_id % 4 AS kind, count(*) AS rows, count(*) FILTER (event_id % 4 < 2) AS valid FROM fixes GROUP BY 1")
def _(t):
    lat = F.expr("CASE event_id % 4 WHEN 2 THEN CAST('NaN' AS DOUBLE) WHEN 3 THEN lat + 60 ELSE lat END")
    return t.fixes.select(F.expr("event_id % 4").alias("kind"), geo.valid_point(lat, F.col("lng")).alias("ok")).groupBy("kind").agg(
        F.count("*").alias("rows"), F.count_if("ok").alias("valid"))


@query("flt03_consecutive_duplicates", "trace", "SELECT journey_id, count(*) AS kept FROM (SELECT journey_id, x, y, lag(CAST(floor(x / 40) AS BIGINT)) OVER w AS px, lag(CAST(floor(y / 40) AS BIGINT)) OVER w AS py FROM trace WINDOW w AS (PARTITION BY journey_id ORDER BY seq)) WHERE px IS NULL OR px <> CAST(floor(x / 40) AS BIGINT) OR py <> CAST(floor(y / 40) AS BIGINT) GROUP BY 1")
def _(t):
    q = t.trace.select("journey_id", "seq", F.floor(F.col("x") / 40).alias("qx"), F.floor(F.col("y") / 40).alias("qy"))
    p = neighbours(q, ["journey_id"], "seq", {"px": ("qx", -1), "py": ("qy", -1)}).where("px IS NULL OR px <> qx OR py <> qy")
    return p.groupBy("journey_id").agg(F.count("*").alias("kept"))


@query("flt04_mode_labels", "", "SELECT CASE event_type WHEN 'click' THEN 'walking' WHEN 'view' THEN 'driving' WHEN 'purchase' THEN 'cycling' WHEN 'error' THEN 'ferry' ELSE 'unknown' END AS mode, count(*) AS rows FROM events GROUP BY 1")
def _(t):
    label = F.expr("CASE event_type WHEN 'click' THEN 'on_foot' WHEN 'view' THEN ' In_Passenger_Vehicle' WHEN 'purchase' THEN 'ON_BICYCLE' WHEN 'error' THEN 'boating' ELSE event_type END")
    return t.events.groupBy(modes.normalise_mode(label).alias("mode")).agg(F.count("*").alias("rows"))


@query("flt05_journey_contract", "journeys", """SELECT journey_id, 'LineString' AS geom_type, round(lng0, 6) || ' ' || round(lat0, 6) AS first_xy, CASE WHEN points < 2 THEN 'unavailable' WHEN matched THEN 'complete' ELSE 'pending' END AS processing,
 CASE WHEN mode IN ('walking', 'running') THEN 'on_foot' WHEN mode = 'cycling' THEN 'cycling' WHEN mode IN ('driving', 'bus') THEN 'road' WHEN mode = 'train' THEN 'rail' ELSE 'other' END AS mode_class FROM journeys""")
def _(t):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    c = t.journeys.select("journey_id", F.struct(F.lit("LineString").alias("type"), F.array(point("lng0", "lat0"), point("lng1", "lat1")).alias("coordinates")).alias("g"),
                          F.when(F.col("points") < 2, "unavailable").when(F.col("matched"), "complete").otherwise("pending").alias("processing"), modes.mode_class("mode").alias("mode_class"))
    first = F.col("g.coordinates")[0]
    return c.select("journey_id", F.col("g.type").alias("geom_type"), F.concat_ws(" ", F.round(first["x"], 6).cast("string"), F.round(first["y"], 6).cast("string")).alias("first_xy"), "processing", "mode_class")


@query("flt06_support_flag", "fixes", """WITH s AS (SELECT journey_id, (lat + user_id % 30 BETWEEN 49.8 AND 61.1 AND lng - user_id % 20 BETWEEN -8.8 AND 2.2) OR (lat + user_id % 30 BETWEEN 53.8 AND 55.5 AND lng - user_id % 20 BETWEEN -8.5 AND -5.0) AS ok FROM fixes)
SELECT journey_id, bool_or(ok) AS any_point, bool_and(ok) AS every_point FROM s GROUP BY 1""")
def _(t):
    ok = text.uk_supported(F.expr("lng - user_id % 20"), F.expr("lat + user_id % 30"))
    return t.fixes.select("journey_id", ok.alias("ok")).groupBy("journey_id").agg(F.bool_or("ok").alias("any_point"), F.bool_and("ok").alias("every_point"))


@query("flt07_envelope_prefilter", "fixes boxes", "SELECT DISTINCT event_id FROM fixes f, boxes b WHERE lng >= west + 0.02 AND lng < east - 0.02 AND lat >= south + 0.01 AND lat < north - 0.01")
def _(t):
    from ..operators.gridjoin import points_in_boxes
    return points_in_boxes(t.fixes.select("event_id", "lng", "lat"), t.boxes.selectExpr("west + 0.02D AS west", "east - 0.02D AS east", "south + 0.01D AS south", "north - 0.01D AS north"), 0.1).select("event_id").distinct()


@query("flt08_journey_filters", "journeys", """SELECT mode, count(*) AS journeys FROM journeys WHERE mode IN ('walking', 'running', 'driving') AND status <> 'P' AND CAST(strftime(make_timestamp(start_ms * 1000) + INTERVAL 1 HOUR, '%Y') AS BIGINT) >= 1995 GROUP BY mode""")
def _(t):
    local = F.from_utc_timestamp(F.timestamp_millis("start_ms"), "Etc/GMT-1")
    return (t.journeys.where(F.col("mode").isin("walking", "running", "driving") & (F.col("status") != "P") & (F.year(local) >= 1995))
            .groupBy("mode").agg(F.count("*").alias("journeys")))


@query("flt09_matchable", "journeys", "SELECT mode, count(*) FILTER (mode <> 'train' AND points >= 2 AND (mode NOT IN ('driving', 'bus', 'cycling') OR points >= 10)) AS matchable, count(*) FILTER (matched AND mode <> 'train') AS stored FROM journeys GROUP BY mode")
def _(t):
    road = F.col("mode").isin("driving", "bus", "cycling")
    can = modes.mode_class("mode").isin("on_foot", "cycling", "road") & (F.col("points") >= 2) & (~road | (F.col("points") >= 10))
    return t.journeys.groupBy("mode").agg(F.count_if(can).alias("matchable"), F.count_if(F.col("matched") & modes.mode_class("mode").isin("on_foot", "cycling", "road")).alias("stored"))


@query("flt10_class_lists", "features", "SELECT highway, count(*) AS features, count(*) FILTER (highway IN ('residential', 'primary')) AS local_, count(*) FILTER (NOT regexp_matches(highway, '_link$|^service$')) AS kept FROM features GROUP BY highway")
def _(t):
    return t.features.groupBy("highway").agg(F.count("*").alias("features"), F.count_if(F.col("highway").isin(*modes.LOCAL_ROADS)).alias("local_"),
                                             F.count_if(~F.col("highway").rlike("_link$|^service$")).alias("kept"))


TAGS_SQL = """tags AS (SELECT p_partkey AS way_id, CASE p_size % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'footway' WHEN 2 THEN 'residential' WHEN 3 THEN 'steps' WHEN 4 THEN 'service' ELSE 'cycleway' END AS highway,
 CASE WHEN p_partkey % 5 = 0 THEN 'private' END AS access, CASE WHEN p_partkey % 7 = 0 THEN 'designated' WHEN p_partkey % 7 = 1 THEN 'no' END AS bicycle,
 CASE WHEN p_partkey % 11 = 0 THEN 'yes' WHEN p_partkey % 11 = 1 THEN '-1' END AS oneway FROM part)"""


def _tags(t):
    c = "CASE p_size % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'footway' WHEN 2 THEN 'residential' WHEN 3 THEN 'steps' WHEN 4 THEN 'service' ELSE 'cycleway' END"
    pairs = f"""map_filter(map('highway', {c}, 'access', CASE WHEN p_partkey % 5 = 0 THEN 'private' END,
      'bicycle', CASE WHEN p_partkey % 7 = 0 THEN 'designated' WHEN p_partkey % 7 = 1 THEN 'no' END,
      'oneway', CASE WHEN p_partkey % 11 = 0 THEN 'yes' WHEN p_partkey % 11 = 1 THEN '-1' END), (k, v) -> v IS NOT NULL)"""
    return t.part.selectExpr("p_partkey AS way_id", "p_name AS name", "p_partkey % 9 AS points", f"{pairs} AS tags")


@query("flt11_access_modes", "", f"""WITH {TAGS_SQL} SELECT way_id, concat_ws(' ', CASE WHEN access IS NULL AND highway <> 'motorway' THEN 'on_foot' END,
 CASE WHEN bicycle = 'designated' THEN 'cycling' WHEN bicycle = 'no' THEN NULL WHEN access IS NULL AND highway NOT IN ('motorway', 'steps', 'footway') THEN 'cycling' END,
 CASE WHEN access IS NULL AND highway IN ('motorway', 'residential', 'service') THEN 'driving' END) AS modes FROM tags""")
def _(t):
    return _tags(t).select("way_id", F.array_join(modes.allowed_modes("tags"), " ").alias("modes"))


@query("flt12_one_way", "", f"WITH {TAGS_SQL} SELECT way_id, CAST(CASE oneway WHEN 'yes' THEN 1 WHEN '-1' THEN -1 ELSE CASE WHEN highway = 'motorway' THEN 1 ELSE 0 END END AS INTEGER) AS direction FROM tags")
def _(t):
    return _tags(t).select("way_id", modes.one_way("tags").alias("direction"))


@query("flt13_rail_tracks", "net", """SELECT edge_id FROM net WHERE (edge_id % 3 = 0 AND edge_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) OR (edge_id % 3 <> 0 AND edge_id % 13 = 5 AND edge_id % 4 <> 1)""")
def _(t):
    members = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("edge_id"))
    tracks = t.net.select("edge_id", F.expr("edge_id % 3 = 0").alias("relation"), F.expr("edge_id % 13 = 5").alias("reviewed"), F.expr("edge_id % 4 = 1").alias("yard"))
    by_relation = tracks.where("relation").join(members, "edge_id", "left_semi")
    return by_relation.select("edge_id").unionByName(tracks.where("NOT relation AND reviewed AND NOT yard").select("edge_id"))


@query("flt14_removed_edges", "spans features", """SELECT f.journey_id, count(*) AS kept FROM features f WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = f.journey_id AND r.l_linenumber = f.feature_idx AND r.l_returnflag = 'R' AND r.l_shipdate >= TIMESTAMP '1998-01-01')
 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.journey_id AND o.o_orderstatus = 'F' AND f.road_ref = 'B7') GROUP BY 1""")
def _(t):
    edges = t.lineitem.where("l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'").select(F.col("l_orderkey").alias("journey_id"), F.col("l_linenumber").alias("feature_idx"))
    roads = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("journey_id"), F.lit("B7").alias("road_ref"))
    kept = t.features.join(edges, ["journey_id", "feature_idx"], "left_anti").join(roads, ["journey_id", "road_ref"], "left_anti")
    return kept.groupBy("journey_id").agg(F.count("*").alias("kept"))


@query("flt15_context_tags", "", f"WITH {TAGS_SQL} SELECT way_id, highway, CASE WHEN highway = 'service' THEN p_name END AS name FROM tags JOIN part ON way_id = p_partkey WHERE way_id % 9 >= 2")
def _(t):
    kept = F.map_filter("tags", lambda k, v: k.isin("highway", "railway", "name", "amenity"))
    named = F.when(F.col("tags")["highway"] == "service", F.col("name"))
    return _tags(t).where("points >= 2").select("way_id", kept["highway"].alias("highway"), named.alias("name"))


@query("flt16_match_quality", "", """WITH q AS (SELECT o_orderkey, count(*) FILTER (l_returnflag <> 'R')::DOUBLE / count(*) AS cov, avg(CASE WHEN l_linestatus = 'O' THEN l_discount * 10 END) AS conf FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey AS journey_id, CASE WHEN cov >= .9 AND (conf IS NULL OR conf >= .65) THEN 'HIGH' WHEN cov >= .65 AND (conf IS NULL OR conf >= .30) THEN 'REVIEW' ELSE 'LOW' END AS quality FROM q""")
def _(t):
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("journey_id")).agg(
        (F.count_if(F.col("l_returnflag") != "R") / F.count("*")).alias("cov"), F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_discount") * 10)).alias("conf"))
    least = lambda v: F.col("conf").isNull() | (F.col("conf") >= v)
    return q.select("journey_id", F.when((F.col("cov") >= 0.9) & least(0.65), "HIGH").when((F.col("cov") >= 0.65) & least(0.30), "REVIEW").otherwise("LOW").alias("quality"))


@query("flt17_valid_visits", "visits", "SELECT visit_id FROM visits WHERE end_min - start_min >= 10 AND end_min <= 40000 AND visit_id % 6 <> 0")
def _(t):
    v = t.visits.withColumn("source", F.expr("CASE WHEN visit_id % 6 = 0 THEN 'manual' ELSE 'place_visit' END"))
    return v.where((F.col("source") == "place_visit") & (F.col("end_min") - F.col("start_min") >= 10) & (F.col("end_min") <= 40_000)).select("visit_id")


@query("flt18_size_guard", "trace", "SELECT journey_id, count(*) AS points, CASE WHEN count(*) > 70 THEN 'review' ELSE 'process' END AS decision FROM trace GROUP BY 1")
def _(t):
    from ..operators.traces import size_guard
    return size_guard(t.trace, ["journey_id"], limit=70)


@query("flt20_fix_reliability", "trace", f"""WITH p AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(t_ms) OVER w AS pt, lag(accuracy_m) OVER w AS pacc, lag(speed_mps) OVER w AS ps FROM trace WINDOW w AS (PARTITION BY journey_id ORDER BY seq))
SELECT journey_id, seq, accuracy_m > 0 AND accuracy_m <= CASE WHEN mode IN ('walking', 'running') THEN 50 ELSE 100 END AND t_ms > 0 AND (pt IS NULL OR (t_ms > pt AND CASE WHEN mode IN ('walking', 'running')
  THEN {hav('plat', 'plng', 'lat', 'lng')} <= greatest(4.5, least(10, greatest(ps, speed_mps) * 1.5)) * ((t_ms - pt) / 1000.0::DOUBLE) + least(20, (pacc + accuracy_m) * .3)
  ELSE {hav('plat', 'plng', 'lat', 'lng')} <= 70 * ((t_ms - pt) / 1000.0::DOUBLE) + least(50, pacc + accuracy_m) END)) AS reliable FROM p""")
def _(t):
    from ..operators.traces import with_reliability
    return with_reliability(t.trace).select("journey_id", "seq", "reliable")


@query("flt21_visible_runs", "trace", """WITH v AS (SELECT journey_id, seq, lng BETWEEN -0.995 AND -0.98 AND lat BETWEEN 51.0 AND 51.02 AS vis FROM trace),
g AS (SELECT *, seq - row_number() OVER (PARTITION BY journey_id ORDER BY seq) AS g FROM v WHERE vis) SELECT journey_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS points FROM g GROUP BY journey_id, g HAVING count(*) >= 2""")
def _(t):
    from ..operators.ordered import islands, seq_chunk
    v = t.trace.select("journey_id", "seq", (F.col("lng").between(-0.995, -0.98) & F.col("lat").between(51.0, 51.02)).alias("vis"))
    p = neighbours(v, ["journey_id"], "seq", {"was": ("vis", -1)})
    runs = islands(p, ["journey_id"], seq_chunk(), ["seq"], F.col("vis") & ~F.coalesce("was", F.lit(False)), "run").where("vis")
    return runs.groupBy("journey_id", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("points")).where("points >= 2").drop("run")


@query("flt22_reprocess_selector", "journeys", "SELECT journey_id FROM journeys WHERE journey_id % 4 = 1 OR (distance_m % 10 <> 0 AND journey_id % 4 = 2)")
def _(t):
    # Receipts: rule version 2 for all but a quarter; another quarter saw an older input.
    now = t.journeys.select("journey_id", F.lit(2).alias("rule_version"), text.text_digest("mode", "distance_m", "points").alias("input_sha"))
    seen = t.journeys.select("journey_id", F.expr("CASE WHEN journey_id % 4 = 1 THEN 1 ELSE 2 END").alias("rule_version"),
                             text.text_digest("mode", F.expr("CASE WHEN journey_id % 4 = 2 THEN distance_m - distance_m % 10 ELSE distance_m END"), "points").alias("input_sha"))
    return now.join(seen, ["journey_id", "rule_version", "input_sha"], "left_anti").select("journey_id")


@query("flt23_category_filters", "journeys", "SELECT CASE WHEN mode IN ('walking', 'running') THEN 'foot' WHEN mode IN ('driving', 'bus', 'cycling') THEN mode ELSE 'unknown' END AS category, count(*) AS journeys FROM journeys GROUP BY 1")
def _(t):
    m = F.col("mode")
    return t.journeys.groupBy(F.when(m.isin("walking", "running"), "foot").when(m.isin("driving", "bus", "cycling"), m).otherwise("unknown").alias("category")).agg(F.count("*").alias("journeys"))


# A match result per order: n inputs; its hit and miss index lists.
PARTIAL_SQL = """m AS (SELECT o_orderkey AS journey_id, 8 + o_orderkey % 9 AS n, list_filter(range(0, 8 + o_orderkey % 9), lambda i: i >= o_orderkey % 3 AND (o_orderkey % 7 <> 0 OR i <> 4)) AS hit,
 list_filter(range(0, 8 + o_orderkey % 9), lambda i: NOT (i >= o_orderkey % 3 AND (o_orderkey % 7 <> 0 OR i <> 4)) OR (o_orderkey % 11 = 0 AND i = 5)) AS missed FROM orders)"""


@query("flt24_partial_match", "", f"""WITH {PARTIAL_SQL}, a AS (SELECT *, len(hit) + len(missed) = n AND len(list_distinct(list_concat(hit, missed))) = n AS accounted FROM m)
SELECT journey_id, accounted AND len(hit) >= 2 AND len(hit) < n AND len(hit) >= ceil(n * .75) AND len(hit) = list_max(hit) - list_min(hit) + 1 AS endpoint_partial, accounted AND len(hit) >= 2 AND len(missed) > 0 AS import_partial, accounted AND len(hit) >= 2 AND len(hit) < n AS verified_partial FROM a""")
def _(t):
    from ..operators.traces import partial_match
    o = t.orders.select(F.col("o_orderkey").alias("journey_id"), F.expr("CAST(8 + o_orderkey % 9 AS INT)").alias("n"))
    m = o.withColumn("hit", F.expr("filter(sequence(0, n - 1), i -> i >= journey_id % 3 AND (journey_id % 7 <> 0 OR i <> 4))")).withColumn(
        "missed", F.expr("filter(sequence(0, n - 1), i -> NOT (i >= journey_id % 3 AND (journey_id % 7 <> 0 OR i <> 4)) OR (journey_id % 11 = 0 AND i = 5))"))
    return m.select("journey_id", *[c.alias(k) for k, c in partial_match("n", "hit", "missed").items()])


@query("flt25_candidate_scope", "", "SELECT item, CASE WHEN starts_with(k, 'fr ') OR starts_with(k, 'be ') THEN 'foreign' WHEN regexp_matches(k, '\\b(the|and|of)\\b') THEN 'anchored' ELSE 'unknown' END AS scope FROM (SELECT doc_id AS item, lang || ' ' || lower(source) || ' ' || lower(text) AS k FROM documents)")
def _(t):
    k = t.documents.select(F.col("doc_id").alias("item"), F.concat_ws(" ", "lang", F.lower("source"), F.lower("text")).alias("k"))
    return k.select("item", F.when(F.col("k").startswith("fr ") | F.col("k").startswith("be "), "foreign").when(F.col("k").rlike(r"\b(the|and|of)\b"), "anchored").otherwise("unknown").alias("scope"))


@query("flt26_effective_distance", "journeys", "SELECT journey_id, CASE WHEN mode = 'train' AND points >= 4 AND journey_id % 4 <> 3 AND status = 'F' THEN distance_m * 2 ELSE distance_m END AS effective_m, distance_m AS original_m, mode = 'train' AND points >= 4 AND journey_id % 4 <> 3 AND status = 'F' AS inferred FROM journeys")
def _(t):
    proof = t.journeys.where("mode = 'train'").select("journey_id", (F.col("distance_m") * 2).alias("inferred_m"), (F.col("points") >= 4).alias("enough"), F.expr("journey_id % 4 <> 3").alias("hash_ok"), (F.col("status") == "F").alias("current"))
    j = t.journeys.join(proof, "journey_id", "left")
    ok = F.coalesce(F.col("enough") & F.col("hash_ok") & F.col("current"), F.lit(False))
    return j.select("journey_id", F.when(ok, F.col("inferred_m")).otherwise(F.col("distance_m")).alias("effective_m"), F.col("distance_m").alias("original_m"), ok.alias("inferred"))


@query("flt27_mode_overrides", "journeys", "SELECT CASE WHEN journey_id % 13 = 0 THEN 'cycling' ELSE mode END AS mode, count(*) AS journeys, CAST(sum(distance_m) AS BIGINT) AS distance_m FROM journeys WHERE journey_id % 13 <> 1 GROUP BY 1")
def _(t):
    chosen = t.journeys.where("journey_id % 13 < 2").select("journey_id", F.expr("CASE journey_id % 13 WHEN 0 THEN 'cycling' ELSE 'ignore' END").alias("override"))
    j = t.journeys.join(chosen, "journey_id", "left").withColumn("mode", F.coalesce("override", "mode")).where("mode <> 'ignore'")
    return j.groupBy("mode").agg(F.count("*").alias("journeys"), F.sum("distance_m").alias("distance_m"))
