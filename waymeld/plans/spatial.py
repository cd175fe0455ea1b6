"""Joins of fixes, visits and lines with venues, sites and networks."""

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import joins as J
from ..operators.gridjoin import near_any, nearest_within, points_in_boxes, segment_cells, planar_cell, within_radius
from ..operators.intervals import points_in_intervals
from ..operators.ordered import neighbours
from .coverage import hav
from .registry import query
from .shapes import CUT_SQL, LINE_SQL, RING_SQL, _long_lines, legs, ring

def sites(t):
    return ring(t).withColumn("east", F.expr("east + 0.01D"))


def as_places(df, *keep):
    return df.select(*keep, F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))


@query("jn01_points_in_activities", "fixes activities", "SELECT activity_id, event_id FROM activities a JOIN fixes f ON a.user_id = f.user_id AND f.t_ms BETWEEN a.start_ms AND a.end_ms")
def _(t):
    return points_in_intervals(t.fixes.select("event_id", "user_id", "t_ms"), t.activities, ["user_id"], "t_ms", "start_ms", "end_ms", 3_600_000).select("activity_id", "event_id")


@query("jn03_nearest_venue", "fixes venues", f"""WITH n AS (SELECT event_id, venue_id, round({hav('f.lat', 'f.lng', 'v.lat', 'v.lng')}, 6) AS d FROM fixes f, venues v WHERE {hav('f.lat', 'f.lng', 'v.lat', 'v.lng')} <= 1350)
SELECT event_id, arg_min(venue_id, (d, venue_id)) AS venue_id, round(min(d), 3) AS distance_m FROM n GROUP BY event_id""")
def _(t):
    best = nearest_within(t.fixes, as_places(t.venues, "venue_id"), 1350.0, "venue_id")
    return t.fixes.select("event_id", "lat", "lng").join(best, ["lat", "lng"]).select("event_id", "venue_id", F.round("distance_m", 3).alias("distance_m"))


@query("jn03_site_overrides_circle", "fixes venues boxes", f"""WITH {RING_SQL},
ins AS (SELECT event_id, box_id FROM fixes f, redges e GROUP BY event_id, box_id, lng, lat HAVING count(*) FILTER (((ey > lat) <> (fy > lat)) AND lng < (fx - ex) * (lat - ey) / (fy - ey) + ex) % 2 = 1),
one AS (SELECT event_id, min(box_id) AS box_id, count(*) AS n FROM ins GROUP BY 1),
circ AS (SELECT event_id, arg_min(venue_id, (round({hav('f.lat', 'f.lng', 'v.lat', 'v.lng')}, 6), venue_id)) AS venue_id FROM fixes f, venues v WHERE {hav('f.lat', 'f.lng', 'v.lat', 'v.lng')} <= 1350 GROUP BY 1)
SELECT coalesce(o.event_id, c.event_id) AS event_id, CASE WHEN n > 1 THEN 'none' WHEN n = 1 THEN 'site' ELSE 'circle' END AS kind, CASE WHEN n > 1 THEN NULL WHEN n = 1 THEN CAST(box_id AS BIGINT) ELSE venue_id END AS place_id FROM one o FULL JOIN circ c USING (event_id)""")
def _(t):
    f = t.fixes.select("event_id", "lat", "lng")
    inside = J.polygon_pairs(f, sites(t).drop("name"), 0.1).groupBy("event_id").agg(F.count("*").alias("n"), F.min("box_id").alias("box_id"))
    best = nearest_within(f, as_places(t.venues, "venue_id"), 1350.0, "venue_id")
    circle = f.join(best, ["lat", "lng"]).select("event_id", "venue_id")
    j = inside.join(circle, "event_id", "full_outer")
    return j.select("event_id", F.when(F.col("n") > 1, "none").when(F.col("n") == 1, "site").otherwise("circle").alias("kind"),
                    F.when(F.col("n") > 1, F.lit(None)).when(F.col("n") == 1, F.col("box_id").cast("long")).otherwise(F.col("venue_id")).alias("place_id"))


@query("jn04_line_site_intersects", "boxes", f"WITH {CUT_SQL} SELECT DISTINCT line_id, box_id FROM inside WHERE n % 2 = 1")
def _(t):
    return J.lines_in_sites(_long_lines(t), sites(t), ["line_id"], "box_id", 0.05).select("line_id", "box_id")


INSIDE_PT = """ins AS (SELECT p.{id} AS pid, b.box_id, (b.east - b.west) * (b.north - b.south) + b.box_id % 3 AS area FROM {src} p JOIN boxes b ON p.lng >= b.west - 0.03 * (b.box_id % 3) AND p.lng < b.east + 0.03 * (b.box_id % 3) AND p.lat >= b.south AND p.lat < b.north)"""


def _grown(t):
    return t.boxes.select("box_id", F.expr("west - 0.03D * (box_id % 3)").alias("west"), "south", F.expr("east + 0.03D * (box_id % 3)").alias("east"), "north",
                          F.expr("(east - west) * (north - south) + box_id % 3").alias("area"))


@query("jn05_smallest_area_wins", "fixes boxes", "WITH " + INSIDE_PT.replace("{id}", "event_id").replace("{src}", "fixes") + " SELECT pid AS event_id, arg_min(box_id, (area, box_id)) AS box_id FROM ins GROUP BY 1")
def _(t):
    return J.smallest_area(points_in_boxes(t.fixes.select("event_id", "lng", "lat"), _grown(t), 0.1), "event_id", "box_id", "area")


@query("jn06_segment_county", "trace boxes", f"WITH {LINE_SQL}, {RING_SQL}, s AS (SELECT journey_id, seq, ax, ay, cx, cy + 0.00001 AS cy FROM legs WHERE t2 IS NOT NULL)," + """
hits AS (SELECT journey_id, seq, box_id, ((ex - ax) * (fy - ey) - (ey - ay) * (fx - ex)) / ((cx - ax) * (fy - ey) - (cy - ay) * (fx - ex)) AS t, ((ex - ax) * (cy - ay) - (ey - ay) * (cx - ax)) / ((cx - ax) * (fy - ey) - (cy - ay) * (fx - ex)) AS u FROM s, redges WHERE (cx - ax) * (fy - ey) - (cy - ay) * (fx - ex) <> 0),
cuts AS (SELECT journey_id, seq, box_id, t FROM hits WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 UNION SELECT journey_id, seq, box_id, z FROM s, boxes, (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS z)),
parts AS (SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY journey_id, seq, box_id ORDER BY t) AS t1 FROM cuts) WHERE t1 > t),
ok AS (SELECT p.journey_id, p.box_id FROM parts p JOIN s USING (journey_id, seq) JOIN redges r ON r.box_id = p.box_id GROUP BY p.journey_id, p.seq, p.box_id, p.t, p.t1, ax, ay, cx, cy
 HAVING count(*) FILTER (((ey > ay + (cy - ay) * (t + t1) / 2) <> (fy > ay + (cy - ay) * (t + t1) / 2)) AND ax + (cx - ax) * (t + t1) / 2 < (fx - ex) * (ay + (cy - ay) * (t + t1) / 2 - ey) / (fy - ey) + ex) % 2 = 1)
SELECT DISTINCT journey_id, box_id FROM ok""")
def _(t):
    s = legs(t).select("journey_id", "seq", "ax", "ay", "cx", (F.col("cy") + 0.00001).alias("cy"))
    return J.lines_in_sites(s, sites(t), ["journey_id", "seq"], "box_id", 0.05).select("journey_id", "box_id").distinct()


SEGD = "sqrt(pow(x0 + f*(x1-x0), 2) + pow(y0 + f*(y1-y0), 2)) * 111195"


def near_segment_sql(src: str, place: str, ids: str) -> str:
    """Brute-force planar distance from every place to every segment."""
    return f"""nd AS (SELECT *, {SEGD} AS d FROM (SELECT *, CASE WHEN (x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) = 0 THEN 0 ELSE greatest(0, least(1, (-x0*(x1-x0) - y0*(y1-y0)) / ((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)))) END AS f
 FROM (SELECT {ids}, v.*, (ax - v.lng) * cos(radians(v.lat)) AS x0, ay - v.lat AS y0, (cx - v.lng) * cos(radians(v.lat)) AS x1, cy - v.lat AS y1 FROM {src} s, {place} v)))"""


@query("jn07_crossing_sets", "trace venues", f"WITH {LINE_SQL}, s AS (SELECT journey_id, seq, ax, ay, cx, cy FROM legs WHERE t2 IS NOT NULL), {near_segment_sql('s', 'venues', 'journey_id, seq')} SELECT venue_id, count(DISTINCT journey_id) AS journeys FROM nd WHERE d <= 300 + venue_id % 5 * 100 GROUP BY 1")
def _(t):
    places = as_places(t.venues, "venue_id").withColumn("radius_m", F.expr("300 + venue_id % 5 * 100"))
    met = J.owners_near(legs(t), places, ["journey_id", "seq"], "journey_id", "venue_id", 700.0)
    return met.select("venue_id", F.col("n").alias("journeys"))


@query("jn08_landmark_semi_join", "anchors venues", f"SELECT anchor_id, road_ref FROM anchors a WHERE EXISTS (SELECT 1 FROM venues v WHERE {hav('a.lat', 'a.lng', 'v.lat', 'v.lng')} <= 1000)")
def _(t):
    return near_any(t.anchors, as_places(t.venues), 1000.0).select("anchor_id", "road_ref")


@query("jn09_near_network", "venues trace", f"SELECT venue_id FROM venues v WHERE EXISTS (SELECT 1 FROM trace t WHERE {hav('v.lat', 'v.lng', 't.lat', 't.lng')} <= 650)")
def _(t):
    return near_any(t.venues, as_places(t.trace), 650.0).select("venue_id")


@query("jn10_unique_named_match", "fixes venues", f"""WITH c AS (SELECT event_id, v.venue_id FROM fixes f JOIN venues v ON {hav('f.lat', 'f.lng', 'v.lat', 'v.lng')} <= 3000 AND 'supplier ' || CAST(f.event_id % 10 AS STRING) = 'supplier ' || CAST(CAST(right(v.name, 1) AS INT) AS STRING))
SELECT event_id, min(venue_id) AS venue_id FROM c GROUP BY event_id HAVING count(*) = 1""")
def _(t):
    f = t.fixes.select("event_id", "lat", "lng", text.fold_name(F.expr("concat('The Supplier ', event_id % 10)")).alias("k"))
    v = as_places(t.venues, "venue_id", text.fold_name(F.expr("concat('Súpplier ', right(name, 1))")).alias("k"))
    return J.unique_match(within_radius(f, v, 3000.0, ["k"]), "event_id", "venue_id")


@query("jn11_already_imported", "journeys", "SELECT journey_id FROM journeys j WHERE start_ms >= 883612800000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = j.journey_id)")
def _(t):
    seen = t.lineitem.select(F.col("l_orderkey").alias("journey_id"))
    return t.journeys.where("start_ms >= 883612800000").join(seen, "journey_id", "left_anti").select("journey_id")


@query("jn12_inventory_status", "boxes", "SELECT b.box_id, CASE WHEN c.n > 2 THEN 'ready' WHEN c.n > 0 THEN 'building' ELSE 'not_requested' END AS status FROM boxes b LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 8000 GROUP BY 1 HAVING count(*) > 0) c ON b.box_id = c.c_nationkey WHERE TRUE")
def _(t):
    n = t.customer.where("c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("box_id")).agg(F.count("*").alias("n"))
    j = t.boxes.join(n, "box_id", "left")
    return j.select("box_id", F.coalesce(F.when(F.col("n") > 2, "ready").when(F.col("n").isNotNull(), "building"), F.lit("not_requested")).alias("status"))


@query("jn13_identity_binding", "spans bindings", """SELECT b.route_id, count(*) AS bound, count(DISTINCT s.edge_id) AS ways FROM spans s JOIN bindings b ON s.edge_id = b.way_id AND list_contains(string_split(b.modes, ','), s.mode) WHERE s.edge_id % 10 <> 3 GROUP BY 1""")
def _(t):
    sha = lambda c, v: F.sha2(F.concat_ws("|", F.col(c).cast("string"), v), 256)
    # Ways whose last digit is 3 changed geometry since they were travelled.
    travelled = t.spans.select(F.col("edge_id").alias("way_id"), "mode", sha("edge_id", F.lit("v1")).alias("geometry_sha"))
    paths = t.bindings.select("way_id", "route_id", "modes", sha("way_id", F.expr("CASE WHEN way_id % 10 = 3 THEN 'v2' ELSE 'v1' END")).alias("geometry_sha"))
    return J.identity_join(travelled, paths).groupBy("route_id").agg(F.count("*").alias("bound"), F.countDistinct("way_id").alias("ways"))


@query("jn15_edge_correspondence", "net", """WITH src AS (SELECT edge_id AS src_id, ax + 1 AS ax, ay + edge_id % 14 AS ay, bx + 1 AS cx, "by" + edge_id % 14 + edge_id % 3 AS cy FROM net),
c AS (SELECT src_id, k, e.edge_id, abs((e.bx - e.ax) * (cx - src.ax) + (e.by - e.ay) * (cy - src.ay)) / (sqrt(pow(e.bx - e.ax, 2) + pow(e.by - e.ay, 2)) * sqrt(pow(cx - src.ax, 2) + pow(cy - src.ay, 2))) AS cosine,
 src.ax + (cx - src.ax) * (k + 0.5) / 6 AS px, src.ay + (cy - src.ay) * (k + 0.5) / 6 AS py, e.ax AS ex, e.ay AS ey, e.bx AS fx, e.by AS fy FROM src, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k), net e WHERE abs(e.ax - src.ax) <= 130 AND abs(e.ay - src.ay) <= 130),
d AS (SELECT *, greatest(0, least(1, ((px - ex) * (fx - ex) + (py - ey) * (fy - ey)) / (pow(fx - ex, 2) + pow(fy - ey, 2)))) AS f FROM c WHERE cosine >= cos(radians(15))),
h AS (SELECT src_id, k, count(*) AS n, min(edge_id) AS edge_id FROM d WHERE sqrt(pow(px - ex - f * (fx - ex), 2) + pow(py - ey - f * (fy - ey), 2)) <= 10 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT src_id, edge_id, count(*) AS stations FROM h GROUP BY 1, 2""")
def _(t):
    # Six stations per source edge; a station counts where exactly one target is close and aligned.
    src = t.net.selectExpr("edge_id AS src_id", "ax + 1 AS sx", "ay + edge_id % 14 AS sy", "bx + 1 AS tx", "by + edge_id % 14 + edge_id % 3 AS ty")
    st = src.withColumn("k", F.explode(F.array(*map(F.lit, range(6))))).withColumns({"px": F.expr("sx + (tx - sx) * (k + 0.5D) / 6"), "py": F.expr("sy + (ty - sy) * (k + 0.5D) / 6")})
    e = t.net.select("edge_id", "ax", "ay", "bx", "by")
    right = segment_cells(e, "ax", "ay", "bx", "by", 40.0, 10.0)
    near = planar_cell(st, "px", "py", 40.0).join(right, ["_cx", "_cy"])
    ok = near.where((geo.angle_deg(F.expr("tx - sx"), F.expr("ty - sy"), F.expr("bx - ax"), F.expr("by - ay"), directed=False) <= 15)
                    & (geo.point_segment("px", "py", "ax", "ay", "bx", "by") <= 10))
    single = ok.groupBy("src_id", "k").agg(F.countDistinct("edge_id").alias("n"), F.min("edge_id").alias("edge_id")).where("n = 1")
    return single.groupBy("src_id", "edge_id").agg(F.count("*").alias("stations"))


@query("jn17_set_comparison", "features", """WITH o AS (SELECT DISTINCT town_id, road_name FROM features WHERE journey_id % 5 <> 0), n AS (SELECT DISTINCT town_id, road_name FROM features WHERE journey_id % 5 <> 1)
SELECT town_id, count(*) FILTER (o.road_name IS NULL) AS added, count(*) FILTER (n.road_name IS NULL) AS removed, count(*) FILTER (o.road_name IS NOT NULL AND n.road_name IS NOT NULL) AS unchanged FROM o FULL JOIN n USING (town_id, road_name) GROUP BY town_id""")
def _(t):
    # Two snapshots of the same inventory: each misses a fifth of the journeys.
    f = t.features
    return J.set_comparison(f.where("journey_id % 5 <> 0"), f.where("journey_id % 5 <> 1"), "town_id", "road_name")


@query("jn18_asof_later_evidence", "trace activities", """WITH r AS (SELECT user_id, journey_id, seq, t_ms - 1704067200000 AS at FROM trace), e AS (SELECT user_id, activity_id, start_ms - 1704067200000 AS at FROM activities)
SELECT journey_id, seq, (SELECT min(e.at) FROM e WHERE e.user_id = r.user_id AND e.at >= r.at) AS evidence_at FROM r""")
def _(t):
    r = t.trace.select("user_id", "journey_id", "seq", (F.col("t_ms") - 1704067200000).alias("t0"))
    e = t.activities.select("user_id", "activity_id", (F.col("start_ms") - 1704067200000).alias("e0"))
    return J.asof_after(r, e, ["user_id"], "t0", "e0", ["activity_id"]).select("journey_id", "seq", F.col("at").alias("evidence_at"))


MARK = """marks AS (SELECT anchor_id AS marker_id, lat, lng, 1704067200000 + anchor_id % 5 * 432000000 AS valid_from, 1704067200000 + anchor_id % 5 * 432000000 + 864000000 AS valid_until FROM anchors)"""


def markers(t):
    return t.anchors.select(F.col("anchor_id").alias("marker_id"), "lat", "lng", F.expr("1704067200000L + anchor_id % 5 * 432000000L").alias("valid_from"),
                            F.expr("1704067200000L + anchor_id % 5 * 432000000L + 864000000L").alias("valid_until"))


@query("jn19_dated_markers", "fixes anchors", f"""WITH {MARK}, n AS (SELECT event_id, marker_id, round({hav('f.lat', 'f.lng', 'm.lat', 'm.lng')}, 6) AS d FROM fixes f JOIN marks m ON f.t_ms BETWEEN valid_from AND valid_until AND {hav('f.lat', 'f.lng', 'm.lat', 'm.lng')} <= 1000)
SELECT event_id, arg_min(marker_id, (d, marker_id)) AS marker_id FROM n GROUP BY 1""")
def _(t):
    # Equal places of the same dates keep the lowest id, which is also the tie rule.
    m = as_places(markers(t), "marker_id", *J.BOUNDS).groupBy("p_lat", "p_lng", *J.BOUNDS).agg(F.min("marker_id").alias("marker_id"))
    fixes = t.unnumbered_fixes.select("event_id", "t_ms", "lat", "lng")
    reach = J.dated_reach(fixes, m, 1000.0, F.min(F.struct(F.round("distance_m", 6).alias("d"), "marker_id")).alias("b"))
    return J.at_their_time(fixes, reach, "t_ms").groupBy("event_id").agg(F.min("b").alias("b")).select("event_id", "b.marker_id")


STEP_SQL = """steps AS (SELECT * FROM (SELECT journey_id, seq, t_ms, lng AS ax, lat AS ay, lead(lng) OVER w AS cx, lead(lat) OVER w AS cy FROM trace WINDOW w AS (PARTITION BY journey_id ORDER BY seq)) WHERE cx IS NOT NULL)"""
POST_SQL = """posts AS (SELECT edge_id AS marker_id, 51.0 + ay / 111195.08 + 0.0005 AS lat, -1.0 + ax / 69978.0 + edge_id % 7 * 0.0002 AS lng, 1704067200000 + edge_id % 5 * 2000000 AS valid_from, CASE WHEN edge_id % 3 > 0 THEN 1704067200000 + edge_id % 5 * 2000000 + 9000000 END AS valid_until FROM net)"""
WGS_SQL = "LATERAL (SELECT 1 - 0.0066943799901413165::DOUBLE * pow(sin(radians(lat)), 2) AS w) w, LATERAL (SELECT 6378137.0::DOUBLE * (1 - 0.0066943799901413165::DOUBLE) * pi() / 180 / pow(w, 1.5) AS ky, 6378137.0::DOUBLE * pi() / 180 * cos(radians(lat)) / sqrt(w) AS kx) k"


@query("jn19_edges_near_markers", "trace net", f"""WITH {STEP_SQL}, {POST_SQL},
n AS (SELECT journey_id, seq, marker_id, (ax - lng) * kx AS x0, (ay - lat) * ky AS y0, (cx - lng) * kx AS x1, (cy - lat) * ky AS y1 FROM (SELECT * FROM steps s JOIN posts p ON lat BETWEEN least(ay, cy) - 0.002 AND greatest(ay, cy) + 0.002
  AND lng BETWEEN least(ax, cx) - 0.003 AND greatest(ax, cx) + 0.003 AND t_ms >= valid_from AND (valid_until IS NULL OR t_ms <= valid_until)) j, {WGS_SQL}),
d AS (SELECT *, CASE WHEN x0 = x1 AND y0 = y1 THEN 0 ELSE greatest(0, least(1, (-x0 * (x1 - x0) - y0 * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) END AS f FROM n),
m AS (SELECT journey_id, seq, marker_id, round(sqrt(pow(x0 + f * (x1 - x0), 2) + pow(y0 + f * (y1 - y0), 2)), 6) AS metres FROM d)
SELECT journey_id, marker_id, count(*) AS edges, min(seq) AS first_seq, min(metres) AS nearest_m FROM m WHERE metres <= 100 GROUP BY 1, 2""")
def _(t):
    s = neighbours(t.trace, ["journey_id"], "seq", {"cx": ("lng", 1), "cy": ("lat", 1)}).where("cx IS NOT NULL").select("journey_id", "seq", "t_ms", F.col("lng").alias("ax"), F.col("lat").alias("ay"), "cx", "cy")
    m = t.net.selectExpr("edge_id AS marker_id", "51.0D + ay / 111195.08D + 0.0005D AS p_lat", "-1.0D + ax / 69978.0D + edge_id % 7 * 0.0002D AS p_lng", "1704067200000 + edge_id % 5 * 2000000 AS valid_from",
                         "CASE WHEN edge_id % 3 > 0 THEN 1704067200000 + edge_id % 5 * 2000000 + 9000000 END AS valid_until")
    near = J.dated_markers_near(s, m, ["journey_id", "seq"], "marker_id", "t_ms")
    return near.groupBy("journey_id", "marker_id").agg(F.count("*").alias("edges"), F.min("seq").alias("first_seq"), F.min("distance_m").alias("nearest_m"))


def planar_near_sql(name: str, cond: str, reach: float) -> str:
    return f"""{name} AS (SELECT o.journey_id, o.seq, e.edge_id, sqrt(pow(o.x - e.ax - f.f * (e.bx - e.ax), 2) + pow(o.y - e.ay - f.f * (e.by - e.ay), 2)) AS d FROM obs o JOIN net e ON abs(o.x - (e.ax + e.bx) / 2) <= {reach} + 30 AND abs(o.y - (e.ay + e.by) / 2) <= {reach} + 30 AND {cond},
 LATERAL (SELECT greatest(0, least(1, ((o.x - e.ax) * (e.bx - e.ax) + (o.y - e.ay) * (e.by - e.ay)) / (pow(e.bx - e.ax, 2) + pow(e.by - e.ay, 2)))) AS f) f)"""


def planar_near(points, edges, reach: float, keep=()):
    right = segment_cells(edges, "ax", "ay", "bx", "by", 40.0, reach)
    near = planar_cell(points, "x", "y", 40.0).join(right, ["_cx", "_cy"]).drop("_cx", "_cy")
    return near.withColumn("d", geo.point_segment("x", "y", "ax", "ay", "bx", "by")).where(F.col("d") <= reach)


@query("jn20_rail_or_road", "obs net", f"""WITH {planar_near_sql('rail', "e.edge_id % 3 = 0", 40)}, {planar_near_sql('road', "e.edge_id % 3 <> 0", 40)},
rb AS (SELECT journey_id, seq, arg_min(edge_id, (round(d, 6), edge_id)) AS edge_id, min(d) AS d FROM rail WHERE d <= 40 GROUP BY 1, 2),
r2 AS (SELECT rail.journey_id, rail.seq, count(*) AS rivals FROM rail JOIN rb USING (journey_id, seq) WHERE rail.d <= 40 AND rail.edge_id <> rb.edge_id AND rail.d <= rb.d + 8 GROUP BY 1, 2),
ro AS (SELECT journey_id, seq, min(d) AS d FROM road WHERE d <= 40 GROUP BY 1, 2)
SELECT rb.journey_id, rb.seq, CASE WHEN rivals > 0 THEN 'ambiguous' WHEN ro.d <= rb.d - 5 THEN 'road' ELSE 'rail' END AS verdict, count(*) AS n FROM rb LEFT JOIN r2 USING (journey_id, seq) LEFT JOIN ro USING (journey_id, seq) GROUP BY 1, 2, 3""")
def _(t):
    o = t.obs.select("journey_id", "seq", "x", "y")
    near = planar_near(o, t.net.select("edge_id", "ax", "ay", "bx", "by"), 40.0).withColumn("rail", F.expr("edge_id % 3 = 0")).select("journey_id", "seq", "edge_id", "rail", "d").distinct()
    # One pass: best and second-best rail, and the nearest road, by combinable minima.
    by = near.groupBy("journey_id", "seq").agg(F.min(F.when(F.col("rail"), F.struct(F.round("d", 6).alias("r"), "edge_id", "d"))).alias("b"), F.min(F.when(~F.col("rail"), F.col("d"))).alias("road"))
    rivals = (near.where("rail").join(by.where("b IS NOT NULL"), ["journey_id", "seq"]).where("edge_id <> b.edge_id AND d <= b.d + 8")
              .select("journey_id", "seq", F.lit(True).alias("rival")).distinct())
    j = by.where("b IS NOT NULL").join(rivals, ["journey_id", "seq"], "left")
    return j.select("journey_id", "seq", F.when(F.col("rival"), "ambiguous").when(F.col("road") <= F.col("b.d") - 5, "road").otherwise("rail").alias("verdict"), F.lit(1).cast("long").alias("n"))


@query("jn21_station_attachment", "venues anchors", f"""WITH st AS (SELECT venue_id AS station_id, 'station ' || CAST(venue_id % 20 AS STRING) AS nm, lat, lng FROM venues), stop AS (SELECT anchor_id AS stop_id, 'station ' || CAST(anchor_id % 20 AS STRING) AS nm, lat, lng FROM anchors),
n AS (SELECT stop_id, arg_min(station_id, (round({hav('p.lat', 'p.lng', 's.lat', 's.lng')}, 6), station_id)) AS station_id FROM stop p JOIN st s ON p.nm = s.nm AND {hav('p.lat', 'p.lng', 's.lat', 's.lng')} <= 9000 GROUP BY 1)
SELECT stop_id, coalesce('station:' || CAST(station_id AS STRING), 'stop:' || CAST(stop_id AS STRING)) AS attached FROM stop LEFT JOIN n USING (stop_id)""")
def _(t):
    st = as_places(t.venues, F.col("venue_id").alias("station_id"), text.squeeze(F.expr("concat(' Station  ', venue_id % 20)")).alias("nm"))
    stop = t.anchors.select(F.col("anchor_id").alias("stop_id"), text.squeeze(F.expr("concat('STATION ', anchor_id % 20)")).alias("nm"), "lat", "lng")
    best = nearest_within(stop, st, 9000.0, "station_id", ["nm"]).drop("distance_m")
    return stop.join(best, ["nm", "lat", "lng"], "left").select("stop_id", F.coalesce(F.concat(F.lit("station:"), F.col("station_id").cast("string")), F.concat(F.lit("stop:"), F.col("stop_id").cast("string"))).alias("attached"))


@query("jn22_segments_in_trace_box", "trace anchors", """WITH b AS (SELECT journey_id, min(lng) - 0.02 AS w, max(lng) + 0.02 AS e, min(lat) - 0.01 AS s, max(lat) + 0.01 AS n FROM trace GROUP BY 1)
SELECT journey_id, anchor_id FROM b JOIN anchors a ON a.lng >= w AND a.lng < e AND a.lat >= s AND a.lat < n""")
def _(t):
    b = t.trace.groupBy("journey_id").agg((F.min("lng") - 0.02).alias("west"), (F.max("lng") + 0.02).alias("east"), (F.min("lat") - 0.01).alias("south"), (F.max("lat") + 0.01).alias("north"))
    return points_in_boxes(t.anchors.select("anchor_id", "lng", "lat"), b, 0.05).select("journey_id", "anchor_id")


@query("jn23_relation_members", "", """WITH RECURSIVE rel AS (SELECT 'r' || CAST(n_regionkey AS STRING) AS parent, 'n' || CAST(n_nationkey AS STRING) AS child, 'relation' AS kind FROM nation UNION ALL SELECT 'n' || CAST(s_nationkey AS STRING), 'w' || CAST(s_suppkey AS STRING), 'way' FROM supplier UNION ALL SELECT 'n3', 'r' || CAST(n_regionkey AS STRING), 'relation' FROM nation WHERE n_nationkey = 3),
tops AS (SELECT DISTINCT parent FROM rel WHERE parent NOT IN (SELECT child FROM rel WHERE kind = 'relation')),
w AS (SELECT parent AS root, [parent] AS path, child, kind, 1 AS depth FROM rel WHERE parent IN (SELECT parent FROM tops)
 UNION ALL SELECT root, list_append(path, w.child), r.child, r.kind, depth + 1 FROM w JOIN rel r ON w.child = r.parent WHERE w.kind = 'relation' AND NOT list_contains(path, w.child))
SELECT root, child AS member, depth, kind = 'relation' AS cycle FROM w WHERE kind = 'way' OR list_contains(path, child)""")
def _(t):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rel = (t.nation.select(s("r", "n_regionkey").alias("parent"), s("n", "n_nationkey").alias("child"), F.lit("relation").alias("kind"))
           .unionByName(t.supplier.select(s("n", "s_nationkey").alias("parent"), s("w", "s_suppkey").alias("child"), F.lit("way").alias("kind")))
           .unionByName(t.nation.where("n_nationkey = 3").select(F.lit("n3").alias("parent"), s("r", "n_regionkey").alias("child"), F.lit("relation").alias("kind"))))
    return J.members_of_relations(rel)


@query("jn26_metadata_lookup", "features boxes", "SELECT DISTINCT f.town_id, b.name, 'alias ' || CAST(b.box_id AS STRING) AS alias FROM (SELECT DISTINCT town_id FROM features) f JOIN boxes b ON trim('NATION_' || CAST(f.town_id AS STRING) || ' ') = b.name")
def _(t):
    names = t.features.select("town_id").distinct().withColumn("name", F.trim(F.expr("concat('NATION_', town_id, ' ')")))
    return names.join(t.boxes.select("name", F.expr("concat('alias ', box_id)").alias("alias")), "name").select("town_id", "name", "alias")


@query("jn27_historic_county", "features boxes", "SELECT f.town_id, coalesce('county ' || CAST(b.county_id AS STRING), 'unaligned') AS county, count(*) AS features FROM features f LEFT JOIN boxes b ON f.town_id = b.box_id AND b.box_id % 6 <> 0 GROUP BY 1, 2")
def _(t):
    county = t.boxes.where("box_id % 6 <> 0").select(F.col("box_id").cast("long").alias("town_id"), F.expr("concat('county ', county_id)").alias("county"))
    towns = t.features.groupBy("town_id").agg(F.count("*").alias("features"))
    return towns.join(county, "town_id", "left").select("town_id", F.coalesce("county", F.lit("unaligned")).alias("county"), "features")


@query("jn28_journeys_at_point", "trace", f"WITH {LINE_SQL}, s AS (SELECT journey_id, seq, t_ms, ax, ay, cx, cy FROM legs WHERE t2 IS NOT NULL), pt AS (SELECT 51.00539591::DOUBLE AS lat, -0.9957130::DOUBLE AS lng), {near_segment_sql('s', 'pt', 'journey_id, seq, t_ms')} SELECT journey_id, max(t_ms) AS latest_ms FROM nd WHERE d <= 120 GROUP BY 1")
def _(t):
    d = geo.point_segment_m(F.lit(-0.9957130), F.lit(51.00539591), "ax", "ay", "cx", "cy")
    return legs(t).where(d <= 120).groupBy("journey_id").agg(F.max("t_ms").alias("latest_ms")).orderBy(F.desc("latest_ms"), "journey_id")


@query("jn29_point_context", "obs net", f"""WITH {planar_near_sql('nn', "TRUE", 15)} SELECT o.journey_id, o.seq, min(edge_id) FILTER (edge_id % 3 = 0 AND d <= greatest(15, accuracy_m)) AS rail_edge, arg_min(edge_id, (round(d, 6), edge_id)) FILTER (edge_id % 3 <> 0 AND d <= 15) AS road_edge,
 arg_min(edge_id, (round(d, 6), edge_id)) FILTER (edge_id % 3 = 1 AND d <= 15) AS through_edge FROM obs o JOIN nn USING (journey_id, seq) WHERE d <= 15 GROUP BY 1, 2""")
def _(t):
    near = planar_near(t.obs.select("journey_id", "seq", "x", "y", "accuracy_m"), t.net.select("edge_id", "ax", "ay", "bx", "by"), 15.0)
    best = lambda cond: F.min(F.when(F.expr(cond), F.struct(F.round("d", 6).alias("r"), "edge_id")))["edge_id"]
    return near.groupBy("journey_id", "seq").agg(
        F.min(F.when(F.expr("edge_id % 3 = 0 AND d <= greatest(15, accuracy_m)"), F.col("edge_id"))).alias("rail_edge"),
        best("edge_id % 3 <> 0 AND d <= 15").alias("road_edge"), best("edge_id % 3 = 1 AND d <= 15").alias("through_edge"))


@query("jn30_internal_movement", "trace boxes", "WITH ins AS (SELECT event_id AS pid, box_id FROM trace JOIN boxes ON lng >= west AND lng < east AND lat >= south AND lat < north) SELECT t.journey_id, bool_and(i.pid IS NOT NULL) AND count(DISTINCT i.box_id) = 1 AS internal FROM trace t LEFT JOIN ins i ON t.event_id = i.pid GROUP BY 1")
def _(t):
    inside = points_in_boxes(t.trace.select("event_id", "lng", "lat"), t.boxes, 0.1).select("event_id", "box_id")
    j = t.trace.select("journey_id", "event_id").join(inside, "event_id", "left")
    return j.groupBy("journey_id").agg((F.bool_and(F.col("box_id").isNotNull()) & (F.countDistinct("box_id") == 1)).alias("internal"))


@query("jn31_station_own_radius", "fixes venues", f"""WITH n AS (SELECT event_id, venue_id, round({hav('f.lat', 'f.lng', 'v.lat', 'v.lng')}, 6) AS d, 500 + venue_id % 7 * 100 AS r FROM fixes f, venues v WHERE f.accuracy_m <= 50)
SELECT event_id, arg_min(venue_id, (d, venue_id)) AS station_id, round(min(d), 3) AS distance_m FROM n WHERE d <= r GROUP BY event_id""")
def _(t):
    st = as_places(t.venues, F.col("venue_id").alias("station_id"), F.expr("500 + venue_id % 7 * 100").alias("radius_m"))
    best = J.nearest_own_radius(t.fixes.where("accuracy_m <= 50").select("event_id", "lat", "lng"), st, 1100.0, "event_id", "station_id")
    return best.select("event_id", "station_id", F.round("distance_m", 3).alias("distance_m"))


@query("jn32_collinear_pieces", "net", """WITH tl AS (SELECT edge_id AS line_id, ax + 20 AS ax, ay AS ay, ax + 110 AS cx, ay AS cy FROM net WHERE "by" = ay),
tv AS (SELECT edge_id AS line_id, ax, ay + 20 AS ay, ay + 110 AS cy FROM net WHERE bx = ax)
SELECT line_id, edge_id, CAST(round(greatest(ax, ex) - ax) AS BIGINT) AS line_lo, CAST(round(least(cx, fx) - ax) AS BIGINT) AS line_hi, CAST(round(greatest(ax, ex) - ex) AS BIGINT) AS edge_lo, CAST(round(least(cx, fx) - ex) AS BIGINT) AS edge_hi
FROM tl JOIN (SELECT edge_id, ax AS ex, ay AS ey, bx AS fx, "by" AS fy FROM net) e ON e.ey = tl.ay AND e.fy = tl.ay AND least(cx, fx) > greatest(ax, ex)
UNION ALL SELECT line_id, edge_id, CAST(round(greatest(ay, ey) - ay) AS BIGINT), CAST(round(least(cy, fy) - ay) AS BIGINT), CAST(round(greatest(ay, ey) - ey) AS BIGINT), CAST(round(least(cy, fy) - ey) AS BIGINT)
FROM tv JOIN (SELECT edge_id, ax AS ex, ay AS ey, bx AS fx, "by" AS fy FROM net) e ON e.ex = tv.ax AND e.fx = tv.ax AND least(cy, fy) > greatest(ay, ey)""")
def _(t):
    # A piece of the carrier of every edge, from 20 m to 110 m along it.
    east = "by = ay"
    lines = t.net.selectExpr("edge_id AS line_id", f"IF({east}, ax + 20, ax) AS sx", f"IF({east}, ay, ay + 20) AS sy", f"IF({east}, ax + 110, ax) AS tx", f"IF({east}, ay, ay + 110) AS ty")
    e = t.net.select("edge_id", "ax", "ay", "bx", "by")
    left = segment_cells(lines, "sx", "sy", "tx", "ty", 60.0)
    right = segment_cells(e, "ax", "ay", "bx", "by", 60.0)
    # Collinear: both edge ends on the line's carrier; offsets are feet on either axis.
    foot = lambda px, py, a: geo.segment_fraction(px, py, *a, clamped=False)
    line, edge = ("sx", "sy", "tx", "ty"), ("ax", "ay", "bx", "by")
    near = left.join(right, ["_cx", "_cy"]).dropDuplicates(["line_id", "edge_id"])
    p = near.withColumns({"ll": F.hypot(F.expr("tx - sx"), F.expr("ty - sy")), "el": F.hypot(F.expr("bx - ax"), F.expr("by - ay")),
                          "f0": foot("ax", "ay", line), "f1": foot("bx", "by", line),
                          "o0": F.expr("(tx - sx) * (ay - sy) - (ty - sy) * (ax - sx)"), "o1": F.expr("(tx - sx) * (by - sy) - (ty - sy) * (bx - sx)")})
    p = p.where("abs(o0) <= 0.001 * ll AND abs(o1) <= 0.001 * ll").withColumns({"lo": F.greatest(F.lit(0.0), F.least("f0", "f1")), "hi": F.least(F.lit(1.0), F.greatest("f0", "f1"))}).where("hi > lo")
    on_edge = lambda f: F.abs(F.col(f) - F.col("f0")) * F.col("ll")
    r = lambda c: F.round(c).cast("long")
    return p.select("line_id", "edge_id", r(F.col("lo") * F.col("ll")).alias("line_lo"), r(F.col("hi") * F.col("ll")).alias("line_hi"),
                    r(F.least(on_edge("lo"), on_edge("hi"))).alias("edge_lo"), r(F.greatest(on_edge("lo"), on_edge("hi"))).alias("edge_hi"))
