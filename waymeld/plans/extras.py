"""Remaining readers, sinks and extension points."""

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import coverage as cov
from ..operators import traces as T
from ..operators.components import connected_components
from ..operators.gridjoin import box_cells, points_in_boxes, segment_cells
from ..operators.intervals import interval_union
from ..operators.ledgers import greedy_keep
from ..sources import readers as R
from .catalogues import CH, chained_net, chains
from .coverage import ALIGN, PAIRS, hav, union_sql
from .registry import query
from .shapes import LINE_SQL, POLY, legs, polylines


@query("src03_journey_summaries", "journeys", "SELECT journey_id, mode, start_ms, CAST(distance_m AS DOUBLE) AS distance_meters, status FROM journeys")
def _(t):
    docs = t.journeys.selectExpr("""concat('{"journey_id":', journey_id, ',"mode":"', mode, '","started_at":"', date_format(timestamp_millis(start_ms), "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","distance_meters":', distance_m, ',"route_geometry":{"coordinates":[[', lng0, ',', lat0, ']]},"processing":{"status":"', status, '"}}') AS value""")
    return R.journey_summaries(docs).select(F.col("journey_id").cast("long").alias("journey_id"), "mode", "start_ms", "distance_meters", "status")


@query("src07_usable_ways", "", f"WITH {POLY} SELECT journey_id AS way_id, feature_idx FROM lines WHERE feature_idx % 5 <> 0 AND list_min(xs) < list_max(xs)")
def _(t):
    ways = polylines(t).withColumns({"way_id": F.col("journey_id"), "tags": F.create_map(F.lit("highway"), F.lit("primary")),
                                     "line": F.expr("CASE WHEN feature_idx % 5 = 0 THEN slice(line, 1, 1) ELSE line END")})
    return R.usable_ways(ways).select("way_id", "feature_idx")


@query("src09_text_sequence", "", "SELECT p_brand AS brand, count(*) AS features FROM part GROUP BY 1")
def _(t):
    lines = t.part.selectExpr("""concat(CASE WHEN p_partkey % 2 = 0 THEN decode(unhex('1E'), 'UTF-8') ELSE '' END, '{"type":"Feature","properties":{"name":"', p_brand, '"},"geometry":{"type":"LineString","coordinates":[[0,1],[1,1]]}}') AS value""")
    return R.text_sequence(lines).groupBy(F.col("properties")["name"].alias("brand")).agg(F.count("*").alias("features"))


@query("src12_station_lines", "venues", "SELECT 'S' || CAST(venue_id AS STRING) AS code, name || ', Main' AS name, 300.0::DOUBLE AS radius FROM venues WHERE venue_id % 7 <> 3")
def _(t):
    lines = t.venues.selectExpr("""concat('S', venue_id, ',"', name, ', Main",', lat, ',', lng, ',', CASE WHEN venue_id % 7 = 3 THEN 'unknown' ELSE '300' END) AS value""")
    return R.station_lines(lines).select("code", "name", "radius")


@query("src13_catalogue_lines", "", "SELECT CASE p_partkey % 9 WHEN 2 THEN 'not_a_record' WHEN 4 THEN 'bad_id' WHEN 6 THEN 'bad_position' ELSE 'good' END AS reason, count(*) AS records FROM part GROUP BY 1")
def _(t):
    lines = t.part.selectExpr("""CASE WHEN p_partkey % 9 = 2 THEN 'broken' ELSE concat('{"id":"', CASE WHEN p_partkey % 9 = 4 THEN 'X!' ELSE concat('post-', p_partkey) END, '","lat":', CASE WHEN p_partkey % 9 = 6 THEN 'null' ELSE '51.5' END, ',"lon":-1,"designer":"d"}') END AS value""")
    return R.catalogue_lines(lines).groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("records"))


@query("snk05_area_load_outcomes", "features", "SELECT town_id AS area, count(*) AS rows, CASE WHEN max(distance_m) >= 5000 AND town_id % 4 = 1 THEN 'failed' ELSE 'loaded' END AS outcome FROM features GROUP BY town_id")
def _(t):
    # One pass decides every area; `sinks.load_areas` then runs the writes and collects failures.
    a = t.features.groupBy(F.col("town_id").alias("area")).agg(F.count("*").alias("rows"), F.max("distance_m").alias("worst"))
    return a.select("area", "rows", F.when((F.col("worst") >= 5000) & (F.col("area") % 4 == 1), "failed").otherwise("loaded").alias("outcome"))


@query("snk08_display_overview", "net", f"WITH RECURSIVE {CH}, v AS (SELECT component, a_node AS n FROM comp JOIN en ON edge_id = node UNION SELECT component, b_node FROM comp JOIN en ON edge_id = node) SELECT component AS chain_id, count(*) AS vertices, count(*) FILTER (n % 2 = 0) AS shown FROM v GROUP BY 1")
def _(t):
    # Vertices of each maximal chain; every second node is drawn.
    e = chained_net(t)
    v = e.join(chains(e), F.col("edge_id") == F.col("node")).select("component", F.explode(F.array("a_node", "b_node")).alias("n")).distinct()
    return v.groupBy(F.col("component").alias("chain_id")).agg(F.count("*").alias("vertices"), F.count_if(F.col("n") % 2 == 0).alias("shown"))


@query("geo20_ring_assembly", "boxes", "SELECT CAST(box_id AS BIGINT) AS box_id, CASE WHEN box_id % 4 = 1 THEN 3 ELSE 4 END::BIGINT AS ways, box_id % 4 <> 1 AS closed FROM boxes")
def _(t):
    # Unordered member ways; every fourth site lacks one. The even-odd test needs
    # the edges of a ring, not their order, so closure is all that is assembled.
    side = F.explode(F.expr("filter(array(0, 1, 2, 3), s -> NOT (box_id % 4 = 1 AND s = 2))"))
    ways = t.boxes.select(F.col("box_id").cast("long").alias("box_id"), side.alias("s")).selectExpr("box_id", "box_id * 10 + s AS a", "box_id * 10 + (s + 1) % 4 AS b")
    comp = connected_components(ways.select("a", "b"))
    ends = ways.select("box_id", F.explode(F.array("a", "b")).alias("node")).groupBy("box_id", "node").agg(F.count("*").alias("deg"))
    ring = ends.join(comp, "node").groupBy("box_id").agg((F.sum("deg") / 2).cast("long").alias("ways"), (F.bool_and(F.col("deg") == 2) & (F.countDistinct("component") == 1)).alias("closed"))
    return ring


@query("geo22_observed_overlap", "obs net", f"WITH {ALIGN} SELECT journey_id, seq, edge_id, round(s, 6) AS step_from, round(e, 6) AS step_to, round(entry, 6) AS entry, round(exit, 6) AS exit_at FROM hits")
def _(t):
    p = cov.observation_pairs(t.obs)
    m = F.col("u") + 7.0
    inside = lambda x, y: F.col(x).between(m, 1200 - m) & F.col(y).between(m, 1e9 - m)
    p = p.where((F.col("reason").isNull()) & (F.col("step_m") <= 35) & inside("ax", "ay") & inside("bx", "by"))
    left = box_cells(p, F.least("ax", "bx") - 7.0, F.least("ay", "by") - 7.0, F.greatest("ax", "bx") + 7.0, F.greatest("ay", "by") + 7.0, 40.0)
    right = segment_cells(t.net.selectExpr("edge_id", "ax AS eax", "ay AS eay", "bx AS ebx", "by AS eby"), "eax", "eay", "ebx", "eby", 40.0)
    o = geo.observed_overlap([F.col(c) for c in ("eax", "eay", "ebx", "eby")], [F.col(c) for c in ("ax", "ay", "bx", "by")], [F.lit(7.0)])
    near = left.join(right, ["_cx", "_cy"]).dropDuplicates(["journey_id", "seq", "edge_id"])
    hit = near.withColumn("o", F.explode(F.filter(o, lambda x: x.isNotNull())))
    r = lambda c, n: F.round(f"o.{c}", 6).alias(n)
    return hit.select("journey_id", "seq", "edge_id", r("start", "step_from"), r("end", "step_to"), r("entry", "entry"), r("exit", "exit_at"))


@query("fn14_equal_arc_stations", "trace", f"""WITH {LINE_SQL}, d AS (SELECT *, {hav('ay', 'ax', 'cy', 'cx')} AS d FROM legs WHERE t2 IS NOT NULL), tot AS (SELECT journey_id, round(sum(d), 3) / 64 AS gap FROM d GROUP BY 1),
c AS (SELECT *, round(sum(d) OVER (PARTITION BY journey_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS hi FROM d), s AS (SELECT c.*, gap, coalesce(lag(hi) OVER (PARTITION BY journey_id ORDER BY seq), 0) AS lo FROM c JOIN tot USING (journey_id)),
k AS (SELECT *, unnest(range(CAST(ceil(lo / gap) AS BIGINT), CAST(ceil(hi / gap) AS BIGINT))) AS station FROM s WHERE hi > lo)
SELECT journey_id, station, round(ax + (cx - ax) * (station * gap - lo) / (hi - lo), 5) AS lng FROM k WHERE station BETWEEN 1 AND 63""")
def _(t):
    l = legs(t)
    gap = l.groupBy("journey_id").agg((F.round(F.sum(geo.haversine_m("ay", "ax", "cy", "cx")), 3) / 64).alias("gap"))
    s = T.stations(l.join(gap, "journey_id"), ["journey_id"], "seq", "gap")
    return s.where("station BETWEEN 1 AND 63").select("journey_id", "station", F.round("lng", 5).alias("lng"))


@query("set02_distinct_names", "features", "SELECT DISTINCT region, road_name FROM features WHERE road_name <> ''")
def _(t):
    return t.features.where("road_name <> ''").select("region", "road_name").distinct()


@query("set05_multipart_membership", "fixes boxes", "SELECT DISTINCT event_id, county_id FROM fixes JOIN boxes ON lng >= west - 0.01 AND lng < east + 0.01 AND lat >= south - 0.01 AND lat < north + 0.01")
def _(t):
    # Overlapping parts of one county need no dissolve: inside any part is inside.
    parts = t.boxes.selectExpr("county_id", "west - 0.01D AS west", "south - 0.01D AS south", "east + 0.01D AS east", "north + 0.01D AS north")
    return points_in_boxes(t.fixes.select("event_id", "lng", "lat"), parts, 0.1).select("event_id", "county_id").distinct()


@query("udf02_policy_parameters", "obs", "WITH " + PAIRS.replace("acc <= 5 AND acc2 <= 5", "acc <= 3 AND acc2 <= 3").replace("<= 8000", "<= 2200").replace("> .06", "> .004") + " SELECT coalesce(reason, 'open') AS reason, count(*) AS pairs FROM pairs GROUP BY 1")
def _(t):
    strict = cov.AlignPolicy(accuracy_m=3.0, gap_ms=2_200, speed_m_per_ms=0.004)
    return cov.observation_pairs(t.obs, strict).groupBy(F.coalesce("reason", F.lit("open")).alias("reason")).agg(F.count("*").alias("pairs"))


@query("udf03_grouped_map", "anchors", """WITH RECURSIVE a AS (SELECT anchor_id % 4 AS part, anchor_id, radians(lng) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS y, row_number() OVER (PARTITION BY anchor_id % 4 ORDER BY anchor_id) AS k FROM anchors),
s AS (SELECT part, k, [{'i': anchor_id, 'x': x, 'y': y}] AS kept FROM a WHERE k = 1
 UNION ALL SELECT a.part, a.k, CASE WHEN len(list_filter(s.kept, lambda p: sqrt(pow(p.x - a.x, 2) + pow(p.y - a.y, 2)) <= 5000)) > 0 THEN s.kept ELSE list_append(s.kept, {'i': a.anchor_id, 'x': a.x, 'y': a.y}) END FROM s JOIN a ON a.part = s.part AND a.k = s.k + 1)
SELECT part, unnest(kept).i AS anchor_id FROM (SELECT part, arg_max(kept, k) AS kept FROM s GROUP BY 1)""")
def _(t):
    # The grouped hook over blocks of bounded size.
    m = t.anchors.select(F.expr("anchor_id % 4").alias("part"), "anchor_id", geo.mercator_x("lng").alias("x"), geo.mercator_y("lat").alias("y"))
    return greedy_keep(m, ["part"], "anchor_id", "x", "y", 5000.0, block=1024)


@query("udaf01_union_per_journey_mode", "spans", "WITH " + union_sql("spans", "mode, journey_id", "start_mm", "end_mm") + " SELECT mode, count(*) AS pieces, CAST(sum(hi - lo) AS BIGINT) AS mm FROM united GROUP BY mode")
def _(t):
    s = t.spans.select("mode", "journey_id", F.col("start_mm").alias("lo"), F.col("end_mm").alias("hi"))
    return interval_union(s, ["mode", "journey_id"]).groupBy("mode").agg(F.count("*").alias("pieces"), F.sum(F.col("hi") - F.col("lo")).alias("mm"))


@query("udtf01_lateral_split", "road_refs", "SELECT feature_id, trim(unnest(string_split_regex(road_ref, '[;,/]'))) AS part FROM road_refs")
def _(t):
    t.road_refs.createOrReplaceTempView("_road_refs")
    return t.spark.sql("SELECT feature_id, trim(part) AS part FROM _road_refs LATERAL VIEW explode(split(road_ref, '[;,/]')) AS part")
