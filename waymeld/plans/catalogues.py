"""Sources, sinks, reference builds, graphs and quality checks."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators.components import connected_components, near_components
from ..operators.gridjoin import points_in_boxes, near_any
from ..operators.ordered import quantiles
from ..sources import readers as R
from ..sources import sinks as S
from .coverage import hav
from .ledgers import KEYED, keyed_segments
from .registry import query
from .shapes import polylines
from .spatial import as_places, planar_near, planar_near_sql

ISO = "date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def timeline_docs(t):
    """Every event spelt as one export document, in the new or the legacy layout."""
    new = f"""concat('{{"semanticSegments":[{{"startTime":"', {ISO}, '","endTime":"', {ISO}, '","activity":{{"distanceMeters":', event_id, ',"start":"', 51 + user_id % 40 / 100, '°, ', -1 + user_id % 60 / 100, '°","end":"geo:51.5,-0.5","topCandidate":{{"type":"IN_BUS"}}}},"timelinePath":[{{"point":"51.25°, -0.25°","durationMinutesOffsetFromStartTime":"5"}}]}},{{"startTime":"', {ISO}, '","endTime":"', {ISO}, '","visit":{{"topCandidate":{{"placeId":"p', user_id, '","placeLocation":"51.1, -0.2"}}}}}}]}}')"""
    old = f"""concat('{{"timelineObjects":[{{"activitySegment":{{"activityType":"CYCLING","distance":', event_id, ',"duration":{{"startTimestamp":"', {ISO}, '","endTimestamp":"', {ISO}, '"}},"startLocation":{{"latitudeE7":', 510000000 + user_id % 40 * 100000, ',"longitudeE7":-10000000}},"endLocation":{{"latitudeE7":515000000,"longitudeE7":-5000000}},"waypointPath":{{"waypoints":[{{"latE7":512500000,"lngE7":-2500000}},{{"latE7":513500000,"lngE7":-3500000}}]}}}}}}]}}')"""
    return t.events.selectExpr("event_id", f"CASE WHEN event_id % 3 = 0 THEN {old} ELSE {new} END AS value")


@query("src01_timeline_activities", "fixes", "SELECT event_id, t_ms AS start_ms, CASE WHEN event_id % 3 = 0 THEN 'cycling' ELSE 'bus' END AS mode, CAST(event_id AS DOUBLE) AS distance_m, round(51 + (user_id % 40) / 100.0::DOUBLE, 6) AS lat0, 51.5::DOUBLE AS lat1 FROM fixes")
def _(t):
    return R.timeline_activities(timeline_docs(t)).select("event_id", "start_ms", "mode", "distance_m", F.round("lat0", 6).alias("lat0"), "lat1")


@query("src01_timeline_visits", "fixes", "SELECT event_id, t_ms AS start_ms, 'p' || CAST(user_id AS STRING) AS place_id, 51.1::DOUBLE AS lat FROM fixes WHERE event_id % 3 <> 0")
def _(t):
    return R.timeline_visits(timeline_docs(t)).select("event_id", "start_ms", "place_id", "lat")


@query("src02_timeline_points", "fixes", "SELECT event_id, 0 AS i, CASE WHEN event_id % 3 = 0 THEN NULL ELSE t_ms + 300000 END AS t_ms, 51.25::DOUBLE AS lat, -0.25::DOUBLE AS lng FROM fixes UNION ALL SELECT event_id, 1, NULL, 51.35, -0.35 FROM fixes WHERE event_id % 3 = 0")
def _(t):
    return R.timeline_points(timeline_docs(t)).select("event_id", "i", "t_ms", "lat", "lng")


@query("src04_diagnostics_exports", "", """WITH j AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders), u AS (SELECT 'j' || CAST(c AS STRING) AS journey_id, k % 2 AS v FROM j WHERE k % 10 <> 0 AND k % 10 <> 5)
SELECT journey_id, count(*) AS fixes FROM (SELECT journey_id, unnest([0, 1, 2]) FROM u GROUP BY journey_id HAVING count(DISTINCT v) = 1) GROUP BY 1""")
def _(t):
    doc = """concat('{"format":"', CASE WHEN o_orderkey % 10 = 0 THEN 'other' ELSE 'capture-v1' END, '","schema_version":1,"export_complete":', CASE WHEN o_orderkey % 10 = 5 THEN 'false' ELSE 'true' END,
     ',"journey":{"journey_id":"j', o_custkey, '","mode":"walking","raw_capture_samples":[[-1.0,51.0,5,1000,', o_orderkey % 2, '],[-1.0,51.1,5,2000,1],[-1.0,51.2,5,3000,1]]}}') AS value"""
    rows, _bad = R.diagnostics_exports(t.orders.selectExpr(doc), "capture-v1")
    return rows.groupBy("journey_id").agg(F.count("*").alias("fixes"))


def match_docs(t):
    """A stored router response per order: two matchings, the second broken for every fourth order."""
    return t.orders.selectExpr("o_orderkey AS journey_id", """concat('{"code":"Ok","tracepoints":[{"matchings_index":0,"waypoint_index":0,"location":[-1,51]},null,{"matchings_index":0,"waypoint_index":1,"location":[-1,51]},{"matchings_index":0,"waypoint_index":2,"location":[-1,51]},{"matchings_index":1,"waypoint_index":', CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END, ',"location":[-1,51]},{"matchings_index":1,"waypoint_index":1,"location":[-1,51]}],"matchings":[{"distance":300,"confidence":0.9,"legs":[{"distance":', o_orderkey % 500, ',"duration":1,"steps":[{"ref":"A', o_orderkey % 9 + 1, '; M2","name":"x","distance":', o_orderkey % 500, '}]},{"distance":200,"duration":1,"steps":[{"ref":"","name":"Lane","distance":200}]}]},{"distance":50,"confidence":0.4,"legs":[{"distance":50,"duration":1,"steps":[{"ref":"A7","name":"y","distance":50}]}]}]}') AS value""")


@query("src05_match_legs", "", "SELECT o_orderkey AS journey_id, 0 AS matching, 0 AS leg, 0 AS start_point, 2 AS end_point, CAST(o_orderkey % 500 AS DOUBLE) AS distance_m FROM orders UNION ALL SELECT o_orderkey, 0, 1, 2, 3, 200 FROM orders UNION ALL SELECT o_orderkey, 1, 0, 4, 5, 50 FROM orders WHERE o_orderkey % 4 <> 0")
def _(t):
    return R.match_legs(match_docs(t)).select("journey_id", "matching", "leg", "start_point", "end_point", "distance_m")


@query("jn24_leg_completeness", "", "SELECT o_orderkey AS journey_id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 3 END AS BIGINT) AS legs, o_orderkey % 4 <> 0 AS complete FROM orders")
def _(t):
    return R.match_legs(match_docs(t)).groupBy("journey_id").agg(F.count("*").alias("legs")).withColumn("complete", F.col("legs") == 3)


@query("gra07_match_outcome", "", """WITH s AS (SELECT o_orderkey AS j, CAST(o_orderkey % 500 AS DOUBLE) AS d, 'A' || CAST(o_orderkey % 9 + 1 AS STRING) AS ref, 'a_road' AS kind FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 500, 'M2', 'motorway' FROM orders UNION ALL SELECT o_orderkey, 200, '', 'other' FROM orders UNION ALL SELECT o_orderkey, 50, 'A7', 'a_road' FROM orders WHERE o_orderkey % 4 <> 0)
SELECT kind, ref, count(DISTINCT j) AS journeys, sum(d) AS distance_m FROM s GROUP BY 1, 2""")
def _(t):
    s = R.match_legs(match_docs(t)).select("journey_id", F.explode("steps").alias("s")).select("journey_id", F.col("s.distance").alias("d"), F.col("s.ref").alias("ref"))
    tag = lambda kind, refs: F.transform(refs, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))
    named = F.concat(tag("motorway", text.motorway_refs("ref")), tag("a_road", text.a_road_refs("ref")))
    other = F.array(F.struct(F.lit("other").alias("kind"), F.lit("").alias("ref")))
    each = s.select("journey_id", "d", F.explode(F.when(F.size(named) > 0, named).otherwise(other)).alias("r"))
    return each.groupBy("r.kind", "r.ref").agg(F.countDistinct("journey_id").alias("journeys"), F.sum("d").alias("distance_m"))


@query("src06_osm_ways", "", "SELECT p_partkey AS way_id, p_brand AS ref, 3 AS points FROM part WHERE p_partkey % 3 <> 0")
def _(t):
    docs = t.part.selectExpr("""concat('{"elements":[{"type":"', CASE WHEN p_partkey % 3 = 0 THEN 'node' ELSE 'way' END, '","id":', p_partkey, ',"tags":{"ref":"', p_brand, '"},"geometry":[{"lat":51,"lon":-1},{"lat":51.1,"lon":-1},{"lat":51.2,"lon":-1}]}]}') AS value""")
    return R.osm_ways(docs).select("way_id", F.col("tags")["ref"].alias("ref"), F.size("line").alias("points"))


@query("src08_geojson_features", "", "SELECT p_name AS name, count(*) AS features, CAST(count(*) FILTER (p_partkey % 2 = 0) * 2 + count(*) FILTER (p_partkey % 2 = 1) * 3 AS BIGINT) AS points FROM part GROUP BY 1")
def _(t):
    one = """'{"type":"Feature","properties":{"name":"', p_name, '"},"geometry":{"type":"LineString","coordinates":', CASE WHEN p_partkey % 2 = 0 THEN '[[0,1],[1,1]]' ELSE '[[0,1],[1,1],[2,2]]' END, '}}'"""
    docs = t.part.selectExpr(f"""CASE WHEN p_partkey % 5 = 0 THEN concat({one}) ELSE concat('{{"type":"FeatureCollection","features":[', {one}, ']}}') END AS value""")
    return R.geojson_features(docs).groupBy(F.col("properties")["name"].alias("name")).agg(F.count("*").alias("features"), F.sum(F.size("line")).alias("points"))


@query("src10_road_links", "", "SELECT p_partkey AS link_id, p_size FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_size >= 10")
def _(t):
    # Class filter and the slip-road bound both reach the Parquet scan.
    return t.part.where(F.col("p_type").isin("ECONOMY", "STANDARD") & (F.col("p_size") >= 10)).select(F.col("p_partkey").alias("link_id"), "p_size")


@query("src11_road_files", "", "SELECT 'GB:A' || CAST(p_partkey AS STRING) AS road_id, pos, round(-1 + pos / 10.0::DOUBLE, 6) AS lng FROM part, (SELECT unnest([0, 1, 2]) AS pos)")
def _(t):
    docs = t.part.selectExpr("""concat('{"version":', CASE WHEN p_partkey % 2 = 0 THEN concat('4,"anchors":[[-1,51,0],[-0.9,51,0],[-0.8,51,1]]') ELSE '5,"paths":[[[-1,51,0],[-0.9,51,0]],[[-0.8,51,1]]]' END, ',"id":"GB:A', p_partkey, '","region":"GB","ref":"A', p_partkey, '","total_km":1.5}') AS value""")
    return R.road_references(docs).select("road_id", "pos", F.round("lng", 6).alias("lng"))


@query("src14_movement_log", "fixes", "SELECT event_id, t_ms, 'still' AS activity FROM fixes WHERE event_id % 4 <> 0 AND t_ms BETWEEN 1704067200000 AND 1705000000000")
def _(t):
    lines = t.events.selectExpr("event_id", f"""CASE WHEN event_id % 4 = 0 THEN 'service started' ELSE concat('{{"timestamp_utc":"', {ISO}, '","activity":"still","transition":"entered"}}') END AS value""")
    return R.movement_log(lines, 1704067200000, 1705000000000).select("event_id", "t_ms", "activity")


@query("src15_page_proof", "", "SELECT o_custkey AS id, 'repeated' AS fault FROM orders GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    pages = t.orders.select(F.col("o_orderkey").alias("page"), F.lit(False).alias("truncated"), F.array("o_custkey").alias("ids"))
    return R.page_gaps(pages, t.customer.select(F.col("c_custkey").alias("id")))


@query("src16_reference_status", "boxes", "SELECT CAST(box_id AS BIGINT) AS box_id, name, (SELECT count(*) FROM customer WHERE c_nationkey = box_id) AS inventory FROM boxes WHERE west >= -0.9 AND north <= 51.3")
def _(t):
    inv = t.customer.groupBy(F.col("c_nationkey").alias("box_id")).agg(F.count("*").alias("inventory"))
    return t.boxes.where("west >= -0.9 AND north <= 51.3").join(inv, "box_id", "left").select(F.col("box_id").cast("long").alias("box_id"), "name", F.coalesce("inventory", F.lit(0)).alias("inventory"))


@query("snk01_manifest", "features", "SELECT town_id, count(*) AS rows, CAST(sum(octet_length(encode(b))) AS BIGINT) AS bytes, CAST(sum(('0x' || substr(sha256(b), 1, 8))::BIGINT) AS BIGINT) AS digest FROM (SELECT town_id, '{\"journey_id\":' || journey_id || ',\"road_ref\":\"' || road_ref || '\"}' AS b FROM features) GROUP BY 1")
def _(t):
    return S.manifest(t.features.select("town_id", "journey_id", "road_ref"), "town_id")


@query("snk02_geojson_output", "", "SELECT count(*) AS features, count(DISTINCT l_orderkey) AS journeys FROM lineitem")
def _(t):
    f = S.geojson_lines(polylines(t), "line", ["journey_id", "feature_idx"])
    back = R.geojson_features(f)
    return back.where("geometry_type = 'LineString' AND size(line) = 4").agg(F.count("*").alias("features"), F.countDistinct(F.col("properties")["journey_id"]).alias("journeys"))


@query("snk03_merge_latest", "", "SELECT l_partkey AS part_id, CAST(arg_max(q, (v, n, q)) AS DOUBLE) AS quantity, max(v) AS version FROM (SELECT l_partkey, l_orderkey AS v, 0 AS n, max(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2 UNION ALL SELECT l_partkey, l_orderkey, 1, max(l_quantity) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) GROUP BY 1")
def _(t):
    side = lambda cond: t.lineitem.where(cond).groupBy(F.col("l_partkey").alias("part_id"), F.col("l_orderkey").alias("version")).agg(F.max("l_quantity").alias("quantity"))
    return S.merge_latest(side("l_returnflag <> 'R'"), side("l_returnflag = 'R'"), ["part_id"], "version").select("part_id", "quantity", "version")


@query("snk03_insert_absent", "", "SELECT o_custkey AS id, 'order' AS origin FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return S.insert_absent(t.orders.select(F.col("o_custkey").alias("id")).distinct().withColumn("origin", F.lit("order")), t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin")), ["id"])


@query("snk04_load_gate", "", "SELECT CAST(l_suppkey AS STRING) AS source_key, count(*) AS row_count FROM lineitem GROUP BY 1 HAVING count(*) <> count(*) FILTER (l_shipdate < TIMESTAMP '1999-06-01')")
def _(t):
    def load(df):
        return df.groupBy(F.col("l_suppkey").cast("string").alias("source_key")).agg(F.count("*").alias("row_count"), F.sum("l_orderkey").alias("checksum"))
    return S.loads_due(load(t.lineitem), load(t.lineitem.where("l_shipdate < TIMESTAMP '1999-06-01'"))).select("source_key", "row_count")


@query("snk06_additive_release", "features", "SELECT town_id, road_name, 'published' AS origin FROM (SELECT DISTINCT town_id, road_name FROM features WHERE region = 'GB') UNION ALL SELECT town_id, road_name, 'added' FROM (SELECT DISTINCT town_id, road_name FROM features WHERE region = 'NI' EXCEPT SELECT DISTINCT town_id, road_name FROM features WHERE region = 'GB')")
def _(t):
    one = lambda region, origin: t.features.where(F.col("region") == region).select("town_id", "road_name").distinct().withColumns({"k": F.concat_ws("|", F.col("town_id").cast("string"), "road_name"), "origin": F.lit(origin)})
    return S.additive_release(one("GB", "published"), one("NI", "added"), "k")[0].drop("k")


@query("snk07_fill_missing", "", "SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name, coalesce(a.points, b.points) AS points FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, NULL::BIGINT AS points FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS id, 'n' || CAST(c_custkey AS STRING) AS name, c_custkey * 2 AS points FROM customer) b USING (id)")
def _(t):
    old = t.customer.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name", "CAST(NULL AS BIGINT) AS points")
    return S.fill_missing(old, t.customer.selectExpr("c_custkey AS id", "concat('n', c_custkey) AS name", "c_custkey * 2 AS points"), "id")


# --- reference builds ----------------------------------------------------

@query("agg19_settlement_inventory", "anchors boxes", "WITH r AS (SELECT DISTINCT b.box_id, trim(p.p_name) AS name FROM anchors a JOIN part p ON a.anchor_id = p.p_partkey JOIN boxes b ON a.lng >= west AND a.lng < east AND a.lat >= south AND a.lat < north) SELECT box_id, name, count(*) OVER (PARTITION BY box_id) AS names FROM r")
def _(t):
    named = t.anchors.join(t.part.select(F.col("p_partkey").alias("anchor_id"), F.trim("p_name").alias("name")), "anchor_id")
    r = points_in_boxes(named.select("name", "lng", "lat"), t.boxes.drop("name"), 0.1).select("box_id", "name").distinct()
    # The inventory stays in long form; its size is a separate aggregate.
    return r.join(r.groupBy("box_id").agg(F.count("*").alias("names")), "box_id").select("box_id", "name", "names")


@query("agg20_way_evidence_cube", "features", "SELECT highway, highway <> 'service' AS eligible, road_name <> '' AS named, count(*) AS ways, count(*) FILTER (regexp_full_match(road_ref, '[0-9]+')) AS numeric_names, CAST(GROUPING(highway, eligible, named) AS BIGINT) AS level FROM features GROUP BY CUBE (highway, eligible, named)")
def _(t):
    f = t.features.select("highway", (F.col("highway") != "service").alias("eligible"), (F.col("road_name") != "").alias("named"), "road_ref")
    return f.cube("highway", "eligible", "named").agg(F.count("*").alias("ways"), F.count_if(F.col("road_ref").rlike("^[0-9]+$")).alias("numeric_names"), F.grouping_id().alias("level"))


@query("agg20_way_samples", "features", "SELECT highway, feature_id AS sample_id FROM (SELECT highway, feature_id, row_number() OVER (PARTITION BY highway ORDER BY feature_id) AS n FROM (SELECT DISTINCT highway, feature_id FROM features)) WHERE n <= 5")
def _(t):
    return S.newest_within(t.features.select("highway", (-F.col("feature_id")).alias("k")).distinct(), ["highway"], "k", 5).select("highway", (-F.col("k")).alias("sample_id"))


SVC = f"""sv AS (SELECT c_custkey AS id, 'service ' || CAST(c_custkey % 6 AS STRING) AS nm, 51.0::DOUBLE + (c_custkey * 523 % 410)::DOUBLE / 1000 AS lat, -1.0::DOUBLE + (c_custkey * 811 % 610)::DOUBLE / 1000 AS lng FROM customer),
lk AS (SELECT a.id AS a, b.id AS b FROM sv a JOIN sv b ON a.nm = b.nm AND a.id < b.id AND {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 2500),
bo AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
cc AS (SELECT id AS node, id AS root FROM sv UNION SELECT bo.b, cc.root FROM cc JOIN bo ON bo.a = cc.node),
comp AS (SELECT node, min(root) AS component FROM cc GROUP BY 1)"""


def services(t):
    return t.customer.selectExpr("c_custkey AS id", "concat('service ', c_custkey % 6) AS nm", "51.0D + CAST(c_custkey * 523 % 410 AS DOUBLE) / 1000 AS lat", "-1.0D + CAST(c_custkey * 811 % 610 AS DOUBLE) / 1000 AS lng")


def service_components(t):
    sv = services(t)
    return sv, near_components(sv, "id", 2500.0, ["nm"])


@query("gra01_components", "", f"WITH RECURSIVE {SVC} SELECT * FROM comp")
def _(t):
    return service_components(t)[1]


@query("agg36_service_dedupe", "", f"WITH RECURSIVE {SVC} SELECT component AS service_id, nm AS name, count(*) AS sites, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM comp JOIN sv ON id = node GROUP BY 1, 2")
def _(t):
    sv, comp = service_components(t)
    return (sv.join(comp, sv.id == comp.node).groupBy(F.col("component").alias("service_id"), F.col("nm").alias("name"))
            .agg(F.count("*").alias("sites"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng")))


def chains(edges):
    """Maximal chains of a network: edges that meet at a degree-two node belong together."""
    ends = edges.select("edge_id", F.explode(F.array("a_node", "b_node")).alias("node"))
    # A degree-two node names its two edges by min and max: no pair is formed at junctions.
    pass_through = ends.groupBy("node").agg(F.count("*").alias("deg"), F.min("edge_id").alias("a"), F.max("edge_id").alias("b")).where("deg = 2 AND a <> b")
    return connected_components(pass_through.select("a", "b"), edges.select("edge_id"))


def chained_net(t):
    # Two of three cross streets belong to a network of their own, so that chains of several edges form in both.
    own = F.expr("IF(edge_id % 2 = 1 AND edge_id % 6 <> 1, 1000000000000L, 0L)")
    return t.net.withColumns({"a_node": F.col("a_node") + own, "b_node": F.col("b_node") + own})


CH = """en AS (SELECT edge_id, a_node + own AS a_node, b_node + own AS b_node, length_mm FROM (SELECT *, CASE WHEN edge_id % 2 = 1 AND edge_id % 6 <> 1 THEN 1000000000000 ELSE 0 END AS own FROM net)), nd AS (SELECT node, min(edge_id) AS a, max(edge_id) AS b FROM (SELECT edge_id, a_node AS node FROM en UNION ALL SELECT edge_id, b_node FROM en) GROUP BY 1 HAVING count(*) = 2 AND min(edge_id) <> max(edge_id)),
bo AS (SELECT a, b FROM nd UNION ALL SELECT b, a FROM nd), cc AS (SELECT edge_id AS node, edge_id AS root FROM en UNION SELECT bo.b, cc.root FROM cc JOIN bo ON bo.a = cc.node), comp AS (SELECT node, min(root) AS component FROM cc GROUP BY 1)"""


@query("gra02_degree_two_chains", "net", f"WITH RECURSIVE {CH} SELECT component AS chain_id, count(*) AS edges, CAST(sum(length_mm) AS BIGINT) AS length_mm FROM comp JOIN en ON edge_id = node GROUP BY 1")
def _(t):
    e = chained_net(t)
    return e.join(chains(e), F.col("edge_id") == F.col("node")).groupBy(F.col("component").alias("chain_id")).agg(F.count("*").alias("edges"), F.sum("length_mm").alias("length_mm"))


@query("gra03_edges_and_degree", "net", "WITH e AS (SELECT a_node AS node, edge_id FROM net UNION ALL SELECT b_node, edge_id FROM net), p AS (SELECT least(a_node, b_node) AS a, greatest(a_node, b_node) AS b, count(*) AS n FROM net GROUP BY 1, 2) SELECT node, count(*) AS degree, count(*) = 1 AS dead_end, (SELECT coalesce(CAST(sum(n - 1) AS BIGINT), 0) FROM p WHERE a = node) AS parallel FROM e GROUP BY node")
def _(t):
    deg = t.net.select(F.explode(F.array("a_node", "b_node")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    par = (t.net.groupBy(F.least("a_node", "b_node").alias("node"), F.greatest("a_node", "b_node").alias("o")).agg(F.count("*").alias("n")).groupBy("node").agg(F.sum(F.col("n") - 1).alias("p")))
    return deg.join(par, "node", "left").select("node", "degree", (F.col("degree") == 1).alias("dead_end"), F.coalesce("p", F.lit(0)).alias("parallel"))


@query("gra04_roundabout_gates", "net", f"WITH RECURSIVE {CH}, g AS (SELECT component, count(DISTINCT n.node) FILTER (n.deg <> 2) AS gates, count(DISTINCT edge_id) AS edges FROM comp JOIN en ON edge_id = comp.node JOIN (SELECT node, edge_id AS e2, count(*) OVER (PARTITION BY node) AS deg FROM (SELECT a_node AS node, edge_id FROM en UNION ALL SELECT b_node, edge_id FROM en)) n ON n.e2 = edge_id GROUP BY 1) SELECT component AS group_id, gates, edges, CASE WHEN gates = 2 THEN 'alternatives' ELSE 'held' END AS decision FROM g")
def _(t):
    e = chained_net(t)
    ends = e.select("edge_id", F.explode(F.array("a_node", "b_node")).alias("n"))
    deg = ends.groupBy("n").agg(F.count("*").alias("deg"))
    g = ends.join(chains(e).select(F.col("node").alias("edge_id"), "component"), "edge_id").join(deg, "n")
    r = g.groupBy(F.col("component").alias("group_id")).agg(F.countDistinct(F.when(F.col("deg") != 2, F.col("n"))).alias("gates"), F.countDistinct("edge_id").alias("edges"))
    return r.withColumn("decision", F.when(F.col("gates") == 2, "alternatives").otherwise("held"))


@query("agg41_relation_summary", "features", "SELECT region, count(DISTINCT feature_id) AS ways, count(DISTINCT town_id) AS extents, count(DISTINCT sha256(road_ref)) AS versions FROM features GROUP BY 1")
def _(t):
    return t.features.groupBy("region").agg(F.countDistinct("feature_id").alias("ways"), F.countDistinct("town_id").alias("extents"), F.countDistinct(F.sha2("road_ref", 256)).alias("versions"))


@query("agg42_physical_edges", "journeys", f"WITH {KEYED} SELECT routes, count(*) AS edges, round(sum(m), 1) AS length_m FROM (SELECT seg_key, count(DISTINCT journey_id % 7) AS routes, max(length_m) AS m FROM keyed GROUP BY 1) GROUP BY 1")
def _(t):
    e = keyed_segments(t).groupBy("seg_key").agg(F.countDistinct(F.expr("journey_id % 7")).alias("routes"), F.max("length_m").alias("m"))
    return e.groupBy("routes").agg(F.count("*").alias("edges"), F.round(F.sum("m"), 1).alias("length_m"))


@query("agg45_triage", "", "SELECT l_suppkey AS route_id, CASE WHEN x >= .75 THEN 'match' WHEN x >= .68 THEN 'review' ELSE 'reject' END AS disposition FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R')::DOUBLE / count(*) AS x FROM lineitem GROUP BY 1)")
def _(t):
    x = t.lineitem.groupBy(F.col("l_suppkey").alias("route_id")).agg((F.count_if(F.col("l_returnflag") != "R") / F.count("*")).alias("x"))
    return x.select("route_id", F.when(F.col("x") >= 0.75, "match").when(F.col("x") >= 0.68, "review").otherwise("reject").alias("disposition"))


@query("agg46_candidate_classes", "", "SELECT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'approved' WHEN o_orderstatus = 'F' THEN 'held' ELSE 'rejected' END AS class, CASE WHEN o_orderstatus <> 'F' THEN 'not_final' WHEN o_totalprice <= 100000 THEN 'weak_evidence' ELSE 'complete' END AS reason, count(*) AS candidates FROM orders GROUP BY 1, 2")
def _(t):
    final, strong = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000
    return t.orders.groupBy(F.when(final & strong, "approved").when(final, "held").otherwise("rejected").alias("class"), F.when(~final, "not_final").when(~strong, "weak_evidence").otherwise("complete").alias("reason")).agg(F.count("*").alias("candidates"))


@query("agg47_catalogue_build", "venues boxes", "WITH v AS (SELECT venue_id // 2 AS identity, min(venue_id) AS venue_id, count(*) AS aliases, count(DISTINCT name) > 1 AS conflict FROM venues GROUP BY 1), c AS (SELECT v.*, b.county_id FROM v JOIN venues USING (venue_id) LEFT JOIN boxes b ON lng >= west AND lng < east AND lat >= south AND lat < north) SELECT identity, venue_id, aliases, conflict, county_id, CASE WHEN identity % 5 = 0 THEN 'added' ELSE 'kept' END AS release FROM c")
def _(t):
    ids = t.venues.groupBy(F.expr("venue_id DIV 2").alias("identity")).agg(F.min("venue_id").alias("venue_id"), F.count("*").alias("aliases"), (F.countDistinct("name") > 1).alias("conflict"))
    at = ids.join(t.venues.select("venue_id", "lng", "lat"), "venue_id")
    county = points_in_boxes(at.select("venue_id", "lng", "lat"), t.boxes, 0.1).select("venue_id", "county_id")
    before = ids.where("identity % 5 <> 0").select("identity", F.lit(1).alias("was"))
    return ids.join(county, "venue_id", "left").join(before, "identity", "left").select("identity", "venue_id", "aliases", "conflict", "county_id", F.when(F.col("was").isNull(), "added").otherwise("kept").alias("release"))


@query("agg53_adaptive_cells", "anchors", """WITH RECURSIVE p AS (SELECT (lng + 1) / 0.61 AS x, (lat - 51) / 0.41 AS y FROM anchors), c AS (SELECT d, CAST(floor(x * pow(2, d)) AS BIGINT) AS cx, CAST(floor(y * pow(2, d)) AS BIGINT) AS cy, count(*) AS n FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS d) GROUP BY 1, 2, 3)
SELECT CAST(d AS INTEGER) AS depth, cx, cy, n AS rows FROM c WHERE (n <= 60 OR d = 5) AND (d = 1 OR (SELECT n FROM c u WHERE u.d = c.d - 1 AND u.cx = c.cx // 2 AND u.cy = c.cy // 2) > 60)""")
def _(t):
    # Count once at the finest cell, roll the counts up, keep the first cell at or below the cap.
    fine = t.anchors.groupBy(F.floor((F.col("lng") + 1) / 0.61 * 32).alias("fx"), F.floor((F.col("lat") - 51) / 0.41 * 32).alias("fy")).agg(F.count("*").alias("n"))
    lv = fine.withColumn("depth", F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 5)))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), 5 - F.col("depth")))
    c = lv.groupBy("depth", up("fx").alias("cx"), up("fy").alias("cy")).agg(F.sum("n").alias("n"))
    parent = c.select((F.col("depth") + 1).alias("depth"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("n").alias("pn"))
    j = c.withColumns({"px": F.floor(F.col("cx") / 2), "py": F.floor(F.col("cy") / 2)}).join(parent, ["depth", "px", "py"], "left")
    return j.where("(n <= 60 OR depth = 5) AND (pn IS NULL OR pn > 60)").select("depth", "cx", "cy", F.col("n").alias("rows"))


@query("agg54_extent_composition", "net", "WITH RECURSIVE " + CH + ", d AS (SELECT node, count(*) AS deg FROM (SELECT a_node AS node FROM en UNION ALL SELECT b_node FROM en) GROUP BY 1) SELECT (SELECT count(*) FROM en) AS edges, (SELECT CAST(sum(length_mm) AS BIGINT) FROM en) AS length_mm, (SELECT count(*) FROM d WHERE deg = 1) AS ends, (SELECT count(*) FROM d WHERE deg > 2) AS branches, (SELECT count(DISTINCT component) FROM comp) AS chains")
def _(t):
    e = chained_net(t)
    d = e.select(F.explode(F.array("a_node", "b_node")).alias("n")).groupBy("n").agg(F.count("*").alias("deg"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    a = one(e.agg(F.count("*").alias("edges"), F.sum("length_mm").alias("length_mm")))
    b = one(d.agg(F.count_if(F.col("deg") == 1).alias("ends"), F.count_if(F.col("deg") > 2).alias("branches")))
    c = one(chains(e).agg(F.countDistinct("component").alias("chains")))
    return a.join(b, "_k").join(c, "_k").drop("_k")


@query("agg55_replay_diagnostics", "obs net", f"WITH {planar_near_sql('nn', 'TRUE', 10)} SELECT o.journey_id, count(*) AS fixes, count(*) FILTER (EXISTS (SELECT 1 FROM nn WHERE nn.journey_id = o.journey_id AND nn.seq = o.seq AND nn.d <= 10)) AS near_fixes FROM obs o GROUP BY 1")
def _(t):
    o = t.obs.select("journey_id", "seq", "x", "y")
    near = planar_near(o, t.net.select("edge_id", "ax", "ay", "bx", "by"), 10.0).groupBy("journey_id").agg(F.countDistinct("seq").alias("near_fixes"))
    return o.groupBy("journey_id").agg(F.count("*").alias("fixes")).join(near, "journey_id", "left").select("journey_id", "fixes", F.coalesce("near_fixes", F.lit(0)).alias("near_fixes"))


@query("jn25_position_audit", "obs net", f"WITH {planar_near_sql('nn', 'TRUE', 30)}, b AS (SELECT journey_id, seq, round(min(d), 6) AS d FROM nn WHERE d <= 30 GROUP BY 1, 2) SELECT journey_id, count(*) AS audited, round(median(d), 4) AS median_m, round(max(d), 4) AS worst_m FROM b GROUP BY 1")
def _(t):
    near = planar_near(t.obs.select("journey_id", "seq", "x", "y"), t.net.select("edge_id", "ax", "ay", "bx", "by"), 30.0)
    b = near.groupBy("journey_id", "seq").agg(F.round(F.min("d"), 6).alias("d"))
    mid = quantiles(b, ["journey_id"], "d", {"m": 0.5}, 1.0)
    return b.groupBy("journey_id").agg(F.count("*").alias("audited"), F.round(F.max("d"), 4).alias("worst_m")).join(mid, "journey_id").select(
        "journey_id", "audited", F.round("m", 4).alias("median_m"), "worst_m")


# --- quality -------------------------------------------------------------

@query("dq01_record_validation", "", "SELECT CASE WHEN reasons = '' THEN 'good' ELSE reasons END AS outcome, count(*) AS records FROM (SELECT concat_ws(',', CASE WHEN o_totalprice < 20000 THEN 'range' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'enum' END, CASE WHEN o_custkey % 50 = 3 THEN 'id' END) AS reasons FROM orders) GROUP BY 1")
def _(t):
    r = F.array_compact(F.array(F.when(F.col("o_totalprice") < 20000, "range"), F.when(~F.col("o_orderstatus").isin("F", "O"), "enum"), F.when(F.col("o_custkey") % 50 == 3, "id")))
    return t.orders.groupBy(F.when(F.size(r) == 0, "good").otherwise(F.array_join(r, ",")).alias("outcome")).agg(F.count("*").alias("records"))


@query("dq02_table_digest", "", "SELECT 'orders' AS name, count(*) AS rows, CAST(sum(('0x' || substr(sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 8))::BIGINT) AS BIGINT) AS digest FROM orders UNION ALL SELECT 'part', count(*), CAST(sum(('0x' || substr(sha256(p_partkey || '|' || p_name), 1, 8))::BIGINT) AS BIGINT) FROM part")
def _(t):
    one = lambda name, cols: t.table(name).agg(F.count("*").alias("rows"), F.sum(text.digest_number(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))).alias("digest")).select(F.lit(name).alias("name"), "rows", "digest")
    return one("orders", ["o_orderkey", "o_custkey", "o_orderstatus"]).unionByName(one("part", ["p_partkey", "p_name"]))


@query("dq03_conflicts", "", "SELECT o_custkey AS key, count(DISTINCT sha256(o_orderstatus)) AS versions FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _(t):
    return t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.countDistinct(F.sha2("o_orderstatus", 256)).alias("versions")).where("versions > 1")


@query("dq04_pinned_hashes", "", "SELECT p_partkey AS source_id, 'mismatch' AS fault FROM part WHERE p_partkey % 9 = 4 UNION ALL SELECT p_partkey, 'unpinned' FROM part WHERE p_partkey % 9 = 5")
def _(t):
    now = t.part.select(F.col("p_partkey").alias("source_id"), F.sha2("p_name", 256).alias("sha"))
    pins = t.part.where("p_partkey % 9 <> 5").select(F.col("p_partkey").alias("source_id"), F.sha2(F.when(F.expr("p_partkey % 9 = 4"), F.lit("old")).otherwise(F.col("p_name")), 256).alias("pin"))
    return now.join(pins, "source_id", "left").select("source_id", F.when(F.col("pin").isNull(), "unpinned").when(F.col("pin") != F.col("sha"), "mismatch").alias("fault")).where("fault IS NOT NULL")


@query("dq05_node_history", "", "WITH v AS (SELECT l_partkey AS node, l_suppkey % 5 AS pos, min(l_orderkey) AS version FROM lineitem GROUP BY 1, 2) SELECT p.p_partkey AS node, v.version, v.version IS NOT NULL AS explained FROM part p LEFT JOIN v ON v.node = p.p_partkey AND v.pos = p.p_partkey % 5")
def _(t):
    v = t.lineitem.groupBy(F.col("l_partkey").alias("node"), F.expr("l_suppkey % 5").alias("pos")).agg(F.min("l_orderkey").alias("version"))
    p = t.part.selectExpr("p_partkey AS node", "p_partkey % 5 AS pos")
    return p.join(v, ["node", "pos"], "left").select("node", "version", F.col("version").isNotNull().alias("explained"))


# Each long line against a shifted copy: stations every 500 m both ways.
CMP = f"""ll AS (SELECT p_partkey AS line_id, -1.0::DOUBLE + ((p_partkey * 37) % 600)::DOUBLE / 1000 AS ax, 51.0::DOUBLE + ((p_partkey * 53) % 400)::DOUBLE / 1000 AS ay, -1.0::DOUBLE + ((p_partkey * 37) % 600)::DOUBLE / 1000 + 0.02 AS cx, 51.0::DOUBLE + ((p_partkey * 53) % 400)::DOUBLE / 1000 + (p_partkey % 5)::DOUBLE / 250 AS cy, (p_partkey % 8)::DOUBLE / 10000 AS sh FROM part),
st AS (SELECT line_id, sh, k, ax + (cx - ax) * k / 10 AS x, ay + (cy - ay) * k / 10 AS y FROM ll, (SELECT unnest(range(0, 11)) AS k)),
pr AS (SELECT s.line_id, s.k, min(sqrt(pow((u.x - s.x) * cos(radians(51.2)), 2) + pow(u.y + u.sh - s.y, 2)) * 111195) AS d FROM st s JOIN st u USING (line_id) GROUP BY 1, 2),
ps AS (SELECT s.line_id, s.k, min(sqrt(pow((u.x - s.x) * cos(radians(51.2)), 2) + pow(u.y - s.y - s.sh, 2)) * 111195) AS d FROM st s JOIN st u USING (line_id) GROUP BY 1, 2)"""


def compared_lines(t):
    ll = t.part.selectExpr("p_partkey AS line_id", "-1.0D + CAST((p_partkey * 37) % 600 AS DOUBLE) / 1000 AS ax", "51.0D + CAST((p_partkey * 53) % 400 AS DOUBLE) / 1000 AS ay",
                           "-1.0D + CAST((p_partkey * 37) % 600 AS DOUBLE) / 1000 + 0.02D AS cx", "51.0D + CAST((p_partkey * 53) % 400 AS DOUBLE) / 1000 + CAST(p_partkey % 5 AS DOUBLE) / 250 AS cy", "CAST(p_partkey % 8 AS DOUBLE) / 10000 AS sh")
    at = lambda dy: F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct((F.col("ax") + (F.col("cx") - F.col("ax")) * k / 10).alias("x"), (F.col("ay") + (F.col("cy") - F.col("ay")) * k / 10 + dy).alias("y")))
    two = ll.select("line_id", at(F.lit(0.0)).alias("p"), at(F.col("sh")).alias("q"))
    k = 0.6266037542  # cos(51.2 degrees)
    gap = lambda a, b: F.transform(F.col(a), lambda s: F.array_min(F.transform(F.col(b), lambda u: F.hypot((u["x"] - s["x"]) * k, u["y"] - s["y"]) * 111195)))
    # Both lines of a pair have a fixed number of stations, so this stays in one row.
    return two.withColumns({"fwd": gap("p", "q"), "back": gap("q", "p")})


@query("geo27_line_metrics", "", f"WITH {CMP} SELECT line_id, round(greatest(max(pr.d), max(ps.d)), 1) AS deviation_m FROM pr JOIN ps USING (line_id, k) GROUP BY 1")
def _(t):
    return compared_lines(t).select("line_id", F.round(F.greatest(F.array_max("fwd"), F.array_max("back")), 1).alias("deviation_m"))


@query("geo28_corridor_fractions", "", f"WITH {CMP} SELECT line_id, round(avg(CASE WHEN pr.d <= 25 THEN 1.0 ELSE 0 END), 6) AS fwd25, round(avg(CASE WHEN ps.d <= 50 THEN 1.0 ELSE 0 END), 6) AS back50 FROM pr JOIN ps USING (line_id, k) GROUP BY 1")
def _(t):
    share = lambda c, r: F.round(F.size(F.filter(F.col(c), lambda d: d <= r)) / F.size(F.col(c)), 6)
    return compared_lines(t).select("line_id", share("fwd", 25).alias("fwd25"), share("back", 50).alias("back50"))


@query("dq06_source_verdict", "", f"WITH {CMP}, m AS (SELECT line_id, greatest(max(pr.d), max(ps.d)) AS dev FROM pr JOIN ps USING (line_id, k) GROUP BY 1) SELECT CASE WHEN dev <= 10 THEN 'same' WHEN dev <= 60 THEN 'drifted' ELSE 'different' END AS verdict, count(*) AS lines FROM m GROUP BY 1")
def _(t):
    dev = F.greatest(F.array_max("fwd"), F.array_max("back"))
    return compared_lines(t).groupBy(F.when(dev <= 10, "same").when(dev <= 60, "drifted").otherwise("different").alias("verdict")).agg(F.count("*").alias("lines"))


@query("dq07_scope_exceptions", "anchors venues", f"SELECT 'source_outside' AS kind, anchor_id AS id FROM anchors a WHERE NOT EXISTS (SELECT 1 FROM venues v WHERE {hav('a.lat', 'a.lng', 'v.lat', 'v.lng')} <= 3000) UNION ALL SELECT 'official_unsourced', venue_id FROM venues v WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE {hav('a.lat', 'a.lng', 'v.lat', 'v.lng')} <= 3000)")
def _(t):
    a = t.anchors.select(F.col("anchor_id").alias("id"), "lat", "lng")
    v = t.venues.select(F.col("venue_id").alias("id"), "lat", "lng")
    out = a.join(near_any(a, as_places(v), 3000.0).select("id"), "id", "left_anti").select(F.lit("source_outside").alias("kind"), "id")
    return out.unionByName(v.join(near_any(v, as_places(a), 3000.0).select("id"), "id", "left_anti").select(F.lit("official_unsourced").alias("kind"), "id"))


@query("dq08_boundary_coverage", "boxes", "SELECT box_id, round(avg(CASE WHEN west + (east - west) * (i + 0.5) / 20 < -0.75 OR south + (north - south) * (j + 0.5) / 20 < 51.25 THEN 1.0 ELSE 0 END), 6) AS covered FROM boxes, (SELECT unnest(range(0, 20)) AS i), (SELECT unnest(range(0, 20)) AS j) GROUP BY 1")
def _(t):
    k = F.sequence(F.lit(0), F.lit(19))
    g = t.boxes.withColumn("i", F.explode(k)).withColumn("j", F.explode(k))
    inside = F.expr("west + (east - west) * (i + 0.5D) / 20 < -0.75D OR south + (north - south) * (j + 0.5D) / 20 < 51.25D")
    return g.groupBy("box_id").agg(F.round(F.avg(F.when(inside, 1.0).otherwise(0.0)), 6).alias("covered"))


@query("dq09_capture_partition", "trace", """WITH n AS (SELECT journey_id, count(*) AS n FROM trace GROUP BY 1), k AS (SELECT journey_id, unnest(range(0, (n - 1) // 20 + 1)) AS k FROM n),
r AS (SELECT journey_id, k * 20 + CASE WHEN journey_id % 9 = 1 AND k = 1 THEN 2 ELSE 0 END AS lo, k * 20 + 20 + CASE WHEN journey_id % 9 = 2 AND k = 0 THEN 3 ELSE 0 END AS hi FROM k),
c AS (SELECT t.journey_id, t.seq, count(r.lo) AS hits FROM trace t LEFT JOIN r ON r.journey_id = t.journey_id AND seq >= lo AND seq < hi GROUP BY ALL) SELECT journey_id, count(*) FILTER (hits = 0) AS unassigned, count(*) FILTER (hits > 1) AS doubled FROM c GROUP BY 1""")
def _(t):
    # Reviewed ranges of 20; some leave a hole of two, some overlap by three.
    n = t.trace.groupBy("journey_id").agg(F.max("seq").alias("last"))
    r = n.withColumn("k", F.explode(F.expr("sequence(0L, last DIV 20)"))).selectExpr(
        "journey_id", "k * 20 + CASE WHEN journey_id % 9 = 1 AND k = 1 THEN 2 ELSE 0 END AS lo", "k * 20 + 20 + CASE WHEN journey_id % 9 = 2 AND k = 0 THEN 3 ELSE 0 END AS hi")
    # Ranges become indices, so the join is an equi-join on (journey, index).
    idx = r.withColumn("seq", F.explode(F.expr("sequence(lo, hi - 1)"))).groupBy("journey_id", "seq").agg(F.count("*").alias("hits"))
    c = t.trace.select("journey_id", "seq").join(idx, ["journey_id", "seq"], "left")
    return c.groupBy("journey_id").agg(F.count_if(F.col("hits").isNull()).alias("unassigned"), F.count_if(F.col("hits") > 1).alias("doubled"))


@query("dq10_edit_remap", "journeys", f"WITH {KEYED}, o AS (SELECT journey_id, seg_key, count(*) AS n FROM keyed WHERE journey_id % 5 = 0 GROUP BY 1, 2), w AS (SELECT journey_id, seg_key, count(*) + CASE WHEN journey_id % 15 = 0 THEN 1 ELSE 0 END AS n FROM keyed WHERE journey_id % 25 <> 0 GROUP BY 1, 2) SELECT o.journey_id, bool_and(coalesce(w.n = o.n, FALSE)) AS remapped, count(*) AS removed FROM o LEFT JOIN w USING (journey_id, seg_key) GROUP BY 1")
def _(t):
    k = keyed_segments(t)
    old = k.where("journey_id % 5 = 0").groupBy("journey_id", "seg_key").agg(F.count("*").alias("n"))
    new = k.where("journey_id % 25 <> 0").groupBy("journey_id", "seg_key").agg((F.count("*") + F.expr("CASE WHEN any_value(journey_id) % 15 = 0 THEN 1 ELSE 0 END")).alias("m"))
    j = old.join(new, ["journey_id", "seg_key"], "left")
    return j.groupBy("journey_id").agg(F.bool_and(F.coalesce(F.col("n") == F.col("m"), F.lit(False))).alias("remapped"), F.count("*").alias("removed"))


@query("dq11_correction_targets", "obs net", f"WITH {planar_near_sql('nn', 'TRUE', 45)} SELECT journey_id, seq, arg_min(edge_id, (round(d, 6), edge_id)) AS remove_edge, count(DISTINCT edge_id) AS within_reach FROM nn WHERE d <= 45 GROUP BY 1, 2")
def _(t):
    # Every position is measured once, however many fixes stand there.
    near = planar_near(t.obs.select("x", "y").distinct(), t.net.select("edge_id", "ax", "ay", "bx", "by"), 45.0)
    target = near.groupBy("x", "y").agg(F.min(F.struct(F.round("d", 6).alias("r"), "edge_id"))["edge_id"].alias("remove_edge"), F.countDistinct("edge_id").alias("within_reach"))
    return t.obs.select("journey_id", "seq", "x", "y").join(target, ["x", "y"]).select("journey_id", "seq", "remove_edge", "within_reach")


@query("dq12_seam_audit", "bindings", "SELECT way_id, piece, 'only_stored' AS side FROM bindings WHERE way_id % 11 = 3 AND piece = 2 UNION ALL SELECT way_id, piece, 'only_derived' FROM bindings WHERE way_id % 13 = 5 AND piece = 0")
def _(t):
    cols = ["way_id", "piece", "low_mm", "high_mm"]
    stored = t.bindings.where("NOT (way_id % 13 = 5 AND piece = 0)").select(cols)
    derived = t.bindings.where("NOT (way_id % 11 = 3 AND piece = 2)").selectExpr("way_id", "piece", "piece * 30000 AS low_mm", "piece * 30000 + 24000 AS high_mm")
    side = lambda a, b, name: a.exceptAll(b).select("way_id", "piece", F.lit(name).alias("side"))
    return side(stored, derived, "only_stored").unionByName(side(derived, stored, "only_derived"))


@query("dq13_stale_builds", "", "SELECT c_custkey AS area_id, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 90 > 45 THEN 'pending' WHEN c_mktsegment = 'BUILDING' THEN 'building' WHEN c_acctbal > 5000 THEN 'ready' ELSE 'pending' END AS status FROM customer")
def _(t):
    age, building = F.col("c_custkey") % 90, F.col("c_mktsegment") == "BUILDING"
    return t.customer.select(F.col("c_custkey").alias("area_id"), F.when(building & (age > 45), "pending").when(building, "building").when(F.col("c_acctbal") > 5000, "ready").otherwise("pending").alias("status"))


@query("dq14_target_proximity", "obs net", f"WITH {planar_near_sql('nn', 'TRUE', 25)} SELECT journey_id, label, count(DISTINCT seq) AS fixes FROM nn JOIN net USING (edge_id) WHERE d <= 25 AND label IN ('Brand#1', 'Brand#7') GROUP BY 1, 2")
def _(t):
    target = t.net.where(F.col("label").isin("Brand#1", "Brand#7"))
    near = planar_near(t.obs.select("journey_id", "seq", "x", "y"), target.select("edge_id", "label", "ax", "ay", "bx", "by"), 25.0)
    return near.groupBy("journey_id", "label").agg(F.countDistinct("seq").alias("fixes"))


@query("dq15_bundle_gate", "bindings", "SELECT route_id, count(*) = count(DISTINCT way_id * 10 + piece) AS distinct_ids, bool_and(low_mm >= 0 AND high_mm <= 90000) AS inside, bool_and(end_mm > start_mm) AND bool_and(way_id % 1000 <> 3) AS admitted FROM bindings GROUP BY 1")
def _(t):
    b = t.bindings
    ids = b.groupBy("route_id", "way_id", "piece").agg(F.count("*").alias("n"), F.bool_and(F.expr("low_mm >= 0 AND high_mm <= 90000")).alias("inside"), F.bool_and(F.expr("end_mm > start_mm AND way_id % 1000 <> 3")).alias("ok"))
    return ids.groupBy("route_id").agg(F.bool_and(F.col("n") == 1).alias("distinct_ids"), F.bool_and("inside").alias("inside"), F.bool_and("ok").alias("admitted"))


@query("udf01_rule_receipts", "journeys", "SELECT CASE WHEN points > 45 THEN 'TOO_LARGE' WHEN NOT matched THEN 'EVIDENCE_UNAVAILABLE' WHEN status = 'P' THEN 'REVIEW_REQUIRED' WHEN mode = 'train' THEN 'SAFE_CANDIDATE' ELSE 'UNCHANGED' END AS outcome, count(*) AS journeys FROM journeys GROUP BY 1")
def _(t):
    from ..operators.rules import Rule, apply_rule
    rule = Rule(3, lambda df: df.withColumn("outcome", F.when(F.col("points") > 45, "TOO_LARGE").when(~F.col("matched"), "EVIDENCE_UNAVAILABLE").when(F.col("status") == "P", "REVIEW_REQUIRED").when(F.col("mode") == "train", "SAFE_CANDIDATE").otherwise("UNCHANGED")))
    done = apply_rule(rule, t.journeys, None, ["journey_id"], ["mode", "points", "matched", "status"])
    return done.groupBy("outcome").agg(F.count("*").alias("journeys"))
