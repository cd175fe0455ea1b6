"""Readers: files become documents (one text value a row), documents become tables.

Every parser takes a DataFrame with a `value` column, so the same code reads
files, tables of stored responses, and streams. Schemas are narrow and fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import valid_point
from ..functions.modes import normalise_mode
from ..functions.text import parse_location

POINT_LIST = "array<struct<point:string,time:string,durationMinutesOffsetFromStartTime:string>>"
TIMELINE = f"""struct<semanticSegments:array<struct<startTime:string,endTime:string,
 activity:struct<distanceMeters:double,start:string,`end`:string,topCandidate:struct<type:string>>,
 visit:struct<topCandidate:struct<placeId:string,placeLocation:string>>,
 timelinePath:{POINT_LIST}>>,
 timelineObjects:array<struct<activitySegment:struct<activityType:string,distance:double,
  duration:struct<startTimestamp:string,endTimestamp:string>,
  startLocation:struct<latitudeE7:long,longitudeE7:long>,endLocation:struct<latitudeE7:long,longitudeE7:long>,
  waypointPath:struct<waypoints:array<struct<latE7:long,lngE7:long>>>>,
  placeVisit:struct<location:struct<latitudeE7:long,longitudeE7:long,placeId:string>,
   duration:struct<startTimestamp:string,endTimestamp:string>>>>>"""
EXPORT = """struct<format:string,schema_version:int,export_complete:boolean,journey:struct<journey_id:string,mode:string,
 raw_capture_samples:array<array<double>>>>"""
MATCH = """struct<code:string,tracepoints:array<struct<matchings_index:int,waypoint_index:int,location:array<double>>>,
 matchings:array<struct<distance:double,confidence:double,legs:array<struct<distance:double,duration:double,
  steps:array<struct<ref:string,name:string,distance:double,geometry:struct<type:string,coordinates:array<array<double>>>>>>>>>>"""
OSM = """struct<elements:array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>>"""
FEATURES = """struct<type:string,features:array<struct<properties:map<string,string>,
 geometry:struct<type:string,coordinates:string>>>>"""
ROAD_FILE = """struct<version:int,id:string,region:string,ref:string,total_km:double,
 anchors:array<array<double>>,paths:array<array<array<double>>>>"""


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file. Exports are many and small; the reader splits by file."""
    return spark.read.text(path, wholetext=True)


def _parsed(docs: DataFrame, schema: str) -> DataFrame:
    keep = [c for c in docs.columns if c != "value"]
    return docs.select(*keep, F.from_json("value", schema.replace("\n", "")).alias("d"))


def _time(c) -> F.Column:
    return F.unix_millis(F.try_to_timestamp(c))


def timeline_activities(docs: DataFrame) -> DataFrame:
    """Activities of both export layouts: start, end, mode, distance, end points."""
    keep = [c for c in docs.columns if c != "value"]
    d = _parsed(docs, TIMELINE)
    new = d.select(*keep, F.explode("d.semanticSegments").alias("s")).where("s.activity IS NOT NULL")
    new = new.select(*keep, _time("s.startTime").alias("start_ms"), _time("s.endTime").alias("end_ms"),
                     normalise_mode("s.activity.topCandidate.type").alias("mode"), F.col("s.activity.distanceMeters").alias("distance_m"),
                     parse_location(F.col("s.activity.start")).alias("a"), parse_location(F.col("s.activity.end")).alias("b"))
    old = d.select(*keep, F.explode("d.timelineObjects.activitySegment").alias("s")).where("s IS NOT NULL")
    e7 = lambda c: F.when(F.col(f"s.{c}.latitudeE7").isNotNull(), F.struct((F.col(f"s.{c}.latitudeE7") / 1e7).alias("lat"), (F.col(f"s.{c}.longitudeE7") / 1e7).alias("lng")))
    old = old.select(*keep, _time("s.duration.startTimestamp").alias("start_ms"), _time("s.duration.endTimestamp").alias("end_ms"),
                     normalise_mode("s.activityType").alias("mode"), F.col("s.distance").alias("distance_m"), e7("startLocation").alias("a"), e7("endLocation").alias("b"))
    both = new.unionByName(old).where("start_ms IS NOT NULL AND end_ms >= start_ms")
    return both.select(*keep, "start_ms", "end_ms", "mode", "distance_m", F.col("a.lat").alias("lat0"), F.col("a.lng").alias("lng0"),
                       F.col("b.lat").alias("lat1"), F.col("b.lng").alias("lng1"))


def timeline_points(docs: DataFrame) -> DataFrame:
    """Path points with their time, and legacy waypoints (no time) in order."""
    keep = [c for c in docs.columns if c != "value"]
    d = _parsed(docs, TIMELINE)
    new = d.select(*keep, F.posexplode("d.semanticSegments").alias("seg", "s")).select(*keep, "seg", F.col("s.startTime").alias("t0"), F.posexplode("s.timelinePath").alias("i", "p"))
    offset = F.coalesce(F.col("p.durationMinutesOffsetFromStartTime").try_cast("long") * 60_000, F.lit(0))
    new = new.select(*keep, "seg", "i", F.coalesce(_time("p.time"), _time("t0") + offset).alias("t_ms"), parse_location(F.col("p.point")).alias("l"))
    old = d.select(*keep, F.posexplode("d.timelineObjects").alias("seg", "o")).select(*keep, "seg", F.posexplode("o.activitySegment.waypointPath.waypoints").alias("i", "p"))
    old = old.select(*keep, "seg", "i", F.lit(None).cast("long").alias("t_ms"), F.struct((F.col("p.latE7") / 1e7).alias("lat"), (F.col("p.lngE7") / 1e7).alias("lng")).alias("l"))
    return new.unionByName(old).select(*keep, "seg", "i", "t_ms", F.col("l.lat").alias("lat"), F.col("l.lng").alias("lng")).where(valid_point("lat", "lng"))


def timeline_visits(docs: DataFrame) -> DataFrame:
    keep = [c for c in docs.columns if c != "value"]
    d = _parsed(docs, TIMELINE)
    new = d.select(*keep, F.explode("d.semanticSegments").alias("s")).where("s.visit IS NOT NULL").select(
        *keep, _time("s.startTime").alias("start_ms"), _time("s.endTime").alias("end_ms"), F.col("s.visit.topCandidate.placeId").alias("place_id"), parse_location(F.col("s.visit.topCandidate.placeLocation")).alias("l"))
    old = d.select(*keep, F.explode("d.timelineObjects.placeVisit").alias("s")).where("s IS NOT NULL").select(
        *keep, _time("s.duration.startTimestamp").alias("start_ms"), _time("s.duration.endTimestamp").alias("end_ms"), F.col("s.location.placeId").alias("place_id"),
        F.struct((F.col("s.location.latitudeE7") / 1e7).alias("lat"), (F.col("s.location.longitudeE7") / 1e7).alias("lng")).alias("l"))
    return new.unionByName(old).select(*keep, "start_ms", "end_ms", "place_id", F.col("l.lat").alias("lat"), F.col("l.lng").alias("lng"))


def diagnostics_exports(docs: DataFrame, expected_format: str) -> tuple[DataFrame, DataFrame]:
    """(fixes, rejected): complete exports of the right format, one per journey.

    A journey exported twice with different raw samples is refused as a conflict.
    """
    d = _parsed(docs, EXPORT).select("d.*").withColumn("id", F.col("journey.journey_id"))
    sha = F.sha2(F.to_json("journey.raw_capture_samples"), 256)
    reason = (F.when(F.col("format").isNull() | (F.col("format") != expected_format), "wrong_format")
              .when(~F.coalesce("export_complete", F.lit(False)), "incomplete").when(F.col("id").isNull(), "no_journey"))
    tagged = d.withColumns({"reason": reason, "sha": sha})
    good = tagged.where("reason IS NULL")
    # Each hash keeps one copy; two hashes for one journey are a conflict.
    one = good.groupBy("id", "sha").agg(F.any_value("journey").alias("journey"))
    clash = one.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    fixes = one.join(clash, "id", "left_anti").select(
        F.col("id").alias("journey_id"), F.col("journey.mode").alias("mode"), F.posexplode("journey.raw_capture_samples").alias("seq", "s"))
    at = lambda i: F.get(F.col("s"), F.lit(i))
    rows = fixes.select("journey_id", "mode", "seq", at(0).alias("lng"), at(1).alias("lat"), at(2).alias("accuracy_m"), at(3).cast("long").alias("t_ms"), at(4).alias("speed_mps"))
    bad = tagged.where("reason IS NOT NULL").select("id", "reason").unionByName(clash.select("id", F.lit("conflict").alias("reason")))
    return rows, bad


def match_legs(docs: DataFrame) -> DataFrame:
    """Legs of stored router responses with the observation indices they join.

    A matching counts only when its waypoints number exactly 0..legs.
    """
    keep = [c for c in docs.columns if c != "value"]
    d = _parsed(docs, MATCH)
    points = d.select(*keep, F.posexplode("d.tracepoints").alias("point", "p")).where("p IS NOT NULL").select(
        *keep, "point", F.col("p.matchings_index").alias("matching"), F.col("p.waypoint_index").alias("waypoint"))
    matchings = d.select(*keep, F.posexplode("d.matchings").alias("matching", "m")).select(*keep, "matching", F.col("m.confidence").alias("confidence"), F.col("m.legs").alias("legs"))
    ok = points.groupBy(*keep, "matching").agg(F.count("*").alias("n"), F.countDistinct("waypoint").alias("u"), F.min("waypoint").alias("lo"), F.max("waypoint").alias("hi"))
    sized = matchings.join(ok, [*keep, "matching"]).where("n = size(legs) + 1 AND u = n AND lo = 0 AND hi = size(legs)")
    legs = sized.select(*keep, "matching", "confidence", F.posexplode("legs").alias("leg", "l")).select(
        *keep, "matching", "confidence", "leg", F.col("l.distance").alias("distance_m"), F.col("l.steps").alias("steps")).where("distance_m >= 0")
    at = points.select(*keep, "matching", F.col("waypoint").alias("leg"), F.col("point").alias("start_point"))
    to = points.select(*keep, "matching", (F.col("waypoint") - 1).alias("leg"), F.col("point").alias("end_point"))
    return legs.join(at, [*keep, "matching", "leg"]).join(to, [*keep, "matching", "leg"])


def osm_ways(docs: DataFrame) -> DataFrame:
    keep = [c for c in docs.columns if c != "value"]
    e = _parsed(docs, OSM).select(*keep, F.explode("d.elements").alias("e")).where("e.type = 'way' AND size(e.geometry) >= 2")
    return e.select(*keep, F.col("e.id").alias("way_id"), F.col("e.tags").alias("tags"),
                    F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("line"))


def geojson_features(docs: DataFrame) -> DataFrame:
    """Features of collections; a line holding one feature is accepted as well."""
    keep = [c for c in docs.columns if c != "value"]
    wrapped = docs.withColumn("value", F.when(F.get_json_object("value", "$.features").isNull(), F.concat(F.lit('{"features":['), "value", F.lit("]}"))).otherwise(F.col("value")))
    f = _parsed(wrapped, FEATURES).select(*keep, F.explode("d.features").alias("f"))
    at, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    # Both polygon kinds become parts of rings of points; the other kinds have none.
    parts = (F.when(kind == "Polygon", F.array(F.from_json(at, "array<array<array<double>>>")))
             .when(kind == "MultiPolygon", F.from_json(at, "array<array<array<array<double>>>>")))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return f.select(*keep, F.col("f.properties").alias("properties"), kind.alias("geometry_type"),
                    F.when(kind == "LineString", F.from_json(at, "array<array<double>>")).alias("line"),
                    F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, point))).alias("polygons"))


def road_references(docs: DataFrame) -> DataFrame:
    """Anchors of both reference layouts: (road_id, region, ref, component, pos, lng, lat)."""
    d = _parsed(docs, ROAD_FILE).select("d.*")
    part = F.coalesce(F.when(F.col("paths").isNotNull(), F.flatten("paths")), F.col("anchors"))
    rows = d.select(F.col("id").alias("road_id"), "region", "ref", "total_km", F.posexplode(part).alias("pos", "p"))
    at = lambda i: F.get(F.col("p"), F.lit(i))
    return rows.select("road_id", "region", "ref", "total_km", "pos", at(0).alias("lng"), at(1).alias("lat"), at(2).cast("int").alias("component"))


def stations_csv(spark: SparkSession, path: str, least: int = 2_000) -> DataFrame:
    """Valid stations; a file with too few of them is refused."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', schema="code string, name string, lat double, lng double, radius double")
    good = raw.where(F.col("code").isNotNull() & (F.trim("name") != "") & valid_point("lat", "lng") & (F.col("radius") > 0))
    found = good.count()
    if found < least:
        raise ValueError(f"too few stations: {found}")
    return good


def movement_log(lines: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """JSON events of a mixed text log within a time range; other lines are skipped."""
    keep = [c for c in lines.columns if c != "value"]
    e = lines.where(F.col("value").startswith("{")).select(*keep, F.from_json("value", "struct<timestamp_utc:string,activity:string,transition:string>").alias("e"))
    t = e.select(*keep, _time("e.timestamp_utc").alias("t_ms"), "e.activity", "e.transition")
    return t.where(F.col("t_ms").between(from_ms, to_ms))


def page_gaps(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Completeness proof of a paged source: ids missing, unexpected or repeated.

    `pages` holds page, truncated, ids (array). An empty result is the proof.
    """
    got = pages.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    j = expected.select("id").join(got.withColumnRenamed("id", "gid"), F.col("id") == F.col("gid"), "full_outer")
    faults = j.select(F.coalesce("id", "gid").alias("id"), F.when(F.col("gid").isNull(), "missing").when(F.col("id").isNull(), "unexpected").when(F.col("n") > 1, "repeated").alias("fault")).where("fault IS NOT NULL")
    cut = pages.where("truncated").select(F.col("page").alias("id"), F.lit("truncated").alias("fault"))
    return faults.unionByName(cut)


SUMMARY = "struct<journey_id:string,mode:string,started_at:string,ended_at:string,distance_meters:double,processing:struct<status:string>>"


def journey_summaries(docs: DataFrame) -> DataFrame:
    """Summary fields of archived journeys; route geometry is never materialised. Journey ids are text, also where the archive holds numbers."""
    d = _parsed(docs, SUMMARY).select("d.*")
    return d.select("journey_id", "mode", _time("started_at").alias("start_ms"), _time("ended_at").alias("end_ms"), "distance_meters", F.col("processing.status").alias("status"))


def usable_ways(ways: DataFrame) -> DataFrame:
    """Input contract of an extract's ways: id, tags, line of two distinct points or more."""
    missing = {"way_id", "tags", "line"} - set(ways.columns)
    if missing:
        raise ValueError(f"ways lack {sorted(missing)}")
    moved = F.exists("line", lambda p: (p["x"] != F.col("line")[0]["x"]) | (p["y"] != F.col("line")[0]["y"]))
    return ways.where((F.size("line") >= 2) & moved)


def text_sequence(lines: DataFrame) -> DataFrame:
    """GeoJSON text sequence: one feature a line, optional record separator."""
    return geojson_features(lines.withColumn("value", F.regexp_replace("value", "^\u001e", "")))


def station_lines(lines: DataFrame) -> DataFrame:
    """Stations from CSV lines (quoted fields allowed); invalid rows drop out."""
    row = F.from_csv("value", "code string, name string, lat double, lng double, radius double", {"quote": '"', "escape": '"'})
    s = lines.select(row.alias("s")).select("s.*")
    return s.where(F.col("code").isNotNull() & (F.trim("name") != "") & valid_point("lat", "lng") & (F.col("radius") > 0))


def catalogue_lines(lines: DataFrame, most_bytes: int = 4096) -> DataFrame:
    """Catalogue rows with `reason` (null when good): bad JSON, oversize or bad fields."""
    d = lines.select("value", F.from_json("value", "struct<id:string,lat:double,lon:double,designer:string>").alias("d"))
    reason = (F.when(F.octet_length("value") > most_bytes, "too_large")
              .when(F.col("d.id").isNull(), "not_a_record")
              .when(~F.col("d.id").rlike("^[a-z0-9-]{3,40}$"), "bad_id")
              .when(~valid_point("d.lat", "d.lon"), "bad_position"))
    return d.select("d.*", reason.alias("reason"))
