"""Files in, files out."""

import json
import tempfile
from pathlib import Path

import pytest

from waymeld.functions import text
from waymeld.operators.components import connected_components
from waymeld.sources import readers as R
from waymeld.sources import sinks as S


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_timeline_files_of_both_layouts(spark):
    d = Path(folder())
    (d / "a.json").write_text(json.dumps({"semanticSegments": [
        {"startTime": "2024-01-01T10:00:00Z", "endTime": "2024-01-01T10:30:00Z",
         "activity": {"distanceMeters": 1200, "start": "51.5°, -0.1°", "end": "geo:51.6,-0.2", "topCandidate": {"type": "WALKING"}}},
        {"startTime": "bad", "endTime": "bad", "activity": {"start": "?", "end": "?", "topCandidate": {"type": "X"}}}]}, indent=1))
    (d / "b.json").write_text(json.dumps({"timelineObjects": [{"activitySegment": {
        "activityType": "IN_BUS", "distance": 9, "duration": {"startTimestamp": "2020-01-01T00:00:00Z", "endTimestamp": "2020-01-01T00:01:00Z"},
        "startLocation": {"latitudeE7": 515000000, "longitudeE7": -1000000}, "endLocation": {"latitudeE7": 516000000, "longitudeE7": -2000000}}}]}))
    rows = {r.mode: r for r in R.timeline_activities(R.documents(spark, str(d))).collect()}
    assert set(rows) == {"walking", "bus"}
    assert (rows["walking"].lat0, rows["walking"].lng1, rows["bus"].lat1) == (51.5, -0.2, 51.6)


def test_conflicting_exports_are_refused(spark):
    def doc(v, fmt="f", done=True):
        return (json.dumps({"format": fmt, "schema_version": 1, "export_complete": done, "journey": {"journey_id": "j", "mode": "walking", "raw_capture_samples": [[-1, 51, 5, 1000, v]]}}),)
    fixes, bad = R.diagnostics_exports(spark.createDataFrame([doc(1), doc(1)], "value string"), "f")
    assert fixes.count() == 1 and bad.count() == 0
    fixes, bad = R.diagnostics_exports(spark.createDataFrame([doc(1), doc(2), doc(1, "g"), doc(1, done=False)], "value string"), "f")
    assert fixes.count() == 0 and sorted(r.reason for r in bad.collect()) == ["conflict", "incomplete", "wrong_format"]


def test_station_file_with_too_few_rows_is_refused(spark):
    d = Path(folder()) / "s.csv"
    d.write_text('code,name,lat,lng,radius\nAB,"Here, There",51.5,-0.1,300\nCD,Bad,x,1,1\n')
    assert R.stations_csv(spark, str(d), least=1).first()["name"] == "Here, There"
    with pytest.raises(ValueError):
        R.stations_csv(spark, str(d), least=2)


def test_keyed_files_and_manifest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long")
    out = folder()
    m = {r.k: r for r in S.write_keyed(df, "k", out).collect()}
    back = spark.read.json(f"{out}/data")
    assert back.count() == 3 and m["a"].rows == 2
    again = {r.k: r.digest for r in S.manifest(df.repartition(3), "k").collect()}
    assert again == {k: r.digest for k, r in m.items()}


def test_additive_release_reports_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    release, changed = S.additive_release(old, new, "k")
    assert sorted(map(tuple, release.collect())) == [(1, "a"), (2, "b"), (3, "c")] and [r.k for r in changed.collect()] == [2]


def test_area_loads_collect_failures(spark):
    def load(area):
        if area == "x":
            raise RuntimeError("no page")
    done, failed = S.load_areas(spark, ["w", "x", "y"], load)
    assert done == ["w", "y"] and failed.first()["message"] == "no page"


def test_long_chain_settles(spark):
    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = {r.node: r.component for r in connected_components(edges, spark.createDataFrame([(5000,)], "n long")).collect()}
    assert set(got[i] for i in range(401)) == {0} and got[1001] == 1000 and got[5000] == 5000


def test_reference_spellings(spark):
    df = spark.createDataFrame([("A1(M); a 2/M6 toll,B7",)], "r string")
    r = df.select(text.motorway_refs("r").alias("m"), text.a_road_refs("r").alias("a")).first()
    assert r.m == ["A1(M)", "M6 Toll"] and r.a == ["A2"]
    n = spark.createDataFrame([("The Café & Bar's",)], "n string").select(text.fold_name("n").alias("v")).first()
    assert n.v == "cafe and bars"


def test_every_sql_twin_names_a_query():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())


def test_journey_ids_are_text(spark):
    from waymeld.operators.matching import match_journeys
    from waymeld.sources import readers
    docs = spark.createDataFrame([('{"journey_id":"ride-7f3","mode":"cycling","distance_meters":12.5}',), ('{"journey_id":41}',)], "value string")
    assert sorted(r["journey_id"] for r in readers.journey_summaries(docs).collect()) == ["41", "ride-7f3"]
    edges = spark.createDataFrame([(1, 1, 2, 0.0, 0.0, 100.0, 0.0)], "edge_id long, a_node long, b_node long, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([("ride-7f3", 0, 5.0, 1.0, 5.0), ("ride-7f3", 1, 60.0, 1.0, 5.0)], "journey_id string, seq long, x double, y double, accuracy_m double")
    assert [(r["journey_id"], r["edge_id"]) for r in match_journeys(points, edges).collect()] == [("ride-7f3", 1)] * 2
