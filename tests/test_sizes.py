"""Sizes that the planner must not guess."""

import re

from waymeld.operators.ledgers import similar_shapes, trip_shapes
from waymeld.operators.matching import MatchPolicy, edge_candidates
from waymeld.plans.catalogue import QUERIES
from waymeld.plans.views import Tables
from waymeld.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_cell_copies_are_not_broadcast_by_file_size(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    session.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    (session.range(200_000).selectExpr("id AS edge_id", "id * 60.0D AS ax", "0.0D AS ay", "id * 60.0D + 60 AS bx", "0.0D AS by")
     .write.parquet(f"{tmp_path}/streets.parquet"))
    (session.range(100_000).selectExpr("id AS journey_id", "id AS seq", "id * 70.0D AS x", "5.0D AS y").write.parquet(f"{tmp_path}/seen.parquet"))
    t = Tables(session, str(tmp_path))
    near = edge_candidates(t.seen, t.streets, MatchPolicy(radius_m=60.0, candidates=8, cell_m=60.0))
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
    assert session.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10m"
    assert near.where("journey_id = 6").selectExpr("min(edge_id)", "min(gap)").first() == (6, 5.0)


def test_size_estimates_stay_true_over_rounds(spark):
    steps = spark.range(1000).selectExpr("id", "id + 1 AS next")
    for _ in range(6):
        ahead = steps.selectExpr("id AS next", "next AS far")
        steps = cut_lineage(steps.join(ahead, "next", "left").selectExpr("id", "coalesce(far, next) AS next"))
    assert int(steps._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10_000_000
    assert steps.where("id = 3").first()["next"] == 67


def test_similar_shapes_copy_few_stations(spark):
    # Two routes of ten customers each way; the first station of a route is far from the border of its cell.
    route = "transform(sequence(0, 64), i -> named_struct('x', {u} * 1000D + 200 + i * 40, 'y', 200D + {j}))"
    trips = spark.range(40).selectExpr("id AS trip_id", "'walking' AS mode", "3000D + id % 4 AS length_m", "35D AS cap_m", route.format(u="(id div 4)", j="(id % 2) * 20") + " AS stations")
    pairs = similar_shapes(trip_shapes(trips)[0], trips)
    assert pairs.count() == 10 * 6
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "explode([-1,0,1])" not in plan.replace(" ", "")
    assert plan.count("Generate explode(sequence(") == 2


def test_similar_shapes_by_the_cap_of_the_smaller_id(spark):
    line = lambda y: [(i * 40.0, y) for i in range(65)]
    rows = [(1, "walking", 3000.0, 35.0, line(390.0)), (2, "walking", 3001.0, 10.0, line(420.0)), (3, "walking", 3000.0, 35.0, line(450.0)), (4, "walking", 5000.0, 35.0, line(390.0)),
            (5, "train", 3000.0, 35.0, line(390.0)), (6, "walking", 3002.0, 35.0, line(390.0)), (7, "walking", 3003.0, 35.0, [*line(390.0)[:64], (None, 390.0)])]
    trips = spark.createDataFrame(rows, "trip_id long, mode string, length_m double, cap_m double, stations array<struct<x:double,y:double>>")
    pairs = similar_shapes(trip_shapes(trips)[0], trips)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 6)]


def test_correction_targets_measure_a_position_once(spark, tables):
    found = QUERIES["dq11_correction_targets"](spark, SF)
    assert re.search(r"Aggregate \[x#\w+, y#\w+\]", found._jdf.queryExecution().analyzed().toString())
    seen = {(r["journey_id"], r["seq"]): (r["remove_edge"], r["within_reach"]) for r in found.collect()}
    by_place = {}
    for o in tables.obs.collect():
        if (o["journey_id"], o["seq"]) in seen:
            by_place.setdefault((o["x"], o["y"]), set()).add(seen[o["journey_id"], o["seq"]])
    assert seen and all(len(v) == 1 for v in by_place.values())


def test_membership_change_joins_its_features_once(spark):
    plan = QUERIES["set06_membership_change"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") > 0 and plan.count("Join") == 2
