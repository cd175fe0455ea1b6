"""Grid joins against full scans, and geometry against known values."""

import random
from math import asin, cos, radians, sin, sqrt

from pyspark.sql import functions as F

from waymeld.functions import geo
from waymeld.operators.gridjoin import near_any, nearest_within, within_radius


def hav(a, o, b, p, r=6_371_000.0):
    x, y = radians(a), radians(b)
    h = sin((y - x) / 2) ** 2 + cos(x) * cos(y) * sin(radians(p - o) / 2) ** 2
    return 2 * r * asin(sqrt(min(1, h)))


def test_grid_nearest_equals_full_scan_at_any_latitude(spark):
    rng = random.Random(11)
    for base in (0.0, 51.0, 68.0, -75.0):
        pts = [(i, base + rng.uniform(0, 0.2), rng.uniform(-0.2, 0.2)) for i in range(150)]
        refs = [(i, base + rng.uniform(0, 0.2), rng.uniform(-0.2, 0.2)) for i in range(150)]
        p = spark.createDataFrame(pts, "i long, lat double, lng double")
        q = spark.createDataFrame(refs, "j long, p_lat double, p_lng double")
        got = {(r.i, r.j) for r in within_radius(p, q, 1500.0).collect()}
        want = {(i, j) for i, a, o in pts for j, b, w in refs if hav(a, o, b, w) <= 1500.0}
        assert got == want
        best = nearest_within(p, q, 1500.0, "j")
        got = {(round(r.lat, 9), round(r.lng, 9)): r.j for r in best.collect()}
        for i, a, o in pts:
            near = [(hav(a, o, b, w), j) for j, b, w in refs if hav(a, o, b, w) <= 1500.0]
            assert got.get((round(a, 9), round(o, 9))) == (min(near)[1] if near else None)
        assert {r.i for r in near_any(p, q, 1500.0).collect()} == {i for i, _ in want}


def test_tie_keeps_lowest_id(spark):
    p = spark.createDataFrame([(51.0, -1.0)], "lat double, lng double")
    q = spark.createDataFrame([(9, 51.001, -1.0), (3, 51.001, -1.0)], "j long, p_lat double, p_lng double")
    assert nearest_within(p, q, 500.0, "j").first()["j"] == 3


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_published_grid_point(spark):
    p = one(spark, geo.british_grid_to_wgs84(F.lit(651409.903), F.lit(313177.270)))
    assert abs(p["lat"] - 52.657977) < 2e-6 and abs(p["lng"] - 1.716052) < 2e-5


def test_geodesic_gap_against_dense_oracle(spark):
    # Oracle: 3-D chord on the WGS84 ellipsoid to 20 000 points of the segment.
    def ecef(lat, lng):
        a, e2 = 6378137.0, 0.0066943799901413165
        s = sin(radians(lat))
        n = a / sqrt(1 - e2 * s * s)
        return (n * cos(radians(lat)) * cos(radians(lng)), n * cos(radians(lat)) * sin(radians(lng)), n * (1 - e2) * s)
    lat, lng = 52.3, -1.2
    for da, do, db, dp in ((0.0008, 0.0003, -0.0004, 0.0013), (0.0005, -0.0005, 0.0005, 0.0012)):
        got = one(spark, geo.geodesic_to_segment_m(F.lit(lng), F.lit(lat), F.lit(lng + do), F.lit(lat + da), F.lit(lng + dp), F.lit(lat + db)))
        c = ecef(lat, lng)
        want = min(sqrt(sum((x - y) ** 2 for x, y in zip(c, ecef(lat + da + (db - da) * k / 20000, lng + do + (dp - do) * k / 20000)))) for k in range(20001))
        assert abs(got - want) < 0.005


def test_polygon_with_hole_and_touching_segment(spark):
    ring = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    rings = F.array(ring([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), ring([(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]))
    at = lambda x, y: one(spark, geo.in_polygon(F.lit(float(x)), F.lit(float(y)), rings))
    assert at(1, 1) and not at(5, 5) and not at(11, 5)
    assert one(spark, geo.polygon_area(rings)) == 96.0
    share = one(spark, geo.inside_share(F.lit(-5.0), F.lit(5.0), F.lit(15.0), F.lit(5.0), rings))
    assert abs(share - 0.4) < 1e-9
    assert one(spark, geo.inside_share(F.lit(-5.0), F.lit(10.5), F.lit(15.0), F.lit(10.5), rings)) == 0.0


def paired(monkeypatch, module):
    """Rows of both sides of every radius join from now on."""
    sides, real = [], module.within_radius

    def watched(points, places, *rest, **kw):
        sides.append((points.count(), places.count()))
        return real(points, places, *rest, **kw)
    monkeypatch.setattr(module, "within_radius", watched)
    return sides


def test_equal_positions_are_paired_once(spark, monkeypatch):
    from waymeld.operators import joins
    sides = paired(monkeypatch, joins)
    points = spark.range(300).selectExpr("id AS event_id", "51.0D AS lat", "-1.0D AS lng")
    places = spark.range(200).selectExpr("id + 7 AS station_id", "51.001D AS p_lat", "-1.0D AS p_lng", "100 + (id % 2) * 100 AS radius_m")
    got = joins.nearest_own_radius(points, places, 300.0, "event_id", "station_id")
    assert sides == [(1, 2)]
    assert got.count() == 300 and got.select("station_id", "distance_m").distinct().collect() == [(8, 111.194927)]


def test_venues_at_one_position_are_crossed_once(spark, monkeypatch, tmp_path):
    from waymeld.operators import gridjoin
    from waymeld.plans.catalogue import QUERIES
    SF = "/root/testdata/sf0.01"
    sides = paired(monkeypatch, gridjoin)
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    s = spark.read.parquet(f"{SF}/supplier.parquet")
    s.unionByName(s.withColumn("s_suppkey", s.s_suppkey + 410 * 610)).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.venue_id: (r.journeys, r.completed_ms) for r in QUERIES["agg33_crossings_with_dates"](spark, str(tmp_path)).collect()}
    assert sides[0][1] == s.count()
    want = {r.venue_id: (r.journeys, r.completed_ms) for r in QUERIES["agg33_crossings_with_dates"](spark, SF).collect()}
    assert got == want | {v + 410 * 610: r for v, r in want.items()}


def test_dated_markers_of_shared_positions(spark, monkeypatch):
    from waymeld.operators import joins as J
    rng = random.Random(11)
    spots, places = [(51.0 + i * 0.004, -1.0 + (i % 3) * 0.005) for i in range(9)], [(51.0 + rng.random() * 0.04, -1.0 + rng.random() * 0.02) for _ in range(12)]
    points = [(i, i % 60, rng.randrange(100), *rng.choice(spots)) for i in range(200)]
    # Several markers at a place, of the same and of other dates.
    markers = [(j, j % 4, f, f + rng.choice([3, 20]), *rng.choice(places)) for j in range(60) for f in [rng.choice([0, 30, 60])]]
    df = spark.createDataFrame(points, "event_id long, user_id long, t_ms long, lat double, lng double")
    m = spark.createDataFrame(markers, "marker_id long, designer long, valid_from long, valid_until long, p_lat double, p_lng double")
    facts = {}
    for _, user, at, lat, lng in points:
        for j, kind, f, u, a, o in markers:
            if f <= at <= u and hav(lat, lng, a, o) <= 1000:
                facts[user, j] = min(at, facts.get((user, j), at))
    want_kinds, want_seven = {}, {}
    for (user, j), at in facts.items():
        want_kinds[user, j % 4] = min(at, want_kinds.get((user, j % 4), at))
    for user in {u for u, _ in facts}:
        times = sorted(at for (u, _), at in facts.items() if u == user)
        if len(times) >= 7:
            want_seven[user] = times[6]
    sides, real = [], J.within_radius
    monkeypatch.setattr(J, "within_radius", lambda left, *a, **kw: sides.append(left) or real(left, *a, **kw))
    kinds, seven = J.first_markers(df, m, 1000.0, "user_id", "t_ms", "marker_id", "designer", 7)
    assert {(r["user_id"], r["designer"]): r["t_ms"] for r in kinds.collect()} == want_kinds
    assert {r["user_id"]: r["t_ms"] for r in seven.collect()} == want_seven and 0 < len(want_seven) < len({u for u, _ in want_kinds})
    # Pairs form once a position, not once a point.
    assert sides[0].count() == len(spots)


def test_owners_near_places_that_repeat(spark, monkeypatch):
    from waymeld.operators import joins as J
    segments = spark.createDataFrame([(j, s, -1.0 + s * 0.01, 51.0, -1.0 + s * 0.01 + 0.01, 51.0) for j in range(4) for s in range(j + 1)], "journey_id long, seq long, ax double, ay double, cx double, cy double")
    # Two places of three ids each, the second near the later legs only; one place twice with other radii.
    places = spark.createDataFrame([(i, -1.0 + (i % 2) * 0.035, 51.003, 500.0) for i in range(6)] + [(6, -1.0, 51.003, 100.0), (7, -1.0, 51.003, 600.0)], "venue_id long, p_lng double, p_lat double, radius_m double")
    sides, real = [], J.segments_near
    monkeypatch.setattr(J, "segments_near", lambda a, p, *x, **kw: sides.append(p) or real(a, p, *x, **kw))
    got = {r["venue_id"]: r["n"] for r in J.owners_near(segments, places, ["journey_id", "seq"], "journey_id", "venue_id", 700.0).collect()}
    assert got == {0: 4, 2: 4, 4: 4, 7: 4, 1: 2, 3: 2, 5: 2}
    assert sides[0].count() == 4
