"""Jump pointers, first-fit selection and simplification against plain loops."""

import random
from math import cos, hypot, radians

import pytest

from waymeld.functions.geo import haversine_m
from waymeld.operators import ledgers
from waymeld.operators import traces as T
from waymeld.operators.lines import simplify


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sessions_compare_with_the_retained_start(spark):
    rng = random.Random(4)
    rows = [(k, s) for k in (1, 2, 3) for s in sorted(rng.sample(range(0, 30_000 if k == 1 else 900), 300))] + [(4, 7)]
    want = []
    for k in (1, 2, 3, 4):
        opened, number = None, 0
        for s in sorted(s for q, s in rows if q == k):
            if opened is None or s - opened > 45:
                opened, number = s, number + 1
            want.append((k, s, number))
    df = spark.createDataFrame(rows, "k long, s long")
    assert rows_of(T.visit_sessions(df, "k", "s", 45, chunk=100), "k", "s", "session") == sorted(want)
    assert T.visit_sessions(df.limit(0), "k", "s", 45).count() == 0


def test_thinning_equals_loop(spark):
    rng = random.Random(8)
    pts = []
    for k in (1, 2):
        lat, lng = 51.0, -1.0
        for i in range(400):
            stride = 0.0 if rng.random() < 0.2 else rng.choice([2e-5, 6e-5, 3e-4])
            lat, lng = lat + rng.uniform(-1, 1) * stride, lng + rng.uniform(-1, 1) * stride
            pts.append((k, i, lat, lng))
    pts.append((3, 0, 51.0, -1.0))
    df = spark.createDataFrame(pts, "journey_id long, seq long, lat double, lng double")
    pairs = [(a, b) for a, b in zip(pts, pts[1:]) if a[0] == b[0]]
    lengths = spark.createDataFrame([(b[0], b[1], a[2], a[3], b[2], b[3]) for a, b in pairs], "k long, seq long, a double, o double, lat double, lng double")
    step = {(r["k"], r["seq"]): r["d"] for r in lengths.select("k", "seq", haversine_m("a", "o", "lat", "lng", 6_371_008.8).alias("d")).collect()}
    want = []
    for k in (1, 2, 3):
        line, run = [p for p in pts if p[0] == k], 0.0
        for n, p in enumerate(line):
            ends, turns = n in (0, len(line) - 1), False
            if not ends:
                f = cos(radians(p[2]))
                u, v = ((p[3] - line[n - 1][3]) * f, p[2] - line[n - 1][2]), ((line[n + 1][3] - p[3]) * f, line[n + 1][2] - p[2])
                nu, nv = hypot(*u), hypot(*v)
                turns = nu > 2e-5 and nv > 2e-5 and 1 - (u[0] * v[0] + u[1] * v[1]) / (nu * nv) > 0.35
            run += step.get((k, n), 0.0)
            if ends or run >= 25 or (run >= 8 and turns):
                want.append((k, n))
                run = 0.0
    assert rows_of(T.thin_trace(df), "journey_id", "seq") == sorted(want)


def first_fit(points, radius):
    kept = []
    for k, i, x, y in sorted(points):
        if not any(q == k and hypot(x - a, y - b) <= radius for q, _, a, b in kept):
            kept.append((k, i, x, y))
    return sorted((k, i) for k, i, _, _ in kept)


@pytest.mark.parametrize("shape", ["random", "line", "there and back", "one place"])
def test_first_fit_equals_loop(spark, shape):
    rng = random.Random(3)
    at = {"random": lambda i: (rng.uniform(0, 700), rng.uniform(0, 700)), "line": lambda i: (i * 25.0, 3.0),
          "there and back": lambda i: (min(i, 400 - i) * 25.0, 0.0 if i < 200 else 40.0), "one place": lambda i: (5.0, 5.0)}[shape]
    points = [(i % 2, i * 7, *at(i)) for i in range(400)]
    df = spark.createDataFrame(points + [(0, 1, float("nan"), 0.0), (0, 2, None, 0.0), (0, 3, float("inf"), 0.0)], "r long, i long, x double, y double")
    assert rows_of(ledgers.greedy_keep(df, ["r"], "i", "x", "y", 95.0, block=150), "r", "i") == first_fit(points, 95.0)


def test_first_fit_of_a_long_line_takes_one_round(spark, monkeypatch):
    calls = []
    real = ledgers.cut_lineage
    monkeypatch.setattr(ledgers, "cut_lineage", lambda df: calls.append(1) or real(df))
    df = spark.range(4000).selectExpr("0L AS r", "id AS i", "id * 25.0D AS x", "0.0D AS y")
    assert ledgers.greedy_keep(df, ["r"], "i", "x", "y", 95.0).count() == 1000
    assert len(calls) == 3
    assert ledgers.greedy_keep(df.limit(0), ["r"], "i", "x", "y", 95.0).count() == 0


def split_line(points, tolerance, long_m, most, scale):
    """Plain recursion over (lat, lng)."""
    def plane(p, a, k):
        return (p[1] - a[1]) * k * scale, (p[0] - a[0]) * scale

    def part(a, z):
        k = cos(radians((points[a][0] + points[z][0]) / 2))
        dx, dy = plane(points[z], points[a], k)
        worst, at = tolerance, None
        for i in range(a + 1, z):
            px, py = plane(points[i], points[a], k)
            n = dx * dx + dy * dy
            t = max(0.0, min(1.0, (px * dx + py * dy) / n)) if n else 0.0
            off = hypot(px - t * dx, py - t * dy)
            if off > worst:
                worst, at = off, i
        if at is None and z - a > 1 and (hypot(dx, dy) > long_m or (most and z - a > most)):
            at = (a + z) // 2
        return set() if at is None else part(a, at) | {at} | part(at, z)

    return sorted({0, len(points) - 1} | part(0, len(points) - 1))


@pytest.mark.parametrize("rule", [(5.0, 100.0, None), (3.0, 60.0, 8), (1e9, 1e9, None)])
def test_simplified_lines_equal_recursion(spark, rule):
    rng = random.Random(6)
    lines = {1: [(51.0 + i * 2e-5 + rng.uniform(-4e-5, 4e-5), -1.0 + i * 6e-5) for i in range(200)], 2: [(51.0, -1.0 + i * 1e-4) for i in range(60)],
             3: [(51.0, -1.0)] * 20, 4: [(51.0, -1.0)], 5: [(51.0, -1.0), (51.1, -1.0)]}
    rows = [(k, 10 + 3 * i, *p) for k, line in lines.items() for i, p in enumerate(line)]
    df = spark.createDataFrame(rows + [(2, 11, None, -1.0), (5, 11, float("nan"), -1.0)], "k long, seq long, lat double, lng double")
    want = [(k, 10 + 3 * i) for k, line in lines.items() for i in split_line(line, *rule, 111_320.0)]
    assert rows_of(simplify(df, ["k"], *rule), "k", "seq") == sorted(want)


@pytest.mark.parametrize("rule", [(5.0, 100.0, None), (3.0, 60.0, 8)])
def test_only_long_spans_take_rounds(spark, monkeypatch, rule):
    from waymeld.operators import lines as module
    rng = random.Random(7)
    lines = {1: [(51.0 + rng.uniform(-9e-5, 9e-5), -1.0 + i * 6e-5) for i in range(150)], 2: [(51.0 + rng.uniform(-9e-5, 9e-5), -1.0 + i * 6e-5) for i in range(25)], 3: [(51.0, -1.0)] * 40}
    df = spark.createDataFrame([(k, i, *p) for k, line in lines.items() for i, p in enumerate(line)], "k long, seq long, lat double, lng double")
    want = sorted((k, i) for k, line in lines.items() for i in split_line(line, *rule, 111_320.0))
    rounds, real = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda rows: rounds.append(1) or real(rows))
    assert rows_of(simplify(df, ["k"], *rule, most=30), "k", "seq") == want
    assert len(rounds) > 2
    rounds.clear()
    assert rows_of(simplify(df, ["k"], *rule), "k", "seq") == want
    assert len(rounds) == 1


def test_short_keys_are_followed_in_order(spark, monkeypatch):
    from waymeld.operators import jumps as module
    rng = random.Random(8)
    big = 2 ** 53 + 1
    rows = [(k, big + i, big + i + rng.randrange(1, 5) if i < n - 5 else None, i == 0 or rng.random() < 0.03) for k, n in ((1, 40), (2, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, s long, f long, h boolean")
    want, due = [], set()
    for k, s, f, h in rows:
        if h or (k, s) in due:
            want.append((k, s))
            due.add((k, f))
    assert rows_of(module.reached(df, ["k"], "s", "f", "h", most=60), "k", "s") == want
    monkeypatch.setattr(module, "_by_rounds", None)
    assert rows_of(module.reached(df, ["k"], "s", "f", "h"), "k", "s") == want
