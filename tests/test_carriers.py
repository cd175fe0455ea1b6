"""Carrier lines and chained as-of joins against plain loops."""

import random
from math import atan, cos, degrees, exp, pi, sin

import pytest

from waymeld.operators.carriers import collinear_coverage
from waymeld.operators.chained import asof_chain

R = 6378137
ENDS = "ax double, ay double, bx double, by double"


def lnglat(x, y):
    return degrees(x / R), degrees(2 * atan(exp(y / R)) - pi / 2)


def turned(scene, angle):
    turn = lambda x, y: lnglat(x * cos(angle) - y * sin(angle) - 50_000, x * sin(angle) + y * cos(angle) + 6_600_000)
    return [(*turn(a, b), *turn(c, d)) for a, b, c, d in scene]


@pytest.mark.parametrize("angle", [0.0, 0.4, 1.57, 2.3])
def test_length_does_not_depend_on_the_bearing(spark, angle):
    # 0-100 and 60-160 back, again, a gap of 0.3 m bridged, a gap of 5 m kept; a line 20 m beside; one across.
    scene = [(0, 0.2, 100, 0.2), (160, 0.2, 60, 0.2), (0, 0.2, 100, 0.2), (160.3, 0.2, 200, 0.2), (205, 0.2, 210, 0.2), (0, 20.2, 50, 20.2), (30.2, -40, 30.2, 40)]
    got = collinear_coverage(spark.createDataFrame(turned(scene, angle), ENDS)).collect()
    lat = lnglat(0, 6_600_000)[1]
    assert sorted((r["hi_mm"] - r["lo_mm"]) / 1000 for r in got) == pytest.approx([5, 50, 80, 200], abs=0.01)
    assert sum(r["length_m"] for r in got) == pytest.approx(335 * cos(lat * pi / 180), rel=1e-4)


def test_rows_without_a_carrier(spark):
    rows = [(None, 51.0, 0.0, 51.0), (0.0, float("nan"), 0.0, 51.0), (0.0, 86.0, 1.0, 86.0), (1.0, 51.0, 1.0, 51.0), (0.0, 51.0, float("inf"), 51.0)]
    assert collinear_coverage(spark.createDataFrame(rows, ENDS)).count() == 0
    assert collinear_coverage(spark.createDataFrame([], ENDS)).count() == 0


def plain_chain(route, evidence):
    got, prev = {}, {}
    for k, s, p in sorted((r for r in route if None not in r), key=lambda r: r[:2]):
        later = [t for q, w, t in evidence if q == k and w == p and t is not None and (k not in prev or t > prev[k])]
        got[k, s] = min(later, default=None)
        prev[k] = min(later, default=prev.get(k, -1))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_equals_the_sequential_scan(spark, seed):
    rng = random.Random(seed)
    # A place visited for long, shared places, equal times, places without evidence, and a key without any.
    route = [(1, i, rng.choice("aaab")) for i in range(60)] + [(2, i, rng.choice("abcdef")) for i in range(80)] + [(3, 0, "a"), (4, 0, None), (2, 100, "a")]
    evidence = [(1, rng.choice("ab"), rng.randrange(0, 9_000_000, 100_000)) for _ in range(90)] + [(2, rng.choice("abcde"), i * 60_000 + rng.randrange(5) * 30_000) for i in range(90)]
    evidence += evidence[:10] + [(2, None, 5), (2, "a", None)]
    got = asof_chain(spark.createDataFrame(route, "k long, s long, p string"), spark.createDataFrame(evidence, "k long, p string, t long"), ["k"], "p", "s", "t").collect()
    want = plain_chain(route, evidence)
    assert len(got) == len(route) and {(r["k"], r["s"]): r["picked_at"] for r in got} == want | {(4, 0): None}


def test_chain_of_empty_tables(spark):
    route, evidence = spark.createDataFrame([(1, 0, "a")], "k long, s long, p string"), spark.createDataFrame([], "k long, p string, t long")
    assert [r["picked_at"] for r in asof_chain(route, evidence, ["k"], "p", "s", "t").collect()] == [None]
    assert asof_chain(route.limit(0), evidence, ["k"], "p", "s", "t").count() == 0


def test_short_keys_of_a_chain_take_no_rounds(spark, monkeypatch):
    from waymeld.operators import chained
    rng = random.Random(3)
    route = [(k, i, rng.choice("abc")) for k in (1, 2) for i in range(30 * k)]
    evidence = [(k, rng.choice("abc"), i * 60_000 + rng.randrange(5) * 45_000) for k in (1, 2) for i in range(30 * k)]
    sides, want = (spark.createDataFrame(route, "k long, s long, p string"), spark.createDataFrame(evidence, "k long, p string, t long")), plain_chain(route, evidence)
    picks = lambda **kw: {(r["k"], r["s"]): r["picked_at"] for r in asof_chain(*sides, ["k"], "p", "s", "t", **kw).collect()}
    # Key 2 is too long for one task, key 1 is not.
    assert picks(most=80) == want
    monkeypatch.setattr(chained, "_by_rounds", None)
    assert picks() == want
