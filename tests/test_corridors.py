"""Corridor shares and edge correspondence against plain loops."""

import random
from collections import defaultdict
from math import ceil, hypot

import pytest

from waymeld.operators.corridors import corridor_shares, edge_correspondence

SEG = "id long, ax double, ay double, bx double, by double"


def away(p, s):
    ax, ay, bx, by = s
    n = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / n)) if n else 0.0
    return hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))


@pytest.mark.parametrize("own", [False, True])
def test_shares_equal_loop(spark, own):
    rng = random.Random(9)
    line = lambda: (rng.uniform(0, 300), rng.uniform(0, 300))
    source = [(i % 4, *line(), *line()) for i in range(20)] + [(9, 5.0, 5.0, 5.0, 5.0)]
    source += source[:3]
    target = [(i % 4, *line(), *line()) for i in range(12)] + [(1, 50.0, 50.0, 50.0, 50.0)]
    want = defaultdict(lambda: [0.0] * 4)
    for k, ax, ay, bx, by in source:
        length = hypot(bx - ax, by - ay)
        for i in range(ceil(length / 7)):
            f = (i + 0.5) / ceil(length / 7)
            d = min((away((ax + (bx - ax) * f, ay + (by - ay) * f), s[1:]) for s in target if not own or s[0] == k), default=1e9)
            for c, r in enumerate((1e8, 3, 10, 25)):
                want[k][c] += length / ceil(length / 7) * (d <= r or c == 0)
    got = corridor_shares(spark.createDataFrame(source, SEG), spark.createDataFrame(target, SEG), ["id"], spacing=7.0, on=["id"] if own else None).collect()
    assert {r["id"] for r in got} == set(want)
    for r in got:
        w = want[r["id"]]
        assert r["length_m"] == pytest.approx(w[0], abs=1e-3)
        assert [r["share_3"], r["share_10"], r["share_25"]] == pytest.approx([x / w[0] for x in w[1:]], abs=2e-6)
    none = corridor_shares(spark.createDataFrame(source, SEG), spark.createDataFrame([], SEG), ["id"]).collect()
    assert len(none) == 4 and all(r["share_25"] == 0 for r in none)


def rows(spark, source, target):
    got = edge_correspondence(spark.createDataFrame(source, SEG), spark.createDataFrame(target, SEG.replace("id", "other")), "id", "other").collect()
    return sorted((r["id"], r["from_m"], r["to_m"], r["rivals"], r["other"], r["tgt_from_m"], r["tgt_to_m"]) for r in got)


def test_offsets_on_a_split_and_reversed_target(spark):
    got = rows(spark, [(1, 0.0, 3.0, 100.0, 3.0)], [(7, 0.0, 0.0, 40.0, 0.0), (8, 90.0, 0.0, 40.0, 0.0), (9, 50.0, -50.0, 50.0, 50.0)])
    assert got == [(1, 0.0, 40.0, 1, 7, 0.0, 40.0), (1, 40.0, 90.0, 1, 8, 50.0, 0.0), (1, 90.0, 100.0, 0, None, None, None)]


def test_two_rivals_leave_a_piece_unbound(spark):
    got = rows(spark, [(1, 0.0, 0.0, 100.0, 0.0), (2, 0.0, 500.0, 10.0, 500.0), (3, 5.0, 5.0, 5.0, 5.0)], [(7, 0.0, 4.0, 60.0, 4.0), (8, 30.0, -4.0, 100.0, -4.0)])
    assert got == [(1, 0.0, 30.0, 1, 7, 0.0, 30.0), (1, 30.0, 60.0, 2, None, None, None), (1, 60.0, 100.0, 1, 8, 30.0, 70.0), (2, 0.0, 10.0, 0, None, None, None)]


def test_pieces_cover_every_source_once(spark):
    rng = random.Random(1)
    near = [(i, rng.uniform(0, 200), rng.uniform(0, 20), rng.uniform(0, 200), rng.uniform(0, 20)) for i in range(30)]
    got = rows(spark, near, [(100 + i, a + 2, b + 3, c + 5, d - 2) for i, a, b, c, d in near])
    for i, ax, ay, bx, by in near:
        mine = [r for r in got if r[0] == i]
        assert mine[0][1] == 0 and mine[-1][2] == pytest.approx(hypot(bx - ax, by - ay), abs=1e-3)
        assert all(a[2] == b[1] for a, b in zip(mine, mine[1:]))
    assert edge_correspondence(spark.createDataFrame([], SEG), spark.createDataFrame([], SEG.replace("id", "other")), "id", "other").count() == 0


def test_travel_is_ordered_once_for_both_ways(tables):
    from waymeld.plans.corridors import both_ways
    for side in both_ways(tables):
        assert "Window" not in side._jdf.queryExecution().optimizedPlan().toString()
