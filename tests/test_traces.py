"""Sequential operators against plain loops; skew-safe windows against plain windows."""

import random
from itertools import product
from math import hypot

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymeld.operators import machines as M, matching as G, traces as T
from waymeld.operators.ordered import dense_seq, islands, neighbours, running
from waymeld.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_chunked_windows_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, rng.randint(0, 9)]), rng.random() < 0.2) for k in (1, 2) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, seq long, v long, s boolean")
    w = Window.partitionBy("k").orderBy("seq")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    plain = df.select("*", F.lag("v", 2).over(w).alias("a"), F.lead("v", 1).over(w).alias("b"), F.coalesce(F.sum("v").over(up), F.lit(0)).alias("c"),
                      F.last("v", True).over(up).alias("d"), F.first("v", True).over(down).alias("e"), F.sum(F.col("s").cast("int")).over(up).alias("f"))
    got = neighbours(df, ["k"], "seq", {"a": ("v", -2), "b": ("v", 1)}, size=8)
    chunk = F.floor(F.col("seq") / 8)
    got = running(got, ["k"], chunk, ["seq"], {"c": ("sum", "v"), "d": ("last", "v")})
    got = running(got, ["k"], chunk, ["seq"], {"e": ("next", "v")}, exclusive=True)
    got = islands(got, ["k"], chunk, ["seq"], F.col("s"), "f")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    cols = ["k", "seq", "a", "b", "c", "d", "e", "f"]
    assert sorted(map(key, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(key, (tuple(r[c] for c in cols) for r in plain.collect())))
    numbered = dense_seq(df.drop("seq").withColumn("o", F.monotonically_increasing_id()), ["k"], ["o"], F.floor(F.col("o") / 7), "n")
    assert rows_of(numbered.groupBy("k").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.countDistinct("n").alias("c")), "k", "a", "b", "c") == [(1, 0, 100, 101), (2, 0, 100, 101)]


def walk(n, seed=1):
    rng = random.Random(seed)
    lat, lng, out = 51.0, -1.0, []
    for i in range(n):
        lat, lng = lat + rng.uniform(-4e-5, 2e-4), lng + rng.uniform(-5e-5, 2e-4)
        out.append((1, i, lat, lng))
    return out


def test_redundant_points_equal_loop(spark):
    pts = walk(300)
    kept, want = None, []
    for i, (_, s, lat, lng) in enumerate(pts):
        ends = i in (0, len(pts) - 1)
        if not ends and M.metres(*kept, lat, lng, 6_371_008.8) <= 15 and M.off_chord(lat, lng, kept, pts[i + 1][2:]) <= 5:
            continue
        kept = (lat, lng)
        want.append(s)
    df = spark.createDataFrame(pts, "journey_id long, seq long, lat double, lng double")
    assert [s for _, s in rows_of(T.drop_redundant(df), "journey_id", "seq")] == want


def test_clean_foot_path_drops_the_spike():
    rows = [(1000 * (i + 1), 51.0 + i * 1e-5, -1.0, 5.0, 1.2) for i in range(9)]
    rows[4] = (rows[4][0], 51.01, -1.0, 40.0, 1.2)
    kept = M.clean_foot_path(rows)
    assert 4 not in kept and kept[0] == 0 and kept[-1] == 8
    assert M.clean_foot_path([(0, 51.0, -1.0, 5.0, 0.0)] * 3) == [0, 1, 2]  # untimed: untouched


def test_stop_needs_four_fixes_and_three_minutes():
    def run(times):
        m = M.Stops(None)
        out = [x for t in times for x in m.row("j", t, 51.0, -1.0, 5.0, 0.0, 7)]
        return out + m.end()
    assert run([1_000, 61_000, 121_000, 182_000]) == [("j", 7, 1_000, 182_000, 5.0)]
    assert run([1_000, 61_000, 121_000]) == []
    assert run([1_000, 61_000, 152_000, 183_000]) == []  # a 91 s gap starts again


def test_size_guard_lists_what_it_sets_aside(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "journey_id long, seq long")
    assert rows_of(T.size_guard(df, ["journey_id"], 4), "journey_id", "decision") == [(1, "review"), (2, "process")]


def grid_network():
    import pandas as pd
    rows, n = [], 0
    for r in range(3):
        for c in range(3):
            if c < 2:
                rows.append((n, r * 10 + c, r * 10 + c + 1, c * 60.0, r * 60.0, c * 60.0 + 60, r * 60.0)); n += 1
            if r < 2:
                rows.append((n, r * 10 + c, r * 10 + 10 + c, c * 60.0, r * 60.0, c * 60.0, r * 60.0 + 60)); n += 1
    return pd.DataFrame(rows, columns=["edge_id", "a_node", "b_node", "ax", "ay", "bx", "by"])


def test_matching_equals_exhaustive_search():
    graph = G.Graph(grid_network())
    pts = [(0, 5.0, 4.0, 5.0), (1, 55.0, -3.0, 5.0), (2, 64.0, 40.0, 5.0), (3, 66.0, 80.0, 5.0)]

    def candidates(p):
        out = []
        for e, (a, b, length) in graph.edges.items():
            (ax, ay), (bx, by) = graph.at[a], graph.at[b]
            t = max(0, min(1, ((p[1] - ax) * (bx - ax) + (p[2] - ay) * (by - ay)) / length ** 2))
            out.append((e, t, hypot(p[1] - ax - t * (bx - ax), p[2] - ay - t * (by - ay))))
        return sorted(out, key=lambda c: (c[2], c[0]))[:3]

    layers = [candidates(p) for p in pts]

    def cost(choice):
        total = sum((max(0.0, c[2] - 5) / 5) ** 2 for c in choice)
        for k in range(1, len(pts)):
            s, e = pts[k - 1][1:3], pts[k][1:3]
            limit = max(120.0, hypot(e[0] - s[0], e[1] - s[1]) * 4 + 60)
            found = graph.path(choice[k - 1], choice[k], graph.reach(choice[k - 1], limit), limit)
            if found is None:
                return float("inf")
            route = [graph.place(choice[k - 1]), *(graph.at[n] for n in found[1]), graph.place(choice[k])]
            total += G.transition_cost(s, e, route, found[0], 5.0, 20.0)
        return total

    best = min(cost(c) for c in product(*layers))
    assert abs(cost(G.best_sequence(pts, layers, graph)) - best) < 1e-9


def test_matching_goes_on_behind_a_fix_without_candidates(spark):
    grid = spark.createDataFrame(grid_network())
    big = 2 ** 53 + 1
    grid = grid.withColumn("edge_id", grid.edge_id + big)
    fixes = [(1, 0, 5.0, 4.0, 5.0), (1, 1, 55.0, -3.0, 5.0), (1, 2, 30.0, -5000.0, 5.0), (1, 3, 64.0, 40.0, 5.0), (1, 4, 66.0, 80.0, 5.0), (1, 5, -100.0, 0.0, 5.0)]
    points = spark.createDataFrame(fixes, "journey_id long, seq long, x double, y double, accuracy_m double")
    got = {r["seq"]: r for r in G.match_journeys(points, grid).collect()}
    assert {k: r["status"] for k, r in got.items()} == {k: "no_candidates" if k == 2 else "matched" for k in range(6)}
    assert got[2]["edge_id"] is None and got[2]["frac"] is None
    ids = {r["edge_id"] for r in grid.collect()}
    assert all(got[k]["edge_id"] in ids for k in got if k != 2)


def test_queries_without_sql_give_rows(spark):
    for name in ("win12_clean_foot_trace", "win13_simplify_walking", "gra05_map_matching", "geo04_british_grid", "st02_trip_starts"):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_inputs_are_not_edited(spark, tables):
    before = rows_of(tables.trace.select("journey_id", "seq", "t_ms"), "journey_id", "seq", "t_ms")
    kept = rows_of(T.thin_trace(tables.trace), "journey_id", "seq")
    assert set(kept) <= {r[:2] for r in before}


def test_motion_window_needs_a_sustained_walk():
    walk_m, stand = M.MotionWindow(), M.MotionWindow()
    moving = [walk_m.row("j", i, 1_000 + i * 10_000, 51.0 + i * 1.3e-4, -1.0, 5.0, 1.4)[0][2] for i in range(7)]
    still = [stand.row("j", i, 1_000 + i * 10_000, 51.0 + (i % 2) * 1e-5, -1.0, 5.0, 0.0)[0][2] for i in range(7)]
    assert moving[-1] and not moving[1] and not any(still)


def test_stillness_ends_a_trip_after_five_minutes():
    m = M.Stillness()
    out = [x for t in range(0, 331_000, 30_000) for x in m.row("j", 1_000 + t, 51.0, -1.0, 8.0, 0.0)]
    assert out == [("j", 1_000, 301_000)]
    moved = M.Stillness()
    assert not [x for t in range(0, 331_000, 30_000) for x in moved.row("j", 1_000 + t, 51.0 + t * 1e-8, -1.0, 8.0, 1.5)]


def test_station_dwell_then_rail_departure():
    m, events = M.StationDwell(), []
    for t in range(0, 100_000, 20_000):
        events += m.row("j", 1_000 + t, 51.0, -1.0, 5.0, 0.0, 4, True)
    for k, t in enumerate(range(100_000, 180_000, 20_000)):
        events += m.row("j", 1_000 + t, 51.0 + (k + 1) * 2e-3, -1.0, 5.0, 12.0, None, True)
    assert [e[2] for e in events] == ["arrival", "dwell", "rail_departure"]


def test_few_candidates_search_the_network(monkeypatch):
    graph = G.Graph(grid_network())
    pts = [(k, 5.0 + 30 * k, 3.0 - k % 2, 5.0) for k in range(5)]
    near = lambda p: sorted(((e, max(0, min(1, ((p[1] - graph.at[a][0]) * (graph.at[b][0] - graph.at[a][0]) + (p[2] - graph.at[a][1]) * (graph.at[b][1] - graph.at[a][1])) / n ** 2))) for e, (a, b, n) in graph.edges.items()),
                            key=lambda c: (hypot(p[1] - graph.place(c)[0], p[2] - graph.place(c)[1]), c[0]))
    layers = [[(*c, hypot(p[1] - graph.place(c)[0], p[2] - graph.place(c)[1])) for c in near(p)] for p in pts]
    searches, real = [], G.Graph.reach
    monkeypatch.setattr(G.Graph, "reach", lambda self, *a: searches.append(a) or real(self, *a))
    chosen = G.best_sequence(pts, layers, graph)
    assert all(c[2] < 8.0 for c in chosen)
    # Not one search for each candidate of each fix.
    assert len(searches) < sum(map(len, layers[:-1])) / 2
