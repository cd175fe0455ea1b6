"""Interval unions against plain loops, and the coverage invariants."""

import random

from pyspark.sql import functions as F

from waymeld.operators import coverage as cov
from waymeld.operators.intervals import interval_union, missing_intervals, overlap_join, points_in_intervals

MILE = 1_609_344


def plain_union(rows):
    out = []
    for lo, hi in sorted(rows):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return sorted(map(tuple, out))


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_union_equals_loop_for_any_chunk_width(spark):
    rng = random.Random(7)
    rows = [(k, lo, lo + rng.randint(1, 400)) for k in (1, 2) for lo in (rng.randint(0, 20_000) for _ in range(300))]
    df = spark.createDataFrame(rows, "k long, lo long, hi long")
    want = sorted((k, *p) for k in (1, 2) for p in plain_union([(a, b) for q, a, b in rows if q == k]))
    for width in (1, 50, 1000, 1 << 20):
        assert rows_of(interval_union(df, ["k"], width=width), "k", "lo", "hi") == want


def test_long_interval_swallows_later_chunks(spark):
    df = spark.createDataFrame([("e", 0, 1000), ("e", 150, 160), ("e", 990, 1100), ("e", 1100, 1101), ("e", 1103, 1104)], "k string, lo long, hi long")
    assert rows_of(interval_union(df, ["k"], width=100), "lo", "hi") == [(0, 1101), (1103, 1104)]


def test_repeats_and_direction_never_raise_coverage(spark):
    base = spark.createDataFrame([("e", "j1", 0, MILE), ("e", "j1", 8 * MILE, 9 * MILE)], "edge_id string, journey_id string, lo long, hi long")
    edges = spark.createDataFrame([("e", 9 * MILE)], "edge_id string, length_mm long")
    twice = base.unionByName(base.withColumn("journey_id", F.lit("j2")))
    for spans in (base, twice, twice.repartition(7)):
        assert cov.ledger_by_edge(spans, edges).first()["unique_mm"] == 2 * MILE
    gap = missing_intervals(interval_union(base, ["edge_id"]), edges, "edge_id", "length_mm")
    assert rows_of(gap, "gap_lo", "gap_hi") == [(MILE, 8 * MILE)]
    filled = base.unionByName(spark.createDataFrame([("e", "j3", MILE, 3 * MILE)], base.schema))
    gap = missing_intervals(interval_union(filled, ["edge_id"]), edges, "edge_id", "length_mm")
    assert rows_of(gap, "gap_lo", "gap_hi") == [(3 * MILE, 8 * MILE)]


def test_untouched_edge_is_one_gap(spark):
    none = spark.createDataFrame([], "edge_id string, lo long, hi long")
    edges = spark.createDataFrame([("e", 10)], "edge_id string, length_mm long")
    assert rows_of(missing_intervals(none, edges, "edge_id", "length_mm"), "gap_lo", "gap_hi") == [(0, 10)]


def test_removal_equals_rebuild(spark, tables):
    spans = tables.spans.select("edge_id", "journey_id", F.col("start_mm").alias("lo"), F.col("end_mm").alias("hi"))
    gone = spans.where("journey_id % 3 = 0").select("journey_id")
    empty = spans.limit(0)
    after = cov.replace_journeys(spans, empty, empty, gone)
    rebuilt = spans.where("journey_id % 3 <> 0")
    assert rows_of(interval_union(after, ["edge_id"]), "edge_id", "lo", "hi") == rows_of(interval_union(rebuilt, ["edge_id"]), "edge_id", "lo", "hi")


def test_hot_key_is_spread_and_exact(spark):
    # One key holds all rows; with narrow chunks no task sees more than one chunk of starts.
    df = spark.range(20_000).selectExpr("1 AS k", "id * 3 AS lo", "id * 3 + CASE WHEN id % 5 = 0 THEN 10 ELSE 2 END AS hi")
    got = interval_union(df, ["k"], width=512).agg(F.sum(F.expr("hi - lo")).alias("s"), F.count("*").alias("n")).first()
    want = plain_union([(i * 3, i * 3 + (10 if i % 5 == 0 else 2)) for i in range(20_000)])
    assert (got["s"], got["n"]) == (sum(b - a for a, b in want), len(want))


def test_overlap_and_point_joins_equal_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.randint(0, 900), 0) for i in range(60)]
    a = [(i, lo, lo + rng.randint(1, 200)) for i, lo, _ in a]
    b = [(i, lo + 7, hi - 3) for i, lo, hi in a if hi - lo > 20]
    x = spark.createDataFrame([(1, *r) for r in a], "k long, i long, lo long, hi long")
    y = spark.createDataFrame([(1, *r) for r in b], "k long, m long, s long, e long")
    want = sorted((i, j) for i, lo, hi in a for j, s, e in b if min(hi, e) > max(lo, s))
    assert rows_of(overlap_join(x, y, ["k"], ("lo", "hi"), ("s", "e"), 64), "i", "m") == want
    p = spark.createDataFrame([(1, t) for t in range(0, 1000, 13)], "k long, t long")
    want = sorted((t, i) for t in range(0, 1000, 13) for i, lo, hi in a if lo <= t <= hi)
    assert rows_of(points_in_intervals(p, x, ["k"], "t", "lo", "hi", 50), "t", "i") == want


def test_union_reads_its_source_once(spark):
    # Unions that follow each other must not multiply the plan, which the driver holds.
    df = spark.createDataFrame([("e", 0, 1000), ("e", 150, 160), ("e", 2000, 2100)], "k string, lo long, hi long")
    once = interval_union(interval_union(df, ["k"], width=100), ["k"], width=70)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert rows_of(once, "lo", "hi") == [(0, 1000), (2000, 2100)]


def test_union_of_float_ends_with_a_gap_allowed(spark):
    rng = random.Random(5)
    rows = [(round(a, 2), round(a + rng.random() * 9, 2)) for a in (rng.random() * 3000 for _ in range(400))]
    want = []
    for a, b in sorted(rows):
        if want and a <= want[-1][1] + 0.75:
            want[-1] = (want[-1][0], max(want[-1][1], b))
        else:
            want.append((a, b))
    df = spark.createDataFrame([(1, a, b) for a, b in rows], "k long, lo double, hi double")
    for width in (0.3, 7.1, 1024.0):
        assert rows_of(interval_union(df, ["k"], eps=0.75, width=width), "lo", "hi") == want
