"""Corridor shares, scope exceptions and edge correspondence over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.corridors import corridor_shares, edge_correspondence
from ..operators.ordered import neighbours
from ..session import written
from .registry import query


def fraction_sql(px, py, ax, ay, bx, by):
    return f"((({px}) - {ax}) * ({bx} - {ax}) + (({py}) - {ay}) * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))"


def away_sql(px, py, ax, ay, bx, by):
    f = f"greatest(0, least(1, {fraction_sql(px, py, ax, ay, bx, by)}))"
    return f"round(sqrt(pow(({px}) - {ax} - {f} * ({bx} - {ax}), 2) + pow(({py}) - {ay} - {f} * ({by} - {ay}), 2)), 6)"


TRAVEL_SQL = """travel AS (SELECT * FROM (SELECT journey_id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS "by" FROM trace WINDOW w AS (PARTITION BY journey_id ORDER BY seq)) WHERE bx IS NOT NULL AND (ax <> bx OR ay <> "by"))"""


def travel(t):
    p = neighbours(t.trace, ["journey_id"], "seq", {"bx": ("x", 1), "by": ("y", 1)}).where("bx IS NOT NULL")
    return p.select("journey_id", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by").where("ax <> bx OR ay <> by")


def shares_sql(name, source, key, target):
    """Shares of `source` within 3, 10 and 25 m of `target`, samples of 10 m at most."""
    d = away_sql("px", "py", "e.ax", "e.ay", "e.bx", 'e."by"')
    share = ", ".join(f"round(sum(CASE WHEN d <= {r} THEN w ELSE 0 END) / sum(w), 6) AS share_{r}" for r in (3, 10, 25))
    return f"""{name}_s AS (SELECT {key}, ax + (bx - ax) * ((i + 0.5::DOUBLE) / n) AS px, ay + ("by" - ay) * ((i + 0.5::DOUBLE) / n) AS py, len / n AS w FROM (SELECT *, unnest(range(0, n)) AS i
 FROM (SELECT *, CAST(ceil(len / 10) AS BIGINT) AS n FROM (SELECT *, sqrt(pow(bx - ax, 2) + pow("by" - ay, 2)) AS len FROM {source})))),
{name}_d AS (SELECT px, py, min({d}) AS d FROM (SELECT DISTINCT px, py FROM {name}_s) s JOIN (SELECT DISTINCT ax, ay, bx, "by" FROM {target}) e
 ON px BETWEEN least(e.ax, e.bx) - 25 AND greatest(e.ax, e.bx) + 25 AND py BETWEEN least(e.ay, e."by") - 25 AND greatest(e.ay, e."by") + 25 GROUP BY 1, 2),
{name} AS (SELECT {key}, round(sum(w), 3) AS length_m, {share} FROM {name}_s LEFT JOIN {name}_d USING (px, py) GROUP BY 1)"""


BOTH_SQL = f"WITH {TRAVEL_SQL}, {shares_sql('there', 'travel', 'journey_id', 'net')}, {shares_sql('back', 'net', 'edge_id', 'travel')}"


def both_ways(t):
    # Travel serves both ways three times; written once, its ordering is not planned and run for each.
    trips, net = written(travel(t), "travel"), t.net.select("edge_id", "ax", "ay", "bx", "by")
    return corridor_shares(trips, net, ["journey_id"], spacing=10.0), corridor_shares(net, trips, ["edge_id"], spacing=10.0)


@query("geo28_corridor_shares", "trace net", BOTH_SQL + " SELECT 'journey' AS side, journey_id AS id, length_m, share_3, share_10, share_25 FROM there UNION ALL SELECT 'edge', edge_id, length_m, share_3, share_10, share_25 FROM back")
def _(t):
    there, back = both_ways(t)
    return there.withColumnRenamed("journey_id", "id").withColumn("side", F.lit("journey")).unionByName(back.withColumnRenamed("edge_id", "id").withColumn("side", F.lit("edge")))


@query("dq07_corridor_scope", "trace net", BOTH_SQL + " SELECT 'source_outside' AS kind, journey_id AS id, share_25 FROM there WHERE share_25 < 0.9 UNION ALL SELECT 'official_unsourced', edge_id, share_25 FROM back WHERE share_25 < 0.9")
def _(t):
    # Travel that leaves the network's corridor, and network that no travel runs along.
    there, back = both_ways(t)
    return (there.where("share_25 < 0.9").select(F.lit("source_outside").alias("kind"), F.col("journey_id").alias("id"), "share_25")
            .unionByName(back.where("share_25 < 0.9").select(F.lit("official_unsourced").alias("kind"), F.col("edge_id").alias("id"), "share_25")))


_S, _E = ("sx", "sy", "tx", "ty"), ("ax", "ay", "bx", '"by"')
_MID = ("sx + (tx - sx) * ((f0 + f1) / 2)", "sy + (ty - sy) * ((f0 + f1) / 2)")
_SIDE = lambda a, b, p: f"(({b[0]} - {a[0]}) * ({p[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({p[0]} - {a[0]}))"
_CROSS = (f"({_SIDE(_S[:2], _S[2:], _E[:2])} * {_SIDE(_S[:2], _S[2:], _E[2:])} < 0 AND {_SIDE(_E[:2], _E[2:], _S[:2])} * {_SIDE(_E[:2], _E[2:], _S[2:])} < 0)")
_APART = f"least({away_sql(*_E[:2], *_S)}, {away_sql(*_E[2:], *_S)}, {away_sql(*_S[:2], *_E)}, {away_sql(*_S[2:], *_E)}) <= 10"


def _offset_sql(f):
    return f"round(greatest(0, least(1, {fraction_sql(f'sx + (tx - sx) * {f}', f'sy + (ty - sy) * {f}', *_E)})) * sqrt(pow(bx - ax, 2) + pow(\"by\" - ay, 2)), 3)"


def _cut_sql(x, y):
    return f"round(greatest(0, least(1, {fraction_sql(x, y, *_S)})), 9)"


@query("jn15_common_refinement", "net", f"""WITH src AS (SELECT edge_id AS src_id, ax + 1 AS sx, ay + edge_id % 14 AS sy, bx + 1 AS tx, "by" + edge_id % 14 + edge_id % 3 AS ty FROM net),
tgt AS (SELECT edge_id * 2 AS piece_id, ax, ay, ax + (bx - ax) * 0.4::DOUBLE AS bx, ay + ("by" - ay) * 0.4::DOUBLE AS "by" FROM net UNION ALL SELECT edge_id * 2 + 1, bx, "by", ax + (bx - ax) * 0.4::DOUBLE, ay + ("by" - ay) * 0.4::DOUBLE FROM net),
p AS MATERIALIZED (SELECT * FROM src JOIN tgt ON abs(sx - ax) <= 150 AND abs(sy - ay) <= 150 WHERE abs((tx - sx) * (bx - ax) + (ty - sy) * ("by" - ay)) / (sqrt(pow(tx - sx, 2) + pow(ty - sy, 2)) * sqrt(pow(bx - ax, 2) + pow("by" - ay, 2))) >= cos(radians(15)) AND ({_CROSS} OR {_APART})),
c AS (SELECT src_id, {_cut_sql('ax', 'ay')} AS f0 FROM p UNION SELECT src_id, {_cut_sql('bx', '"by"')} FROM p UNION SELECT src_id, 0 FROM src UNION SELECT src_id, 1 FROM src),
k AS MATERIALIZED (SELECT * FROM (SELECT src_id, f0, lead(f0) OVER (PARTITION BY src_id ORDER BY f0) AS f1 FROM c) WHERE f1 IS NOT NULL),
b AS (SELECT src_id, f0, count(*) AS n, min(piece_id) AS piece_id, min({_offset_sql('f0')}) AS a, min({_offset_sql('f1')}) AS z FROM k JOIN p USING (src_id) WHERE {away_sql(*_MID, *_E)} <= 10 AND round({fraction_sql(*_MID, *_E)}, 9) BETWEEN 0 AND 1 GROUP BY 1, 2)
SELECT src_id, round(f0 * sqrt(pow(tx - sx, 2) + pow(ty - sy, 2)), 3) AS from_m, round(f1 * sqrt(pow(tx - sx, 2) + pow(ty - sy, 2)), 3) AS to_m, coalesce(n, 0) AS rivals, CASE WHEN n = 1 THEN piece_id END AS piece_id, CASE WHEN n = 1 THEN a END AS tgt_from_m, CASE WHEN n = 1 THEN z END AS tgt_to_m
FROM k JOIN src USING (src_id) LEFT JOIN b USING (src_id, f0)""")
def _(t):
    # The targets are the network's edges cut at two fifths, the second part stored the other way round.
    src = t.net.selectExpr("edge_id AS src_id", "ax + 1 AS ax", "ay + edge_id % 14 AS ay", "bx + 1 AS bx", "by + edge_id % 14 + edge_id % 3 AS by")
    cut = ("ax + (bx - ax) * 0.4D AS bx", "ay + (by - ay) * 0.4D AS by")
    tgt = t.net.selectExpr("edge_id * 2 AS piece_id", "ax", "ay", *cut).unionByName(t.net.selectExpr("edge_id * 2 + 1 AS piece_id", "bx AS ax", "by AS ay", *cut))
    return edge_correspondence(src, tgt, "src_id", "piece_id")
