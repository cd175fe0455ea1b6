"""Coverage along carrier lines and chained as-of joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators.carriers import collinear_coverage
from ..operators.chained import asof_chain
from .registry import query

# Travelled parts of the network, each row of streets turned to one of 24 bearings around the scene's corner.
_TURN = "(edge_id // 40) % 24 * 0.1309::DOUBLE"
_END = lambda f, axis: (f"(ax + (bx - ax) * {f}) * cos(r) - (ay + (\"by\" - ay) * {f}) * sin(r) - 111000" if axis == "x"
                        else f"(ax + (bx - ax) * {f}) * sin(r) + (ay + (\"by\" - ay) * {f}) * cos(r) + 6621000")
_PART_SQL = f"""part AS (SELECT edge_id, ax, ay, bx, "by", r, CASE WHEN seen % 2 = 0 THEN f0 ELSE f1 END AS f0, CASE WHEN seen % 2 = 0 THEN f1 ELSE f0 END AS f1
 FROM (SELECT n.edge_id, ax, ay, bx, "by", {_TURN.replace("edge_id", "n.edge_id")} AS r, s.journey_id AS seen, start_mm / e.length_mm AS f0, end_mm / e.length_mm AS f1 FROM net n JOIN edges e USING (edge_id) JOIN spans s USING (edge_id))),
m AS (SELECT {_END('f0', 'x')} AS px, {_END('f0', 'y')} AS py, {_END('f1', 'x')} AS qx, {_END('f1', 'y')} AS qy FROM part)"""


@query("agg12_carrier_lines", "net edges spans", f"""WITH {_PART_SQL},
h AS (SELECT *, CASE WHEN t < 0 THEN t + pi() ELSE t END AS h FROM (SELECT *, atan2(qy - py, qx - px) AS t FROM m WHERE sqrt(pow(qx - px, 2) + pow(qy - py, 2)) >= 0.01)),
b AS (SELECT *, CAST(floor(CASE WHEN h >= pi() THEN h - pi() ELSE h END * 100000 + 0.5) AS BIGINT) AS bearing FROM h),
s AS (SELECT bearing, CAST(floor(py * cos(bearing / 100000) - px * sin(bearing / 100000) + 0.5) AS BIGINT) AS "offset",
 CAST(floor((px * cos(bearing / 100000) + py * sin(bearing / 100000)) * 1000 + 0.5) AS BIGINT) AS p, CAST(floor((qx * cos(bearing / 100000) + qy * sin(bearing / 100000)) * 1000 + 0.5) AS BIGINT) AS q FROM b),
o AS (SELECT bearing, "offset", least(p, q) AS lo, greatest(p, q) AS hi, max(greatest(p, q)) OVER (PARTITION BY bearing, "offset" ORDER BY least(p, q), greatest(p, q) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY bearing, "offset" ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM o),
u AS (SELECT bearing, "offset", min(lo) AS lo, max(hi) AS hi FROM i GROUP BY bearing, "offset", island)
SELECT bearing, "offset", count(*) AS pieces, round(sum((hi - lo) / 1000 / ((exp(n / 6378137) + exp(-n / 6378137)) / 2)), 2) AS length_m
FROM (SELECT *, (lo + hi) / 2000 * sin(bearing / 100000) + "offset" * cos(bearing / 100000) AS n FROM u) GROUP BY 1, 2""")
def _(t):
    # Odd journeys travel the other way.
    part = (t.net.select("edge_id", "ax", "ay", "bx", "by").join(t.edges.select("edge_id", "length_mm"), "edge_id").join(t.spans.select("edge_id", "journey_id", "start_mm", "end_mm"), "edge_id")
            .withColumns({"r": F.floor(F.col("edge_id") / 40) % 24 * 0.1309, "u0": F.col("start_mm") / F.col("length_mm"), "u1": F.col("end_mm") / F.col("length_mm")}))
    odd = F.col("journey_id") % 2 == 1
    part = part.withColumns({"f0": F.when(odd, F.col("u1")).otherwise(F.col("u0")), "f1": F.when(odd, F.col("u0")).otherwise(F.col("u1"))})

    def end(f):
        x, y = F.col("ax") + (F.col("bx") - F.col("ax")) * F.col(f), F.col("ay") + (F.col("by") - F.col("ay")) * F.col(f)
        return (geo.mercator_lng(x * F.cos("r") - y * F.sin("r") - 111000), geo.mercator_lat(x * F.sin("r") + y * F.cos("r") + 6621000))

    (plng, plat), (qlng, qlat) = end("f0"), end("f1")
    lines = part.select(plng.alias("ax"), plat.alias("ay"), qlng.alias("bx"), qlat.alias("by"))
    return collinear_coverage(lines).groupBy("bearing", "offset").agg(F.count("*").alias("pieces"), F.round(F.sum("length_m"), 2).alias("length_m"))


@query("jn18_asof_chain", "trace", """WITH RECURSIVE p AS MATERIALIZED (SELECT journey_id, seq, CAST(floor(x / 90) AS BIGINT) AS place, t_ms + event_id % 5 * 45000 AS t, accuracy_m FROM trace),
e AS MATERIALIZED (SELECT DISTINCT journey_id, place, t FROM p WHERE accuracy_m < 50),
c AS (SELECT journey_id, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS picked_at, CAST(0 AS BIGINT) AS prev FROM p GROUP BY 1
 UNION ALL SELECT c.journey_id, p.seq, min(e.t), coalesce(min(e.t), c.prev) FROM c JOIN p ON p.journey_id = c.journey_id AND p.seq = c.seq + 1
 LEFT JOIN e ON e.journey_id = p.journey_id AND e.place = p.place AND e.t > c.prev GROUP BY c.journey_id, p.seq, c.prev)
SELECT journey_id, seq, picked_at FROM c WHERE seq >= 0""")
def _(t):
    # Evidence of a place arrives up to three minutes late, so picks push each other.
    place = F.floor(F.col("x") / 90).alias("place")
    evidence = t.trace.where("accuracy_m < 50").select("journey_id", place, F.expr("t_ms + event_id % 5 * 45000").alias("at"))
    return asof_chain(t.trace.select("journey_id", "seq", place), evidence, ["journey_id"], "place", "seq", "at").select("journey_id", "seq", "picked_at")
