"""Interval ledgers, alignment to a network, anchor coverage."""

import uuid

from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..operators.intervals import interval_union, missing_intervals
from ..operators.gridjoin import nearest_within
from ..operators.ordered import dense_seq
from ..session import shared_folder
from ..streaming.ledger import LedgerUpkeep
from .registry import query

# Brute-force union over `rows(keys, lo, hi)`; used by several checks.
def union_sql(source: str, keys: str, lo: str = "lo", hi: str = "hi", name: str = "united") -> str:
    return f"""{name}_m AS (SELECT {keys}, {lo} AS lo, {hi} AS hi,
  max({hi}) OVER (PARTITION BY {keys} ORDER BY {lo}, {hi} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM {source} WHERE {hi} > {lo}),
{name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END)
  OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM {name}_m),
{name} AS (SELECT {keys}, min(lo) AS lo, max(hi) AS hi FROM {name}_i GROUP BY {keys}, island)"""


def spans_of(t):
    return t.spans.select("edge_id", "journey_id", "mode", F.col("start_mm").alias("lo"), F.col("end_mm").alias("hi"))


@query("agg08_interval_union", "spans", "WITH " + union_sql("spans", "edge_id", "start_mm", "end_mm")
       + " SELECT edge_id, lo, hi FROM united")
def _(t):
    return interval_union(spans_of(t), ["edge_id"])


@query("agg08_union_narrow_chunks", "spans", "WITH " + union_sql("spans", "mode", "start_mm", "end_mm")
       + " SELECT mode, lo, hi FROM united")
def _(t):
    # Two keys hold all rows: the chunks, not the keys, spread the work.
    return interval_union(spans_of(t), ["mode"], width=4096)


@query("agg09_ledger_edges", "spans edges", "WITH " + union_sql("spans", "edge_id", "start_mm", "end_mm") + """,
tot AS (SELECT edge_id, CAST(sum(end_mm - start_mm) AS BIGINT) AS total_mm, count(DISTINCT journey_id) AS journeys FROM spans GROUP BY edge_id),
uni AS (SELECT edge_id, CAST(sum(hi - lo) AS BIGINT) AS unique_mm, count(*) AS pieces FROM united GROUP BY edge_id)
SELECT e.edge_id, e.label, e.region, e.length_mm, total_mm, journeys, unique_mm, pieces, round(unique_mm * 100.0::DOUBLE / length_mm, 6) AS percent
FROM edges e JOIN tot USING (edge_id) JOIN uni USING (edge_id)""")
def _(t):
    return cov.ledger_by_edge(spans_of(t), t.edges)


@query("agg09_ledger_network", "spans edges", "WITH " + union_sql("spans", "edge_id", "start_mm", "end_mm") + """
SELECT region, label, CAST(sum(hi - lo) AS BIGINT) AS unique_mm, count(DISTINCT edge_id) AS edges
FROM united JOIN edges USING (edge_id) GROUP BY GROUPING SETS ((region, label), (region), ())""")
def _(t):
    merged = interval_union(spans_of(t), ["edge_id"]).groupBy("edge_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("mm"))
    return (merged.join(t.edges, "edge_id").rollup("region", "label")
            .agg(F.sum("mm").alias("unique_mm"), F.count("edge_id").alias("edges")))


@query("agg10_missing_intervals", "spans edges", "WITH " + union_sql("spans", "edge_id", "start_mm", "end_mm") + """,
cut AS (SELECT edge_id, greatest(lo, 0) AS lo, least(hi, length_mm) AS hi FROM united JOIN edges USING (edge_id) WHERE least(hi, length_mm) > greatest(lo, 0)),
marks AS (SELECT edge_id, CAST(0 AS BIGINT) AS prev_hi, NULL AS lo FROM edges WHERE FALSE),
seqd AS (SELECT edge_id, lo, hi, lag(hi) OVER (PARTITION BY edge_id ORDER BY lo) AS prev_hi, lead(lo) OVER (PARTITION BY edge_id ORDER BY lo) AS next_lo FROM cut),
gaps AS (SELECT edge_id, coalesce(prev_hi, 0) AS gap_lo, lo AS gap_hi FROM seqd
 UNION ALL SELECT s.edge_id, hi, length_mm FROM seqd s JOIN edges USING (edge_id) WHERE next_lo IS NULL
 UNION ALL SELECT edge_id, 0, length_mm FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM cut))
SELECT edge_id, CAST(gap_lo AS BIGINT) AS gap_lo, CAST(gap_hi AS BIGINT) AS gap_hi FROM gaps WHERE gap_hi > gap_lo""")
def _(t):
    return missing_intervals(interval_union(spans_of(t), ["edge_id"]), t.edges, "edge_id", "length_mm")


@query("agg11_contributors_at_offset", "spans edges", """
SELECT DISTINCT edge_id, CAST(edge_id * 977 % 100000 AS BIGINT) AS at_mm, journey_id FROM spans
WHERE edge_id * 977 % 100000 BETWEEN start_mm AND end_mm""")
def _(t):
    points = t.edges.select("edge_id", F.expr("edge_id * 977 % 100000").alias("at_mm"))
    return cov.contributors_at(spans_of(t), points)


BOUND = """united_src AS (SELECT s.edge_id % 10 AS route_id, s.edge_id AS way_id, mode, start_mm AS lo, end_mm AS hi FROM spans s),
""" + union_sql("united_src", "route_id, way_id, mode") + """,
bound AS (SELECT u.route_id, u.way_id, target_id, mode, greatest(lo, start_mm) AS src_lo, least(hi, end_mm) AS src_hi,
 CAST(round(low_mm + (greatest(lo, start_mm) - start_mm) * ((high_mm - low_mm)::DOUBLE / (end_mm - start_mm))) AS BIGINT) AS lo,
 CAST(round(low_mm + (least(hi, end_mm) - start_mm) * ((high_mm - low_mm)::DOUBLE / (end_mm - start_mm))) AS BIGINT) AS hi
 FROM united u JOIN bindings b ON u.route_id = b.route_id AND u.way_id = b.way_id
 WHERE least(hi, end_mm) > greatest(lo, start_mm) AND list_contains(string_split(modes, ','), mode))"""


def _source(t):
    return spans_of(t).withColumn("route_id", F.expr("edge_id % 10")).withColumnRenamed("edge_id", "way_id")


@query("jn14_bind_spans", "spans bindings", f"WITH {BOUND} SELECT * FROM bound")
def _(t):
    return cov.bind_spans(_source(t), t.bindings)


@query("agg27_modes_and_combined", "spans bindings", f"""WITH {BOUND},
both_modes AS (SELECT route_id, target_id, mode, lo, hi FROM bound UNION ALL SELECT route_id, target_id, 'combined', lo, hi FROM bound),
{union_sql("both_modes", "route_id, target_id, mode", name="merged")}
SELECT route_id, mode, CAST(sum(hi - lo) AS BIGINT) AS unique_mm FROM merged GROUP BY route_id, mode""")
def _(t):
    bound = cov.by_mode_and_combined(cov.bind_spans(_source(t), t.bindings))
    return (interval_union(bound, ["route_id", "target_id", "mode"]).groupBy("route_id", "mode")
            .agg(F.sum(F.col("hi") - F.col("lo")).alias("unique_mm")))


@query("agg28_network_union", "spans bindings", f"""WITH {BOUND},
shared AS (SELECT CAST(target_id // 2 AS BIGINT) AS network_id, mode, lo, hi FROM bound),
{union_sql("shared", "network_id, mode", name="merged")}
SELECT mode, CAST(sum(hi - lo) AS BIGINT) AS network_mm, count(DISTINCT network_id) AS pieces FROM merged GROUP BY mode""")
def _(t):
    bound = cov.bind_spans(_source(t), t.bindings).withColumn("network_id", F.expr("target_id DIV 2"))
    merged = (interval_union(bound, ["network_id", "mode"]).groupBy("network_id", "mode")
              .agg(F.sum(F.col("hi") - F.col("lo")).alias("mm")))
    return merged.groupBy("mode").agg(F.sum("mm").alias("network_mm"), F.count("*").alias("pieces"))


@query("agg26_route_capacity", "bindings", """WITH
m AS (SELECT route_id, target_id, mode, low_mm AS lo, high_mm AS hi FROM bindings, (SELECT unnest(['on_foot', 'cycling']) AS mode)
  WHERE list_contains(string_split(modes, ','), mode)), """ + union_sql("m", "route_id, target_id, mode") + """,
cap AS (SELECT route_id, target_id, mode, sum(hi - lo) AS mm FROM united GROUP BY ALL),
goal AS (SELECT route_id, target_id, max(high_mm) AS target_mm FROM bindings GROUP BY ALL)
SELECT route_id, mode, CAST(sum(target_mm) AS BIGINT) AS target_mm, CAST(sum(mm) AS BIGINT) AS bound_mm,
  CAST(sum(target_mm - mm) AS BIGINT) AS unbound_mm, bool_and(mm >= target_mm) AS attainable FROM cap JOIN goal USING (route_id, target_id) GROUP BY route_id, mode""")
def _(t):
    b = t.bindings
    each = b.withColumn("mode", F.explode(F.split("modes", ","))).select(
        "route_id", "target_id", "mode", F.col("low_mm").alias("lo"), F.col("high_mm").alias("hi"))
    cap = interval_union(each, ["route_id", "target_id", "mode"]).groupBy("route_id", "target_id", "mode").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("mm"))
    goal = b.groupBy("route_id", "target_id").agg(F.max("high_mm").alias("target_mm"))
    return (cap.join(goal, ["route_id", "target_id"]).groupBy("route_id", "mode")
            .agg(F.sum("target_mm").alias("target_mm"), F.sum("mm").alias("bound_mm"),
                 F.sum(F.col("target_mm") - F.col("mm")).alias("unbound_mm"),
                 F.bool_and(F.col("mm") >= F.col("target_mm")).alias("attainable")))


@query("agg43_alternative_paths", "spans bindings", f"""WITH {BOUND},
clash AS (SELECT route_id, way_id, count(*) AS overlaps FROM (SELECT route_id, way_id, start_mm,
  lag(end_mm) OVER (PARTITION BY route_id, way_id ORDER BY start_mm, end_mm) AS before FROM bindings) WHERE start_mm < before GROUP BY ALL),
kept AS (SELECT b.* FROM bound b LEFT JOIN clash c USING (route_id, way_id) WHERE c.overlaps IS NULL),
{union_sql("kept", "route_id, target_id", name="merged")}
SELECT route_id, target_id, CAST(sum(hi - lo) AS BIGINT) AS covered_mm, count(*) AS pieces,
 (SELECT count(DISTINCT way_id) FROM kept k WHERE k.route_id = m.route_id AND k.target_id = m.target_id) AS paths FROM merged m GROUP BY route_id, target_id""")
def _(t):
    b = t.bindings
    # Bindings of one way that overlap are refused; one way has few bindings.
    from pyspark.sql import Window
    w = Window.partitionBy("route_id", "way_id").orderBy("start_mm", "end_mm")
    clash = (b.withColumn("before", F.lag("end_mm").over(w)).where("start_mm < before").select("route_id", "way_id").distinct())
    kept = cov.bind_spans(_source(t), b).join(clash, ["route_id", "way_id"], "left_anti")
    merged = interval_union(kept, ["route_id", "target_id"]).groupBy("route_id", "target_id").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("covered_mm"), F.count("*").alias("pieces"))
    return merged.join(kept.groupBy("route_id", "target_id").agg(F.countDistinct("way_id").alias("paths")), ["route_id", "target_id"])


@query("agg44_fixed_denominator", "spans bindings edges", f"""WITH {BOUND},
{union_sql("bound", "route_id, target_id", name="merged")},
done AS (SELECT route_id, target_id, sum(hi - lo) AS mm FROM merged GROUP BY ALL),
units AS (SELECT edge_id % 10 AS route_id, CAST(edge_id // 2 AS BIGINT) AS target_id, max(length_mm) AS length_mm FROM edges GROUP BY ALL)
SELECT route_id, count(*) AS targets, CAST(sum(length_mm) AS BIGINT) AS inventory_mm, CAST(sum(coalesce(mm, 0)) AS BIGINT) AS covered_mm,
 round(sum(coalesce(mm, 0))::DOUBLE * 100 / sum(length_mm)::DOUBLE, 6) AS percent FROM units LEFT JOIN done USING (route_id, target_id) GROUP BY route_id""")
def _(t):
    units = t.edges.groupBy(F.expr("edge_id % 10").alias("route_id"), F.expr("edge_id DIV 2").alias("target_id")).agg(F.max("length_mm").alias("length_mm"))
    done = interval_union(cov.bind_spans(_source(t), t.bindings), ["route_id", "target_id"]).groupBy("route_id", "target_id").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("mm"))
    return (units.join(done, ["route_id", "target_id"], "left").groupBy("route_id")
            .agg(F.count("*").alias("targets"), F.sum("length_mm").alias("inventory_mm"),
                 F.coalesce(F.sum("mm"), F.lit(0)).alias("covered_mm"))
            .withColumn("percent", F.round(F.col("covered_mm").cast("double") * 100 / F.col("inventory_mm"), 6)))


@query("st09_ledger_replace_batch", "spans", """WITH
changed AS (SELECT DISTINCT journey_id FROM spans WHERE journey_id % 17 = 0), removed AS (SELECT DISTINCT journey_id FROM spans WHERE journey_id % 17 = 1),
fresh AS (SELECT edge_id, journey_id, start_mm + 500 AS lo, end_mm + 900 AS hi FROM spans WHERE journey_id % 17 = 0),
now AS (SELECT edge_id, journey_id, start_mm AS lo, end_mm AS hi FROM spans WHERE journey_id % 17 > 1 UNION ALL SELECT * FROM fresh), """
       + union_sql("now", "edge_id") + " SELECT edge_id, CAST(sum(hi - lo) AS BIGINT) AS unique_mm FROM united GROUP BY edge_id")
def _(t):
    old = spans_of(t).drop("mode")
    # The update itself, not a sample: journeys 0 of 17 are re-imported, 1 of 17 deleted.
    fresh = old.where("journey_id % 17 = 0").select("edge_id", "journey_id", (F.col("lo") + 500).alias("lo"), (F.col("hi") + 900).alias("hi"))
    gone = old.where("journey_id % 17 = 1").select("journey_id")
    now = cov.replace_journeys(old, fresh, fresh, gone)
    return interval_union(now, ["edge_id"]).groupBy("edge_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("unique_mm"))


@query("st09_ledger_upkeep", "spans", """WITH
now AS (SELECT edge_id, journey_id, start_mm AS lo, end_mm AS hi FROM spans WHERE journey_id % 17 > 1 UNION ALL
  SELECT edge_id, journey_id, start_mm + 500 AS lo, end_mm + 900 AS hi FROM spans WHERE journey_id % 17 = 0), """
       + union_sql("now", "edge_id") + " SELECT edge_id, coalesce(unique_mm, 0) AS unique_mm FROM (SELECT DISTINCT edge_id FROM spans) LEFT JOIN (SELECT edge_id, CAST(sum(hi - lo) AS BIGINT) AS unique_mm FROM united GROUP BY edge_id) USING (edge_id)")
def _(t):
    old = spans_of(t).drop("mode")
    ledger = LedgerUpkeep(f"{shared_folder(t.spark)}/ledger-{uuid.uuid4().hex}")
    fresh = old.where("journey_id % 17 = 0").select("edge_id", "journey_id", (F.col("lo") + 500).alias("lo"), (F.col("hi") + 900).alias("hi"))
    gone = old.where("journey_id % 17 = 1").select(F.lit(None).cast("long").alias("edge_id"), "journey_id", "lo", "hi").distinct()
    # Two halves of the history, a re-import, a removal, and the removal replayed.
    for number, batch in enumerate([old.where("journey_id % 2 = 0"), old.where("journey_id % 2 = 1"), fresh, gone, gone]):
        ledger(batch, min(number, 3))
    return ledger.totals(t.spark)


PAIRS = """pairs0 AS (SELECT journey_id, seq, x AS ax, y AS ay, t_ms, accuracy_m AS acc, lead(x) OVER w AS cx, lead(y) OVER w AS cy, lead(t_ms) OVER w AS t2, lead(accuracy_m) OVER w AS acc2
  FROM obs WINDOW w AS (PARTITION BY journey_id ORDER BY seq)),
pairs AS (SELECT journey_id, seq, ax, ay, cx, cy, greatest(acc, acc2) AS u, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) AS step_m,
  CASE WHEN NOT (acc <= 5 AND acc2 <= 5) THEN 'fix_accuracy' WHEN NOT (t2 - t_ms > 0 AND t2 - t_ms <= 8000) THEN 'time_gap'
   WHEN sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) < 2 OR sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) <= acc + acc2 THEN 'insufficient_motion'
   WHEN sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) / (t2 - t_ms) > .06 THEN 'implausible_speed' END AS reason
  FROM pairs0 WHERE t2 IS NOT NULL)"""

ALIGN = PAIRS + """,
gated AS (SELECT * EXCLUDE (reason), coalesce(reason, CASE WHEN NOT (step_m > 0 AND step_m <= 35) THEN 'distance_gap'
  WHEN NOT (least(ax, cx) >= u + 7 AND greatest(ax, cx) <= 1200 - u - 7 AND least(ay, cy) >= u + 7 AND greatest(ay, cy) <= 1e9 - u - 7) THEN 'catalogue_boundary' END) AS reason FROM pairs),
cand0 AS (SELECT g.journey_id, g.seq, g.step_m, g.u, e.edge_id, e.a_node, e.b_node, e.direction, e.eligible, e.length_mm,
  e.bx - e.ax AS ux, e.by - e.ay AS uy, g.cx - g.ax AS vx, g.cy - g.ay AS vy, g.ax - e.ax AS px, g.ay - e.ay AS py, g.cx - e.ax AS qx, g.cy - e.ay AS qy
  FROM gated g JOIN net e ON greatest(e.ax, e.bx) >= least(g.ax, g.cx) - 12 AND least(e.ax, e.bx) <= greatest(g.ax, g.cx) + 12
   AND greatest(e.ay, e.by) >= least(g.ay, g.cy) - 12 AND least(e.ay, e.by) <= greatest(g.ay, g.cy) + 12 WHERE g.reason IS NULL),
cand1 AS (SELECT *, ux * ux + uy * uy AS nn, (px * ux + py * uy) / (ux * ux + uy * uy) AS p0, (qx * ux + qy * uy) / (ux * ux + uy * uy) AS p1,
  (ux * py - uy * px) / sqrt(ux * ux + uy * uy) AS q0, (ux * qy - uy * qx) / sqrt(ux * ux + uy * uy) - (ux * py - uy * px) / sqrt(ux * ux + uy * uy) AS dq FROM cand0
  WHERE abs(ux * vx + uy * vy) >= cos(radians(20)) * sqrt(ux * ux + uy * uy) * step_m),
cand2 AS (SELECT *, greatest(0, least(-p0 / (p1 - p0), (1 - p0) / (p1 - p0))) AS s0, least(1, greatest(-p0 / (p1 - p0), (1 - p0) / (p1 - p0))) AS e0 FROM cand1),
cand3 AS (SELECT *, CASE WHEN dq = 0 THEN (CASE WHEN abs(q0) <= 7 THEN s0 END) ELSE greatest(s0, least((-7 - q0) / dq, (7 - q0) / dq)) END AS s,
  CASE WHEN dq = 0 THEN e0 ELSE least(e0, greatest((-7 - q0) / dq, (7 - q0) / dq)) END AS e,
  CASE WHEN dq = 0 THEN (CASE WHEN abs(q0) <= 7 + u THEN s0 END) ELSE greatest(s0, least((-7 - u - q0) / dq, (7 + u - q0) / dq)) END AS ws,
  CASE WHEN dq = 0 THEN e0 ELSE least(e0, greatest((-7 - u - q0) / dq, (7 + u - q0) / dq)) END AS we FROM cand2),
cand4 AS (SELECT *, coalesce(e > s, FALSE) AS hit, NOT coalesce(e > s, FALSE) AND coalesce(we > ws AND (we - ws) * step_m > 0.5, FALSE) AS rival,
  greatest(0, least(1, p0 + s * (p1 - p0))) AS entry, greatest(0, least(1, p0 + e * (p1 - p0))) AS exit FROM cand3),
rivals AS (SELECT journey_id, seq FROM cand4 GROUP BY ALL HAVING bool_or(rival)),
hits AS (SELECT *, CASE WHEN round(exit) = 0 THEN a_node ELSE b_node END AS out_node, abs(exit - round(exit)) * length_mm / 1000 AS out_off,
  CASE WHEN round(entry) = 0 THEN a_node ELSE b_node END AS in_node, abs(entry - round(entry)) * length_mm / 1000 AS in_off,
  CAST(round(least(entry, exit) * length_mm) AS BIGINT) AS lo, CAST(round(greatest(entry, exit) * length_mm) AS BIGINT) AS hi FROM cand4 WHERE hit),
chained AS (SELECT *, row_number() OVER w AS place, (s - lag(e) OVER w) * step_m AS seam,
  coalesce(lag(out_node) OVER w = in_node AND lag(out_off) OVER w <= 0.5 AND in_off <= 0.5, FALSE) AS joined
  FROM hits WINDOW w AS (PARTITION BY journey_id, seq ORDER BY s, e, edge_id)),
faults AS (SELECT *, CASE WHEN place = 1 THEN 0 WHEN seam < -0.5 OR (seam < 0 AND NOT joined) THEN 1 WHEN seam > 0.5 OR NOT joined THEN 2 ELSE 0 END AS fault FROM chained),
per_pair AS (SELECT journey_id, seq, arg_min(fault, place) FILTER (fault > 0) AS ff, max(step_m) AS step_m, min(s) AS s, arg_max(e, place) AS e,
  bool_or(direction <> 0 AND direction <> CASE WHEN entry < exit THEN 1 ELSE -1 END) AS wrong, bool_or(hi > lo) AS anylen, bool_and(eligible) AS eligible FROM faults GROUP BY ALL),
decided AS (SELECT g.journey_id, g.seq, CASE WHEN g.reason IS NOT NULL THEN g.reason WHEN r.seq IS NOT NULL THEN 'competing_sections' WHEN p.seq IS NULL THEN 'no_alignment'
  WHEN ff = 1 THEN 'competing_sections' WHEN ff = 2 THEN 'disconnected_sections' WHEN greatest(p.s, 1 - p.e) * p.step_m > 0.5 THEN 'incomplete_alignment'
  WHEN wrong THEN 'unsupported_direction' WHEN NOT anylen THEN 'no_alignment' WHEN NOT p.eligible THEN 'out_of_scope_road' END AS reason
  FROM gated g LEFT JOIN rivals r USING (journey_id, seq) LEFT JOIN per_pair p USING (journey_id, seq)),
aligned AS (SELECT d.journey_id, d.seq, d.reason, h.edge_id, h.lo, h.hi FROM decided d JOIN hits h USING (journey_id, seq) WHERE d.reason IS NULL AND h.hi > h.lo
  UNION ALL SELECT journey_id, seq, reason, NULL, NULL, NULL FROM decided WHERE reason IS NOT NULL)"""


def _aligned(t):
    return cov.align_pairs(cov.observation_pairs(t.obs), t.net, extent=(1200.0, 1e9))


@query("flt19_observation_gates", "obs", f"WITH {PAIRS} SELECT journey_id, seq, round(step_m, 3) AS step_m, coalesce(reason, 'open') AS reason FROM pairs")
def _(t):
    return cov.observation_pairs(t.obs).select("journey_id", "seq", F.round("step_m", 3).alias("step_m"), F.coalesce("reason", F.lit("open")).alias("reason"))


@query("jn16_align_pairs", "obs net", f"WITH {ALIGN} SELECT * FROM aligned")
def _(t):
    return _aligned(t)


@query("agg22_hold_reasons", "obs net", f"WITH {ALIGN} SELECT coalesce(reason, 'covered') AS reason, count(DISTINCT journey_id * 1000000 + seq) AS pairs FROM aligned GROUP BY 1")
def _(t):
    return (_aligned(t).select("journey_id", "seq", F.coalesce("reason", F.lit("covered")).alias("reason")).distinct()
            .groupBy("reason").agg(F.count("*").alias("pairs")))


@query("agg09_observed_ledger", "obs net", f"""WITH {ALIGN}, ok AS (SELECT * FROM aligned WHERE reason IS NULL), {union_sql("ok", "edge_id")}
SELECT label, count(DISTINCT edge_id) AS edges, CAST(sum(hi - lo) AS BIGINT) AS unique_mm FROM united JOIN net USING (edge_id) GROUP BY label""")
def _(t):
    merged = interval_union(_aligned(t).where("reason IS NULL"), ["edge_id"]).groupBy("edge_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("mm"))
    return merged.join(t.net.select("edge_id", "label"), "edge_id").groupBy("label").agg(F.count("*").alias("edges"), F.sum("mm").alias("unique_mm"))


@query("agg57_legacy_comparison", "obs net", f"""WITH {ALIGN},
old AS (SELECT edge_id, count(*) AS n FROM (SELECT DISTINCT o.journey_id, o.seq, e.edge_id FROM obs o JOIN net e
  ON o.x BETWEEN least(e.ax, e.bx) - 5 AND greatest(e.ax, e.bx) + 5 AND o.y BETWEEN least(e.ay, e.by) - 5 AND greatest(e.ay, e.by) + 5) GROUP BY 1),
new AS (SELECT edge_id, count(*) AS n FROM aligned WHERE reason IS NULL GROUP BY 1)
SELECT coalesce(o.edge_id, n.edge_id) AS edge_id, coalesce(o.n, 0) AS legacy_fixes, coalesce(n.n, 0) AS aligned_spans,
 CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' ELSE 'both' END AS state FROM old o FULL JOIN new n USING (edge_id)""")
def _(t):
    from ..operators.gridjoin import box_cells, planar_cell
    e = t.net.select("edge_id", F.least("ax", "bx").alias("w"), F.greatest("ax", "bx").alias("e"), F.least("ay", "by").alias("s"), F.greatest("ay", "by").alias("n"))
    right = box_cells(e, F.col("w") - 5, F.col("s") - 5, F.col("e") + 5, F.col("n") + 5, 40.0)
    near = (planar_cell(t.obs.select("journey_id", "seq", "x", "y"), "x", "y", 40.0).join(right, ["_cx", "_cy"])
            .where("x BETWEEN w - 5 AND e + 5 AND y BETWEEN s - 5 AND n + 5"))
    old = near.groupBy("edge_id").agg(F.count("*").alias("o"))
    new = _aligned(t).where("reason IS NULL").groupBy("edge_id").agg(F.count("*").alias("n"))
    return old.join(new, "edge_id", "full_outer").select(
        "edge_id", F.coalesce("o", F.lit(0)).alias("legacy_fixes"), F.coalesce("n", F.lit(0)).alias("aligned_spans"),
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("both").alias("state"))


# --- anchors -------------------------------------------------------------

HAV = "2 * {r} * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def hav(lat1, lng1, lat2, lng2, r="6371000.0"):
    return HAV.format(a=lat1, b=lat2, c=lng1, d=lng2, r=r)


def road_fixes(t):
    return t.fixes.withColumn("road_ref", F.expr("concat('A', cast(event_id % 20 + 1 AS STRING))"))


RADIUS = 1500.0
NEAREST = f"""pf AS (SELECT *, 'A' || CAST(event_id % 20 + 1 AS STRING) AS road_ref FROM fixes),
near AS (SELECT f.event_id, f.journey_id, f.road_ref, a.anchor_id, round({hav('f.lat', 'f.lng', 'a.lat', 'a.lng')}, 6) AS d FROM pf f JOIN anchors a USING (road_ref)
  WHERE {hav('f.lat', 'f.lng', 'a.lat', 'a.lng')} < {RADIUS}),
best AS (SELECT event_id, journey_id, road_ref, arg_min(anchor_id, (d, anchor_id)) AS anchor_id, min(d) AS d FROM near GROUP BY event_id, journey_id, road_ref)"""


@query("jn02_nearest_anchor", "fixes anchors", f"WITH {NEAREST} SELECT event_id, road_ref, anchor_id, round(d, 3) AS distance_m FROM best")
def _(t):
    f = road_fixes(t)
    a = t.anchors.select("road_ref", "anchor_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    best = nearest_within(f, a, RADIUS, "anchor_id", ["road_ref"], strict=True)
    return f.select("event_id", "road_ref", "lat", "lng").join(best, ["road_ref", "lat", "lng"]).select(
        "event_id", "road_ref", "anchor_id", F.round("distance_m", 3).alias("distance_m"))


DONE = NEAREST + """,
covered AS (SELECT DISTINCT road_ref, anchor_id FROM best WHERE anchor_id % 11 <> 0),
sizes AS (SELECT road_ref, count(*) AS anchors FROM anchors GROUP BY road_ref),
done AS (SELECT s.road_ref, anchors, coalesce(n, 0) AS covered, least(1.0::DOUBLE, coalesce(n, 0)::DOUBLE / anchors) AS share
 FROM sizes s LEFT JOIN (SELECT road_ref, count(*) AS n FROM covered GROUP BY road_ref) USING (road_ref))"""


def _covered(t):
    removed = t.anchors.where("anchor_id % 11 = 0").select("road_ref", "anchor_id")
    return cov.covered_anchors(road_fixes(t), t.anchors, RADIUS, ["road_ref"], removed=removed)


@query("agg05_road_completion", "fixes anchors", f"WITH {DONE} SELECT road_ref, anchors, covered, round(share * 100, 6) AS percent, round(share * anchors * 100.0, 6) AS unique_m FROM done")
def _(t):
    return cov.completion(_covered(t), t.anchors, ["road_ref"], F.count("*") * 100.0)


@query("agg06_network_completion", "fixes anchors", f"""WITH {DONE}, reg AS (SELECT CASE WHEN length(road_ref) = 2 THEN 'NI' ELSE 'GB' END AS region, sum(share * anchors * 100.0) AS m, sum(anchors) * 100.0 AS cap FROM done GROUP BY 1)
SELECT round(least(100.0, sum(least(m, cap * 0.9)) / sum(cap) * 100), 6) AS percent FROM reg""")
def _(t):
    roads = cov.completion(_covered(t), t.anchors, ["road_ref"], F.count("*") * 100.0)
    reg = (roads.withColumn("region", F.when(F.length("road_ref") == 2, "NI").otherwise("GB"))
           .groupBy("region").agg(F.sum("unique_m").alias("m"), (F.sum("anchors") * 100.0).alias("cap")))
    return reg.agg(F.round(F.least(F.lit(100.0), F.sum(F.least("m", F.col("cap") * 0.9)) / F.sum("cap") * 100), 6).alias("percent"))


SECTIONS = DONE + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY road_ref ORDER BY lat, lng, anchor_id) - 1 AS pos FROM anchors),
flagged AS (SELECT p.*, c.anchor_id IS NOT NULL AS cov, coalesce(c.anchor_id % 3 = 0, FALSE) AS old FROM placed p LEFT JOIN covered c USING (road_ref, anchor_id)),
prs AS (SELECT road_ref, pos, lat, lng, cov, old, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2, lead(cov) OVER w AS cov2, lead(old) OVER w AS old2 FROM flagged WINDOW w AS (PARTITION BY road_ref ORDER BY pos)),
st AS (SELECT *, """ + hav("lat", "lng", "lat2", "lng2") + """ AS d, {state} AS state FROM prs WHERE lat2 IS NOT NULL),
st2 AS (SELECT *, d <= 20000 AS near FROM st),
op AS (SELECT *, sum(CASE WHEN n0 IS NULL OR NOT n0 OR s0 <> state THEN 1 ELSE 0 END) OVER (PARTITION BY road_ref ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section
 FROM (SELECT *, lag(near) OVER (PARTITION BY road_ref ORDER BY pos) AS n0, lag(state) OVER (PARTITION BY road_ref ORDER BY pos) AS s0 FROM st2))
SELECT road_ref, CAST(section AS BIGINT) AS section, state, min(pos) AS first_pos, max(pos) + 1 AS last_pos, round(sum(d), 3) AS length_m FROM op WHERE near {extra} GROUP BY road_ref, section, state"""


def _placed(t):
    placed = dense_seq(t.anchors, ["road_ref"], ["lat", "lng", "anchor_id"], F.floor(F.col("lat") * 100), "pos")
    return placed.join(_covered(t).withColumn("hit", F.lit(True)), ["road_ref", "anchor_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("agg48_map_sections", "fixes anchors", "WITH " + SECTIONS.replace("{state}", "cov OR cov2").replace("{extra}", ""))
def _(t):
    return cov.map_sections(_placed(t), ["road_ref"], "pos", F.col("hit"), 20_000.0)


@query("agg49_newly_covered_sections", "fixes anchors", "WITH " + SECTIONS.replace("{state}", "(cov OR cov2) AND NOT old AND NOT old2").replace("{extra}", "AND state"))
def _(t):
    return cov.map_sections(_placed(t), ["road_ref"], "pos", F.col("hit"), 20_000.0, before=F.col("hit") & F.expr("anchor_id % 3 = 0"))
