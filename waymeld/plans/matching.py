"""Map matching, observed intervals and hypothesis scoring."""

from pyspark.sql import functions as F

from ..operators import matching as G
from ..operators.intervals import interval_union
from ..operators.ordered import dense_seq
from ..operators import traces as T
from ..session import cut_lineage
from .registry import query
from .spatial import planar_near_sql


def thinned_obs(t):
    # Read by the thinning and by the join back: numbered and written once.
    seen = cut_lineage(t.obs)
    o = seen.withColumns({"lat": F.expr("51.0D + y / 111195.08D"), "lng": F.expr("-1.0D + x / 69978.0D")})
    kept = T.thin_trace(o)
    rows = seen.select("journey_id", "seq", "x", "y", "accuracy_m").join(kept, ["journey_id", "seq"]).withColumnRenamed("seq", "source_seq")
    return dense_seq(rows, ["journey_id"], ["source_seq"], F.floor(F.col("source_seq") / 32_768))


@query("gra05_map_matching")
def _(t):
    # Sequential minimum: tests/test_traces.py compares with an exhaustive search.
    return G.match_journeys(thinned_obs(t), t.net)


@query("gra05_edge_candidates", "obs net", f"WITH {planar_near_sql('nn', 'TRUE', 60)}, r AS (SELECT journey_id, seq, edge_id, round(d, 4) AS gap, row_number() OVER (PARTITION BY journey_id, seq ORDER BY round(d, 9), edge_id) AS rank FROM nn WHERE d <= 60) SELECT journey_id, seq, count(*) AS candidates, min(gap) AS nearest_m, max(gap) AS farthest_m FROM r WHERE rank <= 8 GROUP BY 1, 2")
def _(t):
    c = G.edge_candidates(t.obs.select("journey_id", "seq", "x", "y"), t.net, G.MatchPolicy(radius_m=60.0, candidates=8, cell_m=60.0))
    return c.groupBy("journey_id", "seq").agg(F.count("*").alias("candidates"), F.round(F.min("gap"), 4).alias("nearest_m"), F.round(F.max("gap"), 4).alias("farthest_m"))


OBS_INT = f"""{planar_near_sql('nn', 'TRUE', 18)}, nr AS (SELECT n.journey_id, n.seq, n.edge_id, round(n.d, 6) AS d, o.x, o.y, o.t_ms, o.accuracy_m, e.eligible,
  greatest(0, least(1, ((o.x - e.ax) * (e.bx - e.ax) + (o.y - e.ay) * (e.by - e.ay)) / 3600)) * 60 AS off FROM nn n JOIN obs o USING (journey_id, seq) JOIN net e USING (edge_id) WHERE n.d <= 18 AND o.accuracy_m <= 10),
bs AS (SELECT *, min(d) OVER (PARTITION BY journey_id, seq) AS best FROM nr), sg AS (SELECT journey_id, seq, min(edge_id) AS edge_id, min(off) AS off, min(x) AS x, min(y) AS y, min(t_ms) AS t_ms FROM bs WHERE best <= 8 AND d <= best + greatest(3, accuracy_m) GROUP BY 1, 2 HAVING count(*) = 1 AND bool_and(eligible)),
lg AS (SELECT a.journey_id, a.edge_id, a.seq, least(a.off, b.off) AS lo, greatest(a.off, b.off) AS hi FROM sg a JOIN sg b ON a.journey_id = b.journey_id AND a.edge_id = b.edge_id AND b.seq = a.seq + 1
  WHERE b.t_ms - a.t_ms BETWEEN 1 AND 30000 AND sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) BETWEEN 1 AND 50 AND abs(b.off - a.off) <= 1.5 * sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) + 3)"""


@query("gra06_observed_intervals", "obs net", f"WITH {OBS_INT} SELECT journey_id, edge_id, seq, round(lo, 4) AS lo_m, round(hi, 4) AS hi_m FROM lg a WHERE EXISTS (SELECT 1 FROM lg b WHERE b.journey_id = a.journey_id AND b.edge_id = a.edge_id AND b.seq IN (a.seq - 1, a.seq + 1))")
def _(t):
    r = G.observed_intervals(t.obs, t.net)
    return r.select("journey_id", "edge_id", "seq", F.round("lo_m", 4).alias("lo_m"), F.round("hi_m", 4).alias("hi_m"))


@query("gra08_hypothesis_scores", "obs net", """WITH pth AS (SELECT CASE WHEN edge_id % 2 = 0 THEN a_node // 1000 ELSE -1 - a_node % 1000 END AS hypothesis, edge_id,
 CASE WHEN edge_id % 2 = 0 THEN a_node % 1000 ELSE a_node // 1000 END * 60.0::DOUBLE AS base_m, ax, ay, bx AS cx, "by" AS cy FROM net),
nr AS (SELECT o.journey_id, hypothesis, o.seq, round(sqrt(pow(o.x - greatest(ax, least(cx, o.x)), 2) + pow(o.y - greatest(ay, least(cy, o.y)), 2)), 6) AS d,
 base_m + greatest(ax, least(cx, o.x)) - ax + greatest(ay, least(cy, o.y)) - ay AS off FROM obs o JOIN pth ON o.y BETWEEN ay - 25 AND cy + 25 AND o.x BETWEEN ax - 25 AND cx + 25),
one AS (SELECT journey_id, hypothesis, seq, min(d) AS d, arg_min(off, (d, off)) AS off FROM nr WHERE d <= 25 GROUP BY 1, 2, 3), sp AS (SELECT journey_id, count(*) AS fixes, max(seq) AS last FROM obs GROUP BY 1),
ag AS (SELECT a.journey_id, a.hypothesis, count(*) AS w, count(*) FILTER (b.off > a.off) AS rising, count(b.off) AS steps, any_value(fixes) AS fixes, count(DISTINCT CAST(floor(a.seq * 3::DOUBLE / (last + 1)) AS BIGINT)) AS thirds, median(a.d) AS med FROM one a LEFT JOIN one b ON b.journey_id = a.journey_id AND b.hypothesis = a.hypothesis AND b.seq = a.seq + 1 JOIN sp ON sp.journey_id = a.journey_id GROUP BY 1, 2),
sc AS (SELECT *, round(w::DOUBLE / fixes + coalesce(rising::DOUBLE / nullif(steps, 0), 0) - med / 100, 6) AS score FROM ag WHERE thirds = 3 AND w >= 3), rk AS (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY score DESC, hypothesis) AS k FROM sc)
SELECT journey_id, max(hypothesis) FILTER (k = 1) AS hypothesis, max(score) AS score, CASE WHEN count(*) = 1 OR max(score) - min(score) >= 0.1 THEN 'best' ELSE 'ambiguous' END AS verdict FROM rk WHERE k <= 2 GROUP BY 1""")
def _(t):
    # A path per street row, from west to east, and one per column (negative), from south to north.
    paths = t.net.selectExpr("CASE WHEN edge_id % 2 = 0 THEN a_node DIV 1000 ELSE -1 - a_node % 1000 END AS hypothesis", "edge_id",
                             "CAST(CASE WHEN edge_id % 2 = 0 THEN a_node % 1000 ELSE a_node DIV 1000 END * 60 AS DOUBLE) AS base_m", "ax", "ay", "bx", "by")
    return G.score_hypotheses(t.obs.select("journey_id", "seq", "x", "y"), paths)


@query("gra06_reference_coverage", "obs net", f"""WITH {OBS_INT}, ok AS (SELECT edge_id, CAST(round(lo * 1000) AS BIGINT) AS lo, CAST(round(hi * 1000) AS BIGINT) AS hi FROM lg a WHERE EXISTS (SELECT 1 FROM lg b WHERE b.journey_id = a.journey_id AND b.edge_id = a.edge_id AND b.seq IN (a.seq - 1, a.seq + 1)) AND hi > lo),
mm AS (SELECT *, max(hi) OVER (PARTITION BY edge_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok WHERE hi > lo), ii AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY edge_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM mm), uu AS (SELECT edge_id, min(lo) AS lo, max(hi) AS hi FROM ii GROUP BY edge_id, i)
SELECT edge_id, CAST(sum(hi - lo) AS BIGINT) AS covered_mm FROM uu GROUP BY 1""")
def _(t):
    r = G.observed_intervals(t.obs, t.net).select("edge_id", F.round(F.col("lo_m") * 1000).cast("long").alias("lo"), F.round(F.col("hi_m") * 1000).cast("long").alias("hi"))
    return interval_union(r, ["edge_id"]).groupBy("edge_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered_mm"))
