"""Cleaning, segmentation, sessions and stops."""

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import machines as M
from ..operators import traces as T
from ..operators.intervals import interval_union
from ..operators.ledgers import first_rows
from ..operators.ordered import islands, neighbours, overlapping_chunks, running, seq_chunk
from ..operators.lines import simplify
from ..operators.scans import scan_sorted
from .coverage import hav, union_sql
from .registry import query
from .shapes import LINE_SQL, legs

W = "WINDOW w AS (PARTITION BY journey_id ORDER BY seq)"


@query("win01_steps", "trace", f"""SELECT journey_id, seq, round({hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')}, 3) AS step_m, t_ms - lag(t_ms) OVER w AS dt_ms, round({hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} * 1000 / (t_ms - lag(t_ms) OVER w), 5) AS mps FROM trace {W}""")
def _(t):
    p = neighbours(t.trace, ["journey_id"], "seq", {"a": ("lat", -1), "o": ("lng", -1), "pt": ("t_ms", -1)})
    d, dt = geo.haversine_m("a", "o", "lat", "lng"), F.col("t_ms") - F.col("pt")
    return p.select("journey_id", "seq", F.round(d, 3).alias("step_m"), dt.alias("dt_ms"), F.round(d * 1000 / dt, 5).alias("mps"))


SEC = f"""sec AS (SELECT *, sum(CASE WHEN t_ms - pt > 120000 THEN 1 ELSE 0 END) OVER (PARTITION BY journey_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT *, lag(t_ms) OVER w AS pt FROM trace {W}))"""


@query("win02_time_sections", "trace", f"WITH {SEC} SELECT journey_id, CAST(section AS BIGINT) AS section, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS points FROM sec GROUP BY 1, 2 HAVING count(*) >= 2")
def _(t):
    rows, _gaps = T.time_sections(t.trace, ["journey_id"], 120_000)
    return rows.groupBy("journey_id", "section").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("points"))


@query("win02_time_gaps", "trace", f"WITH {SEC} SELECT journey_id, seq - 1 AS after_seq, t_ms - pt AS duration_ms FROM sec WHERE t_ms - pt > 120000")
def _(t):
    return T.time_sections(t.trace, ["journey_id"], 120_000)[1]


def thin_sql(keep: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT journey_id, seq, lag(lat) OVER w AS blat, lag(lng) OVER w AS blng, lat, lng, lead(lat) OVER w AS alat, lead(lng) OVER w AS alng FROM trace {W}),
q AS (SELECT *, {hav('blat', 'blng', 'lat', 'lng', '6371008.8')} AS d, (lng - blng) * cos(radians(lat)) AS ux, lat - blat AS uy, (alng - lng) * cos(radians(lat)) AS vx, alat - lat AS vy FROM p),
r AS (SELECT journey_id, seq, alat IS NULL AS last, d, sqrt(ux*ux + uy*uy) AS nu, sqrt(vx*vx + vy*vy) AS nv, CASE WHEN sqrt(ux*ux + uy*uy) > 0 AND sqrt(vx*vx + vy*vy) > 0 THEN 1 - greatest(-1, least(1, (ux*vx + uy*vy) / (sqrt(ux*ux + uy*uy) * sqrt(vx*vx + vy*vy)))) ELSE 0 END AS turn FROM q),
s AS (SELECT journey_id, seq, 0.0::DOUBLE AS acc, TRUE AS kept FROM r WHERE seq = 0
 UNION ALL SELECT r.journey_id, r.seq, CASE WHEN r.last THEN 0 WHEN {keep} THEN 0 ELSE s.acc + d END, r.last OR ({keep}) FROM s JOIN r ON r.journey_id = s.journey_id AND r.seq = s.seq + 1)
SELECT journey_id, seq FROM s WHERE kept"""


@query("win03_thinning", "trace", thin_sql("s.acc + d >= 25 OR (s.acc + d >= 8 AND nu > 0.00002 AND nv > 0.00002 AND turn > 0.35)"))
def _(t):
    return T.thin_trace(t.trace)


@query("win04_overlapping_chunks", "trace", """WITH n AS (SELECT journey_id, count(*) AS n FROM trace GROUP BY 1), c AS (SELECT journey_id, n, unnest(range(0, CASE WHEN n <= 20 THEN 1 ELSE 1 + CAST(ceil((n - 20) / 15.0) AS BIGINT) END)) AS chunk_no FROM n)
SELECT journey_id, chunk_no, count(*) AS points, min(seq) AS first_seq, max(seq) AS last_seq FROM c JOIN trace USING (journey_id) WHERE seq >= chunk_no * 15 AND seq < chunk_no * 15 + 20 GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t):
    n = t.trace.groupBy("journey_id").agg(F.count("*").alias("n"))
    c = overlapping_chunks(t.trace.select("journey_id", "seq").join(n, "journey_id"), ["journey_id"], "seq", "n", 20, 5)
    return c.groupBy("journey_id", "chunk_no").agg(F.count("*").alias("points"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).where("points >= 2")


@query("win05_retention_by_size", "", "SELECT doc_id, running FROM (SELECT doc_id, lang, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS n FROM documents) WHERE running <= 150000 AND n <= 500")
def _(t):
    d = t.documents.select("doc_id", "lang", "n_chars", (-F.col("doc_id")).alias("newest"))
    r = running(d, ["lang"], F.floor(F.col("newest") / 4096), ["newest"], {"running": ("sum", "n_chars"), "n": ("sum", F.lit(1))})
    return r.where("running <= 150000 AND n <= 500").select("doc_id", "running")


@query("win06_latest_per_key", "fixes", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(t_ms) AS t_ms FROM fixes GROUP BY 1")
def _(t):
    return first_rows(t.fixes.select("user_id", (-F.unix_micros("ts")).alias("k"), (-F.col("event_id")).alias("e"), "event_id", "t_ms"), ["user_id"], ["k", "e"]).select("user_id", "event_id", "t_ms")


@query("win07_visit_sessions", "visits", """WITH RECURSIVE v AS (SELECT venue_id, start_min, max(end_min) AS end_min, min(visit_id % 97) AS d, count(*) AS n, row_number() OVER (PARTITION BY venue_id ORDER BY start_min) AS k FROM visits GROUP BY 1, 2),
s AS (SELECT venue_id, k, start_min AS s0, end_min AS e, d, n, 1 AS session FROM v WHERE k = 1
 UNION ALL SELECT v.venue_id, v.k, CASE WHEN v.start_min - s0 <= 45 THEN s0 ELSE v.start_min END, v.end_min, CASE WHEN v.start_min - s0 <= 45 THEN least(s.d, v.d) ELSE v.d END, CASE WHEN v.start_min - s0 <= 45 THEN s.n + v.n ELSE v.n END, CASE WHEN v.start_min - s0 <= 45 THEN session ELSE session + 1 END FROM s JOIN v ON v.venue_id = s.venue_id AND v.k = s.k + 1)
SELECT venue_id, s0 AS start_min, arg_max(e, k) AS end_min, arg_max(d, k) AS distance, CAST(arg_max(n, k) AS BIGINT) AS visits, session = 1 AS first_visit FROM s GROUP BY venue_id, session, s0""")
def _(t):
    # Equal starts collapse first.
    v = t.visits.groupBy("venue_id", "start_min").agg(F.max("end_min").alias("end_min"), F.min(F.expr("visit_id % 97")).alias("d"), F.count("*").alias("n"))
    s = T.visit_sessions(v, "venue_id", "start_min", 45)
    return s.groupBy("venue_id", "session").agg(F.min("start_min").alias("start_min"), F.max_by("end_min", "start_min").alias("end_min"), F.min("d").alias("distance"), F.sum("n").alias("visits")).select(
        "venue_id", "start_min", "end_min", "distance", "visits", (F.col("session") == 1).alias("first_visit"))


@query("win08_proof_sessions", "visits", "WITH pv AS (SELECT user_id, venue_id, start_min AS lo, end_min + 15 AS hi FROM visits), " + union_sql("pv", "user_id, venue_id") + " SELECT user_id, venue_id, lo AS start_min, hi - 15 AS end_min FROM united")
def _(t):
    v = t.visits.select("user_id", "venue_id", F.col("start_min").alias("lo"), (F.col("end_min") + 15).alias("hi"))
    return interval_union(v, ["user_id", "venue_id"]).select("user_id", "venue_id", F.col("lo").alias("start_min"), (F.col("hi") - 15).alias("end_min"))


STOP_ROWS = """rowsv AS (SELECT journey_id, seq, t_ms, lat, lng, accuracy_m, speed_mps, CAST(floor(x / 400) AS BIGINT) AS venue FROM trace)"""


@query("win09_stops", "trace", f"""WITH RECURSIVE {STOP_ROWS},
s AS (SELECT journey_id, -1::BIGINT AS seq, NULL::BIGINT AS venue, 0::BIGINT AS first, 0::BIGINT AS last, 0 AS n, 0.0::DOUBLE AS lat0, 0.0::DOUBLE AS lng0, 0.0::DOUBLE AS worst, 0 AS run FROM (SELECT DISTINCT journey_id FROM trace)
 UNION ALL SELECT r.journey_id, r.seq,
  CASE WHEN r.speed_mps > 2 THEN NULL WHEN skip THEN s.venue ELSE r.venue END, CASE WHEN r.speed_mps > 2 THEN 0 WHEN skip THEN s.first WHEN fresh THEN r.t_ms ELSE s.first END,
  CASE WHEN r.speed_mps > 2 THEN 0 WHEN skip THEN s.last ELSE r.t_ms END, CASE WHEN r.speed_mps > 2 THEN 0 WHEN skip THEN s.n WHEN fresh THEN 1 ELSE s.n + 1 END,
  CASE WHEN skip OR NOT fresh THEN s.lat0 ELSE r.lat END, CASE WHEN skip OR NOT fresh THEN s.lng0 ELSE r.lng END,
  CASE WHEN skip THEN s.worst WHEN fresh THEN r.accuracy_m ELSE greatest(s.worst, r.accuracy_m) END, CASE WHEN r.speed_mps > 2 OR (NOT skip AND fresh) THEN s.run + 1 ELSE s.run END
  FROM (SELECT s.*, r.seq AS rseq, r.t_ms, r.lat, r.lng, r.accuracy_m, r.speed_mps, r.venue AS rvenue, r.speed_mps <= 2 AND (r.accuracy_m > 50 OR r.t_ms <= s.last) AS skip,
    s.venue IS NULL OR s.venue <> r.venue OR r.t_ms - s.last > 90000 OR {hav('r.lat', 'r.lng', 's.lat0', 's.lng0')} > 80 AS fresh FROM s JOIN rowsv r ON r.journey_id = s.journey_id AND r.seq = s.seq + 1) z,
   LATERAL (SELECT z.journey_id, z.rseq AS seq, z.t_ms, z.lat, z.lng, z.accuracy_m, z.speed_mps, z.rvenue AS venue) r, LATERAL (SELECT z.venue, z.first, z.last, z.n, z.lat0, z.lng0, z.worst, z.run) s)
SELECT journey_id, venue AS venue_id, first AS from_ms, max(last) AS to_ms, max(worst) AS accuracy_m FROM s WHERE venue IS NOT NULL AND n > 0 GROUP BY journey_id, run, venue, first HAVING max(n) >= 4 AND max(last) - first >= 180000""")
def _(t):
    rows, _gaps = T.time_sections(t.trace.withColumn("venue", F.floor(F.col("x") / 400)), ["journey_id"], 90_000, least=1)
    # A gap above 90 s always ends a stop, so sections are independent scans.
    return scan_sorted(rows, ["journey_id", "section"], ["seq"], ["journey_id", "t_ms", "lat", "lng", "accuracy_m", "speed_mps", "venue"], lambda k: M.Stops(k),
                       "journey_id long, venue_id long, from_ms long, to_ms long, accuracy_m double")


@query("win10_uncorroborated_fixes", "trace", f"""WITH z AS (SELECT journey_id, seq, CAST(t_ms // 10 AS BIGINT) AS t_ms, lat, lng, CASE WHEN event_id % 7 = 0 THEN 70.0 ELSE accuracy_m END AS accuracy_m, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE speed_mps + 3 END AS speed_mps FROM (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN lat + 0.002 ELSE lat END AS lat) FROM trace)),
m AS (SELECT *, CASE WHEN accuracy_m > 0 AND accuracy_m <= 25 AND speed_mps >= 3 THEN seq END AS ms FROM z),
n AS (SELECT *, max(ms) OVER (PARTITION BY journey_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ka, min(ms) OVER (PARTITION BY journey_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS kb FROM m)
SELECT n.journey_id, n.seq FROM n JOIN m a ON a.journey_id = n.journey_id AND a.seq = ka JOIN m b ON b.journey_id = n.journey_id AND b.seq = kb, LATERAL (SELECT cos(radians(n.lat)) AS k) c,
 LATERAL (SELECT (a.lng - n.lng) * k AS x0, a.lat - n.lat AS y0, (b.lng - n.lng) * k AS x1, b.lat - n.lat AS y1) g, LATERAL (SELECT greatest(0, least(1, CASE WHEN (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) = 0 THEN 0 ELSE (-x0*(x1-x0)-y0*(y1-y0))/((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) END)) AS f) h
WHERE n.speed_mps < 0 AND n.t_ms > a.t_ms AND n.t_ms < b.t_ms AND b.t_ms - a.t_ms <= 30000 AND n.accuracy_m > 2 * greatest(a.accuracy_m, b.accuracy_m)
 AND {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= greatest(15, greatest(a.speed_mps, b.speed_mps) * 1.5) * (b.t_ms - a.t_ms) / 1000 + a.accuracy_m + b.accuracy_m
 AND sqrt(pow(x0 + f*(x1-x0), 2) + pow(y0 + f*(y1-y0), 2)) * 111195 > n.accuracy_m + greatest(a.accuracy_m, b.accuracy_m)""")
def _(t):
    odd = F.expr("event_id % 7 = 0")
    z = t.trace.select("journey_id", "seq", F.expr("t_ms DIV 10").alias("t_ms"), F.when(odd, F.col("lat") + 0.002).otherwise(F.col("lat")).alias("lat"), "lng",
                       F.when(odd, 70.0).otherwise(F.col("accuracy_m")).alias("accuracy_m"), F.when(odd, -1.0).otherwise(F.col("speed_mps") + 3).alias("speed_mps"))
    return T.uncorroborated(z)


@query("win11_redundant_points")
def _(t):
    # Sequential; tests/test_traces.py compares with a plain loop.
    return T.drop_redundant(t.trace.withColumn("lng", F.expr("-1.0D + (lng + 1.0D) / 4")))


@query("win12_clean_foot_trace")
def _(t):
    foot = t.trace.where(F.col("mode") == "walking")
    rows, _gaps = T.time_sections(foot, ["journey_id"], 900_000, least=1)
    return T.grouped_keep(rows, ["journey_id", "section"], ["t_ms", "lat", "lng", "accuracy_m", "speed_mps"], M.clean_foot_path)


@query("win13_simplify_cycling")
def _(t):
    rows, _gaps = T.time_sections(t.trace.where(F.col("mode") == "cycling"), ["journey_id"], 900_000, least=1)
    return simplify(rows, ["journey_id", "section"], 5.0, 100.0)


@query("win13_simplify_walking")
def _(t):
    rows, _gaps = T.time_sections(t.trace.where(F.col("mode") == "walking"), ["journey_id"], 900_000, least=1)
    return simplify(rows, ["journey_id", "section"], 3.0, 60.0, 8, 111_195.0)


@query("win14_supported_sections", "trace", f"""WITH {LINE_SQL}, l AS (SELECT journey_id, seq, {hav('ay', 'ax', 'cy', 'cx', '6371008.8')} AS obs, {hav('ay', 'ax', 'cy', 'cx', '6371008.8')} * (1 + seq % 4) + CASE WHEN seq % 9 = 4 THEN 400 ELSE 0 END AS d FROM legs WHERE t2 IS NOT NULL),
k AS (SELECT *, d <= greatest(obs * 1.4, obs + 300) AS ok FROM l), s AS (SELECT *, sum(CASE WHEN ok AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY journey_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT *, lag(ok) OVER (PARTITION BY journey_id ORDER BY seq) AS was FROM k))
SELECT journey_id, CAST(section AS BIGINT) AS section, min(seq) AS first_seq, max(seq) AS last_seq, round(sum(d), 2) AS distance_m FROM s WHERE ok GROUP BY 1, 2""")
def _(t):
    obs = geo.haversine_m("ay", "ax", "cy", "cx", geo.EARTH_MEAN_M)
    l = legs(t).withColumn("obs", obs).withColumn("d", F.col("obs") * F.expr("1 + seq % 4") + F.expr("CASE WHEN seq % 9 = 4 THEN 400 ELSE 0 END"))
    s = T.supported_sections(l.select("journey_id", "seq", "obs", "d"), ["journey_id"], "obs", "d").where("ok")
    return s.groupBy("journey_id", "section").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.round(F.sum("d"), 2).alias("distance_m"))


@query("win15_traversed_spans", "obs", "WITH f AS (SELECT journey_id, seq, CAST(floor(x / 60) AS BIGINT) AS feature FROM obs), g AS (SELECT *, seq - row_number() OVER (PARTITION BY journey_id, feature ORDER BY seq) AS g FROM f) SELECT journey_id, feature, min(seq) AS from_seq, max(seq) AS to_seq FROM g GROUP BY journey_id, feature, g")
def _(t):
    f = t.obs.select("journey_id", "seq", F.floor(F.col("x") / 60).alias("feature"))
    return T.run_lengths(f, ["journey_id"], "feature").select("journey_id", "feature", "from_seq", "to_seq")


@query("win16_rolling_motion")
def _(t):
    # Bounded 90 s window per fix; a pause above 60 s clears it, so sections are independent.
    rows, _gaps = T.time_sections(t.trace, ["journey_id"], 60_000, least=1)
    return scan_sorted(rows, ["journey_id", "section"], ["seq"], ["journey_id", "seq", "t_ms", "lat", "lng", "accuracy_m", "speed_mps"], lambda k: M.MotionWindow(k), "journey_id long, seq long, moving boolean")


RUN_SQL = f"""pr AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(t_ms) OVER w AS pt, lag(accuracy_m) OVER w AS pacc, lag(speed_mps) OVER w AS ps FROM trace {W}),
rl AS (SELECT *, {{moving}} AS mv, coalesce(pt IS NOT NULL AND {{moving_prev}} AND accuracy_m <= CASE WHEN mode = 'walking' THEN 50 ELSE 100 END AND t_ms > pt AND t_ms - pt <= 60000 AND CASE WHEN mode = 'walking'
  THEN {hav('plat', 'plng', 'lat', 'lng')} <= greatest(4.5, least(10, greatest(ps, speed_mps) * 1.5)) * ((t_ms - pt) / 1000.0::DOUBLE) + least(20, (pacc + accuracy_m) * .3)
  ELSE {hav('plat', 'plng', 'lat', 'lng')} <= 70 * ((t_ms - pt) / 1000.0::DOUBLE) + least(50, pacc + accuracy_m) END, FALSE) AS joins FROM pr),
is_ AS (SELECT *, sum(CASE WHEN mv AND NOT joins THEN 1 ELSE 0 END) OVER (PARTITION BY journey_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run, CASE WHEN joins THEN greatest(0, {hav('plat', 'plng', 'lat', 'lng')} - least(8, (pacc + accuracy_m) * .25)) ELSE 0 END AS credit FROM rl)"""
MOVE = "speed_mps >= 0.5 AND speed_mps <= 3.5 AND accuracy_m <= 25"


@query("win17_sustained_runs", "trace", "WITH " + RUN_SQL.replace("{moving}", MOVE).replace("{moving_prev}", "ps >= 0.5 AND ps <= 3.5 AND pacc <= 25") + " SELECT journey_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS fixes, round(sum(credit), 2) AS path_m FROM is_ WHERE mv GROUP BY journey_id, run HAVING count(*) >= 3 AND max(t_ms) - min(t_ms) >= 20000 AND sum(credit) >= 30")
def _(t):
    return T.sustained_runs(t.trace, ["journey_id"], F.expr(MOVE), 3, 20_000, 30.0).select("journey_id", "first_seq", "last_seq", "fixes", F.round("path_m", 2).alias("path_m"))


@query("win18_witness_runs", "obs", f"""WITH p AS (SELECT journey_id, seq, x, y, lead(x) OVER w AS cx, lead(t_ms) OVER w - t_ms AS dt, accuracy_m <= 4 AND lead(accuracy_m) OVER w <= 4 AS witness FROM obs {W}),
q AS (SELECT *, dt <= 8000 AND abs(cx - x) <= 40 AS linked FROM p WHERE cx IS NOT NULL), r AS (SELECT *, sum(CASE WHEN linked AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY journey_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(linked) OVER (PARTITION BY journey_id ORDER BY seq) AS was FROM q)),
a AS (SELECT journey_id, run, count(*) FILTER (witness) AS witnesses, sum(abs(cx - x)) FILTER (witness) AS m FROM r WHERE linked GROUP BY 1, 2), g AS (SELECT journey_id, CAST(sum(witnesses) AS BIGINT) AS witnesses, count(*) AS runs FROM a WHERE witnesses >= 3 AND m >= 100 GROUP BY 1), n AS (SELECT journey_id, count(*) AS pairs, count(*) FILTER (linked) AS linked FROM q GROUP BY 1)
SELECT journey_id, CASE WHEN runs = 1 AND linked = pairs THEN 'full' WHEN runs > 0 THEN 'partial' ELSE 'unresolved' END AS verdict, coalesce(witnesses, 0) AS witnesses FROM n LEFT JOIN g USING (journey_id)""")
def _(t):
    p = neighbours(t.obs, ["journey_id"], "seq", {"cx": ("x", 1), "t2": ("t_ms", 1), "acc2": ("accuracy_m", 1)}).where("cx IS NOT NULL")
    p = p.withColumns({"linked": F.expr("t2 - t_ms <= 8000 AND abs(cx - x) <= 40"), "witness": F.expr("accuracy_m <= 4 AND acc2 <= 4")})
    q = neighbours(p, ["journey_id"], "seq", {"was": ("linked", -1)})
    runs = islands(q, ["journey_id"], seq_chunk(), ["seq"], F.col("linked") & ~F.coalesce("was", F.lit(False)), "run").where("linked")
    a = runs.groupBy("journey_id", "run").agg(F.count_if("witness").alias("witnesses"), F.sum(F.when(F.col("witness"), F.abs(F.col("cx") - F.col("x")))).alias("m")).where("witnesses >= 3 AND m >= 100")
    g = a.groupBy("journey_id").agg(F.sum("witnesses").alias("witnesses"), F.count("*").alias("runs"))
    n = p.groupBy("journey_id").agg(F.count("*").alias("pairs"), F.count_if("linked").alias("linked"))
    verdict = F.when((F.col("runs") == 1) & (F.col("linked") == F.col("pairs")), "full").when(F.col("runs") > 0, "partial").otherwise("unresolved")
    return n.join(g, "journey_id", "left").select("journey_id", verdict.alias("verdict"), F.coalesce("witnesses", F.lit(0)).alias("witnesses"))


@query("win19_boundary_fixes", "obs", f"""WITH b AS (SELECT journey_id, min(t_ms) + 5100 AS s, max(t_ms) - 5300 AS e FROM obs GROUP BY 1), p AS (SELECT *, lead(t_ms) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM obs {W})
SELECT p.journey_id, tm AS t_ms, round(x + (x2 - x) * ((tm - t_ms)::DOUBLE / (t2 - t_ms)), 4) AS x, round(y + (y2 - y) * ((tm - t_ms)::DOUBLE / (t2 - t_ms)), 4) AS y FROM (SELECT b.journey_id, unnest([s, e]) AS tm FROM b) q JOIN p ON p.journey_id = q.journey_id AND t_ms < tm AND tm < t2 AND tm - t_ms <= 5000 AND t2 - tm <= 5000 AND sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) <= 100""")
def _(t):
    b = t.obs.groupBy("journey_id").agg((F.min("t_ms") + 5100).alias("s"), (F.max("t_ms") - 5300).alias("e")).select("journey_id", F.explode(F.array("s", "e")).alias("at"))
    p = neighbours(t.obs, ["journey_id"], "seq", {"t2": ("t_ms", 1), "x2": ("x", 1), "y2": ("y", 1)}).where("t2 - t_ms <= 10000 AND hypot(x2 - x, y2 - y) <= 100")
    hit = p.join(b, "journey_id").where("t_ms < at AND at < t2 AND at - t_ms <= 5000 AND t2 - at <= 5000")
    f = (F.col("at") - F.col("t_ms")) / (F.col("t2") - F.col("t_ms"))
    return hit.select("journey_id", F.col("at").alias("t_ms"), F.round(geo.interpolate("x", "x2", f), 4).alias("x"), F.round(geo.interpolate("y", "y2", f), 4).alias("y"))


@query("win20_ferry_review", "trace", f"""WITH z AS (SELECT journey_id, seq, t_ms, x, y, x BETWEEN 300 AND 1400 AND speed_mps >= 0 AS marine, CASE WHEN x < 200 THEN 1 WHEN x > 1500 THEN 2 ELSE 0 END AS port FROM trace WHERE accuracy_m <= 35),
m AS (SELECT *, lag(t_ms) OVER (PARTITION BY journey_id ORDER BY seq) AS pt, lag(x) OVER (PARTITION BY journey_id ORDER BY seq) AS px FROM z WHERE marine), i AS (SELECT *, sum(CASE WHEN t_ms - pt > 600000 THEN 1 ELSE 0 END) OVER (PARTITION BY journey_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM m),
r AS (SELECT journey_id, run, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS fixes, sum(CASE WHEN t_ms - pt <= 600000 THEN abs(x - px) ELSE 0 END) AS d FROM i GROUP BY 1, 2 HAVING count(*) >= 4 AND max(t_ms) - min(t_ms) >= 180000 AND sum(CASE WHEN t_ms - pt <= 600000 THEN abs(x - px) ELSE 0 END) >= 600)
SELECT r.journey_id, r.first_seq, r.last_seq, fixes, (SELECT arg_max(port, z.seq) FROM z WHERE z.journey_id = r.journey_id AND z.seq < r.first_seq AND port <> 0) AS origin, (SELECT arg_min(port, z.seq) FROM z WHERE z.journey_id = r.journey_id AND z.seq > r.last_seq AND port <> 0) AS arrival FROM r""")
def _(t):
    z = t.trace.where("accuracy_m <= 35").selectExpr("journey_id", "seq", "t_ms", "x", "x BETWEEN 300 AND 1400 AND speed_mps >= 0 AS marine", "CASE WHEN x < 200 THEN 1 WHEN x > 1500 THEN 2 ELSE 0 END AS port")
    m = z.where("marine")
    p = running(m, ["journey_id"], seq_chunk(), ["seq"], {"prev": ("last", F.struct("t_ms", "x"))}, exclusive=True)
    i = islands(p, ["journey_id"], seq_chunk(), ["seq"], F.coalesce(F.col("t_ms") - F.col("prev.t_ms") > 600_000, F.lit(False)), "run")
    step = F.when(F.col("t_ms") - F.col("prev.t_ms") <= 600_000, F.abs(F.col("x") - F.col("prev.x"))).otherwise(0.0)
    r = (i.groupBy("journey_id", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("fixes"), F.sum(step).alias("d"), (F.max("t_ms") - F.min("t_ms")).alias("span"))
         .where("fixes >= 4 AND span >= 180000 AND d >= 600"))
    ports = running(z, ["journey_id"], seq_chunk(), ["seq"], {"origin": ("last", F.expr("nullif(port, 0)")), "arrival": ("next", F.expr("nullif(port, 0)"))})
    a = r.join(ports.select("journey_id", F.col("seq").alias("first_seq"), "origin"), ["journey_id", "first_seq"])
    return a.join(ports.select("journey_id", F.col("seq").alias("last_seq"), "arrival"), ["journey_id", "last_seq"]).select("journey_id", "first_seq", "last_seq", "fixes", "origin", "arrival")


@query("win21_reversals", "obs", f"WITH c AS (SELECT journey_id, seq, CAST(floor(x / 30) AS BIGINT) AS c, lag(CAST(floor(x / 30) AS BIGINT)) OVER w AS c1, lag(CAST(floor(x / 30) AS BIGINT), 2) OVER w AS c2 FROM obs {W}) SELECT journey_id, count(*) FILTER (c = c2 AND c <> c1) AS reversals, count(*) FILTER (c = c1) AS repeats FROM c GROUP BY 1")
def _(t):
    c = t.obs.select("journey_id", "seq", F.floor(F.col("x") / 30).alias("c"))
    p = neighbours(c, ["journey_id"], "seq", {"c1": ("c", -1), "c2": ("c", -2)})
    return p.groupBy("journey_id").agg(F.count_if(F.expr("c = c2 AND c <> c1")).alias("reversals"), F.count_if(F.expr("c = c1")).alias("repeats"))


@query("win22_endpoint_drop", "fixes", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY journey_id ORDER BY seq DESC) AS k, count(*) OVER (PARTITION BY journey_id) AS c FROM fixes), p AS (SELECT a.journey_id, a.seq, {hav('b.lat', 'b.lng', 'a.lat', 'a.lng', '6371008.8')} AS jump, a.t_ms - b.t_ms AS dt FROM n a JOIN n b ON a.journey_id = b.journey_id AND a.k = 1 AND b.k = 2 WHERE a.c >= 3)
SELECT journey_id, seq, CAST(round(jump) AS BIGINT) AS jump_m FROM p WHERE jump >= 500 AND dt BETWEEN 0 AND 6000000""")
def _(t):
    # The last two fixes by one combinable maximum per journey.
    ends = t.fixes.groupBy("journey_id").agg(F.max("seq").alias("last"))
    p = neighbours(t.fixes, ["journey_id"], "seq", {"b": (F.struct("lat", "lng", "t_ms"), -1)}).join(ends, "journey_id").where("seq = last AND last >= 2")
    jump = geo.haversine_m("b.lat", "b.lng", "lat", "lng", geo.EARTH_MEAN_M)
    return p.where((jump >= 500) & (F.col("t_ms") - F.col("b.t_ms")).between(0, 6_000_000)).select("journey_id", "seq", F.round(jump).cast("long").alias("jump_m"))


@query("win23_split_journey", "trace", """WITH b AS (SELECT journey_id, k * (10 + journey_id % 7) AS cut, k FROM (SELECT DISTINCT journey_id FROM trace), (SELECT unnest([1, 2]) AS k)), r AS (SELECT t.journey_id, t.seq, (SELECT count(*) FROM b WHERE b.journey_id = t.journey_id AND b.cut < t.seq) AS part, t.seq IN (SELECT cut FROM b WHERE b.journey_id = t.journey_id) AS edge FROM trace t)
SELECT journey_id || '-' || part AS part_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS points FROM (SELECT journey_id, seq, part FROM r UNION ALL SELECT journey_id, seq, part + 1 FROM r WHERE edge) GROUP BY 1""")
def _(t):
    cut = F.expr("10 + journey_id % 7")
    rows = t.trace.select("journey_id", "seq", cut.alias("c"))
    part = F.least(F.lit(2), F.greatest(F.lit(0), F.ceil(F.col("seq") / F.col("c")) - 1))
    edge = (F.col("seq") > 0) & (F.col("seq") % F.col("c") == 0) & (F.col("seq") <= F.col("c") * 2)
    both = rows.withColumn("part", F.explode(F.when(edge, F.array(part, part + 1)).otherwise(F.array(part))))
    return both.groupBy("journey_id", "part").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("points")).select(
        F.concat_ws("-", F.col("journey_id").cast("string"), F.col("part").cast("string")).alias("part_id"), "first_seq", "last_seq", "points")


@query("win24_vehicle_tail", "trace", "WITH " + RUN_SQL.replace("FROM trace", "FROM (SELECT * REPLACE (CASE WHEN seq >= 30 THEN speed_mps + 6 ELSE speed_mps END AS speed_mps) FROM trace)").replace("{moving}", "speed_mps >= 6 AND accuracy_m <= 25").replace("{moving_prev}", "ps >= 6 AND pacc <= 25") + ", g AS (SELECT journey_id, min(seq) AS first_seq FROM is_ WHERE mv GROUP BY journey_id, run HAVING count(*) >= 3 AND max(t_ms) - min(t_ms) >= 20000 AND sum(credit) >= 30) SELECT journey_id, min(first_seq) AS tail_seq FROM g GROUP BY 1")
def _(t):
    z = t.trace.withColumn("speed_mps", F.when(F.col("seq") >= 30, F.col("speed_mps") + 6).otherwise(F.col("speed_mps")))
    return T.sustained_runs(z, ["journey_id"], F.expr("speed_mps >= 6 AND accuracy_m <= 25"), 3, 20_000, 30.0).groupBy("journey_id").agg(F.min("first_seq").alias("tail_seq"))


@query("srt02_top_facts", "fixes", "SELECT event_id, t_ms FROM fixes ORDER BY accuracy_m, t_ms, event_id LIMIT 7")
def _(t):
    return t.fixes.orderBy("accuracy_m", "t_ms", "event_id").limit(7).select("event_id", "t_ms")


@query("srt01_orderings", "journeys", "SELECT journey_id, distance_m FROM journeys")
def _(t):
    return t.journeys.select("journey_id", "distance_m").orderBy(F.desc_nulls_last("distance_m"), "journey_id")


@query("srt03_key_page", "journeys", "SELECT journey_id, start_ms FROM journeys WHERE journey_id > 5000 ORDER BY journey_id LIMIT 500")
def _(t):
    # One page after a cursor: the filter reaches the scan, the limit is a TakeOrdered.
    return t.journeys.where("journey_id > 5000").orderBy("journey_id").limit(500).select("journey_id", "start_ms")
