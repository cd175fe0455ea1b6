"""Journey-shaped views over the given tables, for Spark and for SQL.

The given tables hold no coordinates, so each view derives the columns of one
input of the engine (fixes, spans, anchors, ...) from whole tables. `SQL` holds
the same views for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import dense_seq, spread
from ..session import measure_broadcasts, measure_partitions

# Local metres to degrees around (51 N, 1 W), used by `trace`, `obs` and `net`.
LAT_M, LNG_M = 111195.08, 69978.0

SQL = {
    "fixes": """
SELECT CAST(user_id * 100 + EXTRACT(day FROM ts) AS BIGINT) AS journey_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id, EXTRACT(day FROM ts) ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
       event_id, user_id, ts, epoch_us(ts) // 1000 AS t_ms,
       CAST(51.0 AS DOUBLE) + CAST(user_id % 40 AS DOUBLE) / 100 + CAST((event_id * 7919) % 1000 AS DOUBLE) / 100000 AS lat,
       CAST(-1.0 AS DOUBLE) + CAST(user_id % 60 AS DOUBLE) / 100 + CAST((event_id * 104729) % 1000 AS DOUBLE) / 100000 AS lng,
       CAST(2 + event_id % 60 AS DOUBLE) AS accuracy_m,
       CAST((event_id * 31) % 250 AS DOUBLE) / 10 AS speed_mps,
       CASE user_id % 5 WHEN 0 THEN 'driving' WHEN 1 THEN 'bus' WHEN 2 THEN 'walking' WHEN 3 THEN 'cycling' ELSE 'train' END AS mode
FROM events""",
    "activities": """
SELECT event_id AS activity_id, user_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 10800000 AS end_ms, event_type AS source_mode
FROM events""",
    "spans": """
SELECT l_partkey AS edge_id, l_orderkey AS journey_id, l_linenumber AS line_no,
       CASE l_linenumber % 2 WHEN 0 THEN 'cycling' ELSE 'on_foot' END AS mode,
       CAST((l_orderkey * 7919) % 90000 AS BIGINT) AS start_mm,
       CAST((l_orderkey * 7919) % 90000 + 1 + CAST(FLOOR(l_quantity) AS BIGINT) * 100 AS BIGINT) AS end_mm
FROM lineitem""",
    "edges": """
SELECT p_partkey AS edge_id, p_brand AS label, CASE p_size % 4 WHEN 0 THEN 'NI' ELSE 'GB' END AS region,
       CAST(100000 AS BIGINT) AS length_mm
FROM part""",
    "anchors": """
SELECT p_partkey AS anchor_id, 'A' || CAST(p_partkey % 20 + 1 AS STRING) AS road_ref,
       CAST(51.0 AS DOUBLE) + CAST((p_partkey * 7919) % 4100 AS DOUBLE) / 10000 AS lat,
       CAST(-1.0 AS DOUBLE) + CAST((p_partkey * 104729) % 6100 AS DOUBLE) / 10000 AS lng
FROM part""",
    "venues": """
SELECT s_suppkey AS venue_id, s_name AS name, s_nationkey AS box_id,
       CAST(51.0 AS DOUBLE) + CAST((s_suppkey * 523) % 410 AS DOUBLE) / 1000 AS lat,
       CAST(-1.0 AS DOUBLE) + CAST((s_suppkey * 811) % 610 AS DOUBLE) / 1000 AS lng
FROM supplier""",
    "visits": """
SELECT o_orderkey AS visit_id, o_custkey AS user_id, o_custkey % 10 + 1 AS venue_id,
       CAST((o_orderkey * 37) % 43200 AS BIGINT) AS start_min,
       CAST((o_orderkey * 37) % 43200 + 5 + o_orderkey % 40 AS BIGINT) AS end_min
FROM orders""",
    "boxes": """
SELECT n_nationkey AS box_id, n_name AS name, n_regionkey AS county_id,
       CAST(-1.0 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * 12 / 100 AS west,
       CAST(-1.0 AS DOUBLE) + CAST(n_nationkey % 5 + 1 AS DOUBLE) * 12 / 100 AS east,
       CAST(51.0 AS DOUBLE) + CAST((n_nationkey - n_nationkey % 5) AS DOUBLE) / 5 * 8 / 100 AS south,
       CAST(51.0 AS DOUBLE) + CAST((n_nationkey - n_nationkey % 5) + 5 AS DOUBLE) / 5 * 8 / 100 AS north
FROM nation""",
    "road_refs": """
SELECT p_partkey AS feature_id, p_name AS road_name,
       CASE p_partkey % 6 WHEN 0 THEN 'M' || CAST(p_size AS STRING)
                          WHEN 1 THEN 'A' || CAST(p_size AS STRING) || '(M); A' || CAST(p_size + 1 AS STRING)
                          WHEN 2 THEN 'a ' || CAST(p_size AS STRING)
                          WHEN 3 THEN 'M6 Toll/M42'
                          WHEN 4 THEN 'B' || CAST(p_size AS STRING)
                          ELSE '' END AS road_ref,
       CASE p_partkey % 7 WHEN 0 THEN 'service' WHEN 1 THEN 'primary_link' ELSE 'primary' END AS highway,
       p_retailprice AS distance_m
FROM part""",
    # One long recording per user: 24 moving fixes, 12 standing ones, a pause after every 12.
    "trace": """
SELECT user_id AS journey_id, seq, event_id, user_id, CAST(1704067200000 + seq * 20000 + (seq // 12) * 200000 + (event_id % 13) * 1000 AS BIGINT) AS t_ms,
       x, y, 51.0 + y / 111195.08 AS lat, -1.0 + x / 69978.0 AS lng,
       CASE WHEN event_id % 37 = 0 THEN 80.0 ELSE CAST(2 + event_id % 9 AS DOUBLE) END AS accuracy_m,
       CASE WHEN event_id % 7 = 0 THEN -1.0 WHEN seq % 36 < 24 THEN 1.0 + CAST(event_id % 10 AS DOUBLE) / 10 ELSE 0.0 END AS speed_mps,
       mode
FROM (SELECT *, CAST(((seq // 36) * 24 + least(seq % 36, 24)) * 30 + (event_id * 7919) % 7 - 3 AS DOUBLE) AS x,
             CAST((user_id % 50) * 60 + (event_id * 104729) % 7 - 3 AS DOUBLE) AS y
      FROM (SELECT user_id, event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
                   CASE user_id % 5 WHEN 0 THEN 'driving' WHEN 1 THEN 'bus' WHEN 2 THEN 'walking' WHEN 3 THEN 'cycling' ELSE 'train' END AS mode
            FROM events))""",
    # Dense driving observations along the rows of `net`, 12 m and 2 s apart.
    "obs": """
SELECT user_id AS journey_id, seq, event_id, CAST(1704067200000 + seq * 2000 + (event_id % 2) * 500 + (seq // 40) * 30000 AS BIGINT) AS t_ms,
       CAST((seq * 12) % 1140 + (event_id * 7919) % 3 - 1 AS DOUBLE) AS x,
       CAST((user_id % 50) * 60 + (event_id * 104729) % 5 - 2 AS DOUBLE) AS y,
       CAST(1 + event_id % 6 AS DOUBLE) AS accuracy_m
FROM (SELECT user_id, event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq FROM events)""",
    # A street grid of 60 m blocks, 20 columns wide, one edge per part.
    "net": """
SELECT p_partkey AS edge_id, p_brand AS label,
       CASE p_size % 5 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS direction, p_size % 10 <> 0 AS eligible,
       CAST((p_partkey // 40) * 1000 + (p_partkey % 40) // 2 AS BIGINT) AS a_node,
       CAST(CASE WHEN p_partkey % 2 = 0 THEN (p_partkey // 40) * 1000 + (p_partkey % 40) // 2 + 1 ELSE (p_partkey // 40 + 1) * 1000 + (p_partkey % 40) // 2 END AS BIGINT) AS b_node,
       CAST(((p_partkey % 40) // 2) * 60 AS DOUBLE) AS ax, CAST((p_partkey // 40) * 60 AS DOUBLE) AS ay,
       CAST(((p_partkey % 40) // 2) * 60 + CASE WHEN p_partkey % 2 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS bx,
       CAST((p_partkey // 40) * 60 + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 60 END AS DOUBLE) AS by,
       CAST(60000 AS BIGINT) AS length_mm
FROM part""",
    # Source ways bound piecewise to target offsets: three bindings per way.
    "bindings": """
SELECT CAST(p_partkey % 10 AS BIGINT) AS route_id, p_partkey AS way_id, CAST(p_partkey // 2 AS BIGINT) AS target_id, CAST(k AS BIGINT) AS piece,
       CAST(k * 30000 + p_size * 10 AS BIGINT) AS start_mm, CAST(k * 30000 + 24000 + p_size * 10 AS BIGINT) AS end_mm,
       CAST(k * 30000 AS BIGINT) AS low_mm, CAST(k * 30000 + 24000 AS BIGINT) AS high_mm,
       CASE WHEN p_size % 3 = k THEN 'on_foot' ELSE 'on_foot,cycling' END AS modes
FROM part, (SELECT unnest([0, 1, 2]) AS k)""",
    # Travelled features of journeys (one matched road feature per order line).
    "features": """
SELECT l_orderkey AS journey_id, l_linenumber AS feature_idx, p_partkey AS feature_id, o_custkey AS user_id, epoch_ms(o_orderdate) AS start_ms,
       CASE o_orderkey % 4 WHEN 0 THEN 'foot' ELSE 'driving' END AS mode,
       CASE p_partkey % 6 WHEN 0 THEN 'M' || CAST(p_size AS STRING)
                          WHEN 1 THEN 'A' || CAST(p_size AS STRING) || '(M); A' || CAST(p_size + 1 AS STRING)
                          WHEN 2 THEN 'A' || CAST(p_size AS STRING)
                          WHEN 3 THEN CAST(p_size AS STRING)
                          WHEN 4 THEN 'B' || CAST(p_size AS STRING)
                          ELSE '' END AS road_ref,
       CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name || ' ' || CAST(p_size AS STRING) END AS road_name,
       CASE p_size % 7 WHEN 0 THEN 'service' WHEN 1 THEN 'primary_link' WHEN 2 THEN 'residential' ELSE 'primary' END AS highway,
       CASE p_size % 4 WHEN 0 THEN 'NI' ELSE 'GB' END AS region, CAST(l_quantity * 100 AS BIGINT) AS distance_m,
       CAST(o_custkey % 25 AS BIGINT) AS town_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "journeys": """
SELECT o_orderkey AS journey_id, o_custkey AS user_id, epoch_ms(o_orderdate) AS start_ms, o_orderstatus AS status,
       CASE o_orderkey % 6 WHEN 0 THEN 'driving' WHEN 1 THEN 'walking' WHEN 2 THEN 'train' WHEN 3 THEN 'cycling' WHEN 4 THEN 'bus' ELSE 'running' END AS mode,
       CAST(FLOOR(o_totalprice) AS BIGINT) AS distance_m, o_orderkey % 3 = 0 AS matched,
       CAST(2 + o_orderkey % 50 AS BIGINT) AS points,
       51.0 + CAST(o_custkey % 40 AS DOUBLE) / 100 AS lat0, -1.0 + CAST(o_custkey % 60 AS DOUBLE) / 100 AS lng0,
       51.0 + CAST((o_custkey + o_orderkey % 3) % 40 AS DOUBLE) / 100 AS lat1, -1.0 + CAST((o_custkey + o_orderkey % 3) % 60 AS DOUBLE) / 100 AS lng1
FROM orders""",
}


def with_views(names: str, body: str) -> str:
    """SQL for the check: the named views as CTEs, then `body` (may add CTEs)."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split())
    body = body.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """The given tables and the derived views as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        measure_broadcasts(spark)
        measure_partitions(spark, folder)
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        build = _BUILD.get(name)
        return build(self) if build else self.table(name)


def _mode(user: str = "user_id"):
    return F.expr(f"CASE {user} % 5 WHEN 0 THEN 'driving' WHEN 1 THEN 'bus' WHEN 2 THEN 'walking' "
                  f"WHEN 3 THEN 'cycling' ELSE 'train' END")


def _events(t: Tables) -> DataFrame:
    return t.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


def _unnumbered_fixes(t: Tables) -> DataFrame:
    """`fixes` without their place in the journey, which takes no shuffle."""
    return _events(t).select(
        F.expr("user_id * 100 + extract(day FROM ts)").cast("long").alias("journey_id"), "event_id", "user_id", "ts", F.unix_millis("ts").alias("t_ms"),
        F.expr("51.0D + CAST(user_id % 40 AS DOUBLE) / 100 + CAST((event_id * 7919) % 1000 AS DOUBLE) / 100000").alias("lat"),
        F.expr("-1.0D + CAST(user_id % 60 AS DOUBLE) / 100 + CAST((event_id * 104729) % 1000 AS DOUBLE) / 100000").alias("lng"),
        F.expr("CAST(2 + event_id % 60 AS DOUBLE)").alias("accuracy_m"),
        F.expr("CAST((event_id * 31) % 250 AS DOUBLE) / 10").alias("speed_mps"), _mode().alias("mode"))


def _fixes(t: Tables) -> DataFrame:
    rows = _events(t).withColumn("journey_id", F.expr("user_id * 100 + extract(day FROM ts)").cast("long"))
    rows = dense_seq(rows, ["journey_id"], ["ts", "event_id"], F.date_trunc("minute", "ts"))
    return rows.select(
        "journey_id", "seq", "event_id", "user_id", "ts", F.unix_millis("ts").alias("t_ms"),
        F.expr("51.0D + CAST(user_id % 40 AS DOUBLE) / 100 + CAST((event_id * 7919) % 1000 AS DOUBLE) / 100000").alias("lat"),
        F.expr("-1.0D + CAST(user_id % 60 AS DOUBLE) / 100 + CAST((event_id * 104729) % 1000 AS DOUBLE) / 100000").alias("lng"),
        F.expr("CAST(2 + event_id % 60 AS DOUBLE)").alias("accuracy_m"),
        F.expr("CAST((event_id * 31) % 250 AS DOUBLE) / 10").alias("speed_mps"), _mode().alias("mode"))


def _numbered(t: Tables) -> DataFrame:
    """Events numbered along each user's whole recording."""
    return dense_seq(_events(t), ["user_id"], ["ts", "event_id"], F.date_trunc("minute", "ts"))


def _trace(t: Tables) -> DataFrame:
    rows = _numbered(t).select(
        "*", F.expr("CAST(((seq DIV 36) * 24 + least(seq % 36, 24L)) * 30 + (event_id * 7919) % 7 - 3 AS DOUBLE)").alias("x"),
        F.expr("CAST((user_id % 50) * 60 + (event_id * 104729) % 7 - 3 AS DOUBLE)").alias("y"))
    return rows.select(
        F.col("user_id").alias("journey_id"), "seq", "event_id", "user_id",
        F.expr("1704067200000L + seq * 20000 + (seq DIV 12) * 200000 + (event_id % 13) * 1000").alias("t_ms"),
        "x", "y", F.expr("51.0D + y / 111195.08D").alias("lat"), F.expr("-1.0D + x / 69978.0D").alias("lng"),
        F.expr("CASE WHEN event_id % 37 = 0 THEN 80.0D ELSE CAST(2 + event_id % 9 AS DOUBLE) END").alias("accuracy_m"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN -1.0D WHEN seq % 36 < 24 THEN 1.0D + CAST(event_id % 10 AS DOUBLE) / 10 ELSE 0.0D END").alias("speed_mps"),
        _mode().alias("mode"))


def _obs(t: Tables) -> DataFrame:
    return _numbered(t).select(
        F.col("user_id").alias("journey_id"), "seq", "event_id",
        F.expr("1704067200000L + seq * 2000 + (event_id % 2) * 500 + (seq DIV 40) * 30000").alias("t_ms"),
        F.expr("CAST((seq * 12) % 1140 + (event_id * 7919) % 3 - 1 AS DOUBLE)").alias("x"),
        F.expr("CAST((user_id % 50) * 60 + (event_id * 104729) % 5 - 2 AS DOUBLE)").alias("y"),
        F.expr("CAST(1 + event_id % 6 AS DOUBLE)").alias("accuracy_m"))


def _from_sql(name: str, table: str):
    """Views that are a plain projection of one table share the SQL text."""
    text = SQL[name].replace("//", " DIV ").replace(" AS STRING", " AS STRING")

    def build(t: Tables) -> DataFrame:
        for part in table.split():
            t.table(part).createOrReplaceTempView(f"_{part}")
        import re
        body = text
        for part in table.split():
            body = re.sub(rf"\b(FROM|JOIN) {part}\b", rf"\1 _{part}", body)
        return t.spark.sql(body)
    return build


def _activities(t: Tables) -> DataFrame:
    e = t.table("events")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("activity_id"), "user_id", start.alias("start_ms"),
        (start + 10_800_000).alias("end_ms"), F.col("event_type").alias("source_mode"))


def _bindings(t: Tables) -> DataFrame:
    k = t.table("part").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return k.selectExpr(
        "CAST(p_partkey % 10 AS BIGINT) AS route_id", "p_partkey AS way_id", "p_partkey DIV 2 AS target_id", "CAST(k AS BIGINT) AS piece",
        "CAST(k * 30000 + p_size * 10 AS BIGINT) AS start_mm", "CAST(k * 30000 + 24000 + p_size * 10 AS BIGINT) AS end_mm",
        "CAST(k * 30000 AS BIGINT) AS low_mm", "CAST(k * 30000 + 24000 AS BIGINT) AS high_mm",
        "CASE WHEN p_size % 3 = k THEN 'on_foot' ELSE 'on_foot,cycling' END AS modes")


def _features(t: Tables) -> DataFrame:
    rows = (spread(t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
            .join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.table("part"), F.col("l_partkey") == F.col("p_partkey")))
    lines = SQL["features"].split("SELECT", 1)[1].rsplit("FROM lineitem", 1)[0]
    lines = lines.replace("epoch_ms(o_orderdate)", "unix_millis(CAST(o_orderdate AS TIMESTAMP))")
    rows.createOrReplaceTempView("_feature_rows")
    return t.spark.sql(f"SELECT {lines} FROM _feature_rows")


def _journeys(t: Tables) -> DataFrame:
    t.table("orders").createOrReplaceTempView("_orders")
    text = SQL["journeys"].replace("epoch_ms(o_orderdate)", "unix_millis(CAST(o_orderdate AS TIMESTAMP))")
    return t.spark.sql(text.replace("FROM orders", "FROM _orders").replace("51.0 +", "51.0D +").replace("-1.0 +", "-1.0D +"))


_BUILD = {
    "fixes": _fixes, "unnumbered_fixes": _unnumbered_fixes, "trace": _trace, "obs": _obs, "activities": _activities, "bindings": _bindings,
    "features": _features, "journeys": _journeys,
    "spans": _from_sql("spans", "lineitem"), "edges": _from_sql("edges", "part"),
    "anchors": _from_sql("anchors", "part"), "venues": _from_sql("venues", "supplier"),
    "visits": _from_sql("visits", "orders"), "boxes": _from_sql("boxes", "nation"),
    "road_refs": _from_sql("road_refs", "part"), "net": _from_sql("net", "part"),
}
