"""Writers: keyed files with a manifest, merges, load gates and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import digest_number


def manifest(df: DataFrame, key: str) -> DataFrame:
    """Rows, bytes and an order-free digest per key."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    return (df.select(key, body.alias("_b")).groupBy(key)
            .agg(F.count("*").alias("rows"), F.sum(F.octet_length("_b")).cast("long").alias("bytes"), F.sum(digest_number("_b")).alias("digest")))


def write_keyed(df: DataFrame, key: str, folder: str) -> DataFrame:
    """One partition folder per key plus `_manifest`; returns the manifest.

    Rows are spread by (key, hash) so that a hot key is written by many tasks.
    """
    spread = df.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    spread.repartition(key, "_s").drop("_s").write.mode("overwrite").partitionBy(key).json(f"{folder}/data")
    m = manifest(df, key)
    m.write.mode("overwrite").json(f"{folder}/manifest")
    return m


def geojson_lines(df: DataFrame, line: str, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature a row in `value`."""
    coords = F.transform(F.col(line), lambda p: F.array(p["x"], p["y"]))
    return df.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"))).alias("value"))


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert: the row with the highest version wins, new rows on a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = F.max(F.struct(version, "_new", *[c for c in rest if c != version])).alias("_b")
    return both.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def fill_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keep every stored value; only absent ones come from the new rows."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in cols])


def loads_due(offered: DataFrame, load_log: DataFrame) -> DataFrame:
    """Loads whose checksum or row count is new; an unchanged one is skipped."""
    return offered.join(load_log, ["source_key", "checksum", "row_count"], "left_anti")


def load_areas(spark: SparkSession, areas: list[str], load) -> tuple[list[str], DataFrame]:
    """Run `load(area)` per configured area; failures are collected, others continue."""
    done, failed = [], []
    for area in areas:
        try:
            load(area)
            done.append(area)
        except Exception as error:  # the failure table is the result
            failed.append((area, type(error).__name__, str(error)))
    return done, spark.createDataFrame(failed, "area string, kind string, message string")


def additive_release(published: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(release, changed): additions join the published rows; a changed row is an error to report."""
    sha = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != key])), 256).alias("sha"))
    changed = sha(published).withColumnRenamed("sha", "old").join(sha(new), key).where("old <> sha").select(key)
    return published.unionByName(new.join(published.select(key), key, "left_anti")), changed


def newest_within(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The newest `most` rows of each key; a retention rule, ranked in two salted steps."""
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    first = Window.partitionBy(*keys, "_s").orderBy(F.desc(order))
    part = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return part.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= most).drop("_s", "_r")
