"""Ledger upkeep and exactly-once recognition as foreachBatch steps over a `BucketStore`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import interval_union
from .store import BucketStore

_SPAN = "journey_id {id}, edge_id long, lo long, hi long"


class LedgerUpkeep:
    """Unique length per edge under replacement and removal of journeys.

    A batch holds (journey_id, edge_id, lo, hi): all spans of each journey it names; a journey with
    null edges only is removed. Current spans are kept twice, by journey and by edge: the
    first copy tells which edges a journey leaves, the second holds all that an edge's
    new length needs. Cost follows the touched buckets, not the history. Repeated spans count once in a
    length; a journey named in two batches keeps the later one. `ids` is the type of journey ids.
    """

    def __init__(self, folder: str, ids: str = "long", buckets: int = 16, limit: int = 500_000):
        self.folder, self.buckets, self.limit = folder, buckets, limit
        span = _SPAN.format(id=ids)
        self.tables = {"by_journey": ("journey_id", span), "by_edge": ("edge_id", span), "totals": ("edge_id", "edge_id long, unique_mm long")}
        self.rows_read: list[int] = []

    def store(self, spark: SparkSession) -> BucketStore:
        return BucketStore(spark, self.folder, self.tables, self.buckets, self.limit)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, self.store(batch.sparkSession)
        store.begin(number)
        # The batch is read several times; a written copy costs its source one pass.
        batch.select("journey_id", "edge_id", "lo", "hi").where("journey_id IS NOT NULL").write.mode("overwrite").parquet(f"{self.folder}/incoming")
        new = spark.read.parquet(f"{self.folder}/incoming")
        ids, fresh = new.select("journey_id").distinct(), new.where("edge_id IS NOT NULL")
        journeys = store.touched(ids)
        known = store.read("by_journey", journeys)
        edges = known.join(ids, "journey_id", "left_semi").select("edge_id").unionByName(fresh.select("edge_id")).distinct()
        edges.write.mode("overwrite").parquet(f"{self.folder}/touched")
        edges = spark.read.parquet(f"{self.folder}/touched")
        buckets = store.touched(edges)
        there, lengths = store.read("by_edge", buckets), store.read("totals", buckets)
        store.write("by_journey", journeys, known.join(ids, "journey_id", "left_anti").unionByName(fresh))
        store.write("by_edge", buckets, there.join(ids, "journey_id", "left_anti").unionByName(fresh))
        now = store.read("by_edge", buckets).join(edges, "edge_id", "left_semi")
        united = interval_union(now, ["edge_id"]).groupBy("edge_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("unique_mm"))
        # An edge that has lost its last span stays, with length 0.
        changed = edges.join(united, "edge_id", "left").select("edge_id", F.coalesce("unique_mm", F.lit(0)).cast("long").alias("unique_mm"))
        store.write("totals", buckets, lengths.join(edges, "edge_id", "left_anti").unionByName(changed))
        store.commit()
        self.rows_read.append(store.read_rows)

    def totals(self, spark: SparkSession) -> DataFrame:
        return self.store(spark).table("totals")


class ExactlyOnce:
    """Ids that no earlier batch has brought, each once and for good.

    A batch holds (id, ...); its new ids go to `recognised` under the batch's number, so
    a replayed batch rewrites the same rows. Acknowledged ids are kept without an end, in buckets by id,
    of which a batch reads those of its own ids. Null ids are not recognised.
    """

    def __init__(self, folder: str, ids: str = "long", buckets: int = 16, limit: int = 500_000):
        self.folder, self.buckets, self.limit = folder, buckets, limit
        self.tables = {"seen": ("id", f"id {ids}, batch long")}

    def store(self, spark: SparkSession) -> BucketStore:
        return BucketStore(spark, self.folder, self.tables, self.buckets, self.limit)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, self.store(batch.sparkSession)
        store.begin(number)
        batch.select("id").where("id IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.folder}/incoming")
        ids = spark.read.parquet(f"{self.folder}/incoming")
        buckets = store.touched(ids)
        seen = store.read("seen", buckets)
        fresh = ids.join(seen.select("id"), "id", "left_anti").withColumn("batch", F.lit(number).cast("long"))
        store.write("seen", buckets, seen.unionByName(fresh))
        fresh = store.read("seen", buckets).where(F.col("batch") == number)
        fresh.write.mode("overwrite").parquet(f"{self.folder}/recognised/batch={number}")
        store.commit()

    def recognised(self, spark: SparkSession) -> DataFrame:
        """(id, batch) of every recognition."""
        return self.store(spark).table("seen")
