"""Wide rows against a list of keys, with a sieve of bits in front of the exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of the sieve, as `bitmap_construct_agg` makes them.
SLOT = 32_768
#: Bits a key; one row in this many passes without being asked for.
BITS = 16
#: Rows of the sieve, 8 MB. With more keys than fit more rows pass, and the join still decides.
SLOTS = 2_048


def _sieved(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """`rows` with `_may`, which is false only for keys that `ids` do not hold."""
    bits = min(SLOTS, max(1, -(-ids.count() * BITS // SLOT))) * SLOT

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    sieve = (ids.select(place(F.col(key)).alias("_place")).select(F.floor(F.col("_place") / SLOT).alias("_slot"), (F.col("_place") % SLOT).alias("_at"))
             .repartition("_slot").groupBy("_slot").agg(F.bitmap_construct_agg("_at").alias("_bits")))
    at = F.col("_place") % SLOT
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    placed = rows.withColumn("_place", place(F.col(key))).withColumn("_slot", F.floor(F.col("_place") / SLOT))
    return placed.join(F.broadcast(sieve), "_slot", "left").withColumn("_may", F.coalesce(hit, F.lit(False))).select(*rows.columns, "_may")


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Semi join: rows whose `key` is in `ids`, a kept table of one column of that name.

    A plain join shuffles all rows, whatever their width, before it knows how few are asked for. Here
    the others are told by a broadcast of at most 8 MB; those that pass go through the exact join.
    """
    return _sieved(rows, key, ids).where("_may").drop("_may").join(ids, key, "left_semi")


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Anti join: rows whose `key` is not in `ids`; only those that may be take part in a shuffle."""
    told = _sieved(rows, key, ids)
    doubted = told.where("_may").drop("_may").join(ids, key, "left_anti").select(*rows.columns)
    return told.where("NOT _may").drop("_may").unionByName(doubted)
