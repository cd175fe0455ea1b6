"""Interval unions, complements and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20


def interval_union(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi",
                   eps: float = 0, width: float = WIDTH) -> DataFrame:
    """Merge touching or overlapping [lo, hi] per key; empty intervals are dropped.

    1. An interval is cut where it crosses into the next chunk of `width`. Equal starts
       collapse before the shuffle (map-side max), so a repeated commute costs one row per map task.
    2. A local union runs inside (key, chunk): at most `width` distinct integer starts in one
       task, whatever the key holds.
    3. Only the pieces at a chunk's borders can touch those of other chunks, two at most, so
       they alone meet under the whole key. Nothing is read twice or joined, so plans stay
       small where unions follow each other.

    `width` should not be far below the usual length, since an interval has a row for each chunk it crosses.
    """
    present = F.col(lo).isNotNull() & F.col(hi).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    size, home = F.lit(width), F.floor(F.col(lo) / F.lit(width))
    last = F.greatest(home, F.ceil(F.col(hi) / size) - 1)
    cut = (df.where(present & (F.col(hi) > F.col(lo))).select(*keys, lo, hi, F.explode(F.sequence(home, last)).alias("_chunk"))
           .withColumn(lo, F.when(F.col("_chunk") > home, (F.col("_chunk") * size).cast(df.schema[lo].dataType)).otherwise(F.col(lo))))
    starts = cut.groupBy(*keys, "_chunk", lo).agg(F.max(hi).alias(hi))
    pieces = _merged(starts, [*keys, "_chunk"], lo, hi, eps)
    # A little slack, for widths and ends that are no whole numbers: a piece too many does no harm.
    slack = F.lit(eps + width * 1e-9)
    border = (F.col(lo) <= F.col("_chunk") * size + slack) | (F.col(hi) + slack >= (F.col("_chunk") + 1) * size)
    met = pieces.withColumn("_chunk", F.when(~border, F.col("_chunk")))
    return _merged(met, [*keys, "_chunk"], lo, hi, eps).select(*keys, lo, hi)


def _merged(df: DataFrame, keys: list[str], lo: str, hi: str, eps: float) -> DataFrame:
    """The union inside each key, by one sort of its rows."""
    w = Window.partitionBy(*keys).orderBy(lo)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = (df.withColumn("_reach", reach)
              .withColumn("_open", F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach") + F.lit(eps)), F.col(lo)))
              .withColumn("_root", F.last("_open", True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return opened.groupBy(*keys, "_root").agg(F.max(hi).alias(hi)).withColumnRenamed("_root", lo)


def covered_length(df: DataFrame, keys: list[str], by: list[str] | None = None,
                   lo: str = "lo", hi: str = "hi", name: str = "unique_mm", **kw) -> DataFrame:
    """Length of the union, summed over `by` (default: the union's own keys)."""
    merged = interval_union(df, keys, lo, hi, **kw)
    return merged.groupBy(*(by if by is not None else keys)).agg(
        F.sum(F.col(hi) - F.col(lo)).alias(name), F.count("*").alias("pieces"))


def missing_intervals(union: DataFrame, units: DataFrame, key: str, length: str,
                      lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Complement of a union inside [0, length] of each unit.

    Pieces of one unit are disjoint, so the piece after a gap is the next start.
    Units without pieces yield one full gap.
    """
    inside = (union.join(units.select(key, length), key)
              .select(key, length, F.greatest(lo, F.lit(0)).alias(lo), F.least(hi, F.col(length)).alias(hi))
              .where(F.col(hi) > F.col(lo)))
    edges = inside.select(key, F.explode(F.array(
        F.struct(F.col(lo).alias("at"), F.lit(1).alias("step")),
        F.struct(F.col(hi).alias("at"), F.lit(-1).alias("step")))).alias("e")).select(key, "e.*")
    bounds = units.select(key, F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(-1).alias("step")),
        F.struct(F.col(length).alias("at"), F.lit(1).alias("step")))).alias("e")).select(key, "e.*")
    # Gaps run from a closing mark to the next opening mark; both kinds of mark
    # alternate along a unit, so pairing needs only the next mark.
    from .ordered import running
    marks = edges.unionByName(bounds).groupBy(key, "at").agg(F.sum("step").alias("step")).where("step <> 0")
    paired = running(marks, [key], F.floor(F.col("at") / F.lit(WIDTH)), ["at"],
                     {"gap_hi": ("next", F.col("at"))}, exclusive=True)
    return (paired.where("step < 0 AND gap_hi IS NOT NULL")
            .select(key, F.col("at").alias("gap_lo"), "gap_hi"))


def buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / F.lit(width)), F.floor(hi / F.lit(width))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str,
                        lo: str, hi: str, width: float) -> DataFrame:
    """Inner join of points to the intervals (closed) holding them.

    Intervals are copied into the buckets they touch and points into one, so the
    join is an equi-join on (keys, bucket): a hot key spreads over its buckets.
    """
    left = points.withColumn("_bucket", F.floor(F.col(at) / F.lit(width)))
    right = intervals.withColumn("_bucket", buckets(F.col(lo), F.col(hi), width))
    return (left.join(right, [*keys, "_bucket"])
            .where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bucket"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str],
                 a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs with positive overlap; each pair appears once, in the bucket of its overlap start."""
    one = left.withColumn("_bucket", buckets(F.col(a[0]), F.col(a[1]), width))
    two = right.withColumn("_bucket", buckets(F.col(b[0]), F.col(b[1]), width))
    lo, hi = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    return (one.join(two, [*keys, "_bucket"])
            .where((hi > lo) & (F.col("_bucket") == F.floor(lo / F.lit(width)))).drop("_bucket"))
