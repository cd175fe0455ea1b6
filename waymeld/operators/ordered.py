"""Ordered windows that survive a hot key.

A plain `Window.partitionBy(journey)` puts a whole journey into one task. Every
helper here first splits the key into value-defined chunks, works inside
(key, chunk), and carries one summary row per chunk across the chunk borders.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 32_768


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with too few splits to every core, before CPU-heavy expressions.

    Large inputs have more splits than cores and pass unchanged, so this never
    adds a shuffle at scale; one small file would otherwise run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def keep_parallel(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition for a CPU-heavy grouped function.

    AQE merges partitions by bytes, which would put many small but slow groups
    into one task; a fixed number of partitions is left alone.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _placed(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Rows shuffled once by (key, chunk), packed so that both users share the shuffle.

    The summary and the rows read the same exchange (the plan shows
    ReusedExchange): the packed row keeps column pruning from telling them apart.
    """
    named = df.withColumn("_chunk", chunk)
    present = F.col("_chunk").isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    packed = named.where(present).select(*keys, "_chunk", F.struct(*df.columns).alias("_row"))
    return packed.repartition(*keys, "_chunk")


def _whole_row() -> Column:
    # Refers to the packed row as a whole; its value is not used.
    return F.bit_xor(F.xxhash64("_row")).alias("_whole")


def dense_seq(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
              name: str = "seq") -> DataFrame:
    """0-based row number per key; `chunk` must rise with `order`."""
    rows = _placed(df, keys, chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), _whole_row())
               .where(F.col("_whole").isNotNull())
               .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(f"_row.{c}") for c in order])
    return (rows.join(offsets, [*keys, "_chunk"])
            .select("_row", (F.col("_before") + F.row_number().over(local) - 1).alias(name)).select("_row.*", name))


def neighbours(df: DataFrame, keys: list[str], seq: str, shifts: dict[str, tuple[Column | str, int]],
               size: int = CHUNK_ROWS) -> DataFrame:
    """lag / lead columns over a dense `seq`: name -> (expression, shift).

    A negative shift looks back, a positive one ahead. Rows next to a chunk
    border are copied into the neighbouring chunk, so one shuffle suffices and
    no task sorts more than `size` rows of one key.
    """
    back = max([0, *(-s for _, s in shifts.values())])
    ahead = max([0, *(s for _, s in shifts.values())])
    own = F.floor(F.col(seq) / size)
    offset = F.pmod(F.col(seq), F.lit(size))
    homes = F.filter(F.array(own,
                             F.when(offset >= size - back, own + 1),
                             F.when(offset < ahead, own - 1)), lambda c: c.isNotNull())
    spread = df.withColumn("_own", own).withColumn("_chunk", F.explode(homes))
    w = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    return (spread.select("*", *[F.lag(_col(e), -s).over(w).alias(n) if s < 0
                                 else F.lead(_col(e), s).over(w).alias(n)
                                 for n, (e, s) in shifts.items()])
            .where(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk"))


def running(df: DataFrame, keys: list[str], chunk: Column, order: list[str],
            specs: dict[str, tuple[str, Column | str]], exclusive: bool = False) -> DataFrame:
    """Running sum / max / last (non-null) or the next non-null, per key.

    `order` is ascending and total within a key; `chunk` rises with it.
    """
    inputs = {f"_v_{n}": _col(e) for n, (_, e) in specs.items()}
    rows = _placed(df.withColumns(inputs), keys, chunk)
    values = {n: F.col(f"_row._v_{n}") for n in specs}
    placed = [F.col(f"_row.{c}") for c in order]
    place = F.struct(*placed)
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*placed)
    upto = local.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    onward = local.rowsBetween(1 if exclusive else 0, Window.unboundedFollowing)
    per_chunk = {"sum": F.sum, "max": F.max}
    summary, carried, combined = [], [], []
    for name, (kind, _) in specs.items():
        v, s, c = values[name], F.col(f"_s_{name}"), F.col(f"_c_{name}")
        if kind in per_chunk:
            f = per_chunk[kind]
            summary.append(f(v).alias(f"_s_{name}"))
            carried.append(f(s).over(prior).alias(f"_c_{name}"))
            inner = f(v).over(upto)
            combined.append((F.coalesce(c, F.lit(0)) + F.coalesce(inner, F.lit(0)) if kind == "sum"
                             else F.greatest(c, inner)).alias(name))
        elif kind == "last":
            summary.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_s_{name}"))
            carried.append(F.last(s, True).over(prior).alias(f"_c_{name}"))
            combined.append(F.coalesce(F.last(v, True).over(upto), c).alias(name))
        elif kind == "next":
            summary.append(F.min_by(v, F.when(v.isNotNull(), place)).alias(f"_s_{name}"))
            carried.append(F.first(s, True).over(later).alias(f"_c_{name}"))
            combined.append(F.coalesce(F.first(v, True).over(onward), c).alias(name))
        else:
            raise ValueError(f"unknown running kind {kind!r}")
    carry = (rows.groupBy(*keys, "_chunk").agg(*summary, _whole_row()).where(F.col("_whole").isNotNull())
             .select(*keys, "_chunk", *carried))
    return (rows.join(carry, [*keys, "_chunk"])
            .select(*[F.col(f"_row.{c}").alias(c) for c in df.columns], *combined))


def islands(df: DataFrame, keys: list[str], chunk: Column, order: list[str],
            starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of a key; a row where `starts` holds opens one."""
    flagged = df.withColumn("_start", F.when(starts, 1).otherwise(0))
    return running(flagged, keys, chunk, order, {name: ("sum", "_start")}).drop("_start")


def seq_chunk(seq: str = "seq", size: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(seq) / size)


def overlapping_chunks(df: DataFrame, keys: Iterable[str], seq: str, total: str,
                       size: int, overlap: int) -> DataFrame:
    """Copy each row into the windows of `size` rows, `overlap` shared, it lies in.

    Rows get `chunk_no` and `pos`. Window c covers [c*step, c*step+size) and the
    last window is the first one to reach the end of the key.
    """
    step = max(1, size - overlap)
    last = F.when(F.col(total) <= size, F.lit(0)).otherwise(F.ceil((F.col(total) - size) / F.lit(step)))
    first = F.greatest(F.lit(0), F.ceil((F.col(seq) - size + 1) / F.lit(step)))
    final = F.least(last, F.floor(F.col(seq) / step))
    return (df.where(final >= first)
            .withColumn("chunk_no", F.explode(F.sequence(first.cast("long"), final.cast("long"))))
            .withColumn("pos", F.col(seq) - F.col("chunk_no") * step))


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], chunk_width: float) -> DataFrame:
    """Exact interpolated quantiles per key without gathering a key's values.

    Equal values collapse to counts map-side; the cumulative count finds the
    values at the two ranks around each quantile.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = running(counts, keys, F.floor(F.col(value) / F.lit(chunk_width)), [value], {"_upto": ("sum", "_n")})
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = upto.join(total, keys)
    picks = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("_total") - 1)
        covers = lambda rank: (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
        at = lambda rank: F.max(F.when(covers(rank), F.col(value)))
        share = F.max(place - F.floor(place))
        picks.append((at(F.floor(place)) * (1 - share) + at(F.ceil(place)) * share).alias(name))
    return ranked.groupBy(*keys).agg(*picks)
