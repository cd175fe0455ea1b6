"""As-of joins in which every pick depends on the one before."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .ordered import dense_seq, running, seq_chunk
from .scans import scan_sorted

HOUR_MS = 3_600_000
_BEFORE_ALL = -(1 << 60)


# Rows and samples of a key that one task takes in order; a longer key goes by rounds.
KEY_ROWS = 1 << 18


def asof_chain(route: DataFrame, evidence: DataFrame, keys: list[str], place: str, seq: str, at: str, name: str = "picked_at", most: int = KEY_ROWS) -> DataFrame:
    """Add to each route row the earliest evidence time of its place that is later than the previous pick of its key.

    Rows are taken by `seq` (a whole number, unique in a key); a row without such evidence gets null and leaves the previous pick as it is.
    `at` is a whole number of milliseconds. Nulls in keys, place, seq or time match nothing.

    Keys of at most `most` rows and samples are taken in order, sorted and streamed by Spark: a task holds the samples
    of one key. Longer keys, whose rows no task should hold, are settled by rounds over all of them (`_by_rounds`).
    """
    group = [*keys, place]
    visits = route.select(*group, F.lit(1).alias("_side"), F.col(seq).cast("long").alias("_at")).dropna()
    times = evidence.select(*group, F.lit(0).alias("_side"), F.col(at).cast("long").alias("_at")).dropna().distinct()
    rows = written(visits.unionByName(times), "asof")
    long = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys))
    apart = not long.isEmpty()
    short = rows.join(long, keys, "left_anti") if apart else rows
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + f", {seq} long, {name} long"
    # Samples sort before the visits of their key.
    picked = scan_sorted(short, keys, ["_side", "_at"], [place, "_side", "_at"], _Picks, schema)
    if apart:
        rest = rows.join(long, keys, "left_semi")
        picked = picked.unionByName(_by_rounds(rest.where("_side = 1"), rest.where("_side = 0"), keys, place, "_at").select(
            *keys, F.col("_at").alias(seq), F.col("_pick").alias(name)))
    return route.join(picked, [*keys, seq], "left")


class _Picks:
    """The picks of one key, whose samples come first."""

    def __init__(self, head):
        self.head, self.last, self.times, self.from_ = head, _BEFORE_ALL, {}, {}

    def row(self, place, side, at):
        if side == 0:
            self.times.setdefault(place, []).append(at)
            return
        waiting = self.times.get(place, ())
        # Picks only rise, so no later visit looks before this place again.
        k = self.from_[place] = bisect_right(waiting, self.last, self.from_.get(place, 0))
        if k < len(waiting):
            self.last = waiting[k]
            yield (*self.head, at, self.last)

    def end(self):
        return ()


def _by_rounds(route: DataFrame, evidence: DataFrame, keys: list[str], place: str, at: str) -> DataFrame:
    """(keys, seq, pick) of keys of any length; visits and samples hold their seq and time in `at`.

    Picks only rise along a key, so they are the limit of lower bounds: a round takes the running maximum of the bounds before a row, finds the first
    sample behind it, and lets the n-th visit to a place take no sample that an earlier visit needs (a running maximum over its visits).
    A round is a few chunked passes, with no pairs of visits and samples. Rounds follow how often picks push each other across places, at worst one a row.
    """
    group, seq = [*keys, place], at
    samples = cut_lineage(dense_seq(evidence.select(*group, F.col(at).alias("_t")), group, ["_t"], F.floor(F.col("_t") / HOUR_MS), "_no"))
    visits = dense_seq(route.select(*group, seq), group, [seq], seq_chunk(seq), "_visit")
    state = cut_lineage(visits.withColumn("_pick", F.lit(None).cast("long")))
    marks = samples.withColumn("_side", F.lit(0))
    while True:
        behind = running(state, keys, seq_chunk(seq), [seq], {"_prev": ("max", "_pick")}, exclusive=True)
        asked = behind.select(*group, seq, "_visit", F.col("_pick").alias("_old"), F.coalesce("_prev", F.lit(_BEFORE_ALL)).alias("_t"), F.lit(1).alias("_side"))
        # A sample at the very time of the previous pick is not later: it sorts before the question.
        both = asked.unionByName(marks, allowMissingColumns=True)
        found = running(both, group, F.floor(F.col("_t") / HOUR_MS), ["_t", "_side", seq], {"_first": ("next", "_no")}).where("_side = 1")
        pushed = running(found.select(*group, seq, "_visit", "_old", "_first"), group, seq_chunk(seq), [seq],
                         {"_lead": ("max", F.col("_first") - F.col("_visit"))})
        wanted = pushed.withColumn("_no", F.when(F.col("_first").isNotNull(), F.col("_visit") + F.col("_lead")))
        state = cut_lineage(wanted.join(samples, [*group, "_no"], "left").select(
            *group, seq, "_visit", F.col("_t").alias("_pick"), (~F.col("_t").eqNullSafe(F.col("_old"))).alias("_moved")))
        if state.where("_moved").isEmpty():
            break
        state = state.drop("_moved")
    return state.select(*keys, seq, "_pick")
