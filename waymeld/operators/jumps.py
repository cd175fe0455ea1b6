"""Resetting scans as jump pointers: where would the scan restart if it restarted here?

A rule such as "the next row 25 m behind the last kept one" depends on all kept rows, but
the row that would follow a given row does not. Followers are looked up for every row at once
(`first_from`); the rows that the scan really visits are those reached from a head. Keys of bounded
length are followed in order by one task. In longer ones followers
are doubled, so the rounds grow with the logarithm of the longest run, and the
doubled tables are walked back from the longest jump to the shortest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import running
from .scans import scan_sorted

# Rows of a key that one task follows in order; a longer key goes by rounds.
KEY_ROWS = 1 << 18


def first_from(rows: DataFrame, keys: list[str], at: str, seq: str, width: float, probes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add for each probe (place, usable) the least `seq` of the usable rows of the key whose `at` is `place` or more.

    `at` may repeat; it must not fall with `seq`. Rows and probes are sorted together in
    chunks of `width` along `at`, so no key is held by one task. Null places find nothing.
    """
    flags = [F.coalesce(ok, F.lit(False)).alias(f"_ok_{n}") for n, (_, ok) in probes.items()]
    places = [place.cast(dict(rows.dtypes)[at]) for place, _ in probes.values()]
    sides = F.array(F.struct(F.lit(-1).alias("probe"), F.col(at).alias("place")),
                    *[F.struct(F.lit(i).alias("probe"), place.alias("place")) for i, place in enumerate(places)])
    # A probe sorts before the rows at its place.
    both = (rows.select(*keys, seq, *flags, F.explode(sides).alias("_s")).select(*keys, seq, *[f"_ok_{n}" for n in probes], "_s.*")
            .where("place IS NOT NULL").withColumn("_row", (F.col("probe") < 0).cast("int")))
    values = {n: ("next", F.when((F.col("_row") == 1) & F.col(f"_ok_{n}"), F.col(seq))) for n in probes}
    found = running(both, keys, F.floor(F.col("place") / width), ["place", "_row", seq, "probe"], values).where("_row = 0")
    mine = [F.max(F.when(F.col("probe") == i, F.col(n))).alias(n) for i, n in enumerate(probes)]
    return rows.join(found.groupBy(*keys, seq).agg(*mine), [*keys, seq], "left")


def reached(steps: DataFrame, keys: list[str], seq: str, follower: str, head: str, most: int = KEY_ROWS) -> DataFrame:
    """(keys, seq) of the rows reached from the rows flagged `head` by following `follower`.

    Followers have a greater `seq` of the same key, or are null. (keys, seq) is unique and holds no null.
    """
    # A row without a follower points to itself, so that whole numbers stay whole in a task.
    steps = cut_lineage(steps.dropna(subset=[*keys, seq]).select(*keys, seq, F.coalesce(F.col(follower), F.col(seq)).alias("_to"), F.coalesce(F.col(head), F.lit(False)).alias("_head")))
    long = cut_lineage(steps.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in steps.select(*keys, seq).schema)
    if long.isEmpty():
        return scan_sorted(steps, keys, [seq], [seq, "_to", "_head"], _Followed, schema)
    short = scan_sorted(steps.join(long, keys, "left_anti"), keys, [seq], [seq, "_to", "_head"], _Followed, schema)
    return short.unionByName(_by_rounds(steps.join(long, keys, "left_semi"), keys, seq))


class _Followed:
    """The rows of one key that are reached, in order."""

    def __init__(self, key):
        self.key, self.next = key, set()

    def row(self, seq, to, head):
        if head or seq in self.next:
            self.next.discard(seq)
            if to != seq:
                self.next.add(to)
            yield (*self.key, seq)

    def end(self):
        return ()


def _by_rounds(steps: DataFrame, keys: list[str], seq: str) -> DataFrame:
    jumps = [cut_lineage(steps.where(F.col("_to") != F.col(seq)).select(*keys, seq, "_to"))]
    while True:
        ahead = jumps[-1].select(*keys, F.col(seq).alias("_to"), F.col("_to").alias("_next"))
        longer = cut_lineage(jumps[-1].join(ahead, [*keys, "_to"]).select(*keys, seq, F.col("_next").alias("_to")))
        if longer.isEmpty():
            break
        jumps.append(longer)
    seen = steps.where("_head").select(*keys, seq)
    for jump in reversed(jumps):
        # One jump from different rows can lead to one row; each row is kept once.
        seen = cut_lineage(seen.unionByName(seen.join(jump, [*keys, seq]).select(*keys, F.col("_to").alias(seq))).distinct())
    return seen
