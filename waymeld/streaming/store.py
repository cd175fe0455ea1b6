"""Keyed tables that micro-batches maintain: only the buckets that a batch touches are read and rewritten.

A bucket is a folder of Parquet files under the number of the batch that wrote it last; a
manifest tells which. A batch starts from the newest manifest below its own number and commits
by writing the next one, so a replayed batch sees what it saw before and writes the same
again. Two manifest slots alternate, so a lost writer leaves the other whole. When
buckets pass their size, all of them are split in two; a row is moved that way about as
often as the store doubles.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most buckets of which a manifest is kept; a bucket then grows with the store.
MOST_BUCKETS = 1 << 16


class BucketStore:
    """`tables` maps a name to (key column, schema)."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, str]], buckets: int = 16, limit: int = 500_000):
        self.spark, self.folder, self.tables = spark, folder, tables
        self.first, self.limit = buckets, limit
        self.read_rows = 0  # rows in the buckets read since the start, for those who watch the cost

    def _slot(self, slot: int) -> dict | None:
        try:
            rows = self.spark.read.text(f"{self.folder}/manifest-{slot}", wholetext=True).collect()
        except AnalysisException:  # not written yet
            return None
        return json.loads(rows[0][0]) if rows else None

    def _manifests(self) -> list[dict]:
        return [m | {"slot": s} for s in (0, 1) if (m := self._slot(s))]

    def latest(self) -> dict | None:
        return max(self._manifests(), key=lambda m: m["number"], default=None)

    def begin(self, number: int) -> None:
        """Take the state before batch `number`, split where buckets have grown."""
        before = [m for m in self._manifests() if m["number"] < number]
        base = max(before, key=lambda m: m["number"], default=None)
        self.number, self.into = number, 1 - base["slot"] if base else 0
        self.buckets = base["buckets"] if base else self.first
        self.state = {t: dict(base["state"].get(t, {})) if base else {} for t in self.tables}
        while self.buckets < MOST_BUCKETS and any(sum(r for _, r in s.values()) > self.limit * self.buckets for s in self.state.values()):
            self._split()

    def _split(self) -> None:
        every = {t: self._open(t, self.state[t]) for t in self.tables}
        self.buckets *= 2
        for t, rows in every.items():
            self.state[t] = self._write(t, rows, f"{self.number}-{self.buckets}")

    def _bucket(self, key) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys in the only column of `keys`: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket(keys.columns[0]).alias("b")).distinct().collect())

    def _open(self, table: str, state: dict) -> DataFrame:
        key, schema = self.tables[table]
        if not state:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{table}/v={v}/bucket={b}" for b, (v, _) in sorted(state.items())])

    def read(self, table: str, buckets: Iterable[int]) -> DataFrame:
        """All rows of these buckets as they were before this batch (or as it has written them by now)."""
        wanted = set(map(str, buckets))
        state = {b: s for b, s in self.state[table].items() if b in wanted}
        self.read_rows += sum(r for _, r in state.values())
        return self._open(table, state)

    def _write(self, table: str, rows: DataFrame, version: str) -> dict:
        key, schema = self.tables[table]
        at = f"{self.folder}/{table}/v={version}"
        b = rows.select(*self._columns(table)).withColumn("bucket", self._bucket(key))
        b.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(at)
        try:
            counts = self.spark.read.parquet(at).groupBy("bucket").count().collect()
        except AnalysisException:  # nothing was written
            counts = []
        return {str(r[0]): (version, r[1]) for r in counts}

    def _columns(self, table: str) -> list[str]:
        return [c.split()[0] for c in self.tables[table][1].split(", ")]

    def write(self, table: str, buckets: Iterable[int], rows: DataFrame) -> None:
        """Replace these buckets by `rows`, which hold all that is to stay in them."""
        for b in buckets:
            self.state[table].pop(str(b), None)
        self.state[table] |= self._write(table, rows, str(self.number))

    def commit(self) -> None:
        text = json.dumps({"number": self.number, "buckets": self.buckets, "state": self.state})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest-{self.into}")

    def table(self, name: str) -> DataFrame:
        """The whole table as of the newest commit."""
        newest = self.latest()
        return self._open(name, newest["state"].get(name, {}) if newest else {})
