"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, fold_ascii, query, table

#: A word: ASCII letters and digits (folded) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_IN_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Folds A-Z and turns what is in no word into spaces, so that splitting bytes gives the words.
_FOLDED = bytes(FOLD[c] if FOLD[c] in _IN_WORD else 0x20 for c in range(256))
_SPAN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW = 10
#: Item words that one automaton holds. It bounds what is sent to every task (about 30 MB a
#: million words); a larger benchmark is cut into more automata, which the texts pass one after another.
SHARD_WORDS = 1_000_000


def words_of_bytes(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


class SuffixAutomaton:
    """Automaton of all runs of words of many items (online construction, reset at every item)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._filter(coded)
        # The windows that end in a state: the full ones by the state of their last `window` words,
        # the items shorter than a window by the state that is reached by the whole item.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self._tail: dict[int, int] = {}
        self._ends: dict[int, list[tuple[int, str]]] = {}
        for name, words in coded:
            state, size = 0, 0
            for w in words:
                state, size = self.step(state, size, w)
                if size >= window:
                    self.full.setdefault(self.tail(state), set()).add(name)
            if len(words) < window:
                own = self.short.setdefault(state, [])
                if (len(words), name) not in own:
                    own.append((len(words), name))
        self.least = min([window, *(len(words) for _, words in coded)])

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, w, known)
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.next.append({})
        at = last
        while at != -1 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at != -1:
            known = self.next[at][w]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._clone(at, w, known)
        return new

    def _clone(self, at: int, w: int, known: int) -> int:
        copy = len(self.length)
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[known])
        self.next.append(dict(self.next[known]))
        self.link[known] = copy
        while at != -1 and self.next[at].get(w) == known:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        """State and length of the longest run of item words that ends with word `w`."""
        while state and w not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        target = self.next[state].get(w)
        return (0, 0) if target is None else (target, size + 1)

    def tail(self, state: int) -> int:
        """The state of the last `window` words, for a state reached by at least so many."""
        known = self._tail.get(state)
        if known is None:
            known = state
            while self.length[self.link[known]] >= self.window:
                known = self.link[known]
            self._tail[state] = known
        return known

    def ends(self, state: int) -> list[tuple[int, str]]:
        """Whole short items that are suffixes of the runs of a state: (words, item)."""
        known = self._ends.get(state)
        if known is None:
            known, at = [], state
            while at > 0:
                known += self.short.get(at, [])
                at = self.link[at]
            self._ends[state] = known
        return known

    def _filter(self, coded: list[tuple[str, list[int]]]) -> None:
        """A hashed bit for every pair of neighbouring item words: texts skip places without one."""
        pairs = {(a << 32) | b for _, words in coded for a, b in zip(words, words[1:])}
        bits = max(16, (16 * len(pairs)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._pairs = np.zeros(1 << bits, dtype=bool)
        if pairs:
            self._pairs[self._slot(np.array(sorted(pairs), dtype=np.uint64))] = True

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair * np.uint64(0x9E3779B97F4A7C15)) >> self._shift

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of a text that can hold a window: known words, known neighbours, long enough."""
        known = ids >= 0
        if self.least > 1:
            if len(ids) < 2:
                return
            pair = (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:].astype(np.uint64)
            known = known[:-1] & known[1:]
            known[known] = self._pairs[self._slot(pair[known])]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        extra = int(self.least > 1)
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + extra >= self.least:
                yield a, b + extra

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans covered by occurring windows (ascending, apart), and the items of those windows."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in self.runs(ids):
            state, size = 0, 0
            for place, w in enumerate(ids[a:b].tolist(), a + 1):
                if w < 0:
                    state, size = 0, 0
                    continue
                state, size = self.step(state, size, w)
                reach = 0
                if size >= self.window:
                    reach = size
                    items |= self.full[self.tail(state)]
                for count, name in self.ends(state) if self.short else ():
                    if count <= size:
                        reach = max(reach, count)
                        items.add(name)
                if reach:
                    first = place - reach
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, place))
        return spans, items


_automata: dict[int, SuffixAutomaton] = {}


def _automaton(shared, window: int) -> SuffixAutomaton:
    """One automaton for a worker process, built from the broadcast items at first use."""
    key = shared.value["key"]
    if (key, window) not in _automata:
        _automata[(key, window)] = SuffixAutomaton(shared.value["items"], window)
    return _automata[(key, window)]


HITS = T.StructType([T.StructField("n_words", T.LongType()),
                     T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))),
                     T.StructField("items", T.ArrayType(T.StringType()))])


def _pass(batches, text: str, shared, window: int, schema: pa.Schema):
    automaton = _automaton(shared, window)
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        old = columns.get("_hits")
        out = []
        for i, value in enumerate(columns[text]):
            words = words_of_bytes(value.as_buffer().to_pybytes()) if value.is_valid else []
            spans, items = automaton.hits(words)
            if old is not None and (before := old[i].as_py()):
                items |= set(before["items"])
                spans = united(spans + [(s["a"], s["b"]) for s in before["spans"]])
            out.append({"n_words": len(words), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(items)})
        columns["_hits"] = pa.array(out, schema.field("_hits").type)
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hitter(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, shard_words: int):
    """The schema with `_hits`, and what turns the batches of a task into such rows.

    All automata and whatever follows run in one generator, so that a task needs one Python
    worker: chained maps would hold a worker each, which stay in memory after their stage.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    sized = rows.withColumn("n", F.size(F.coalesce(F.regexp_extract_all(fold_ascii(F.col("text")), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))))
    total = sized.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    automata = []
    for shard in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        items = [(r["item"], words_of_bytes((r["text"] or "").encode())) for r in part.collect()]  # about shard_words; an item is never split
        automata.append(docs.sparkSession.sparkContext.broadcast({"key": hashlib.sha256(repr(items).encode()).hexdigest(), "items": items}))
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "_hits"], T.StructField("_hits", HITS)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for shared in automata:
            batches = _pass(batches, text, shared, window, arrow)
        return batches

    return schema, run


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
              window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """All columns of `docs` and `_hits` (n_words, spans of hit words, items with occurring windows, sorted as strings).

    A window is `window` consecutive words of an item, or a whole shorter item.
    Each text streams through the automaton of the items; the longest match at
    every word tells which windows end there. No shuffle, no join.

    Null texts and items have no words; a null item id is named `null`; repeated
    rows are judged alike; an empty benchmark hits nothing; extra columns stay.
    """
    docs = docs.drop("_hits")
    schema, run = _hitter(docs, benchmark, text, item, item_text, window, shard_words)
    return docs.mapInArrow(run, schema)


def _cut(batches, text: str, columns: list[str], coverage: float, schema: pa.Schema):
    for batch in batches:
        frame = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        keep, texts = [], []
        for value, hits in zip(frame[text], frame["_hits"]):
            hits = hits.as_py()
            covered = sum(s["b"] - s["a"] for s in hits["spans"])
            keep.append(covered <= coverage * hits["n_words"])
            if not keep[-1] or not covered:
                texts.append(value.as_py())
                continue
            raw = value.as_buffer().to_pybytes()
            places = [m.span() for m in _SPAN.finditer(raw)]
            parts, at = [], 0
            for s in hits["spans"]:
                parts.append(raw[at:places[s["a"]][0]])
                at = places[s["b"] - 1][1]
            texts.append(b"".join([*parts, raw[at:]]).decode())
        frame[text] = pa.array(texts, pa.string())
        if "n_chars" in columns and text == "text":
            frame["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([frame[f.name].cast(f.type) for f in schema], schema=schema).filter(pa.array(keep, pa.bool_()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = 0.5, item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` without the spans that benchmark windows cover; rows covered beyond `coverage` are left out.

    Columns stay as they are, except the text and an `n_chars` column, which follows it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if "_hits" in docs.columns:  # a column of the caller's, which stays
        free = "_" + max(docs.columns, key=len)
        return decontaminate(docs.withColumnRenamed("_hits", free), benchmark, text, coverage, item, item_text, window,
                             shard_words).withColumnRenamed(free, "_hits")

    columns, arrow = docs.columns, to_arrow_schema(docs.schema)
    _, run = _hitter(docs, benchmark, text, item, item_text, window, shard_words)
    return docs.mapInArrow(lambda b: _cut(run(b), text, columns, coverage, arrow), docs.schema)


_FOLD_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_decontamination", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD_SQL}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD_SQL}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
k AS (SELECT item_id, least(len(w), {WINDOW}) AS k, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS i FROM d, (SELECT DISTINCT k FROM k) ks)),
m AS MATERIALIZED (SELECT doc_id, k, i, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op4_decontamination(spark, folder):
    found = find_hits(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select("doc_id", F.col("_hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
                        F.size("_hits.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
