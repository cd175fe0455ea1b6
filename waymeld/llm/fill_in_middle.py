"""Fill-in-the-middle: documents cut at line ends into prefix, middle and suffix, in PSM or SPM order.

Where a document's lines end is found by chunks: a rolling hash over the bytes cuts a
text where its contents say so, so that passages shared between documents become equal
chunks. A task remembers the summary of each chunk (line ends, characters)
under the chunk's bytes; sums of summaries tell the chunk of a cut, and its line ends the place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of the documents that are transformed, and of these in SPM order.
RATE, SPM = 100, 50
#: A chunk has LEAST to MOST bytes; a place ends one where AVERAGE_BITS bits of the rolling hash are zero.
LEAST, MOST, AVERAGE_BITS = 64, 4096, 8
#: Bytes of chunks that a task remembers; beyond it the memory starts anew, which changes no result.
MEMO_BYTES = 32_000_000
#: The rolling hash adds a random number for each byte value; a number leaves after 32 bytes.
_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at every place: the sum of their numbers, each shifted by its distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def chunk_ends(raw: bytes) -> list[int]:
    """End of every chunk: a place that the rolling hash names, at least LEAST and at most MOST bytes after the last one."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    h = rolling(np.frombuffer(raw, np.uint8))
    named = (np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + 1).tolist()
    ends, at = [], 0
    for place in [*named, n]:
        while place - at > MOST:
            at += MOST
            ends.append(at)
        if place - at >= LEAST or (place == n and at < n):
            at = place
            ends.append(at)
    return ends


class ChunkMemory:
    """Summaries by a chunk's bytes; the table compares bytes, so an equal hash is never taken for an equal chunk."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.held, self.known = most, 0, {}
        self.hits = 0

    def summary(self, chunk: bytes) -> tuple[np.ndarray, int]:
        """(places behind each line feed, characters) of a chunk."""
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        data = np.frombuffer(chunk, np.uint8)
        found = (np.flatnonzero(data == 10) + 1, int(np.count_nonzero((data & 0xC0) != 0x80)))
        if self.held + len(chunk) > self.most:
            self.known, self.held = {}, 0
        self.known[chunk] = found
        self.held += len(chunk) + 200
        return found

    def lines(self, raw: bytes) -> "Lines":
        ends = chunk_ends(raw)
        starts = [0, *ends[:-1]]
        return Lines(raw, starts, [self.summary(raw[a:b]) for a, b in zip(starts, ends)])


class Lines:
    """Line counts of a text, combined from its chunks."""

    def __init__(self, raw: bytes, starts: list[int], parts: list[tuple[np.ndarray, int]]):
        self.raw, self.starts, self.parts = raw, starts, parts
        self.feeds = np.cumsum([len(p[0]) for p in parts]) if parts else np.zeros(0, np.int64)
        self.chars = np.cumsum([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        whole = int(self.feeds[-1]) if parts else 0
        self.count = whole + (1 if raw and not raw.endswith(b"\n") else 0)

    def cut(self, lines: int) -> tuple[int, int]:
        """(byte, character) behind the first `lines` lines."""
        if not lines:
            return 0, 0
        if lines >= self.count:
            return len(self.raw), int(self.chars[-1]) if self.parts else 0
        i = int(np.searchsorted(self.feeds, lines))  # the chunk with that line feed
        inside = int(self.parts[i][0][lines - 1 - (int(self.feeds[i - 1]) if i else 0)])
        at = self.starts[i] + inside
        part = np.frombuffer(self.raw, np.uint8, inside, self.starts[i])
        return at, (int(self.chars[i - 1]) if i else 0) + int(np.count_nonzero((part & 0xC0) != 0x80))


def draws(key: int | None, seed: int) -> list[int]:
    """Four numbers of a document: the first 8-digit groups of the SHA-256 of `seed:key` (nothing for a null key)."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]


def transform(key: int | None, raw: bytes, memory: ChunkMemory, seed: int = SEED, rate: int = RATE, spm: int = SPM):
    """(lines, form, prefix characters, middle characters, output) of one text."""
    lines = memory.lines(raw)
    h1, h2, h3, h4 = draws(key, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not raw or h3 % 100 >= rate or any(m in raw for m in marks):
        return lines.count, "plain", None, None, raw
    a, b = sorted((h1 % (lines.count + 1), h2 % (lines.count + 1)))
    (x, chars), (y, upto) = lines.cut(a), lines.cut(b)
    p, m, s = raw[:x], raw[x:y], raw[y:]
    if h4 % 100 < spm:
        return lines.count, "spm", chars, upto - chars, b"".join((marks[1], s, marks[0], p, marks[2], m))
    return lines.count, "psm", chars, upto - chars, b"".join((marks[0], p, marks[1], s, marks[2], m))


_FOUND = ["n", "form", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row; no shuffle, whole texts, repeated rows alike.

    Two draws from the document's key choose the cuts among its lines. `plain` documents (empty or
    null texts, texts that hold a marker, those beyond `rate` percent) are put out as they
    are, with null counts; a null key draws as an empty one; a text of one line has an empty
    prefix, middle or suffix. The memory of chunks is bounded; one text at a time is held.
    An empty table gives no rows; other columns are not passed on.
    """
    def run(batches):
        memory = ChunkMemory()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                block = batch.slice(at, 256)
                rows = [transform(k, x.as_buffer().to_pybytes() if x.is_valid else b"", memory, seed, rate, spm)
                        for k, x in zip(block.column(0).to_pylist(), block.column(1))]
                n, form, chars, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(chars, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.binary()).cast(pa.string())], names=["k", *_FOUND])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    found = rows.mapInArrow(run, "k long, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.select(F.col("k").alias(key), *_FOUND)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Markers stand in no transformed text, so each is found at its first place."""
    def after(mark):
        return F.substring_index(output, mark, -1)

    def between(first, second):
        return F.substring_index(F.substring_index(output, second, 1), first, -1)

    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


@query("op13_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS w, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1))::BIGINT AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1))::BIGINT AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, len(w)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM p""")
def op13_fill_in_middle(spark, folder):
    found = fill_in_middle(table(spark, folder, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
