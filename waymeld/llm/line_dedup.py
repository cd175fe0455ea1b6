"""Line dedup by winnowing: fingerprints of line windows find repeated runs, the later ones are deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, query, table

#: Lines in a window: every repeated run of at least so many lines holds a common fingerprint.
WINDOW = 2
#: Words from which a single line counts as a run of its own where a caller asks for that (`long_words`).
LONG_WORDS = 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _spoken(lines: Column) -> Column:
    """Places of the lines with a word; the others are in no run and stay."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())


def _marks(hashes: Column, window: int) -> Column:
    """For every window start the place of its fingerprint: the rightmost least hash."""
    def lowest(s: Column) -> Column:
        # (negative place, hash): the least hash first, then the rightmost.
        entries = [F.struct(hashes[s + j]["h"].alias("h"), (-(s + j)).alias("back")) for j in range(window)]
        return -(reduce(F.least, entries) if window > 1 else entries[0])["back"]
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lowest)


def blocks(docs: DataFrame, text: str, keys: list[str], window: int) -> DataFrame:
    """A row for each fingerprint: its hash, the block of lines whose windows chose it, and those windows.

    A block runs from the first window that chose the place to the end of the last
    one. Equal lines around a place make equal blocks, wherever they stand.
    """
    def per_text(lines: Column) -> Column:
        hashes = F.transform(F.filter(lines, lambda x: x.rlike(WORD)),
                             lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g")))
        return let(hashes, lambda hs: F.when(F.size(hs) >= window, let(_marks(hs, window), lambda ms: _cut(hs, ms, window))))

    return (docs.select(*keys, F.explode(let(_lines(F.col(text)), per_text)).alias("b")).select(*keys, "b.*"))


def _cut(hashes: Column, marks: Column, window: int) -> Column:
    opens = F.filter(F.transform(marks, lambda p, s: F.struct(s.alias("s"), p.alias("p"))),
                     lambda x: (x["s"] == 0) | (marks[F.greatest(x["s"] - 1, F.lit(0))] != x["p"]))

    def block(x: Column, following: Column) -> Column:
        content = F.slice(hashes, x["s"] + 1, following - x["s"] + window - 1)
        windows = F.transform(F.sequence(x["s"], following - 1), lambda s: F.struct(
            s.alias("start"), F.xxhash64(F.transform(F.slice(hashes, s + 1, window), lambda e: e["h"])).alias("wh"),
            F.xxhash64(F.transform(F.slice(hashes, s + 1, window), lambda e: e["g"])).alias("wg")))
        return F.struct(hashes[x["p"]]["h"].alias("mark"), (x["p"] - x["s"]).alias("inset"),
                        F.xxhash64(F.transform(content, lambda e: e["h"])).alias("bh"),
                        F.xxhash64(F.transform(content, lambda e: e["g"])).alias("bg"),
                        x["s"].alias("start"), F.size(content).alias("lines"), windows.alias("windows"))

    return let(opens, lambda o: F.transform(o, lambda x, i: block(
        x, F.when(i + 1 < F.size(o), o[F.least(i + 1, F.size(o) - 1)]["s"]).otherwise(F.size(marks)))))


def long_lines(docs: DataFrame, text: str, keys: list[str], words: int) -> DataFrame:
    """A row for each line of at least `words` words: its ordinal among the lines with a word, and two hashes of the line."""
    def per_text(lines: Column) -> Column:
        return F.filter(F.transform(F.filter(lines, lambda x: x.rlike(WORD)), lambda x, i: F.struct(
            i.alias("start"), F.regexp_count(x, F.lit(WORD)).alias("n"), F.xxhash64(x).alias("wh"), F.xxhash64(F.lit(7), x).alias("wg"))),
            lambda x: x["n"] >= words)

    return docs.select(*keys, F.explode(let(_lines(F.col(text)), per_text)).alias("w")).select(*keys, "w.start", "w.wh", "w.wg")


def _split_first(rows: DataFrame, content: list[str], place: list[str]) -> DataFrame:
    """Add `_later`: whether equal content stands at an earlier place. Only the least place of a content is gathered."""
    at = F.struct(*place)
    first = rows.groupBy(*content).agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(first, content, "left").withColumn("_later", F.coalesce(at > F.col("_first"), F.lit(False))).drop("_first")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   long_words: int | None = None) -> DataFrame:
    """(key, _hash, deleted): per text the ordinals, among its lines with a word, of all lines in later runs.

    A line goes if it lies in a window of `window` such lines that stands, line for
    line, at an earlier place (order: key, then place in the text). With `long_words`
    a line of at least so many words also goes if it alone stands at an earlier
    place, whatever its neighbours; its first copy always stays. Fingerprints are
    joined by block first, which settles copied passages as a whole whatever
    the number of copies; only one block of each content then has its windows
    compared, which extends a match to both sides up to the last equal window.
    No pairs are formed: each content keeps its least place.
    """
    keys = [key, "_hash"]
    docs = docs.withColumn("_hash", F.xxhash64(text))
    found = blocks(docs, text, keys, window)
    place = [key, "_hash", "start"]
    judged = _split_first(found, ["mark", "inset", "bh", "bg"], place)
    whole = judged.where("_later").select(*keys, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)).alias("line"))
    single = judged.where("NOT _later").select(*keys, "mark", F.explode("windows").alias("w")).select(*keys, "mark", "w.*")
    later = _split_first(single, ["mark", "wh", "wg"], place).where("_later")
    parts = later.select(*keys, F.explode(F.sequence(F.col("start"), F.col("start") + window - 1)).alias("line"))
    if long_words is not None:
        alone = _split_first(long_lines(docs, text, keys, long_words), ["wh", "wg"], place).where("_later")
        parts = parts.unionByName(alone.select(*keys, F.col("start").alias("line")))
    return whole.unionByName(parts).groupBy(*keys).agg(F.collect_set("line").alias("deleted"))


def _shortened(docs: DataFrame, key: str, text: str, window: int, long_words: int | None) -> DataFrame:
    """(caller, text, n_lines, n_deleted, n_runs): the caller's row as one struct, out of the way of the names used here."""
    rows = docs.select(F.struct(*docs.columns).alias("caller"), F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    gone = repeated_lines(rows.select("key", "text"), "key", "text", window, long_words)
    both = rows.alias("a").join(gone.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.hash") == F.col("b._hash")), "left")

    def kept(lines: Column) -> Column:
        spoken = let(_spoken(lines), lambda s: F.transform(F.col("b.deleted"), lambda i: s[i]))
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), spoken)
        return F.array_join(F.transform(rest, lambda i: lines[i]), "\n")

    short = F.when(F.col("b.deleted").isNull(), F.col("a.text")).otherwise(let(_lines(F.col("a.text")), kept))
    runs = let(F.sort_array("b.deleted"), lambda d: F.size(F.filter(
        d, lambda x, i: (i == 0) | (d[F.greatest(i - 1, F.lit(0))] != x - 1))))
    return both.select("caller", short.alias("text"), F.size(_spoken(_lines(F.col("a.text")))).cast("long").alias("n_lines"),
                       F.coalesce(F.size("b.deleted"), F.lit(0)).cast("long").alias("n_deleted"),
                       F.when(F.col("b.deleted").isNull(), 0).otherwise(runs).cast("long").alias("n_runs"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    long_words: int | None = None) -> DataFrame:
    """`docs` with the text shortened, and `_n_lines`, `_n_deleted`, `_n_runs`.

    Null texts stay null. Identical rows (same key, same text) share one fate: none
    is later than the other. A null key sorts first. Empty tables and texts without
    a repeated run come back as they are; columns with the names of the three counts are replaced, others stay.
    """
    counts = ("n_lines", "n_deleted", "n_runs")
    return _shortened(docs, key, text, window, long_words).select(
        *[F.col("text").alias(c) if c == text else F.col("caller")[c].alias(c) for c in docs.columns if c.removeprefix("_") not in counts or c in counts],
        *[F.col(c).alias(f"_{c}") for c in counts])


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                long_words: int | None = None) -> DataFrame:
    """`docs` with later repeated runs deleted, in the same columns; `n_chars` follows the text.

    Texts that held words and lost all of them are copies of earlier lines and are left out.
    Nulls, ties, repeated rows and empty tables as in `without_repeats`; every other column stays, whatever its name.
    """
    rows = _shortened(docs, key, text, window, long_words).where("n_deleted = 0 OR n_deleted < n_lines")
    own = {text: F.col("text")} | ({"n_chars": F.length("text").cast("long")} if text == "text" else {})
    return rows.select(*[own.get(c, F.col("caller")[c]).alias(c) for c in docs.columns])


@query("op9_line_dedup", rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT doc_id, i, l[i + 1] AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS o FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM t) WHERE regexp_matches(l[i + 1], '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, o, line, lead(line) OVER (PARTITION BY doc_id ORDER BY o) AS line2 FROM s),
f AS (SELECT doc_id, o, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, o) AS k FROM w WHERE line2 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, o + j AS o FROM f, (VALUES (0), (1)) v(j) WHERE k > 1),
r AS (SELECT doc_id, count(*) AS n_deleted, count(*) FILTER (prev IS NULL OR prev <> o - 1) AS n_runs FROM (SELECT doc_id, o, lag(o) OVER (PARTITION BY doc_id ORDER BY o) AS prev FROM g) GROUP BY 1),
k AS (SELECT t.doc_id, string_agg(l[i + 1], chr(10) ORDER BY i) AS text FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM t) t LEFT JOIN (SELECT s.doc_id, s.i FROM s JOIN g USING (doc_id, o)) x USING (doc_id, i) WHERE x.doc_id IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY 1)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(k.text, '')) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op9_line_dedup(spark, folder):
    rows = without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"),
                       F.col("_n_runs").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
