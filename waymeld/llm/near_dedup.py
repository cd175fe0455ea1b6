"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, components.

Two permutations make a whole signature: `sigma` spreads the shingles over the
circle of 2 ** 32 places, and coordinate k is the least `pi` value of the places
turned by k. Both are bijections computed on the fly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.sieve import among, without
from ..session import cut_lineage, written
from .common import FOLD, query, table

SHINGLE = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair right at the threshold meets in no band with at most this probability.
MISS = 2.5e-8
#: Rows of one side that a task compares at once.
BLOCK = 512

_U64, _U32 = np.uint64, np.uint32


def banding(percent: float) -> tuple[int, int, float]:
    """(bands, rows of a band, screen) for a threshold.

    Four rows a band, fewer where that would take more than 64 bands. Two texts of one
    bucket go to verification if the share `screen` of their coordinates agrees: six
    standard deviations below the threshold.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"a threshold lies above 0 and up to 100, not at {percent}")
    share = percent / 100
    for rows in (4, 3, 2, 1):
        bands = max(1, ceil(log(MISS) / log1p(-share ** rows))) if share < 1 else 1
        if bands <= 64:
            break
    return bands, rows, share - 6 * (share * (1 - share) / (bands * rows)) ** 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = text.translate(FOLD).split()
    if not words:
        return np.zeros(0, _U64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(_U64)
    span = min(size, len(h))
    s = np.full(len(h) - span + 1, span, _U64)
    for j in range(span):
        s = s * _U64(0x9E3779B97F4A7C15) + h[j:j + len(s)]
    return np.unique(_mix(s))


def signature(places: np.ndarray, count: int, step: int = 512) -> np.ndarray:
    """Least pi value of every turn of the circle, over blocks of places that stay in the cache."""
    turns = np.arange(count, dtype=_U32)[:, None]
    best = np.full(count, 0xFFFFFFFF, _U32)
    for at in range(0, len(places), step):
        x = places[None, at:at + step] + turns
        t = x >> _U32(16)
        x ^= t
        x *= _U32(0x85EBCA6B)
        np.right_shift(x, _U32(13), out=t)
        x ^= t
        x *= _U32(0xC2B2AE35)
        np.right_shift(x, _U32(16), out=t)
        x ^= t
        np.minimum(best, x.min(axis=1), out=best)
    return best


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text"))


def _sign(batches, count: int):
    for batch in batches:
        out = []
        for raw in _texts(batch):
            s = shingles(raw)
            # sigma: an odd multiplier turns the high half of the hash into a place on the circle.
            places = (s >> _U64(32)).astype(_U32) * _U32(0x9E3779B1)
            out.append((len(s), int(s.sum(dtype=_U64).astype(np.int64)), int(_mix(s + _U64(1)).sum(dtype=_U64).astype(np.int64)),
                        signature(places, count).astype("<u4").tobytes() if len(s) else None))
        n, a, b, sig = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                          pa.array(sig, pa.binary())], names=["doc_id", "n", "fa", "fb", "sig"])


def _sets(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            block = batch.slice(at, 512)
            sets = [shingles(raw).astype("<u8").tobytes() for raw in _texts(block)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "set"])


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _compare_pairs(batches, percent: int):
    """Of pairs (a, b, sa, sb), those whose sets meet the threshold."""
    for batch in batches:
        keep = []
        for sa, sb in zip(batch.column("sa"), batch.column("sb")):
            x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (sa, sb))
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _groups(batches, keys: list[str]):
    """Arrow tables of the rows of one key each, from rows sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_ids(batch, k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _screen(group: pa.Table, percent: int) -> np.ndarray:
    """Pairs (i < j) of rows that may link and are not of one component yet, each in the first band that it shares."""
    bands, rows, screen = banding(percent)
    n, comp, side = (group.column(c).to_numpy() for c in ("n", "comp", "side"))
    band = int(group.column("band")[0].as_py())
    sig = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in group.column("sig")), "<u4").reshape(len(n), -1)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    own = not len(right)  # a block against itself
    if own:
        right = left
    fits = comp[left][:, None] != comp[right][None, :]
    fits &= 100 * np.minimum.outer(n[left], n[right]) >= percent * np.maximum.outer(n[left], n[right])
    if own:
        fits &= left[:, None] < right[None, :]
    i, j = np.nonzero(fits)
    out = []
    for at in range(0, len(i), 65_536):
        x, y = left[i[at:at + 65_536]], right[j[at:at + 65_536]]
        same = sig[x] == sig[y]
        whole = same.reshape(len(x), bands, rows).all(axis=2)
        ok = (same.mean(axis=1) >= screen) & (whole.argmax(axis=1) == band)
        out.append(np.stack((x[ok], y[ok]), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


_CELL = ["bucket", "lo", "hi"]


def _wanted(batches, percent: int):
    """Rows (cell, id) of the buckets' blocks that take part in a pair worth verifying."""
    for group in _groups(batches, _CELL):
        pairs = _screen(group, percent)
        if len(pairs):
            rows = np.unique(pairs)
            part = group.take(pa.array(rows)).select([*_CELL, "band", "side", "id", "comp", "n", "sig"])
            yield from part.combine_chunks().to_batches()


def _verify(batches, percent: int):
    """Links of each cell, reduced to those that still joined something there."""
    for group in _groups(batches, _CELL):
        pairs = _screen(group, percent)
        sets = [np.frombuffer(s.as_buffer(), "<u8") for s in group.column("set")]
        ids, comp = group.column("id").to_pylist(), group.column("comp").to_pylist()
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        sizes = np.array([len(s) for s in sets])
        both = _intersections(sets, pairs)
        found = []
        for (x, y), k in zip(pairs.tolist(), both.tolist()):
            if 100 * k >= percent * (sizes[x] + sizes[y] - k) and (u := find(comp[x])) != (w := find(comp[y])):
                root[max(u, w)] = min(u, w)
                found.append((ids[x], ids[y]))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _intersections(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs: one by one if few, else by matrix products over slices of the universe."""
    if len(pairs) <= 4 * len(sets):
        return np.array([len(sets[x]) + len(sets[y]) - len(np.union1d(sets[x], sets[y])) for x, y in pairs], np.int64)
    universe, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    total = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2 ** 24 are exact
    for at in range(0, len(universe), 4_096):
        inside = (place >= at) & (place < at + 4_096)
        hot = np.zeros((len(sets), 4_096), np.float32)
        hot[row[inside], place[inside] - at] = 1
        total += hot @ hot.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _sized(small: Column, large: Column, percent: int) -> Column:
    return 100 * F.least(small, large) >= percent * F.greatest(small, large)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Equal sets are one class. A class goes to one bucket a band; in each bucket
    all classes are verified against the least one first (a star, not pairs), and the
    components of these links tell which buckets are settled. In the others,
    classes of different components are screened by their signatures in blocks
    of bounded size and verified on their full sets; a bucket of any size is cut into
    pairs of blocks, and tasks emit only links that join something.

    Null or wordless texts have no set and stand alone; texts under five words have
    one shingle; a null key takes its class's component, else null; rows that share
    a key are one node, linked when one of its texts is; repeated rows repeat
    their result; an empty table gives no rows; other columns are not passed on.
    """
    bands, rows, _ = banding(percent)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(source.mapInArrow(lambda b: _sign(b, bands * rows), "doc_id long, n long, fa long, fb long, sig binary"), "signatures")
    worded = signed.where("n > 0")
    classes = cut_lineage(worded.groupBy("n", "fa", "fb").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")).where("id IS NOT NULL"))
    # A band's value with its number in front is one bucket.
    members = (classes.select("id", "n", F.posexplode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("sig", 1 + 4 * rows * b, 4 * rows)) for b in range(bands)])).alias("band", "bucket")))
    hubs = (members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1"))
    full = cut_lineage(members.join(hubs, "bucket").select("bucket", "band", "id", "n", "hub", "size"))
    star = (full.where(F.col("id") != F.col("hub.id")).where(_sized(F.col("n"), F.col("hub.n"), percent))
            .select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct())
    star = cut_lineage(star)

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = cut_lineage(ids.select(F.col("id").alias("doc_id")).distinct())
        return among(source, "doc_id", asked).mapInArrow(_sets, "id long, set binary")

    asked = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id")))
    # The sets of all texts in some star, computed once for both sides of the join.
    sets = written(sets_of(asked), "sets")
    paired = (star.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
              .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b"))
    links = cut_lineage(paired.mapInArrow(lambda b: _compare_pairs(b, percent), "a long, b long"))
    comps = connected_components(links)
    labelled = full.join(comps, full.id == comps.node, "left").select(
        "bucket", "band", "id", "n", "size", F.coalesce("component", "id").alias("comp"))
    labelled = cut_lineage(labelled)
    unsettled = labelled.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    cells = labelled.join(unsettled, "bucket").join(classes.select("id", "sig"), "id")
    # Blocks of a bucket: each row meets every block once, as the lower or the upper side.
    count = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("id"), count).cast("int")
    cells = (cells.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), count - 1)))
             .select("bucket", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "band",
                     (F.col("_own") > F.col("_other")).cast("int").alias("side"), "id", "comp", "n", "sig"))
    shape = "bucket long, lo int, hi int, band int, side int, id long, comp long, n long, sig binary"
    cells = cells.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in shape.split(", ")])
    wanted = cut_lineage(cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(lambda b: _wanted(b, percent), shape))
    # Rows here may never have been in a star, so their sets are taken anew.
    late_sets = sets_of(wanted.select("id"))
    more = wanted.join(late_sets, "id").select(*[c.split()[0] for c in shape.split(", ")], "set")
    late = more.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(lambda b: _verify(b, percent), "a long, b long")
    every = connected_components(cut_lineage(links.unionByName(late)))
    # Rows find their class by its set, the class its component.
    known = classes.select("n", "fa", "fb", "id").join(every, F.col("id") == F.col("node"), "left").select(
        "n", "fa", "fb", F.coalesce("component", "id").alias("component_id"))
    return (signed.select("doc_id", "n", "fa", "fb").join(known, ["n", "fa", "fb"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the one with the least key, a null key last.

    Rows stand for themselves, whatever their keys: different texts under one key, or
    without one, are different documents. Texts without a word are in no group; of
    those with equal key and text one row stays.
    """
    # Written once, so that the numbers hold wherever the rows are read again. The caller's
    # columns travel in one struct, out of the way of the names used here.
    rows = written(docs.select(F.struct(*docs.columns).alias("caller"), F.monotonically_increasing_id().alias("row")), "rows")
    texts = rows.select("row", F.col(f"caller.{key}").alias("key"), F.col(f"caller.{text}").alias("text"))
    found = near_duplicates(texts, "row", "text", percent).withColumnRenamed("doc_id", "row")
    named = texts.select("row", "key", F.xxhash64("text").alias("tie")).join(found, "row")
    bare = F.col("n_shingles") == 0
    kept = (named.groupBy(F.when(~bare, F.col("component_id")).alias("c"), F.when(bare, F.col("key")).alias("k"), F.when(bare, F.col("tie")).alias("t"))
            .agg(F.min(F.struct(F.col("key").isNull(), "key", "tie", "row"))["row"].alias("row")))
    kept = cut_lineage(kept.select("row"))
    gone = cut_lineage(rows.select("row").join(kept, "row", "left_anti"))
    return without(rows, "row", gone).select("caller.*")


@query("op2_near_dedup", r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT a AS doc_id, a AS r FROM u UNION SELECT u.b, c.r FROM c JOIN u ON u.a = c.doc_id WHERE c.r < u.b),
m AS (SELECT doc_id, min(r) AS r FROM c GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(r, t.doc_id), t.doc_id) AS component_id, t.doc_id = least(coalesce(r, t.doc_id), t.doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""")
def op2_near_dedup(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
