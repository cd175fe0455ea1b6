"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosines.

A hash of a unit vector is floor((a.x + b) / WIDTH) with a Gaussian direction a and an
offset b in [0, WIDTH). Two vectors at distance c share it with a probability that only depends on
c (Datar, Immorlica, Indyk, Mirrokni 2004). A table joins several hashes to one
bucket; vectors that share a bucket of some table and a label are compared exactly.
"""

from __future__ import annotations

from math import ceil, erf, exp, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import written
from .common import query, table
from .near_dedup import _groups

#: Vectors of one label link from this cosine on.
COSINE = 0.98
#: A pair right at the threshold meets in no table with at most this probability.
MISS = 1e-6
#: Width of a hash, in distances of a pair at the threshold.
WIDTH = 8.0
#: Vectors of one side that a task compares at once.
BLOCK = 1024
#: Leading coordinates, after a rotation, that screen a bucket's pairs: their distance never exceeds the whole one.
LEAD = 12
#: A vector with at least this share of all rows is looked up by broadcast; there are at most 1 / HEAVY of them.
HEAVY = 0.001
SEED = 20
_CELL = ["bucket", "lo", "hi"]


def share(distance: float, width: float) -> float:
    """Probability that two vectors at `distance` share one hash."""
    r = width / distance
    return erf(r / sqrt(2)) - sqrt(2 / pi) / r * (1 - exp(-r * r / 2))


def tables_for(n: int, cosine: float = COSINE) -> tuple[int, int, float]:
    """(tables, hashes of a table, width) for at most n vectors of a label.

    Hashes follow from n, so that a vector meets about one unrelated (orthogonal)
    vector in each table at every size; tables follow from hashes and MISS.
    """
    if not 0 < cosine < 1:
        raise ValueError(f"a cosine threshold lies between 0 and 1, not at {cosine}")
    near, far = sqrt(2 - 2 * cosine), sqrt(2)
    width = WIDTH * near
    hashes = max(1, ceil(log(max(n, 2)) / -log(share(far, width))))
    return ceil(log(MISS) / log1p(-share(near, width) ** hashes)), hashes, width


def _directions(size: int, count: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and the screen's rotation for vectors of `size` components, the same in every task."""
    rng = np.random.default_rng([SEED, size])
    lead = np.linalg.qr(rng.standard_normal((size, min(LEAD, size))))[0]
    return rng.standard_normal((size, count)), rng.uniform(0, width, count), lead


def _hash(batches, tables: int, hashes: int, width: float):
    """Unit vectors, their leading coordinates and a 32-bit bucket number for each table."""
    known: dict[int, tuple] = {}
    mix = np.random.default_rng(SEED).integers(1, 1 << 63, hashes, np.uint64) | np.uint64(1)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            block = batch.slice(at, 512)
            column = block.column("vector")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            units, leads, keys = (np.empty(len(sizes), object) for _ in range(3))
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x = flat[(ends[rows] - size)[:, None] + np.arange(size)]
                x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                if size not in known:
                    known[size] = _directions(size, tables * hashes, width)
                directions, offsets, lead = known[size]
                places = np.floor((x @ directions + offsets) / width).astype(np.int64).astype(np.uint64).reshape(len(rows), tables, hashes)
                value = ((places * mix).sum(axis=2, dtype=np.uint64) >> np.uint64(32)).astype("<u4")
                first = (x @ lead).astype("<f4")
                for r, i in enumerate(rows):
                    units[i], leads[i], keys[i] = x[r].tobytes(), first[r].tobytes(), value[r].tobytes()
            yield pa.RecordBatch.from_arrays([block.column("c"), block.column("label"), block.column("n"), *[pa.array(v, pa.binary()) for v in (units, leads, keys)]],
                                             names=["c", "label", "n", "unit", "lead", "keys"])


def _matrix(column, kind: str) -> np.ndarray:
    raw = b"".join(x.as_buffer().to_pybytes() for x in column)
    return np.frombuffer(raw, kind).reshape(len(column), -1)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    side = group.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    own = not len(right)  # a block against itself
    return left, left if own else right, own


def _wanted(batches, distance: float):
    """Rows of a cell with a partner whose leading coordinates are near enough."""
    bound = distance * distance + 1e-4  # leading coordinates are rounded to 32 bits
    for group in _groups(batches, _CELL):
        lead = _matrix(group.column("lead"), "<f4").astype(np.float64)
        square = (lead * lead).sum(axis=1)
        left, right, own = _sides(group)
        wanted = np.zeros(len(square), bool)
        for at in range(0, len(left), 256):
            part = left[at:at + 256]
            near = square[part][:, None] + square[right][None, :] - 2 * lead[part] @ lead[right].T <= bound
            if own:
                near &= part[:, None] != right[None, :]
            wanted[part] |= near.any(axis=1)
            wanted[right] |= near.any(axis=0)
        if wanted.any():
            yield from group.filter(pa.array(wanted)).drop_columns(["lead"]).combine_chunks().to_batches()


def _compare(batches, cosine: float):
    """(c, to, links) of each cell: a linked class, the least class that it reaches inside the cell, and the vectors it links to.

    A pair counts in the first table that it shares, so in one cell only.
    """
    for group in _groups(batches, _CELL):
        unit, keys = _matrix(group.column("unit"), "<f8"), _matrix(group.column("keys"), "<u4")
        c, n = (group.column(x).to_numpy() for x in ("c", "n"))
        here = int(group.column("place")[0].as_py())
        left, right, own = _sides(group)
        links, met = np.zeros(len(c), np.int64), np.zeros((len(left), len(right)), bool)
        for at in range(0, len(left), 128):
            part = left[at:at + 128]
            x, y = np.nonzero(unit[part] @ unit[right].T >= cosine)
            if own:
                x, y = x[at + x < y], y[at + x < y]
            for some in range(0, len(x), 65_536):
                u, v = x[some:some + 65_536], y[some:some + 65_536]
                same = keys[part[u]] == keys[right[v]]
                first = same.any(axis=1) & (same.argmax(axis=1) == here)
                u, v = u[first], v[first]
                met[at + u, v] = True
                np.add.at(links, part[u], n[right[v]])
                np.add.at(links, right[v], n[part[u]])
        if not met.any():
            continue
        reach = np.arange(len(c))
        while True:
            least = reach.copy()
            np.minimum.at(least, left, np.where(met, reach[right][None, :], len(c)).min(axis=1))
            np.minimum.at(least, right, np.where(met, least[left][:, None], len(c)).min(axis=0))
            if (least == reach).all():
                break
            reach = least
        linked = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(c[linked]), pa.array(c[reach[linked]]), pa.array(links[linked])], names=["c", "to", "links"])


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
                 block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`.

    Equal vectors of a label are one class, which stands for its rows. Classes go
    to one bucket a table; buckets with several classes are cut into pairs of blocks of bounded
    size. There leading coordinates tell which classes can have a partner at
    all, and only these fetch their vectors and are compared. Tasks emit at most one row a
    class: how many vectors it links to, and the least class that it reaches. Different
    vectors that are all near each other are compared one by one, since each link counts.

    A null key, label or vector, one without components, with null or non-finite ones, or of length
    zero links with nothing, and only vectors of equal size and label are compared. Repeated rows
    are vectors of their own and link with each other; rows that share a key are told
    apart. An empty table gives no rows; other columns are not passed on.
    """
    source = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
           & F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("vector", lambda x: x != 0))
    marked = source.withColumn("fit", F.coalesce(fit, F.lit(False)))
    names = [F.when(F.col("fit"), F.xxhash64("label", "vector", F.lit(s))).alias(f"h{s}") for s in (0, 1)]
    classes = (marked.where("fit").select("vec_id", "label", "vector", *names).groupBy("h0", "h1")
               .agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    # Written once, so that the numbers hold wherever the classes are read again.
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    size = classes.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("n")).agg(F.max("k"), F.sum("n")).first()
    tables, hashes, width = tables_for(size[0] or 0, cosine)
    kind = classes.schema["label"].dataType.simpleString()
    hashed = written(classes.select("c", "label", "n", "vector").mapInArrow(
        lambda b: _hash(b, tables, hashes, width), f"c long, label {kind}, n long, unit binary, lead binary, keys binary"), "vector-hashes")
    key_of = [F.xxhash64(F.lit(t), "label", F.length("unit"), F.substring("keys", 1 + 4 * t, 4)) for t in range(tables)]
    members = hashed.select("c", F.posexplode(F.array(*key_of)).alias("place", "bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    # Blocks of a bucket: each row meets every block once, as the lower or the upper side.
    count = F.ceil(F.col("size") / F.lit(block)).cast("int")
    cells = (members.join(shared, "bucket").withColumn("own", F.pmod(F.xxhash64("c"), count).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
             .select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "place", "c"))
    shape = "bucket long, lo int, hi int, side int, place int, c long"
    near = sqrt(2 - 2 * cosine)
    able = written(cells.join(hashed.select("c", "lead"), "c").select(*_CELL, "side", "place", "c", "lead").repartition(*_CELL).sortWithinPartitions(*_CELL)
                   .mapInArrow(lambda b: _wanted(b, near), shape), "vector-cells")
    found = written(able.join(hashed.select("c", "n", "unit", "keys"), "c").repartition(*_CELL).sortWithinPartitions(*_CELL)
                    .mapInArrow(lambda b: _compare(b, cosine), "c long, to long, links long"), "vector-links")
    reached = connected_components(found.select(F.col("c").alias("a"), F.col("to").alias("b")))
    named = classes.select("h0", "h1", "c", "id", "n").join(reached, F.col("c") == F.col("node"), "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    results = written(named.join(least, "component").join(links, "c", "left")
                      .select("h0", "h1", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-results")
    # At most 1 / HEAVY classes reach the bar.
    bar = max(1, ceil(HEAVY * (size[1] or 0)))
    heavy, light = F.broadcast(results.where(F.col("n") >= bar)), results.where(F.col("n") < bar)
    rows = marked.select("vec_id", "fit", *names)
    good, columns = rows.where("fit"), ["vec_id", "n_links", "component_id"]
    out = (good.join(heavy, ["h0", "h1"]).select(*columns)
           .unionByName(good.join(heavy, ["h0", "h1"], "left_anti").join(light, ["h0", "h1"]).select(*columns))
           .unionByName(rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op12_embedding_dedup", """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS MATERIALIZED (SELECT vec_id, label, len(x) AS d, list_transform(x, lambda c: c / sqrt(list_sum(list_transform(x, lambda e: e * e)))) AS x FROM v),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) >= 0.98),
r AS (SELECT a AS vec_id, least(a, b) AS r FROM e UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.vec_id WHERE r.r < e.b),
m AS (SELECT vec_id, min(r) AS r FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(m.r, t.vec_id), t.vec_id) AS component_id, t.vec_id = coalesce(least(m.r, t.vec_id), t.vec_id) AS kept
FROM embeddings t LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)""")
def op12_embedding_dedup(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"))
