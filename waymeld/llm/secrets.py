"""Secret scans: strong patterns stand alone, weak ones count when complementary parts lie close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, query, table


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_IDS = "|".join(map(_either_case, ("access_?key_?id", "client_?id", "account_?id", "user_?id", "username")))
_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Kinds in the order in which spans of equal start are listed: (pattern, group, least length of the group).
ASSIGN = (rf"({_NAMES}){_GLUE}([A-Za-z0-9+/_.=-]+)", 2, 8)
# A run of the class is taken whole, so asking for its length inside the pattern drops the same matches.
ACCESS = (r"(AKIA[A-Z0-9]{12,})", 1, 16)
HEX = (r"([0-9a-f]{32,})", 1, 32)
IDENT = (rf"({_IDS}){_GLUE}([A-Za-z0-9_.@-]+)", 2, 4)
KEY = (r"([A-Za-z0-9+/]{40,}=*)", 1, 40)
ENDPOINT = (r"""(https?://[^\x20\x09-\x0D"'<>]+)""", 1, 8)
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE_KINDS, PATTERNS = 3, (ASSIGN, ACCESS, HEX, IDENT, KEY, ENDPOINT)
#: Parts at most this many code points apart belong to one scope.
SCOPE = 200
#: Matches of one block of running sums.
BLOCK = 256
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def find(text: Column, kind: int) -> Column:
    """Spans of one kind: leftmost matches that do not overlap, without those whose group is too short.

    Splitting at the pattern gives the gaps between the matches, so running sums of
    gaps and matches give every place in code points. They are taken block by block: no array
    grows beyond a block, so the cost follows the number of matches.
    """
    pattern, group, least = PATTERNS[kind]
    gaps, matches, groups = (F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                             F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    parts = F.transform(F.slice(F.arrays_zip(gaps.alias("gap"), matches.alias("match"), groups.alias("group")), 1, F.size(matches)),
                        lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("match"), (F.length(p["group"]) >= least).alias("fits")))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["match"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(part["fits"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def spans(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + p["match"]))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), lambda block, at: F.aggregate(
            block, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("spans")), step)["spans"]))

    found = let(parts, lambda all_: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_, i * BLOCK + 1, BLOCK)), spans))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def linked(parts: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """The weak spans among `parts` (keys, start, kind, end) whose complements lie within the scope.

    A weak identifier needs a secret, a weak key needs an identifier or an
    endpoint, an endpoint needs both. The interval join is a sweep: sorted by
    start, the farthest end before and the nearest start after tell whether a
    part of a role is in reach, so no pairs are formed.
    """
    role = {"ident": F.col("kind").isin(1, 3), "secret": F.col("kind").isin(0, 2, 4), "endpoint": F.col("kind") == 5}
    order = Window.partitionBy(*keys).orderBy("start", "kind", "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def near(name: str) -> Column:
        gap_before = F.col("start") - F.max(F.when(role[name], F.col("end"))).over(before)
        gap_after = F.min(F.when(role[name], F.col("start"))).over(after) - F.col("end")
        return F.coalesce(gap_before <= scope, F.lit(False)) | F.coalesce(gap_after <= scope, F.lit(False))

    reach = parts.withColumns({f"_{name}": near(name) for name in role})
    return reach.where("(kind = 3 AND _secret) OR (kind = 4 AND (_ident OR _endpoint)) OR (kind = 5 AND _ident AND _secret)").drop(*[f"_{n}" for n in role])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """`docs` with n_assign, n_access, n_hex, base (spans as text) and spans (base and linked weak ones).

    Null texts count as empty: no spans, empty lists. Repeated rows get the same
    spans; a null key is a key like any other; an empty table gives no rows;
    columns with the names of the results are replaced, all others stay. The text itself is not passed on.
    """
    named = ("n_assign", "n_access", "n_hex", "base", "spans")
    body = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in docs.columns if c not in (text, *named)]
    # The caller's columns travel in one struct, out of the way of the names used here.
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)], F.lit(0).alias("last")).alias("caller"), F.col(key).alias("key"), F.xxhash64(body).alias("hash"), F.length(body).alias("size"),
                       *[find(body, k).alias(f"k{k}") for k in range(len(KINDS))])
    found = (rows.withColumn("strong", F.concat(*[F.col(f"k{k}") for k in range(BASE_KINDS)])).withColumn("weak", F.concat(*[F.col(f"k{k}") for k in range(BASE_KINDS, len(KINDS))]))
             .select("caller", "key", "hash", "size", "strong", "weak", *[F.size(f"k{k}").cast("long").alias(n) for k, n in enumerate(named[:3])]))
    keys = ["key", "hash", "size"]
    # One weak part alone is never reported, so only texts with a complement move on.
    parts = (found.where((F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1))
             .select(*keys, F.explode(F.concat("strong", "weak")).alias("s")).select(*keys, "s.*").distinct())
    added = linked(parts, keys, scope).groupBy(*keys).agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    a, b = found.alias("a"), added.alias("b")
    both = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.hash") == F.col("b.hash")) & (F.col("a.size") == F.col("b.size")), "left")
    return both.select(*[F.col(f"caller.c{i}").alias(c) for i, c in enumerate(own)], *[F.col(f"a.{n}") for n in named[:3]], _listed(F.col("strong")).alias("base"),
                       _listed(F.concat("strong", F.coalesce("added", F.array().cast(_SPANS)))).alias("spans"))


def _found_sql(kind: int) -> str:
    pattern, group, least = PATTERNS[kind]
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, s + list_sum(list_transform(gaps[:i], lambda g: length(g)))::BIGINT AS start, length(m[i]) AS len, g[i] AS part FROM (
  SELECT *, coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM (SELECT doc_id, gaps, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g FROM texts))) WHERE length(g[i]) >= {least}"""


_NAMES_SQL = "['" + "', '".join(KINDS) + "']"


@query("op8_secret_scans", f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS MATERIALIZED (SELECT doc_id, kind, start, start + len AS fin FROM ({" UNION ALL ".join(_found_sql(k) for k in range(len(KINDS)))})),
n AS (SELECT a.doc_id, a.kind, a.start, a.fin, bool_or(b.kind IN (1, 3)) AS ident, bool_or(b.kind IN (0, 2, 4)) AS secret, bool_or(b.kind = 5) AS endpoint
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND (a.kind, a.start) <> (b.kind, b.start) AND greatest(b.start - a.fin, a.start - b.fin) <= {SCOPE}
  WHERE a.kind >= 3 GROUP BY ALL),
w AS (SELECT doc_id, kind, start, fin FROM f WHERE kind < 3 UNION ALL SELECT doc_id, kind, start, fin FROM n WHERE (kind = 3 AND secret) OR (kind = 4 AND (ident OR endpoint)) OR (kind = 5 AND ident AND secret)),
l AS (SELECT *, {_NAMES_SQL}[kind + 1] || ':' || start || ':' || fin AS s FROM w),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM l GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN g USING (doc_id)""")
def op8_secret_scans(spark, folder):
    found = scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
