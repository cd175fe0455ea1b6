"""URL rules as a sort-merge range join over canonical keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_ascii, query, table

#: Distinct urls of one host suffix that one task sorts; above it the suffix gets more slots.
SLOT_ROWS = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty without `://` or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = fold_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _suffix_keys(host: Column) -> Column:
    """Reversed-host keys of a host and of all its parent domains, the empty one included."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    return F.transform(F.sequence(F.lit(0), count),
                       lambda i: F.when(i == 0, F.lit("")).otherwise(_reversed(F.slice(labels, count - i + 1, i))))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(host_key, path, stack): each rule with the rules of its host whose interval encloses it.

    A rule covers the interval of keys that start with its own key, so two rules
    of a host nest or are apart. `stack` lists the active rules from the outermost
    to the rule itself as (path, rule, verdict, host length).
    """
    clean = (rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
             .select(fold_ascii(F.col("host")).alias("host"), "path", "verdict")
             # The same rule given twice: block wins over allow.
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
             .select(F.when(F.col("host") == "", F.lit("")).otherwise(_reversed(F.split("host", r"\."))).alias("host_key"),
                     "path", F.struct("path", F.concat("host", "path").alias("rule"), "verdict",
                                      F.length("host").alias("host_length")).alias("entry")))
    prefixes = clean.select("host_key", "path", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda n:
        F.substr(F.col("path"), F.lit(1), n))).alias("prefix"))
    outer = clean.select("host_key", F.col("path").alias("prefix"), "entry")
    return (prefixes.join(outer, ["host_key", "prefix"])
            .groupBy("host_key", "path").agg(F.sort_array(F.collect_list("entry")).alias("stack")))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add `host`, `path`, `rule` and `verdict` to every row of `pages`.

    `rules` has (host, path, verdict). A rule fits its host and all subdomains
    where the url's path starts with the rule's; the longest rule string wins
    (then the longer host). Without a fitting rule `rule` is null and the verdict is `default`.

    Every distinct (host, path) becomes one key per parent domain that has rules,
    reversed host first; there a rule is an interval of paths. Keys and rules are
    sorted together, and a sweep carries the stack of rules active at the last
    rule start; the innermost entry that still encloses the key is the answer.
    A host suffix with many urls is dealt over slots that each get its rules.

    Null or odd urls have empty host and path; repeated rows are judged alike; an empty
    table gives no rows; columns named host, path, rule or verdict are replaced;
    rules with a null are ignored.
    """
    host, path = url_parts(F.col(url))
    rows = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    rows = rows.withColumns({"host": host, "path": path})
    stacks = rule_stacks(rules)
    keyed = (rows.select("host", "path").distinct()
             .select("host", "path", F.explode(_suffix_keys(F.col("host"))).alias("host_key")))
    hosts = stacks.select("host_key").distinct()
    # Rules are the small side, but nothing bounds them: the planner chooses by measured size.
    load = keyed.join(hosts, "host_key").groupBy("host_key").agg(
        F.ceil(F.count("*") / F.lit(slot_rows)).cast("int").alias("slots"))
    urls = (keyed.join(load, "host_key")
            .select("host_key", F.pmod(F.xxhash64("host", "path"), F.col("slots")).cast("int").alias("slot"),
                    "path", F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")))
    starts = (stacks.join(load, "host_key")
              .select("host_key", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "path",
                      F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack"))
    sweep = Window.partitionBy("host_key", "slot").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # Without this the planner keeps the join's partitioning by suffix alone, and a frequent suffix stays in one task.
    dealt = urls.unionByName(starts).repartition("host_key", "slot")
    active = (dealt.withColumn("stack", F.last("stack", True).over(sweep))
              .where("kind = 1 AND stack IS NOT NULL")
              .select("host", "path", F.filter("stack", lambda s: F.startswith(F.col("path"), s["path"])).alias("open"))
              .where(F.size("open") > 0)
              .select("host", "path", F.element_at("open", -1).alias("top")))
    best = active.groupBy("host", "path").agg(
        F.max_by("top", F.struct(F.length("top.rule"), "top.host_length", "top.rule")).alias("top"))
    # The caller's columns travel in one struct, out of the way of the names used here.
    return (rows.select("host", "path", F.struct(*rows.columns).alias("caller")).join(best, ["host", "path"], "left")
            .select("caller.*", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")))


RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
_VALUES = ", ".join(str(r) for r in RULES)


@query("op1_url_filters", f"""
WITH r(rhost, rpath, v) AS (VALUES {_VALUES}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
d AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS verdict
  FROM d JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.host = p.host AND m.path = p.path""")
def op1_url_filters(spark, folder):
    rules = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS rules(host, path, verdict)")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
