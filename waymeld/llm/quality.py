"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, the posterior decides."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, let, query, table, words_of

#: (name, condition for a vote of good, condition for a vote of bad) over the feature columns;
#: neither: the rule abstains. Integer arithmetic only, so that SQL engines agree.
RULES = (
    ("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("symbol_share", "100 * n_symbols <= word_chars", "100 * n_symbols > 5 * word_chars"),
    ("dup_lines", "10 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    ("repeats", "10 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    ("variety", "10 * n_distinct_words >= 3 * n_words OR n_distinct_words >= 400", "10 * n_distinct_words < 2 * n_words AND n_distinct_words < 400"),
)
ITERATIONS = 12
PRIOR = 0.8         # share of good documents before the first step
#: How often a rule votes (good, bad) on a document of either kind before the first step; it abstains else.
ON_GOOD, ON_BAD = (0.75, 0.05), (0.6, 0.3)
MOST, ROOM = 0.98, 0.99  # most that a rule's rate of bad votes, and both rates together, may reach on bad documents
PSEUDO = 1.0        # documents that stand by the starting values in every step


def features(text: Column) -> dict[str, Column]:
    """Counts over one whole text; all are 0 for a null or empty one."""
    text = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            let(hashes, _repeat_words).alias("n_repeat_words"),
            F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct_words"))

    def lines(kept: Column) -> Column:
        return F.struct(F.size(kept).cast("long").alias("n_lines"),
                        (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"))

    by_word, by_line = let(words_of(text), counts), let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lines)
    symbols = F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    return {"_w": by_word, "_l": by_line, "_s": symbols.cast("long")}


def _repeat_words(hashes: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    Windows sorted by (hash, place) put equal ones side by side; only texts with
    a repeated window pay for the sort. Linear and sorting steps only, so a very
    long text stays cheap.
    """
    last = F.size(hashes) - 3
    windows = F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                    lambda i: F.xxhash64(hashes[i], hashes[i + 1], hashes[i + 2])))

    def covered(ordered: Column) -> Column:
        count = F.size(ordered)
        hit = F.filter(ordered, lambda x, i: ((i > 0) & (ordered[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]))
                       | ((i < count - 1) & (ordered[F.least(i + 1, count - 1)]["h"] == x["h"])))
        spots = F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(spots)).cast("long")

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(ordered, covered))

    return let(windows, count)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [*BASE, "n_lines", "n_distinct_words"]
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


#: Where `features` holds each count.
PATHS = {"n_words": "_w.n_words", "word_chars": "_w.word_chars", "n_symbols": "_s", "n_dup_lines": "_l.n_dup_lines",
         "n_repeat_words": "_w.n_repeat_words", "n_lines": "_l.n_lines", "n_distinct_words": "_w.n_distinct_words"}


def _at(value: Column, path: str) -> Column:
    return reduce(lambda c, name: c[name], path.split("."), value)


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` and the counts of `FEATURES`; columns of the same names are replaced."""
    rows = docs.drop(*[c for c in FEATURES if c != text])
    parts = features(F.col(text))
    counted = let(F.struct(*[c.alias(k) for k, c in parts.items()]), lambda x: F.struct(
        *[_at(x, path).alias(name) for name, path in PATHS.items()]))
    # As rows of a generator the counts are a border for the optimiser: a filter on them would else move
    # below the projection and bring a copy of the whole expression for each time it names a count.
    return rows.select(*[c for c in rows.columns if c not in FEATURES], F.inline(F.array(counted)))


def votes() -> list[Column]:
    """1 good, -1 bad, 0 abstains; a text without words gets no vote."""
    return [F.expr(f"CASE WHEN n_words = 0 THEN 0 WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END").alias(f"v_{name}")
            for name, good, bad in RULES]


@dataclass(frozen=True)
class Weights:
    """Estimated share of good documents, and each rule's rates of voting (good, bad) on good and on bad ones.

    A rule's accuracy on good documents is good / (good + bad) of `on_good`, on bad ones bad / (good + bad) of `on_bad`.
    """
    prior: float
    on_good: tuple[tuple[float, float], ...]
    on_bad: tuple[tuple[float, float], ...]


def posterior(weights: Weights) -> Column:
    """Probability of a good document from the `v_` columns."""
    def side(start: float, rates: tuple[tuple[float, float], ...]) -> Column:
        terms = [F.when(F.col(f"v_{r[0]}") == 1, g).when(F.col(f"v_{r[0]}") == -1, b).otherwise(1.0 - g - b)
                 for r, (g, b) in zip(RULES, rates)]
        return reduce(lambda x, y: x * y, terms, F.lit(start))
    good, bad = side(weights.prior, weights.on_good), side(1 - weights.prior, weights.on_bad)
    return good / (good + bad)


def estimate(judged: DataFrame, iterations: int = ITERATIONS) -> Weights:
    """Expectation-maximisation over the counts of vote patterns.

    The patterns are at most 3 ** rules rows whatever the corpus, and every
    document that passes the base rule counts: the others are decided already. Each step is one aggregate over that table; no truth is used.
    A vote of bad never speaks for a document: its rate on bad ones is at least that on good ones.
    """
    names = [f"v_{r[0]}" for r in RULES]
    patterns = cut_lineage(judged.where(f"NOT ({BASE_FAILED})").select(*votes()).groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    w = Weights(PRIOR, (ON_GOOD,) * len(RULES), (ON_BAD,) * len(RULES))
    for _ in range(iterations):
        p = patterns.withColumn("_p", posterior(w))
        kinds = {"g": F.col("n") * F.col("_p"), "b": F.col("n") * (1 - F.col("_p"))}
        row = p.agg(*[F.sum(c).alias(k) for k, c in kinds.items()],
                    *[F.sum(F.when(F.col(v) == sign, c)).alias(f"{k}{sign}_{v}")
                      for k, c in kinds.items() for v in names for sign in (1, -1)]).first()
        total = {k: row[k] or 0.0 for k in kinds}
        if not sum(total.values()):
            return w

        def rate(kind: str, sign: int, name: str, start: float) -> float:
            return ((row[f"{kind}{sign}_{name}"] or 0.0) + PSEUDO * start) / (total[kind] + PSEUDO)

        good = tuple((rate("g", 1, v, ON_GOOD[0]), rate("g", -1, v, ON_GOOD[1])) for v in names)
        bad = tuple((rate("b", 1, v, ON_BAD[0]), min(MOST, max(rate("b", -1, v, ON_BAD[1]), g[1]))) for v, g in zip(names, good))
        # The three outcomes keep a positive rate each.
        bad = tuple((min(g, ROOM - b), b) for g, b in bad)
        w = Weights((total["g"] + PSEUDO * PRIOR) / (sum(total.values()) + PSEUDO), good, bad)
    return w


def decide(counted: DataFrame, weights: Weights, least: float = 0.5) -> DataFrame:
    """Add `base_failed`, `quality` (posterior) and `kept` to rows with features."""
    rows = counted.drop("base_failed", "quality", "kept").select("*", *votes())
    rows = rows.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("quality", posterior(weights))
    return (rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
            .drop(*[f"v_{r[0]}" for r in RULES]))


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` that pass, with their own columns.

    Null and empty texts have no words, so the base rule rejects them. Repeated
    rows are judged alike. An empty table stays empty.
    """
    weights = estimate(with_features(docs.select(text), text))
    # The counts are taken again here: writing them would write every text once more.
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("text"))
    return decide(with_features(packed), weights, least).where("kept").select("_row.*")


def _pattern_sql() -> str:
    """DuckDB twin of `estimate`, unrolled: one pair of CTEs for each step."""
    names = [r[0] for r in RULES]
    case = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {g} THEN 1 WHEN {b} THEN -1 ELSE 0 END AS v_{n}" for n, g, b in RULES)

    def post(w: str) -> str:
        side = lambda start, k: " * ".join([start, *[
            f"(CASE v_{n} WHEN 1 THEN {w}.{k}g_{n} WHEN -1 THEN {w}.{k}b_{n} ELSE 1.0::DOUBLE - {w}.{k}g_{n} - {w}.{k}b_{n} END)" for n in names]])
        good, bad = side(f"{w}.prior", "g"), side(f"(1 - {w}.prior)", "b")
        return f"({good}) / (({good}) + ({bad}))"

    start = ", ".join(f"{ON_GOOD[0]}::DOUBLE AS gg_{n}, {ON_GOOD[1]}::DOUBLE AS gb_{n}, {ON_BAD[0]}::DOUBLE AS bg_{n}, {ON_BAD[1]}::DOUBLE AS bb_{n}" for n in names)
    out = [f"votes AS MATERIALIZED (SELECT *, {case} FROM counted)",
           f"pat AS MATERIALIZED (SELECT {', '.join('v_' + n for n in names)}, count(*)::DOUBLE AS n FROM votes WHERE NOT ({BASE_FAILED}) GROUP BY ALL)",
           f"w0 AS MATERIALIZED (SELECT {PRIOR}::DOUBLE AS prior, {start})"]
    for i in range(1, ITERATIONS + 1):
        rate = lambda k, sign, n, v: f"(coalesce(sum({k}) FILTER (v_{n} = {sign}), 0) + {PSEUDO * v}::DOUBLE) / (sum({k}) + {PSEUDO}::DOUBLE)"
        raw = ", ".join(f"{rate('g', 1, n, ON_GOOD[0])} AS gg_{n}, {rate('g', -1, n, ON_GOOD[1])} AS gb_{n}, {rate('b', 1, n, ON_BAD[0])} AS bg_{n}, {rate('b', -1, n, ON_BAD[1])} AS bb_{n}" for n in names)
        held = ", ".join(f"gg_{n}, gb_{n}, least(bg_{n}, {ROOM}::DOUBLE - least({MOST}::DOUBLE, greatest(bb_{n}, gb_{n}))) AS bg_{n}, least({MOST}::DOUBLE, greatest(bb_{n}, gb_{n})) AS bb_{n}" for n in names)
        out.append(f"p{i} AS MATERIALIZED (SELECT pat.*, pat.n * {post('w')} AS g, pat.n * (1 - {post('w')}) AS b FROM pat, w{i - 1} w)")
        out.append(f"w{i} AS MATERIALIZED (SELECT prior, {held} FROM (SELECT (sum(g) + {PSEUDO * PRIOR}::DOUBLE) / (sum(g) + sum(b) + {PSEUDO}::DOUBLE) AS prior, {raw} FROM p{i}))")
    out.append(f"judged AS (SELECT votes.*, {post('w')} AS quality, ({BASE_FAILED}) AS base_failed FROM votes, w{ITERATIONS} w)")
    return ",\n".join(out)


COUNTED_SQL = r"""
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
wl AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM wl WHERE len(w) > 2),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM tri) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) t(j) GROUP BY doc_id),
counted AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rw.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_distinct(w))::BIGINT AS n_distinct_words FROM wl LEFT JOIN rw USING (doc_id))"""


@query("op3_quality_rules", f"WITH {COUNTED_SQL},\n{_pattern_sql()}\nSELECT doc_id, {', '.join(BASE)}, base_failed, NOT base_failed AND quality >= 0.5 AS kept FROM judged")
def op3_quality_rules(spark, folder):
    # The counts without the texts are small, so they are written once and serve the estimate and the verdicts.
    counted = cut_lineage(with_features(table(spark, folder, "documents").select("doc_id", "text")).drop("text"))
    return decide(counted, estimate(counted)).select("doc_id", *BASE, "base_failed", "kept")
