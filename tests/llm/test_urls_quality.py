import re

from pyspark.sql import functions as F

from waymeld.llm import quality as Q
from waymeld.llm.url_filters import RULES, judge_urls

RULE_SCHEMA = "host string, path string, verdict string"


def plain_judge(url, rules):
    at = (url or "").find("://")
    if url is None or at < 0:
        return "", "", None, "allow"
    rest = url[at + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules
           if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_rules_match_a_plain_loop(spark):
    urls = ["http://Example.COM/en/a?x", "https://www.example.com/en/", "http://a.www.example.com/en/b#t", "http://x.net/es/1", "http://net",
            "http://com", "com/en/", None, "", "http://badexample.com/en/", "http://example.com/EN/", "http://x.com/", "ftp://com/a://b",
            "http://a.b.c.d.e.net/fr/x/y", "http://net/e", "http://É.com/ü"] * 3
    rules = [*RULES, ("", "/admin", "block"), ("net", "/", "allow"), ("net", "/es/x", "allow"), ("Example.com", "/en/", "allow")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*urls, "http://q.org/admin/1", "http://net/es/x1"])], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in judge_urls(pages, spark.createDataFrame([*rules, (None, "/", "block")], RULE_SCHEMA), slot_rows=3).collect()}
    # The rule given twice in other case: block wins.
    clean = [r for r in rules if r[0] != "Example.com"]
    assert got == {r["page_id"]: plain_judge(r["url"], clean) for r in pages.collect()}
    assert judge_urls(pages.limit(0), spark.createDataFrame(rules, RULE_SCHEMA)).count() == 0
    assert judge_urls(pages, spark.createDataFrame([], RULE_SCHEMA)).where("verdict = 'allow' AND rule IS NULL").count() == pages.count()


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, marked = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            marked |= {p + j for p in places for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked))


def test_counts_match_a_plain_loop(docs, real):
    for rows in (docs, real):
        got = Q.with_features(rows.select("doc_id", "text")).collect()
        assert len(got) == rows.count()
        for r in got:
            assert tuple(r[c] for c in Q.BASE) == plain_features(r["text"])


def test_verdicts_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = Q.with_features(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).drop("text")
    judged = Q.decide(rows, Q.estimate(rows)).join(spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    bad = judged.agg(F.avg(F.when(F.col("label") == 0, (~F.col("kept")).cast("int"))),
                     F.avg(F.when((F.col("label") == 1) & ~F.col("base_failed"), F.col("kept").cast("int")))).first()
    assert bad[0] > 0.95 and bad[1] > 0.99


def test_keep_good_keeps_columns(docs):
    assert Q.keep_good(docs).columns == docs.columns and Q.keep_good(docs.limit(0)).count() == 0
