"""Findings of the last review: ids of words with marks, linear secret scans, columns that clash with internal names."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymeld.llm import line_dedup, near_dedup, secrets, token_files, url_filters

INTERNAL = ("_hash", "_size", "_row", "_key", "_tie", "_n_lines", "_n_deleted", "_n_runs", "_top", "_k0", "_strong", "_added", "caller", "row", "hash", "size",
            "found", "top", "open", "stack", "slot", "host_key", "key", "t", "k", "strong", "weak", "added", "deleted", "line", "_")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return token_files.WordEncoder(token_files.tokenizer_path(), memo=500), Tokenizer.from_file(token_files.tokenizer_path())


def test_ids_of_words_that_leave_marks(both):
    encoder, plain = both
    texts = ["İstanbul. İ.", "Aİ!", "क़.", "ﬁn, ǅ; ẞ?", "é. É!", "ŉ...", "Ω,Å.", "x" * 300 + "."]
    got = encoder.encode([t.encode() for t in texts], 1)
    assert [g.tolist() for g in got] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert len(got[0]) == 9  # with the end id


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB İıßǅﬁéÉ́̇क़Ωऽ漢😀.,!?;:&%$#*|)'\"-_<>0९٣\n\t "), max_size=40), min_size=1, max_size=4))
def test_ids_equal_an_unmodified_tokenizer(both, texts):
    encoder, plain = both
    got = encoder.encode([t.encode() for t in texts], 1)
    assert [g.tolist() for g in got] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_secret_scans_are_linear(spark):
    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"{i:032x}" for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        row = secrets.scan_secrets(df).first()
        spent = time.perf_counter() - began
        assert row["n_hex"] == n and row["base"].split(",")[-1] == f"hex:{33 * n - 33}:{33 * n - 1}"
        return spent

    took(600)
    small, large = min(took(20_000) for _ in range(2)), min(took(40_000) for _ in range(2))
    assert large < 2.6 * small + 1


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, near_dedup.keep_one, secrets.scan_secrets, lambda d: url_filters.judge_urls(
    d.withColumn("url", F.concat(F.lit("https://a.example.com/en/"), "doc_id")), d.sparkSession.createDataFrame(url_filters.RULES, "host string, path string, verdict string"))],
    ids=["lines", "near", "secrets", "urls"])
def test_columns_with_internal_names_stay(spark, docs, run):
    odd = docs.select("doc_id", "text", *[F.concat_ws("/", F.lit(c), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in INTERNAL])
    plain, dressed = run(docs.select("doc_id", "text")), run(odd)
    assert set(dressed.columns) >= set(INTERNAL)
    rows = dressed.collect()
    assert all(r[c] == f"{c}/{-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in INTERNAL)
    order = lambda rows: sorted((tuple(r[c] for c in plain.columns) for r in rows), key=str)
    assert order(rows) == order(plain.collect())
    assert run(odd.limit(0)).count() == 0
