"""Wide rows against few keys: the same rows as the plain joins, and few of them shuffled."""

from pyspark.sql import functions as F

from waymeld.llm import near_dedup
from waymeld.operators import sieve


def test_sieved_joins_equal_plain_ones(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 50 != 7, F.col("id") * 7919 - 10 ** 6).alias("k"), F.col("id").cast("string").alias("text"))
    rows = rows.unionByName(rows.where("k % 3 = 0"))
    for asked in (rows.select("k").where("k % 100 = 0").distinct(), rows.select("k").distinct(), rows.select("k").limit(0), spark.sql("SELECT CAST(NULL AS BIGINT) AS k")):
        for mine, how in ((sieve.among, "left_semi"), (sieve.without, "left_anti")):
            got, want = mine(rows, "k", asked), rows.join(asked, "k", how).select("k", "text")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_few_rows_pass_that_were_not_asked_for(spark):
    rows = spark.range(50_000).withColumnRenamed("id", "k")
    asked = rows.where("k % 40 = 0")
    assert 1250 <= sieve._sieved(rows, "k", asked).where("_may").count() < 1250 + 50_000 // 10


def test_a_full_sieve_still_gives_the_exact_rows(spark, monkeypatch):
    monkeypatch.setattr(sieve, "SLOTS", 1)
    rows = spark.range(100_000).withColumnRenamed("id", "k")
    assert sieve.among(rows, "k", rows.where("k % 2 = 0")).count() == sieve.without(rows, "k", rows.where("k % 2 = 0")).count() == 50_000


def test_near_dedup_shuffles_no_texts_without_a_copy(spark, monkeypatch):
    """Texts without a near copy stay out of the exact join; the plain semi join took all of them."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    docs = spark.createDataFrame([(i, words(i if i < 2980 else i - 2980) + (" end" if i >= 2980 else "")) for i in range(3000)], "doc_id long, text string")
    taken = []

    real = sieve._sieved

    def counted(rows, key, ids):
        told = real(rows, key, ids)
        if "text" in rows.columns:
            taken.append(told.where("_may").count())
        return told

    monkeypatch.setattr(sieve, "_sieved", counted)
    assert near_dedup.near_duplicates(docs).where("NOT kept").count() == 20
    assert len(taken) == 2 and taken[0] < 500 and taken[1] < 500
