"""Maintained ledgers and exactly-once recognition, batch by batch."""

import random

from waymeld.streaming.ledger import ExactlyOnce, LedgerUpkeep

SPAN = "journey_id string, edge_id long, lo long, hi long"


def length(spans):
    total, reach = 0, None
    for lo, hi in sorted(s for s in spans if s[1] > s[0]):
        total += max(0, hi - (lo if reach is None else max(lo, reach)))
        reach = hi if reach is None else max(reach, hi)
    return total


def test_upkeep_equals_a_plain_ledger_and_its_cost_stays_flat(spark, tmp_path):
    """Every batch has two new journeys on new edges, a replaced one and, sometimes, a removal."""
    rng = random.Random(2)
    ledger, live, ever = LedgerUpkeep(str(tmp_path / "l"), "string", buckets=4, limit=4), {}, set()
    for number in range(15):
        batch = {}
        for k in range(2):
            batch[f"j{number}-{k}"] = [(3 * number + rng.randrange(3), lo := rng.randrange(90), lo + rng.randrange(12)) for _ in range(4)]
        if number % 3 == 2:
            batch[f"j{number - 1}-0"] = [(3 * number, 5, 50), (3 * number, 5, 50)]
        if number % 5 == 4:
            batch[f"j{number - 3}-1"] = []
        rows = [(j, *s) for j, spans in batch.items() for s in spans] + [(j, None, None, None) for j, spans in batch.items() if not spans] + [(None, 1, 1, 9)]
        df = spark.createDataFrame(rows, SPAN)
        ledger(df, number)
        if number in (6, 11):
            ledger(df, number)  # a replay
        live |= batch
        ever |= {s[0] for spans in batch.values() for s in spans}
    want = {e: length([s[1:] for spans in live.values() for s in spans if s[0] == e]) for e in ever}
    assert {r[0]: r[1] for r in ledger.totals(spark).collect()} == want
    # Batches of two new journeys only. The history more than doubles between these; a bucket's
    # fill swings by two between splits, and so do the rows read, whatever the history.
    early, late = (sum(ledger.rows_read[n] for n in some) for some in ((3, 6, 7), (10, 12, 13)))
    assert late <= 2 * early, ledger.rows_read
    assert ledger.store(spark).latest()["buckets"] > 4


def test_a_lost_manifest_write_leaves_the_state_before(spark, tmp_path):
    ledger = LedgerUpkeep(str(tmp_path / "l"))
    one, two = (spark.createDataFrame([(1, 7, 0, hi)], "journey_id long, edge_id long, lo long, hi long") for hi in (10, 30))
    ledger(one, 0)
    store = ledger.store(spark)
    store.begin(1)  # a batch that dies before its commit
    store.write("totals", store.touched(two.select("edge_id")), two.selectExpr("edge_id", "99L AS unique_mm"))
    assert [tuple(r) for r in ledger.totals(spark).collect()] == [(7, 10)]
    ledger(two, 1)
    assert [tuple(r) for r in ledger.totals(spark).collect()] == [(7, 30)]
    ledger(two.limit(0), 2)
    assert [tuple(r) for r in ledger.totals(spark).collect()] == [(7, 30)]


def test_exactly_once_has_no_horizon(spark, tmp_path):
    once = ExactlyOnce(str(tmp_path / "o"), "string", buckets=2, limit=5)
    batches = [["a", "b", "b", None], ["b", "c"], [], ["d", "e", "f", "g", "h", "i"], ["a", "j"]]
    for number, ids in enumerate(batches):
        once(spark.createDataFrame([(i,) for i in ids], "id string"), number)
    once(spark.createDataFrame([("a",), ("j",)], "id string"), 4)  # replayed
    for day in range(40):  # long after
        if day in (0, 39):
            once(spark.createDataFrame([("a",), ("c",)], "id string"), 100 + day)
    want = {"a": 0, "b": 0, "c": 1, "d": 3, "e": 3, "f": 3, "g": 3, "h": 3, "i": 3, "j": 4}
    assert {r["id"]: r["batch"] for r in once.recognised(spark).collect()} == want
    told = spark.read.parquet(str(tmp_path / "o" / "recognised")).select("id", "batch").collect()
    assert {r["id"]: r["batch"] for r in told} == want and len(told) == len(want)


def test_upkeep_as_a_live_job(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(i % 2, 5, 10 * i, 10 * i + 10)], "journey_id long, edge_id long, lo long, hi long").coalesce(1).write.mode("append").parquet(source)
    ledger = LedgerUpkeep(str(tmp_path / "l"))
    q = (spark.readStream.schema("journey_id long, edge_id long, lo long, hi long").option("maxFilesPerTrigger", 1).parquet(source)
         .writeStream.foreachBatch(ledger).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    total = ledger.totals(spark).collect()
    assert len(total) == 1 and total[0]["unique_mm"] in (10, 20)  # journey 0 is replaced by its later batch
