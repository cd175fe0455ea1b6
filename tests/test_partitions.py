"""Shuffle partitions follow the tables' bytes, and what the session sets itself stays."""

import pytest

from waymeld import session

FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def fresh(spark):
    s = spark.newSession()
    for name in (FIRST, ADVISED, "waymeld.initialPartitionNum"):
        s.conf.unset(name)
    return s


def test_partitions_grow_with_the_tables(fresh, tmp_path, monkeypatch):
    fresh.range(200_000).write.parquet(str(tmp_path / "one.parquet"))
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file())
    found = []
    for each in (size // 8, size // 80, size * 2):
        monkeypatch.setattr(session, "PARTITION_BYTES", each)
        session.measure_partitions(fresh, str(tmp_path))
        found.append(int(fresh.conf.get(FIRST)))
    assert 8 <= found[0] <= 10 and 80 <= found[1] <= 90 and found[2] == int(fresh.conf.get("spark.sql.shuffle.partitions"))
    assert fresh.conf.get(ADVISED) == session.MERGED


def test_own_settings_stay(fresh):
    fresh.conf.set(FIRST, "7")
    fresh.conf.set(ADVISED, "1g")
    session.measure_partitions(fresh, "/root/testdata/sf0.001")
    assert (fresh.conf.get(FIRST), fresh.conf.get(ADVISED)) == ("7", "1g")


def test_a_task_scans_few_bytes(fresh, tmp_path):
    fresh.conf.unset("spark.sql.files.maxPartitionBytes")
    session.measure_partitions(fresh, "/root/testdata/sf0.001")
    assert fresh.conf.get("spark.sql.files.maxPartitionBytes") == session.SCANNED
    fresh.conf.set("spark.sql.files.maxPartitionBytes", "1g")
    session.measure_partitions(fresh, "/root/testdata/sf0.001")
    assert fresh.conf.get("spark.sql.files.maxPartitionBytes") == "1g"
