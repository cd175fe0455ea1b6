"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest file estimate that is broadcast without a measure.
UNMEASURED = "32k"
# Bytes of the input's files for each shuffle partition that AQE starts from.
PARTITION_BYTES = 1 << 20
# Shuffled bytes up to which AQE merges partitions into one task.
MERGED = "16m"
# Bytes of files that one task scans: rows that repeat little fill the map-side aggregation with ten times as much and more.
SCANNED = "16m"
# More would cost the driver more in map statuses than it saves in the tasks.
MOST_PARTITIONS = 8_192


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "waymeld") -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster leave `master` and `partitions` unset: both then come from
    spark-submit and AQE coalesces the shuffle partitions it is given.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def measure_broadcasts(spark: SparkSession) -> None:
    """Broadcast what the session allows, but by measured size.

    Before a job runs, Spark sizes a table by its compressed file and does not see that rows are copied
    into cells: 720 000 rows of 88 MB counted as less than 256 kB. The session's limit is therefore
    handed to AQE, which measures the shuffled rows, and only small files are broadcast unmeasured.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get("spark.sql.adaptive.enabled") != "true" or spark.conf.get(measured, None) is not None:
        return
    spark.conf.set(measured, spark.conf.get(static))
    if spark.conf.get(static) != "-1":
        spark.conf.set(static, UNMEASURED)


def measure_partitions(spark: SparkSession, folder: str) -> None:
    """Let shuffles start from partitions in proportion to the tables, so that a task's rows don't grow with them.

    With a fixed number of shuffle partitions every task sorts and aggregates more as the tables grow. AQE merges
    those that turn out small, so the number is only the finest cut, and it merges up to `MERGED`, whose rows
    take ten times as much and more in a task. Settings that the session makes itself stay.
    """
    first, ours = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "waymeld.initialPartitionNum"
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", MERGED), ("spark.sql.files.maxPartitionBytes", SCANNED)):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)
    set_to = spark.conf.get(first, None)
    if spark.conf.get("spark.sql.adaptive.enabled") != "true" or (set_to is not None and set_to != spark.conf.get(ours, None)):
        return
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    held = files.agg(F.sum("length")).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, -(-held // PARTITION_BYTES)))
    for name in (first, ours):
        spark.conf.set(name, str(wanted))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session may do without the setting; it then gets a temporary
    folder, which its single process sees whole. A cluster session raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs no recompute.

    A checkpoint keeps the planner's size estimate, and a join's is the product of both sides: over the rounds of an
    iteration the number itself doubles its digits a round, until the driver is full of it. The rows are
    therefore held once while they are written, so that their real size goes along.
    """
    shared_folder(df.sparkSession)
    held = df.persist()
    held.count()
    kept = held.checkpoint(eager=True)
    held.unpersist()
    return kept


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table of its own in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_waymeld_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "waymeld_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._waymeld_shipped = True
