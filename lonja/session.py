"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans rely on.  Every one is a per-session setting, so
# they can be applied to a session that somebody else created.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when that costs one more exchange above it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: What a task of a report reads of a shuffle, and how many bytes the widest shuffle has for one stored byte of the largest table.
TASK_BYTES, WIDENING = 16 << 20, 3
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

_MADE: list[str] = []  # scratch folders of this process


def tune(spark: SparkSession) -> SparkSession:
    for key, value in TUNING.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    spark.conf.unset(FIRST_PARTITIONS)
    return spark


def bound_tasks(spark: SparkSession, stored_bytes: int) -> int:
    """Let shuffles begin with so many partitions that one has ``TASK_BYTES`` at any size of the tables; how many that are.

    Sorts and groupings of a task then take the same memory however much there is in all.  Adaptive execution merges
    partitions up to ``TASK_BYTES`` and cannot split them, so there must be enough to begin with.
    """
    n = max(-(-stored_bytes * WIDENING // TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set(FIRST_PARTITIONS, str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    return n


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder in any store that Spark reads; 0 where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


def size_shuffles(spark: SparkSession, shuffled_bytes: int, partition_bytes: int = 256 << 20) -> int:
    """Set the number of shuffle partitions so that one fits in an executor's memory.

    ``shuffled_bytes`` is what the widest stage moves: for a line-level report the selected line
    columns of its date range.  Adaptive execution merges partitions that turn out small, so a
    generous estimate costs little, while too few partitions spill.
    """
    cores = spark.sparkContext.defaultParallelism
    n = max(-(-shuffled_bytes // partition_bytes), cores)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def get_session(app: str = "lonja", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting falls back to a folder of its own, which goes when the process
    ends; on a cluster every executor must see the same storage, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _own_root()
    folder = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


@functools.cache
def _own_root() -> str:
    folder = tempfile.mkdtemp(prefix="lonja-scratch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders of this process, once no frame that reads them is needed any more; how many there were."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _MADE:
        folder = path(_MADE.pop())
        gone += bool(folder.getFileSystem(conf).delete(folder, True))
    return gone


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For a costly intermediate result that several branches of a plan need: it is computed once,
    and a lost executor does not bring its whole lineage back.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
