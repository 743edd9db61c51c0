"""Session set-up and the shared folder for intermediate tables.

Iterative steps (selection passes, boosting rounds, forests) read the same input
many times.  ``materialize`` writes such an input once as parquet in the folder
the cluster names in ``spark.checkpoint.dir``: the lineage is cut, columns stay
prunable, and a lost executor costs only the re-read of a file.  ``release`` frees
a table that is no longer needed; what is left goes with the session.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "gavelstat") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", _own_folder())
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A folder for a session whose driver and tasks are one process on one machine."""
    folder = tempfile.mkdtemp(prefix="gavelstat-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as configured for checkpoints.

    Only where there are no executors, under a ``local`` master, may the folder be unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _own_folder()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, never overwritten."""
    return f"{shared_dir(spark)}/gavelstat/{label}-{uuid.uuid4().hex}"


#: Bytes of a batch for Python, for rows that are large, and the setting's default, the only value that is replaced.
BATCH_BYTES = 8 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Have batches for Python limited by bytes, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def spread(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a plain scan that has fewer read tasks than there are cores.

    A table stored as a few small files would otherwise keep the joins above it, and every
    table written from it, on as few tasks.  A large table is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: Bytes of a row group of a table with large rows, and rows after which its writer looks at them; by default 128 MB and 100 rows,
#: which a writer collects and a reader takes into its vectors at once.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def materialize(df: DataFrame, label: str = "stage", by: str | None = None, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once and return the table read back; it goes away with the session.

    With ``by`` the table has one partition per value of that column.  Rebalancing before the
    write keeps small values in few files and spreads a dominant one over many tasks.  With ``large_rows``
    tasks that write or read it hold few rows at a time.
    """
    path = new_path(df.sparkSession, label)
    if by is None:
        df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    else:
        df.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(path)
    drop_at_exit(df.sparkSession, path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` has returned and nothing reads any more."""
    for stored in tables:
        path = vars(stored).get("stored_at")
        if path:
            place = stored.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(stored.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove an intermediate table when the session's JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
