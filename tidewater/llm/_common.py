"""Shared folder, lineage cuts and small helpers of the text operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir, as in tests on one machine.
LOCAL_SHARED = "file:///tmp/checkpoints/tidewater"
#: Texts in one batch to a Python worker, at most; a worker holds a batch or two.
BATCH_ROWS = 1000
#: And bytes.
BATCH_BYTES = 8 << 20

#: See `join_groups`.
HOT_SHARE = 1000

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a closing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, remembered for `release`."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Ends the lineage: what follows survives lost executors without running
    what came before, and the plan stays short in loops.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables that `cut` made. Only for tables that no live DataFrame reads."""
    for path in list(_made if paths is None else paths):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _made:
            _made.remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer held; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _release_all() -> None:
    """Delete what is left when the driver ends in order; after a crash the application's folder stays."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            release(spark)


def mark() -> int:
    """The number of tables cut so far; `since(mark)` lists later ones."""
    return len(_made)


def since(start: int) -> list[str]:
    return _made[start:]


def open_fs(uri: str):
    """(pyarrow filesystem, path in it) of a shared URI; works on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://") if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(filesystem, path: str, data: bytes) -> None:
    """Write a file whole or not at all: a retried or lost task never leaves half of it in place."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(part) as out:
        out.write(data)
    filesystem.move(part, path)


def lead(spark: SparkSession, table: str, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with their groups, which hold a count of their rows in column `size`.

    Groups with more than one in HOT_SHARE rows are fewer than HOT_SHARE, so
    they may be broadcast and their rows stay where they are; the others meet
    their group by shuffle, no group above that share of the rows.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE > total
    large = groups.filter(hot)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(large), keys).unionByName(rest.join(groups.filter(~hot), keys))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; the folds of the labelled rows."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, for good: whole texts make 10,000 rows or 64 MB too large for a worker."""
    for kind, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{kind}PerBatch"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the system. For the end of a task's batches, as a Python worker lives on, idle, beside others."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
