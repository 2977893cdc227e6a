"""What the operators of this subpackage share: tables in the shared folder and sized broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Separators of words everywhere in this subpackage: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of a batch that goes to Python.
BATCH_BYTES = "4m"
#: Keys that are broadcast at most, about 30 MB.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where the session names none and runs locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (underscores for dots) that hold inside the block."""
    values = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str, codec: str = "zstd", batch_bytes: str = BATCH_BYTES) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again: lineage ends here, lost executors cost no recomputation.

    The plan's shuffle files go when it is done, its Arrow batches have a bound in bytes, and the table goes with forget()
    or else when the application ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_execution_arrow_maxBytesPerBatch=batch_bytes):
        df.write.option("compression", codec).parquet(path)
    system, at = _file_system(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewright_path = path
    return out


def collected(df: DataFrame) -> list:
    """The rows of a result of bounded size; its plan's shuffle files go when it is done."""
    with settings(df.sparkSession, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_execution_arrow_maxBytesPerBatch=BATCH_BYTES):
        return df.select("*").collect()  # a plan of its own, made under these settings


def small(df: DataFrame) -> DataFrame:
    """A table made by written(), to be broadcast if it has at most BROADCAST_ROWS rows (of a few numbers each); else Spark shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written(); only for those that no later plan reads."""
    for t in tables:
        system, at = _file_system(t.sparkSession, t._tracewright_path)
        system.delete(at, True)


def give_back() -> None:
    """Returns freed memory of this Python process to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run (a function over Arrow batches) that gives the memory it freed back to the system, as Spark uses its worker again for other stages."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_of(col: Column) -> Column:
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))
