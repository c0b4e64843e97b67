"""Tables that cut lineage, broadcasts that are checked first, and shipping this package to the Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A staged table of at most this many bytes on disk may be broadcast; beyond it the join is shuffled. Hash columns don't
#: compress, so in memory a table takes some ten times that at most.
BROADCAST_BYTES = 1 << 20
#: The same for a table that isn't staged, in counted rows of fixed width (ids, numbers).
BROADCAST_ROWS = 200_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application: an archive in the shared folder, which Spark hands out."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared_dir(spark)}/code/{app}/{root.name}.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(archive.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Where it is unset, a local one if all run on this
    machine (tests); on a cluster that is an error, as each executor would write to a disk of its own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = f"file://{os.path.join(tempfile.gettempdir(), 'lexigraph-shared-' + spark.sparkContext.applicationId)}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    The files live until ``clear_staged``; the folder's name holds the application's id.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def bytes_of(df: DataFrame) -> int | None:
    """Bytes on disk of a staged table, without a job; None for others."""
    path = getattr(df, "_staged_at", None)
    if path is None:
        return None
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sum(f.getLen() for f in files)


def clear_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables. Call it once all results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_BYTES, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size is checked and within the limit, else df for a shuffled join.

    For tables of fixed-width columns only: a staged one is measured by its bytes, another by its counted rows.
    """
    size = bytes_of(df)
    return F.broadcast(df) if (df.count() <= rows if size is None else size <= limit) else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one of fewer splits than the cluster has cores is spread over them, so that a small file of one row
    group doesn't leave the work to one task. Filters and column pruning still reach the scan."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
