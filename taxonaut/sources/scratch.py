"""Tables that a job writes for itself, so that what several branches read is computed once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session that names none gets a temporary one, on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, until :func:`dropped`."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/taxonaut-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reference(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """``df`` kept, for joins with larger frames: broadcast up to ``most`` rows, beyond that both sides are shuffled.

    Left to itself, Spark takes the size of compressed files for that of the
    rows, and what it broadcasts may be the items.
    """
    out = kept(df, name)
    return F.broadcast(out) if out.count() <= most else out.hint("merge")


def spread(df: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """``df`` dealt by ``key`` over so many partitions that each has about ``rows`` rows: files that compress well are few, but not their rows."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def dropped(spark: SparkSession) -> int:
    """Deletes what :func:`kept` has written in this process, once no result reads it; says how many tables."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
