"""What the corpus operators share: word splitting, shared storage, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a run of anything but ASCII white space (space, tab, LF, VT, FF, CR).
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A local session that names none gets a temporary one; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Tables that this process has written and not released.
_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    Results read it until they are saved; then :func:`release` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/taxonaut-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that :func:`written` has made in this process, once no result needs them; says how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def group_key(col: Column) -> Column:
    """A key without nulls that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def seeded(col: Column, seed: int) -> Column:
    """32 hex digits that order rows at random but alike in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("null"))).cast("binary"))


def row_key(*cols: Column) -> Column:
    """64 bits that tell rows apart by these columns; nulls are values of their own."""
    return F.xxhash64(*(c for col in cols for c in (col.isNull(), col)))


def share_of(digest: Column, buckets: int) -> Column:
    """Which of ``buckets`` equal ranges of its first 32 bits a digest falls in; ordered like it."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")


def ranked(df: DataFrame, group: str | None, bucket: str, order: list[str], size: str | None = None) -> DataFrame:
    """Adds exact positions inside each group without sorting a whole group in one task.

    ``bucket`` must be an integer ordered like ``order``. Buckets are counted
    first (with map-side combine); offsets come from running sums over the
    runs of 1024 buckets of a group, and over the buckets of a run; only the
    rows of one bucket are sorted together. Adds ``rank`` (from 1),
    ``group_rows`` and, with ``size``, ``start`` (sum of the sizes before the
    row) and ``group_size``.
    """
    of = [group] if group else []
    keys = [*of, bucket]
    sums = [F.count(F.lit(1)).alias("_n"), *([F.sum(size).alias("_s")] if size else [])]
    totals = [("_n", "group_rows"), *([("_s", "group_size")] if size else [])]
    cells = df.groupBy(*keys).agg(*sums).withColumn("_run", F.shiftright(bucket, 10))
    whole = W.partitionBy(*of) if of else W.partitionBy(F.lit(0))
    earlier = lambda w, by: w.orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    sofar = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    runs = cells.groupBy(*of, "_run").agg(*(F.sum(c).alias(c) for c, _ in totals))
    runs = runs.select(*of, "_run", *(sofar(c, earlier(whole, "_run")).alias(f"{c}1") for c, _ in totals), *(F.sum(c).over(whole).alias(g) for c, g in totals))
    cells = cells.join(runs, [*of, "_run"])
    cells = cells.select(*keys, *((F.col(f"{c}1") + sofar(c, earlier(W.partitionBy(*of, "_run"), bucket))).alias(f"{c}0") for c, _ in totals), *(g for _, g in totals))
    inside = W.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_r", F.row_number().over(inside))
    if size:
        df = df.withColumn("_p", F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(size))
    df = df.join(cells, keys).withColumn("rank", F.col("_n0") + F.col("_r"))
    if size:
        df = df.withColumn("start", F.col("_s0") + F.col("_p"))
    return df.drop("_n0", "_r", "_s0", "_p")


def drawn(df: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """The ``most`` rows of each group whose keys have the least seeded hashes; keys must be distinct in a group.

    Rows are counted by the first 12 bits of the hash, so only those of the
    bits that are needed meet in one task for a group.
    """
    hashed = df.withColumn("_d", F.xxhash64(key, F.lit(seed))).withColumn("_c", F.shiftright("_d", 52))
    w = W.partitionBy(group).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    counts = hashed.groupBy(group, "_c").agg(F.count(F.lit(1)).alias("_n"))
    need = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter(F.col("_before") < most).select(group, "_c")
    kept = hashed.join(F.broadcast(need), [group, "_c"])  # 4096 rows a group at most
    rows = kept.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("_d", key))).filter(F.col("_r") <= most)
    return rows.select(df.columns)


def buckets_for(rows: int, per_bucket: int = 2000) -> int:
    """As many buckets as keep about ``per_bucket`` rows in each."""
    return max(1, min(1 << 30, -(-rows // per_bucket)))
