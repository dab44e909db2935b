"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, group_key, ranked, seeded, share_of


def interleave(docs: DataFrame, shards: int = 24, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Deals all rows into ``shards`` shards whose mixture of sources is that of the whole.

    Rows are shuffled by seed inside each source, get the fractional rank
    ``(rank - 1/2) / rows of the source``, are sorted by it and cut into equal
    runs: the law ``rows``, by which counts are at most one apart. Returns
    doc_id, source, size (UTF-8 bytes of the text plus 8; a null text has no
    bytes), text_crc32 (of the UTF-8 bytes; null text: of none), law, shard,
    slot (from 0 without gaps) and grown_shard (null under this law).

    A null source is a stratum of its own; a null id is shuffled as the text
    "null". Equal ids keep apart slots; which of fully equal rows gets which
    slot doesn't matter. Copies of a text aren't held together. No rows give
    no rows; other columns are ignored, whatever their names. A hot source is
    ranked in seeded buckets of some 2000 rows, so no task holds a source.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), group_key(F.col(source)).alias("_src"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        seeded(F.col(doc_id), seed).alias("_h"),
    )
    n = docs.count()
    buckets = buckets_for(n)
    rows = ranked(rows.withColumn("_b", share_of(F.col("_h"), buckets)), "_src", "_b", ["_h", "doc_id", "text_crc32"])
    rows = rows.withColumn("_f", (2 * F.col("rank") - 1).cast("double") / (2 * F.col("group_rows")).cast("double")).drop("rank", "group_rows", "_b", "_src")
    rows = ranked(rows.withColumn("_b", F.floor(F.col("_f") * buckets).cast("int")), None, "_b", ["_f", "_h", "doc_id", "text_crc32"])
    at = F.col("rank") - 1
    rows = rows.withColumn("shard", F.floor(at * shards / F.lit(max(n, 1))).cast("int"))
    rows = rows.withColumn("shard", F.when(F.col("shard") * F.lit(n) > at * shards, F.col("shard") - 1).when((F.col("shard") + 1) * F.lit(n) <= at * shards, F.col("shard") + 1).otherwise(F.col("shard")))
    first = F.floor((F.col("shard").cast("long") * n + (shards - 1)) / F.lit(shards)).cast("long")
    return rows.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (at - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Writes the documents as Parquet, one folder a shard, in the order of the slots.

    ``placed`` is the result of :func:`interleave` for the same rows, whose
    ids must be unique here.
    """
    to = placed.select(F.col("doc_id").alias(doc_id), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = docs.join(to, doc_id).withColumnsRenamed({"_shard": "shard"}) if "shard" not in docs.columns else docs.drop("shard").join(to, doc_id).withColumnsRenamed({"_shard": "shard"})
    out.repartition("shard").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
