"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACES, buckets_for, group_key, ranked, seeded, share_of, written


def n_words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACES.replace("[", "[^", 1))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """Target of each source: its weight's share of all words, at most ``epochs`` times its size.

    ``sizes`` has a row (key, source, source_size) for each source. Sources
    get the weights in turn, by code point, null last. What a capped source
    can't take goes to the others by weight: with sources sorted by cap /
    weight, one is capped just if its cap is reached when all before it are.
    """
    alone = W.partitionBy(F.lit(0))
    by_name = alone.orderBy(F.col("source").isNull(), "source")
    by_ratio = alone.orderBy(F.col("cap") / F.col("weight"), "idx")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    out = sizes.withColumn("idx", F.row_number().over(by_name)).withColumn("cap", epochs * F.col("source_size"))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") - 1) % len(weights) + 1).cast("long"))
    out = out.withColumn("all_size", F.sum("source_size").over(alone)).withColumn("all_weight", F.sum("weight").over(alone))
    out = out.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w0", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("capped", F.col("cap") * (F.col("all_weight") - F.col("w0")) + F.col("c0") * F.col("weight") <= F.col("all_size") * F.col("weight"))
    out = out.withColumn("rest", F.col("all_size") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(alone), F.lit(0)))
    out = out.withColumn("rest_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(alone))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest") / F.col("rest_weight"))
    return out.select("key", "source", "idx", "source_size", "all_size", target.alias("target"))


def quotas(plan: DataFrame, shards: int = 24, block: int = 16) -> DataFrame:
    """Sainte-Lague seats: (key, shard, blocks) for each source and shard.

    All blocks go to the sources by the highest quotients target / (2 seat -
    1), ties to the earlier source. The rule is monotone in the number of
    blocks, so the seats of shard k are those of the first k + 1 shards less
    those of the first k. Only seats that could be the last few are ranked:
    the divisor lies between all / (blocks +- sources / 2), and what is below
    that range has a seat for sure.
    """
    share = F.col("target") / F.col("all_size")
    rows = plan.filter("target > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    rows = rows.withColumn("sources", F.count(F.lit(1)).over(W.partitionBy("k")))
    rows = rows.withColumn("house", F.floor(F.round(F.col("all_size") / block) * F.col("k") / shards))
    rows = rows.withColumn("lo", F.greatest(F.lit(0), F.floor(share * (F.col("house") - F.col("sources") / 2) - 0.5)).cast("long"))
    rows = rows.withColumn("hi", F.floor(share * (F.col("house") + F.col("sources") / 2) + 1.5).cast("long"))
    rows = rows.withColumn("open", F.col("house") - F.sum("lo").over(W.partitionBy("k")))
    seats = rows.filter("hi > lo").withColumn("seat", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))))
    seats = seats.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.desc(F.col("target") / (2 * F.col("seat") - 1)), "idx")))
    seats = seats.filter("r <= open").groupBy("key", "k").agg(F.count(F.lit(1)).alias("more"))
    rows = rows.join(seats, ["key", "k"], "left").withColumn("upto", F.col("lo") + F.coalesce("more", F.lit(0)))
    blocks = F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("key").orderBy("k")), F.lit(0))
    return rows.select("key", (F.col("k") - 1).alias("shard"), blocks.alias("blocks"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, shards: int = 24, block: int = 16, seed: int = 29, broadcast_sources: int = 20_000, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words of each document the mixture takes, and into which shards.

    A source's documents, shuffled by seed, form one tape of words that is cut
    into blocks of ``block`` words and read again from its start, ``epochs``
    times at most. Each shard in turn reads as many blocks of the tape as its
    Sainte-Lague quota for the source says, and so takes words of those
    documents. Returns doc_id, source, size (words; null or blank text: 0),
    source_size, target, taken and by_shard (the words that each shard takes,
    shard 0 first; taken is their sum).

    A null source is a source of its own, sorted last; a null id is an id like
    others. Repeated ids lie beside each other on the tape, ordered by size.
    No rows, or no words: target and taken are 0. Other columns are ignored. A
    hot source is summed in seeded buckets, so no task holds one; only the
    table of sources is sorted whole.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), group_key(F.col(source)).alias("key"), n_words(text).alias("size"), seeded(F.col(doc_id), seed).alias("_h"))
    rows = rows.withColumn("_b", share_of(F.col("_h"), buckets_for(docs.count())))
    plan = targets(rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, epochs)
    earlier = W.partitionBy("key").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    reads = F.struct("shard", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)).alias("first"), "blocks")
    took = quotas(plan, shards, block).select("key", reads.alias("r")).groupBy("key").agg(F.sort_array(F.collect_list("r")).alias("reads"))
    plan = written(plan.join(took, "key", "left").select("key", "target", "reads"), "mix-plan")
    plan = F.broadcast(plan) if plan.count() <= broadcast_sources else plan  # else a skewed join splits a hot source
    rows = ranked(rows, "key", "_b", ["_h", "doc_id", "size"], "size").join(plan, "key")
    rows = rows.withColumn("by_shard", F.coalesce(F.transform("reads", lambda r: words_between(r["first"] * block, r["blocks"] * block, epochs)), F.array_repeat(F.lit(0).cast("long"), shards)))
    taken = F.aggregate("by_shard", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "source", "size", F.col("group_size").alias("source_size"), "target", taken.alias("taken"), "by_shard")


def words_between(first: Column, n: Column, epochs: int) -> Column:
    """How many of the n words from ``first`` on are a document's: it has ``size`` of each reading's group_size, from ``start`` on."""
    whole = F.greatest(F.col("group_size"), F.lit(1))

    def upto(x: Column) -> Column:
        x = F.least(x, epochs * F.col("group_size"))
        here = F.least(F.greatest(x % whole - F.col("start"), F.lit(0)), F.col("size"))
        return F.floor(x / whole) * F.col("size") + here

    return upto(first + n) - upto(first)
