"""Splits and ranks: windows over hash order, so results don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shuffled(key: Column, seed: int) -> Column:
    """A digest to order rows by: random, but alike in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified_split(items: DataFrame, ratios: tuple[float, float] = (0.8, 0.1), least: int = 3, drop_rare: bool = True, seed: int = 42, key: str = "item_id", stratum: str = "code") -> DataFrame:
    """train / val / test inside each class: max(1, floor(n x ratio)) rows of train and val, the rest is test.

    Classes with fewer than ``least`` rows are dropped, or go to train whole.
    A row's place in its class comes from the counts of the class's hash cells
    before its own and its place in the cell, so no task sorts a whole class.
    """
    rows = placed(items, stratum, shuffled(F.col(key), seed), key)
    upto = F.greatest(F.lit(1), F.floor(F.col("_n") * ratios[0]))
    val = upto + F.greatest(F.lit(1), F.floor(F.col("_n") * ratios[1]))
    split = F.when(F.col("_n") < least, "train").when(F.col("_r") <= upto, "train").when(F.col("_r") <= val, "val").otherwise("test")
    rows = rows.withColumn("split", split)
    return (rows.filter(F.col("_n") >= least) if drop_rare else rows).drop("_r", "_n")


def placed(rows: DataFrame, group: str, digest: Column, key: str) -> DataFrame:
    """Adds _r, the place of each row in its group by digest and key (from 1), and _n, the group's rows.

    Rows are counted in the 4096 cells of the first three hex digits; only a
    cell is sorted. Null groups are a group.
    """
    rows = rows.withColumn("_h", digest).withColumn("_c", F.substring("_h", 1, 3))
    cells = rows.groupBy(group, "_c").agg(F.count(F.lit(1)).alias("_k"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("_k").over(whole.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col(group).alias("_g"), F.col("_c").alias("_d"), before.alias("_b"), F.sum("_k").over(whole).alias("_n"))
    inside = F.row_number().over(W.partitionBy(group, "_c").orderBy("_h", key))
    rows = rows.withColumn("_i", inside).join(cells, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_c") == F.col("_d")))
    return rows.withColumn("_r", F.col("_b") + F.col("_i")).drop("_h", "_c", "_g", "_d", "_b", "_i")


def plain_split(items: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42, key: str = "item_id") -> DataFrame:
    """train / val / test by the share of the hash range that a row falls in: no shuffle at all."""
    at = F.conv(F.substring(shuffled(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return items.withColumn("split", F.when(at < train, "train").when(at < train + val, "val").otherwise("test"))


def group_split(rows: DataFrame, test: float = 0.2, seed: int = 42, group: str = "query_id") -> DataFrame:
    """Whole groups go to train or test."""
    at = F.conv(F.substring(shuffled(F.col(group), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(at < test, "test").otherwise("train"))


def frequent_classes(items: DataFrame, least: int = 3, stratum: str = "code") -> DataFrame:
    """Rows of classes with at least ``least`` rows; counts are joined back, so a large class isn't gathered."""
    keep = items.groupBy(stratum).count().filter(F.col("count") >= least).select(stratum)
    return items.join(keep, stratum, "left_semi")


def sample(items: DataFrame, n: int, seed: int = 42, key: str = "item_id") -> DataFrame:
    """n rows by hash order."""
    return items.orderBy(shuffled(F.col(key), seed), key).limit(n)


def split_statistics(split: DataFrame, stratum: str = "code") -> DataFrame:
    """Rows and classes of each split."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(stratum).alias("classes"))


def class_distribution(split: DataFrame, stratum: str = "code") -> DataFrame:
    """Rows by split and class with subtotals (null class: the split)."""
    out = split.rollup("split", stratum).agg(F.count(F.lit(1)).alias("n"))
    return out.filter("split is not null")


def top_k(scored: DataFrame, k: int, item: str = "item_id", code: str = "code", score: str = "score") -> DataFrame:
    """The k best codes of each item with their rank, ties to the smaller code."""
    w = W.partitionBy(item).orderBy(F.desc(score), code)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def adaptive_top_k(scored: DataFrame, signals: DataFrame, k: int = 30) -> DataFrame:
    """Top k with more room for items with signals: +20 incomplete, +10 mixture, +10 quantity, +5 several materials, +5 set.

    ``signals`` has one row (item_id, incomplete, mixture, has_quantity, n_materials, is_set) an item.
    """
    more = lambda c, n: F.when(c, n).otherwise(0)
    room = F.lit(k) + more(F.col("incomplete"), 20) + more(F.col("mixture"), 10) + more(F.col("has_quantity"), 10) + more(F.col("n_materials") > 1, 5) + more(F.col("is_set"), 5)
    room = signals.select("item_id", room.alias("room"))
    w = W.partitionBy("item_id").orderBy(F.desc("score"), "code")
    out = scored.withColumn("rank", F.row_number().over(w)).join(room, "item_id", "left")
    return out.filter(F.col("rank") <= F.coalesce("room", F.lit(k))).drop("room")


def gap_confidence(ranked: DataFrame) -> DataFrame:
    """Per item: first and second score relative to the best, their gap, confidence = min(first, 0.5 + gap, 1)."""
    rows = ranked.groupBy("item_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.max_by("code", -F.col("rank")).alias("code"))
    second = F.coalesce(F.col("s2"), F.lit(0.0))
    gap = F.when(F.col("s1") > 0, (F.col("s1") - second) / F.col("s1")).otherwise(0.0)
    return rows.select("item_id", "code", F.round(gap, 6).alias("gap"), F.round(F.least(F.lit(1.0), 0.5 + gap), 6).alias("confidence"))


def softmax(scored: DataFrame, item: str = "item_id") -> DataFrame:
    """Adds p, the softmax of an item's scores."""
    w = W.partitionBy(item)
    return scored.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w))).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def move_first(ranked: DataFrame, target: DataFrame) -> DataFrame:
    """Ranks with the target code (item_id, target) of an item first and the rest in order."""
    w = W.partitionBy("item_id").orderBy(F.when(F.col("code") == F.col("target"), 0).otherwise(1), "rank")
    return ranked.join(target, "item_id", "left").withColumn("rank", F.row_number().over(w)).drop("target")


def move_last(ranked: DataFrame, codes: Column, when: Column) -> DataFrame:
    """Ranks with some codes (a condition) after the others where ``when`` holds."""
    w = W.partitionBy("item_id").orderBy(F.when(when & codes, 1).otherwise(0), "rank")
    return ranked.withColumn("rank", F.row_number().over(w))


def break_ties(ranked: DataFrame, within: float = 0.05) -> DataFrame:
    """Of the codes within ``within`` of the best score, the highest code comes first."""
    w = W.partitionBy("item_id")
    best = F.max("score").over(w)
    first = F.max(F.when(F.abs(F.col("score") - F.col("_best")) < within, F.col("code"))).over(w)
    out = ranked.withColumn("_best", best).withColumn("_first", first)
    order = w.orderBy(F.when(F.col("code") == F.col("_first"), 0).otherwise(1), "rank")
    return out.withColumn("rank", F.row_number().over(order)).drop("_best", "_first")


def leakage(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts of the test side that are in the train side: count and share."""
    a, b = train.select(text).distinct(), test.select(text).distinct()
    both = b.join(a.withColumn("_in", F.lit(1)), text, "left")
    n = F.count(F.lit(1))
    return both.agg(n.alias("test_texts"), F.count("_in").alias("shared"), F.round(F.when(n > 0, F.count("_in") / n).otherwise(0.0), 6).alias("ratio"))


def known_classes(test: DataFrame, train: DataFrame, code: str = "code") -> DataFrame:
    """Test rows whose class the training side has; null classes go."""
    return test.join(train.select(code).distinct(), code, "left_semi").select(test.columns)


def first_distinct(values: Column, n: int) -> Column:
    """The first n different entries of an array, in order."""
    return F.slice(F.array_distinct(values), 1, n)
