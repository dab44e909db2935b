"""Evaluation metrics over long predictions (item_id, true_code, rank, code, score).

Rank 1 is the best guess. Items without a row of rank 1 count in the
denominator of top-k figures if they are in ``items``; all other figures are
over top-1 rows. Every metric is one or two grouped passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import error_type, route

DP = 6


def top1(pred: DataFrame) -> DataFrame:
    return pred.filter("rank = 1").select("item_id", "true_code", "code", "score", (F.col("true_code") == F.col("code")).alias("correct"))


def hit_ranks(pred: DataFrame) -> DataFrame:
    """item_id, true_code and the rank of the true code (null: not among the candidates)."""
    return pred.groupBy("item_id", "true_code").agg(F.min(F.when(F.col("true_code") == F.col("code"), F.col("rank"))).alias("hit"))


def top_k_accuracy(pred: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: n and the share of items whose true code is among the first k."""
    share = [F.round(F.avg(F.coalesce(F.col("hit") <= k, F.lit(False)).cast("double")), DP).alias(f"top{k}") for k in ks]
    return hit_ranks(pred).agg(F.count(F.lit(1)).alias("n"), *share)


def class_scores(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every true or predicted code (0 where undefined)."""
    rows = top1(pred)
    long = rows.select(F.explode(F.array(
        F.struct(F.col("true_code").alias("code"), F.col("correct").cast("int").alias("tp"), F.lit(0).alias("fp"), (~F.col("correct")).cast("int").alias("fn")),
        F.struct(F.col("code"), F.lit(0).alias("tp"), (~F.col("correct")).cast("int").alias("fp"), F.lit(0).alias("fn")))).alias("x")).select("x.*")
    sums = long.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("code", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"), "tp", "fp", "fn")


def f1_summary(pred: DataFrame) -> DataFrame:
    """Macro, weighted and micro precision, recall and F1."""
    rows = class_scores(pred)
    out = []
    for m in ("precision", "recall", "f1"):
        out += [F.round(F.avg(m), DP).alias(f"{m}_macro"), F.round(F.sum(F.col(m) * F.col("support")) / F.sum("support"), DP).alias(f"{m}_weighted")]
    micro = F.round(F.sum("tp") / F.sum(F.col("tp") + F.col("fp")), DP).alias("f1_micro")
    return rows.agg(F.count(F.lit(1)).alias("classes"), *out, micro)


def coverage(pred: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct predicted codes over all codes of ``classes``."""
    known = classes.agg(F.countDistinct("code").alias("all_classes"))
    return top1(pred).agg(F.countDistinct("code").alias("predicted")).join(known).select("predicted", "all_classes", F.round(F.col("predicted") / F.col("all_classes"), DP).alias("coverage"))


def accuracy_by_level(pred: DataFrame) -> DataFrame:
    """Correct, total, accuracy and number of codes of each chapter and each code in it (null code: the chapter)."""
    rows = top1(pred).withColumn("chapter", F.substring("true_code", 1, 2))
    out = rows.rollup("chapter", "true_code").agg(F.sum(F.col("correct").cast("int")).alias("correct"), F.count(F.lit(1)).alias("total"), F.countDistinct("true_code").alias("codes"))
    return out.filter("chapter is not null").select("chapter", F.col("true_code").alias("code"), "correct", "total", "codes", F.round(F.col("correct") / F.col("total"), DP).alias("accuracy"))


def confidence(score: Column) -> Column:
    """A score as a probability: outside 0..1 it goes through a sigmoid."""
    p = F.when((score > 1) | (score < 0), 1 / (1 + F.exp(-score))).otherwise(score)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def calibration_bins(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins (the last closed): count, accuracy, mean confidence and part of the calibration error.

    An empty bin has accuracy 0 and its midpoint as confidence.
    """
    rows = top1(pred).withColumn("p", confidence(F.col("score"))).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    sums = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("a"), F.avg("p").alias("c"))
    sums = sums.withColumn("all", F.sum("n").over(W.partitionBy(F.lit(0))))  # one row a bin
    every = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(sums, "bin", "left")
    return out.select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("a", F.lit(0.0)), DP).alias("accuracy"),
        F.round(F.coalesce("c", (F.col("bin") + 0.5) / bins), DP).alias("confidence"),
        F.round(F.coalesce(F.abs(F.col("a") - F.col("c")) * F.col("n") / F.col("all"), F.lit(0.0)), DP).alias("contribution"),
    )


def reliability_curve(pred: DataFrame, bins: int = 10) -> DataFrame:
    return calibration_bins(pred, bins).select("bin", F.round((F.col("bin") + 0.5) / bins, DP).alias("center"), "accuracy", F.col("n").alias("count"))


def calibration(pred: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected calibration error, Brier score, items."""
    rows = top1(pred).withColumn("p", confidence(F.col("score"))).withColumn("y", F.col("correct").cast("double")).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    sums = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("b"))
    return sums.agg(F.round(F.sum(F.abs(F.col("y") - F.col("p"))) / F.sum("n"), DP).alias("ece"), F.round(F.sum("b") / F.sum("n"), DP).alias("brier"), F.sum("n").alias("n"))


def confidence_histogram(pred: DataFrame, bins: int = 20) -> DataFrame:
    """Right and wrong top-1 guesses by confidence."""
    rows = top1(pred).withColumn("bin", F.least(F.floor(confidence(F.col("score")) * bins), F.lit(bins - 1)).cast("int"))
    sums = rows.groupBy("bin").agg(F.sum(F.col("correct").cast("long")).alias("r"), F.sum((~F.col("correct")).cast("long")).alias("w"))
    every = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(sums, "bin", "left").select("bin", F.coalesce("r", F.lit(0)).alias("right"), F.coalesce("w", F.lit(0)).alias("wrong"))


def overconfidence(pred: DataFrame, threshold: float = 0.8) -> DataFrame:
    """How many guesses at or above the threshold are right and wrong."""
    rows = top1(pred).filter(F.col("score") >= threshold)
    n, right = F.count(F.lit(1)), F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0))
    rate = F.round(F.when(n > 0, (n - right) / n).otherwise(0.0), DP)
    return rows.agg(n.alias("n_high"), right.alias("n_right"), (n - right).alias("n_wrong"), rate.alias("overconfidence_rate"), F.round(F.when(n > 0, right / n).otherwise(0.0), DP).alias("high_accuracy"))


def confidence_distribution(pred: DataFrame) -> DataFrame:
    """Count, mean, population deviation, quartiles of the confidence of right and of wrong guesses."""
    q = lambda p: F.round(F.percentile("score", F.lit(p)), DP)
    out = top1(pred).groupBy("correct").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), DP).alias("mean"), F.round(F.stddev_pop("score"), DP).alias("std"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"))
    return out


def separation(pred: DataFrame) -> DataFrame:
    """Mean confidence of right guesses less that of wrong ones."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("score"))), F.lit(0.0))
    return top1(pred).agg(F.round(mean(F.col("correct")) - mean(~F.col("correct")), DP).alias("mean_diff"))


def routed(pred: DataFrame, auto: float = 0.7, review: float = 0.4) -> DataFrame:
    """Each item's route, with whether the first and the first three guesses are right."""
    rows = pred.groupBy("item_id", "true_code").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("confidence"),
        F.coalesce(F.min(F.when(F.col("true_code") == F.col("code"), F.col("rank"))), F.lit(1 << 30)).alias("hit"))
    return rows.filter("confidence is not null").select("item_id", "confidence", route(F.col("confidence"), auto, review).alias("route"), (F.col("hit") == 1).alias("correct"), (F.col("hit") <= 3).alias("top3"))


def routing(pred: DataFrame, auto: float = 0.7, review: float = 0.4) -> DataFrame:
    """Count, share, accuracy and top-3 rate of each route."""
    rows = routed(pred, auto, review).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), DP).alias("accuracy"), F.round(F.avg(F.col("top3").cast("double")), DP).alias("top3_rate"))
    return rows.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), DP))  # one row a route


def threshold_grid(pred: DataFrame, target: float = 0.9, least_ratio: float = 0.3) -> DataFrame:
    """For each pair of thresholds of the grid that reaches the target: accuracy and share of AUTO, top-3 rates of the rest.

    The grid is in steps of 0.05: auto from 0.5 to 0.9, review from 0.2 to
    below auto. Items are counted once by the grid cells of their confidence,
    so the grid meets small sums, not items.
    """
    steps = F.sequence(F.lit(0), F.lit(20))
    rows = routed(pred).withColumn("cell", F.aggregate(F.transform(steps, lambda i: (F.col("confidence") >= F.round(i * 0.05, 2)).cast("int")), F.lit(-1), lambda a, b: a + b))
    sums = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("y"), F.sum(F.col("top3").cast("long")).alias("t"))
    grid = pred.sparkSession.range(10, 19).select(F.col("id").cast("int").alias("a")).withColumn("r", F.explode(F.sequence(F.lit(4), F.col("a") - 1)))
    met = sums.join(F.broadcast(grid))  # 21 cells by 99 pairs of thresholds
    part = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    auto, ask, rest = F.col("cell") >= F.col("a"), (F.col("cell") < F.col("a")) & (F.col("cell") >= F.col("r")), F.col("cell") < F.col("r")
    met = met.groupBy("a", "r").agg(F.sum("n").alias("n"), part(auto, "n").alias("an"), part(auto, "y").alias("ay"), part(ask, "n").alias("kn"), part(ask, "t").alias("kt"), part(rest, "n").alias("rn"), part(rest, "t").alias("rt"))
    ratio = lambda x, y: F.round(F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0), DP)
    out = met.select(F.round(F.col("a") * 0.05, 2).alias("auto"), F.round(F.col("r") * 0.05, 2).alias("review"), ratio("ay", "an").alias("auto_accuracy"), ratio("an", "n").alias("auto_ratio"), ratio("kt", "kn").alias("ask_top3"), ratio("rt", "rn").alias("review_top3"))
    return out.filter((F.col("auto_accuracy") >= target) & (F.col("auto_ratio") >= least_ratio))


def best_thresholds(pred: DataFrame, target: float = 0.9, least_ratio: float = 0.3) -> DataFrame:
    """The pair with the largest share of AUTO, ties to the lower thresholds; no row if none reaches the target."""
    return threshold_grid(pred, target, least_ratio).orderBy(F.desc("auto_ratio"), "auto", "review").limit(1)


def status_rates(status: DataFrame) -> DataFrame:
    """One row: share of each status among (item_id, status)."""
    rate = lambda s: F.round(F.avg((F.col("status") == s).cast("double")), DP).alias(f"{s.lower()}_rate")
    return status.agg(F.count(F.lit(1)).alias("n"), *map(rate, ("AUTO", "ASK", "REVIEW", "ABSTAIN")))


def confusion_pairs(pred: DataFrame, n: int = 20, examples: int = 5) -> DataFrame:
    """The most frequent wrong pairs, with the first example ids."""
    wrong = top1(pred).filter("not correct")
    # the least ids without collecting a whole pair: rank inside the pair first
    order = W.partitionBy("true_code", "code").orderBy("item_id")
    rows = wrong.withColumn("r", F.row_number().over(order)).groupBy("true_code", "code").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("item_id")))).alias("examples"))
    return rows.orderBy(F.desc("n"), "true_code", "code").limit(n)


def error_summary(pred: DataFrame) -> DataFrame:
    """Wrong guesses by error type, by true chapter and in all: count, chapter errors, high and low confidence, mean."""
    wrong = top1(pred).filter("not correct").select(error_type(F.col("true_code"), F.col("code")).alias("type"), F.substring("true_code", 1, 2).alias("chapter"), "score")
    count = lambda c: F.sum(c.cast("long"))
    sets = wrong.groupingSets([["type"], ["chapter"], []], "type", "chapter")
    return sets.agg(F.count(F.lit(1)).alias("n"), count(F.col("type") == "chapter_error").alias("chapter_errors"), count(F.col("score") >= 0.7).alias("high"), count(F.col("score") < 0.4).alias("low"), F.round(F.avg("score"), DP).alias("mean_confidence"))


def chapter_confusions(pred: DataFrame, n: int = 5) -> DataFrame:
    """The chapters that each true chapter's errors go to, most frequent first."""
    wrong = top1(pred).filter("not correct").groupBy(F.substring("true_code", 1, 2).alias("chapter"), F.substring("code", 1, 2).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("chapter").orderBy(F.desc("n"), "predicted")
    return wrong.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def failure_cases(pred: DataFrame, n: int = 20, kind: str | None = None, high_confidence: bool = False) -> DataFrame:
    """The most confident wrong guesses, of one error type or all."""
    wrong = top1(pred).filter("not correct").withColumn("type", error_type(F.col("true_code"), F.col("code")))
    if kind:
        wrong = wrong.filter(F.col("type") == kind)
    if high_confidence:
        wrong = wrong.filter("score >= 0.7")
    return wrong.select("item_id", "true_code", "code", "score", "type").orderBy(F.desc("score"), "item_id").limit(n)


def ndcg(scored: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Mean NDCG and top-k over queries of (query_id, doc_id, label, score).

    Equal scores share the mean of their discounts. Queries with one document
    or no positive label are left out.
    """
    w = W.partitionBy("query_id")
    rows = scored.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))).withColumn("i", F.row_number().over(w.orderBy(F.desc("label"), "doc_id")))
    discount = lambda c, k: F.when(F.col(c) <= k, 1 / F.log2(F.col(c) + 1.0)).otherwise(0.0)
    tied = W.partitionBy("query_id", "score")
    for k in ks:
        rows = rows.withColumn(f"d{k}", F.avg(discount("r", k)).over(tied))
    sums = [F.count(F.lit(1)).alias("docs"), F.max("label").alias("best"), F.min(F.when(F.col("label") > 0, F.col("r"))).alias("hit")]
    for k in ks:
        sums += [F.sum(F.col("label") * F.col(f"d{k}")).alias(f"dcg{k}"), F.sum(F.col("label") * discount("i", k)).alias(f"ideal{k}")]
    query = rows.groupBy("query_id").agg(*sums).filter("docs > 1 and best > 0")
    out = [F.count(F.lit(1)).alias("queries")]
    for k in ks:
        out += [F.round(F.avg(F.col(f"dcg{k}") / F.col(f"ideal{k}")), DP).alias(f"ndcg{k}"), F.round(F.avg((F.col("hit") <= k).cast("double")), DP).alias(f"top{k}")]
    return query.agg(*out)


def improvement(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, value) against a baseline: absolute and relative change."""
    base = baseline.select("metric", F.col("value").alias("base"))
    change = F.col("value") - F.col("base")
    return metrics.join(base, "metric").select("metric", "value", "base", F.round(change, DP).alias("absolute"), F.round(F.when(F.col("base") != 0, change / F.col("base")).otherwise(0.0), DP).alias("relative"))


def as_long(row: DataFrame) -> DataFrame:
    """A row of metrics as (metric, value)."""
    names = [c for c in row.columns if c != "n"]
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))).alias("x")).select("x.*")
