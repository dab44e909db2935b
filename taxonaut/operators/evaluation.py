"""Evaluation of several models at once: predictions are read once, every table of figures is a grouping set of one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import split
from .ranking import naive_bayes, naive_bayes_top

DP = 6


def outcomes(predictions: DataFrame, truth: DataFrame, bins: int = 10) -> DataFrame:
    """One row for each model and item of ``truth``: hit and sub_hit (rank of the true code and subcode), confidence, correct, chapter_hit, step, bin and the truth's bucket.

    ``predictions``: model, item_id, code, subcode, score, rank; ``truth``:
    item_id, true_code, true_subcode, bucket. An item that a model has no
    prediction for counts as missed, with confidence 0. ``step`` says what the
    first two scores call for: 3a (clear), 3b (close), 1 (single), none.
    """
    models = predictions.select("model").distinct()  # some names
    base = truth.join(F.broadcast(models))
    rows = base.join(predictions, ["model", "item_id"], "left")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    first = F.max(F.when(F.col("rank") == 1, F.col("code")))
    out = rows.groupBy("model", "item_id", "true_code", "true_subcode", "bucket").agg(
        F.min(F.when(F.col("code") == F.col("true_code"), F.col("rank"))).alias("hit"), F.min(F.when(F.col("subcode") == F.col("true_subcode"), F.col("rank"))).alias("sub_hit"), at(1).alias("p1"), at(2).alias("p2"), first.alias("first"),
    )
    step = F.when(F.col("p1").isNull(), "none").when(F.col("p2").isNull(), "1").when(F.col("p1") - F.col("p2") < 0.15, "3b").otherwise("3a")
    confidence = F.least(F.greatest(F.coalesce("p1", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("confidence", confidence).withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")).withColumn("step", step)
    return out.withColumn("correct", F.coalesce(F.col("hit") == 1, F.lit(False))).withColumn("chapter_hit", F.coalesce(F.substring("first", 1, 2) == F.substring("true_code", 1, 2), F.lit(False)))


def bundle(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Figures of outcomes: model, table (all, bucket, step, bin), value, n, top-k of code and subcode, chapter accuracy, mean confidence, gap.

    One aggregate over four grouping sets; ``gap`` is accuracy less
    confidence, which in the bins is what calibration errors are made of.
    """
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), DP)
    figures = [share(F.col("hit") <= k).alias(f"top{k}") for k in ks] + [share(F.col("sub_hit") <= k).alias(f"sub{k}") for k in ks]
    figures += [share(F.col("chapter_hit")).alias("chapter"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.avg(F.col("correct").cast("int")) - F.avg("confidence"), 4).alias("gap")]
    rows = rows.select("model", F.coalesce("bucket", F.lit("")).alias("bucket"), "step", F.col("bin").cast("string").alias("bin"), "hit", "sub_hit", "chapter_hit", "confidence", "correct")
    dims = [F.col(c) for c in ("model", "bucket", "step", "bin")]
    m, b, s, n = dims
    out = rows.groupingSets([[m], [m, b], [m, s], [m, n]], *dims).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), *figures)
    table = F.when(F.col("_g") == 0b0111, "all").when(F.col("_g") == 0b0011, "bucket").when(F.col("_g") == 0b0101, "step").otherwise("bin")
    return out.select("model", table.alias("table"), F.coalesce("bucket", "step", "bin", F.lit("all")).alias("value"), "n", *(c for c in out.columns if c not in ("model", "bucket", "step", "bin", "_g", "n")))


def calibration_of(figures: DataFrame) -> DataFrame:
    """Expected calibration error of each model from the bins of a bundle: model, n, ece."""
    bins = figures.filter(F.col("table") == "bin")
    return bins.groupBy("model").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs("gap")) / F.sum("n"), DP).alias("ece"))


def run(items: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """A whole evaluation: split, fit on the training side, predict the test side; predictions (model, item_id, code, subcode, score, rank) and truth.

    ``items``: item_id, code, subcode, tokens. The model is naive Bayes over
    tokens; a predicted code's subcode is the most frequent of its training
    items, ties to the smaller. The bucket says whether the item's class has
    ten training items.
    """
    sides = split.stratified_split(items.select("item_id", "code")).select("item_id", "split")
    rows = items.join(sides, "item_id")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    counts = train.groupBy("code", "subcode").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("code").agg(F.min(F.struct((-F.col("n")).alias("n"), "subcode")).alias("u"), F.sum("n").alias("size"))
    found = naive_bayes_top(naive_bayes(train), test.select("item_id", "tokens"), k)
    predictions = found.join(usual.select("code", F.col("u.subcode").alias("subcode")), "code", "left").select(F.lit("naive_bayes").alias("model"), "item_id", "code", "subcode", "score", "rank")
    bucket = F.when(F.coalesce("size", F.lit(0)) >= 10, "frequent").otherwise("rare")
    truth = test.join(usual.select("code", "size"), "code", "left").select("item_id", F.col("code").alias("true_code"), F.col("subcode").alias("true_subcode"), bucket.alias("bucket"))
    return predictions, truth
