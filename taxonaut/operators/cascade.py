"""Cascade of two result sets: which items escalate, and how both answers merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def escalation(results: DataFrame, low: float = 0.5, gap: float = 0.15) -> DataFrame:
    """Adds escalate and reason to (item_id, status, p1, p2, ...); the first reason that applies counts."""
    reason = (
        F.when(F.col("p1").isNull(), "no_candidates")
        .when(F.col("status") == "REVIEW", "decision_review")
        .when(F.col("status") == "ABSTAIN", "decision_abstain")
        .when(F.col("p1") < low, "low_top1")
        .when(F.col("p1") - F.coalesce("p2", F.lit(0.0)) < gap, "small_gap")
        .when(F.col("status") == "ASK", "decision_ask")
    )
    return results.withColumn("reason", reason).withColumn("escalate", F.col("reason").isNotNull())


def merge(first: DataFrame, second: DataFrame, least: float = 0.3, boost: float = 0.15, novel: float = 0.7) -> DataFrame:
    """Joins two answers of an item and decides between them.

    ``first`` has item_id, codes (ranked array), status, confidence; ``second``
    has item_id, answer, answer_confidence, is_fallback. An item without a
    second answer keeps the first. Returns item_id, codes, status, confidence,
    source, merge_reason.
    """
    rows = first.join(second, "item_id", "left")
    top5 = F.slice("codes", 1, 5)
    place = F.array_position(top5, F.col("answer"))
    reason = (
        F.when(F.col("is_fallback").isNull(), "direct")
        .when(F.col("is_fallback"), "fallback")
        .when(F.coalesce(F.col("answer"), F.lit("")) == "", "no_answer")
        .when(F.col("answer_confidence") < least, "low_confidence")
        .when(place == 1, "same")
        .when(place > 1, "reorder")
        .when(F.col("answer_confidence") > novel, "novel_high")
        .otherwise("novel_low")
    )
    rows = rows.withColumn("merge_reason", reason)
    is_ = lambda *r: F.col("merge_reason").isin(*r)
    moved = F.concat(F.array("answer"), F.array_remove("codes", F.col("answer")))
    codes = F.when(is_("reorder"), moved).when(is_("novel_high"), F.concat(F.array("answer"), F.slice("codes", 1, 4))).otherwise(F.col("codes"))
    status = F.when(is_("same", "reorder", "novel_high"), "AUTO").when(is_("novel_low"), "REVIEW").otherwise(F.col("status"))
    conf = F.when(is_("same"), F.least(F.col("confidence") + boost, F.lit(1.0))).when(is_("reorder"), F.greatest("confidence", "answer_confidence")).when(is_("novel_high"), F.col("answer_confidence")).otherwise(F.col("confidence"))
    source = F.when(is_("same"), "confirmed").when(is_("reorder", "novel_high"), "second").otherwise("first")
    return rows.select("item_id", codes.alias("codes"), status.alias("status"), F.round(conf, 6).alias("confidence"), source.alias("source"), "merge_reason")


def run(first: DataFrame, second: DataFrame, low: float = 0.5, gap: float = 0.15) -> DataFrame:
    """Direct items keep the first answer, escalated ones are merged with the second."""
    marked = escalation(first.withColumn("p1", F.get("scores", F.lit(0))).withColumn("p2", F.get("scores", F.lit(1))), low, gap)
    out = merge(marked, second.join(marked.filter("escalate").select("item_id"), "item_id", "left_semi"))
    return out.join(marked.select("item_id", "escalate", "reason"), "item_id")


def answer_confidence(answers: DataFrame) -> DataFrame:
    """Calibrated confidence of (answer_raw, best_rrf, gate_passed, has_signals, is_fallback).

    0.5 answer + 0.3 min(3 x fused score, 1) + 0.2 gate (1 or 0.3); at most 0.9
    with rule signals; a fallback counts 0.8 of it and 0.5 at most.
    """
    gate = F.when(F.col("gate_passed"), 1.0).otherwise(0.3)
    raw = 0.5 * F.col("answer_raw") + 0.3 * F.least(3 * F.col("best_rrf"), F.lit(1.0)) + 0.2 * gate
    raw = F.when(F.col("has_signals"), F.least(raw, F.lit(0.9))).otherwise(raw)
    raw = F.when(F.col("is_fallback"), F.least(raw * 0.8, F.lit(0.5))).otherwise(raw)
    return answers.withColumn("calibrated", F.round(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)), 6))


def evaluate(merged: DataFrame, truth: DataFrame) -> DataFrame:
    """Top-1 and top-5 hits by source and in all, with the share of escalated items (null source: all)."""
    rows = merged.join(truth, "item_id")
    place = F.array_position("codes", F.col("true_code"))
    rows = rows.select("source", "escalate", (place == 1).cast("int").alias("h1"), ((place >= 1) & (place <= 5)).cast("int").alias("h5"))
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.rollup("source").agg(F.count(F.lit(1)).alias("n"), mean("h1").alias("top1"), mean("h5").alias("top5"), mean(F.col("escalate").cast("int")).alias("escalated"))


def regressions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Items by who is right of two top-1 sets (item_id, correct): both, neither, improvement, regression."""
    met = first.select("item_id", F.col("correct").alias("a")).join(second.select("item_id", F.col("correct").alias("b")), "item_id")
    kind = F.when(F.col("a") & F.col("b"), "both_correct").when(F.col("a"), "regression").when(F.col("b"), "improvement").otherwise("both_wrong")
    return met.groupBy(kind.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def wins(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """Items by which of three systems has them right, e.g. 101."""
    out = None
    for i, x in enumerate((first, second, third)):
        one = x.select("item_id", F.col("correct").cast("int").cast("string").alias(f"c{i}"))
        out = one if out is None else out.join(one, "item_id")
    return out.groupBy(F.concat("c0", "c1", "c2").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def union_accuracy(sets: list[DataFrame]) -> DataFrame:
    """Share of items that at least one of the top-1 sets has right."""
    every = sets[0].select("item_id", "correct")
    for x in sets[1:]:
        every = every.unionByName(x.select("item_id", "correct"))
    return every.groupBy("item_id").agg(F.max("correct").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("c").cast("int")), 6).alias("accuracy"))


def collected(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Ranked rows as one row an item: codes and scores in rank order."""
    rows = ranked.filter(F.col("rank") <= k).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "score"))).alias("r"))
    return rows.select("item_id", F.transform("r", lambda s: s["code"]).alias("codes"), F.transform("r", lambda s: s["score"]).alias("scores"))


