"""Classification by retrieval and an external answer: one job whose branches are disjoint sets of items, rejoined at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scorers
from .extract import parsed_answer

KEYS = ["item_id", "code"]
ANSWER = "best_code string, confidence double, need_info boolean, questions array<string>, candidates array<struct<code: string, score: double>>"


def parsed(answers: DataFrame) -> DataFrame:
    """Answers (item_id, raw) with the parsed struct a; null where there is no text or no JSON in it."""
    return answers.select("item_id", parsed_answer(F.col("raw"), ANSWER).alias("a"))


def answered_candidates(answers: DataFrame, retrieved: DataFrame, n: int = 10) -> DataFrame:
    """Ranked candidates of items with an answer: its best code first where its own list lacks it, its list, then the first n retrieved codes.

    ``answers``: item_id and the struct a. Blank codes are dropped.
    """
    own = F.transform(F.coalesce("a.candidates", F.array().cast("array<struct<code:string,score:double>>")), lambda c: F.coalesce(c["code"], F.lit("")))
    lacks = (F.coalesce("a.best_code", F.lit("")) != "") & ~F.array_contains(own, F.coalesce("a.best_code", F.lit("")))
    codes = F.when(lacks, F.concat(F.array("a.best_code"), own)).otherwise(own)
    named = answers.select("item_id", F.posexplode(codes).alias("position", "code")).filter("code <> ''")
    return scorers.answer_candidates(named, retrieved.filter(F.col("rank") <= n).join(answers.select("item_id"), "item_id", "left_semi"), 1 << 20)


def run(items: DataFrame, retrieved: DataFrame, answers: DataFrame, gated: DataFrame, n: int = 10) -> DataFrame:
    """One row an item: branch, best, codes, confidence, status, is_fallback, need_info, n_questions.

    ``items``: item_id, has_signals; ``retrieved``: item_id, code, score, rank
    (fused); ``answers``: item_id, raw text of another system, null or missing
    if it failed; ``gated``: item_id, code, passed.

    Branches, told apart by what an item has: ``nothing`` (nothing was
    retrieved: no code, confidence 0), ``fallback`` (no answer, or none that
    can be parsed: the first n retrieved codes with an answer worth 0),
    ``outside`` (the answer's code isn't among the retrieved) and ``answer``.
    Candidates that the gate excludes go last and the first of the rest is the
    best; the confidence weighs answer, retrieval and gate. Missing
    information asks; without it the confidence decides.
    """
    first = retrieved.groupBy("item_id").agg(F.max("score").alias("best_rrf"), F.collect_set("code").alias("_codes"))
    base = items.select("item_id", "has_signals").join(first, "item_id", "left").join(parsed(answers), "item_id", "left")
    outside = ~F.array_contains("_codes", F.coalesce("a.best_code", F.lit("")))
    base = base.withColumn("branch", F.when(F.col("best_rrf").isNull(), "nothing").when(F.col("a").isNull(), "fallback").when(outside, "outside").otherwise("answer"))
    base = base.withColumn("is_fallback", F.col("branch") == "fallback").withColumn("answer_raw", F.coalesce("a.confidence", F.lit(0.0)))
    with_answer = base.filter(F.col("branch").isin("answer", "outside"))
    without = retrieved.filter(F.col("rank") <= n).join(base.filter("branch = 'fallback'").select("item_id"), "item_id", "left_semi").select(*KEYS, "rank")
    ranked = answered_candidates(with_answer.select("item_id", "a"), retrieved, n).select(*KEYS, "rank").unionByName(without)
    made = scorers.post_processed(ranked, gated, base.select("item_id", "answer_raw", "best_rrf", "has_signals", "is_fallback"))
    out = base.join(made, "item_id", "left")
    needs = F.coalesce("a.need_info", F.lit(False)) & (F.col("branch") != "nothing")
    confidence = F.coalesce("confidence", F.lit(0.0))
    questions = F.when(F.col("branch") == "nothing", 0).otherwise(F.coalesce(F.size("a.questions"), F.lit(0)))
    return out.select(
        "item_id", "branch", F.coalesce("best", F.lit("")).alias("best"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), confidence.alias("confidence"),
        scorers.answer_status(needs, confidence).alias("status"), "is_fallback", needs.alias("need_info"), F.greatest(questions, F.lit(0)).alias("n_questions"),
    )
