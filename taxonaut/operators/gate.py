"""Gate by notes, fact checks, risk and decision: joins of candidates with reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize, section_of, tokenize
from ..sources.scratch import kept, reference, spread

DP = 6
KEYS = ["item_id", "code"]


def notes_of(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """Candidates with the notes of their section and chapter (null chapter: the whole section)."""
    rows = candidates.withColumn("chapter_num", F.substring("code", 1, 2).cast("int")).withColumn("section_num", section_of(F.col("chapter_num")))
    own = notes.select("note_id", "note_type", "note_content", "keywords", "redirect_to", "section_num", "chapter_num", "position")
    whole = rows.join(own.filter("chapter_num is null").drop("chapter_num"), "section_num")
    part = rows.join(own.filter("chapter_num is not null").drop("section_num"), "chapter_num")
    return whole.select(*rows.columns, "note_id", "note_type", "note_content", "keywords", "redirect_to", "position").unionByName(part.select(*rows.columns, "note_id", "note_type", "note_content", "keywords", "redirect_to", "position"))


def note_scores(candidates: DataFrame, items: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds score to each (item, code, note): .3 for a keyword in the text, .15 for a shared token, .2 x share of the text's words, at most 1."""
    words = F.array_distinct(F.array_remove(F.split(normalize(F.col("note_content")), " "), ""))
    prepared = notes.withColumn("_k", F.transform("keywords", lambda k: normalize(k))).withColumn("_kt", F.transform("keywords", lambda k: tokenize(k))).withColumn("_w", words)
    rows = notes_of(candidates, notes).join(items.select("item_id", "norm", "tokens").hint("merge"), "item_id").join(prepared.select("note_id", "_k", "_kt", "_w"), "note_id")
    each = F.zip_with("_k", "_kt", lambda k, t: F.when((F.length(k) >= 2) & F.contains(F.col("norm"), k), 0.3).when(F.arrays_overlap(t, F.col("tokens")), 0.15).otherwise(0.0))
    own = F.array_distinct(F.array_remove(F.split("norm", " "), ""))
    share = F.when(F.size(own) > 0, F.size(F.array_intersect(own, F.col("_w"))) / F.size(own)).otherwise(0.0)
    score = F.least(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) + 0.2 * share, F.lit(1.0))
    return rows.withColumn("score", F.round(score, DP)).drop("_k", "_kt", "_w", "norm", "tokens")


def gate_scores(note_rows: DataFrame, candidates: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Per candidate: include, exclude and redirect sums, redirect target (last matching note), heading terms, total, passed."""
    part = lambda t: F.round(F.coalesce(F.sum(F.when(F.col("note_type") == t, F.col("score"))), F.lit(0.0)), DP)
    target = F.max_by("redirect_to", F.when((F.col("note_type") == "redirect") & (F.col("score") > 0), F.col("position")))
    sums = note_rows.groupBy(*KEYS).agg(part("include").alias("include_support"), (-part("exclude")).alias("exclude_conflict"), (-part("redirect")).alias("redirect_penalty"), target.alias("redirect_to"))
    out = candidates.select(*KEYS).join(sums, KEYS, "left")
    out = out.join(terms, KEYS, "left") if terms is not None else out.withColumn("heading_term", F.lit(0.0))
    for c in ("include_support", "exclude_conflict", "redirect_penalty", "heading_term"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    out = out.withColumn("total", F.round(F.col("heading_term") + F.col("include_support") + F.col("exclude_conflict") + F.col("redirect_penalty"), DP))
    hard = (F.col("exclude_conflict") < -0.7) | (F.col("redirect_to").isNotNull() & (F.col("redirect_penalty") < -0.8))
    return out.withColumn("passed", ~hard)


def heading_terms(hits: DataFrame) -> DataFrame:
    """.1 for each term in the text and .05 for each token hit of a code, at most 1; from match.keyword_hits."""
    return hits.groupBy(*KEYS).agg(F.round(F.least(F.sum(F.when(F.col("substring"), 0.1).otherwise(0.05)), F.lit(1.0)), DP).alias("heading_term"))


def apply_gate(gated: DataFrame, fixed: float = 0.5) -> DataFrame:
    """Passed candidates and the redirect targets that neither passed nor failed for the item."""
    passed = gated.filter("passed").select(*KEYS, F.lit(False).alias("redirected"))
    more = gated.filter("redirect_to is not null").select("item_id", F.col("redirect_to").alias("code")).distinct().join(gated.select(*KEYS), KEYS, "left_anti")
    return passed.unionByName(more.withColumn("redirected", F.lit(True))).withColumn("fixed_score", F.when(F.col("redirected"), fixed))


def fact_holds(values: Column, operator: Column, value: Column) -> Column:
    """Whether an axis' values meet a required fact, letters in either case; comparisons of amounts never do."""
    values = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(v))
    want = F.lower(value)
    return (
        F.when(operator == "eq", F.array_contains(values, want)).when(operator == "ne", ~F.array_contains(values, want))
        .when(operator == "contains", F.exists(values, lambda v: F.contains(v, want))).when(operator == "not_contains", ~F.exists(values, lambda v: F.contains(v, want))).otherwise(False)
    )


def with_axes(candidates: DataFrame, axes: DataFrame, *columns: str) -> DataFrame:
    """Candidates with the axes of their item, an array ``_own`` (axis and ``columns``), dealt by item to tasks of few rows, as each meets many facts."""
    own = axes.groupBy("item_id").agg(F.collect_list(F.struct("axis", *columns)).alias("_own"))
    return spread(kept(candidates.select(*KEYS).join(own.hint("merge"), "item_id", "left"), "with-axes"), "item_id")


def fact_check(candidates: DataFrame, facts: DataFrame, axes: DataFrame, low: float = 0.3) -> DataFrame:
    """Per candidate: satisfied, missing hard and missing soft facts, satisfaction rate, sufficient.

    ``facts``: code, axis, operator, value, hardness; ``axes``: item_id, axis,
    values, confidence. A hard exclusion on an axis of low confidence is soft.
    Axes ride with the candidates, so rows of facts aren't shuffled to meet them.
    """
    rows = with_axes(candidates, axes, "values", "confidence").join(reference(facts, "facts"), "code")
    rows = rows.withColumn("_a", F.explode_outer(F.filter("_own", lambda x: x["axis"] == F.col("axis"))))
    op = F.col("operator")
    ok = fact_holds(F.col("_a.values"), op, F.col("value"))
    hard = (F.col("hardness") == "hard") & ~((op == "not_contains") & (F.coalesce("_a.confidence", F.lit(0.0)) < low))
    n = lambda c: F.sum(c.cast("int"))
    out = rows.withColumn("_ok", ok).withColumn("_hard", hard).groupBy(*KEYS).agg(n(F.col("_ok")).alias("satisfied"), n(~F.col("_ok") & F.col("_hard")).alias("missing_hard"), n(~F.col("_ok") & ~F.col("_hard")).alias("missing_soft"))
    total = F.col("satisfied") + F.col("missing_hard") + F.col("missing_soft")
    return out.withColumn("rate", F.round(F.col("satisfied") / total, DP)).withColumn("sufficient", F.col("missing_hard") == 0)


def missing_fact_questions(candidates: DataFrame, facts: DataFrame, axes: DataFrame, n: int = 3) -> DataFrame:
    """The facts that most candidates of an item lack, n an item."""
    rows = with_axes(candidates, axes, "values").join(reference(facts, "facts"), "code")
    rows = rows.withColumn("_a", F.explode_outer(F.filter("_own", lambda x: x["axis"] == F.col("axis"))))
    lacks = rows.filter(~F.coalesce(F.array_contains("_a.values", F.col("value")), F.lit(False)))
    counts = lacks.groupBy("item_id", "axis", "operator", "value").agg(F.countDistinct("code").alias("codes"))
    w = W.partitionBy("item_id").orderBy(F.desc("codes"), "axis", "operator", "value")
    return counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def axis_scores(candidates: DataFrame, input_axes: DataFrame, code_axes: DataFrame) -> DataFrame:
    """Jaccard overlap of an item's and a code's values on each axis, times the input's confidence."""
    rows = candidates.select(*KEYS).hint("merge").join(input_axes, "item_id").join(reference(code_axes.withColumnRenamed("values", "code_values"), "code-axes"), ["code", "axis"])
    both, either = F.size(F.array_intersect("values", "code_values")), F.size(F.array_union("values", "code_values"))
    return rows.select(*KEYS, "axis", F.round(F.least(F.when(either > 0, both / either * F.col("confidence")).otherwise(0.0), F.lit(1.0)), DP).alias("score"))


def uncertainty(axes: DataFrame, items: DataFrame) -> DataFrame:
    """Penalty of an item: .4 / .2 for three / two of the four key axes missing, .1 for each of confidence below .5."""
    key = ["material", "processing_state", "function_use", "completeness"]
    found = axes.filter(F.col("axis").isin(key)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("confidence") < 0.5).cast("int")).alias("low"))
    rows = items.select("item_id").distinct().join(found.hint("merge"), "item_id", "left")
    missing = 4 - F.coalesce("n", F.lit(0))
    penalty = F.when(missing >= 3, 0.4).when(missing >= 2, 0.2).otherwise(0.0) + 0.1 * F.coalesce("low", F.lit(0))
    return rows.select("item_id", F.round(F.least(penalty, F.lit(1.0)), DP).alias("uncertainty_penalty"))


def essential_character(candidates: DataFrame, weights: tuple[float, ...] = (0.35, 0.25, 0.2, 0.2)) -> DataFrame:
    """Winner and gap of an item from four factor scores (f1..f4) a candidate; ties to the smaller code."""
    total = sum(w * F.col(f"f{i + 1}") for i, w in enumerate(weights))
    rows = candidates.withColumn("total", F.round(total, DP)).withColumn("r", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("total"), "code")))
    at = lambda n, c: F.max(F.when(F.col("r") == n, F.col(c)))
    out = rows.groupBy("item_id").agg(at(1, "code").alias("winner"), at(1, "total").alias("best"), at(2, "total").alias("second"))
    return out.select("item_id", "winner", F.round(F.col("best") - F.coalesce("second", F.lit(0.0)), DP).alias("gap"))


def risk(items: DataFrame, high_gap: float = 0.15, medium_gap: float = 0.3, high: float = 5.0, medium: float = 2.5) -> DataFrame:
    """Adds risk_score, risk_level and risk_reasons to (p1, p2, essence_applied, missing_axes, case_conflict, divergent_rules).

    Gap 3 / 1.5, essential character 2, missing axes 1.5 each from two on,
    case conflict 2, rules that differ by jurisdiction 1.
    """
    gap = F.col("p1") - F.col("p2")
    parts = [
        ("very_small_gap", F.coalesce(gap < high_gap, F.lit(False)), F.lit(3.0)), ("small_gap", F.coalesce((gap >= high_gap) & (gap < medium_gap), F.lit(False)), F.lit(1.5)),
        ("essential_character", F.col("essence_applied"), F.lit(2.0)), ("missing_axes", F.col("missing_axes") >= 2, 1.5 * F.col("missing_axes")),
        ("case_conflict", F.col("case_conflict"), F.lit(2.0)), ("jurisdiction", F.col("divergent_rules"), F.lit(1.0)),
    ]
    score = sum((F.when(c, v).otherwise(0.0) for _, c, v in parts), F.lit(0.0))
    reasons = F.array_compact(F.array(*(F.when(c, n) for n, c, _ in parts)))
    out = items.withColumn("risk_score", score).withColumn("risk_reasons", reasons)
    return out.withColumn("risk_level", F.when(F.col("risk_score") >= high, "HIGH").when(F.col("risk_score") >= medium, "MED").otherwise("LOW"))


def decision(ranked: DataFrame, risks: DataFrame) -> DataFrame:
    """ASK without candidates, REVIEW at high risk, else AUTO; confidence is the best score; the five best as an array."""
    rows = ranked.filter("rank <= 5").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "score"))).alias("topk"))
    out = risks.select("item_id", "risk_level").join(rows, "item_id", "left")
    status = F.when(F.coalesce(F.size("topk"), F.lit(0)) <= 0, "ASK").when(F.col("risk_level") == "HIGH", "REVIEW").otherwise("AUTO")
    return out.select("item_id", status.alias("status"), F.coalesce(F.get("topk", F.lit(0))["score"], F.lit(0.0)).alias("confidence"), "topk")
