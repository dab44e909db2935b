"""Attribute axes of items and codes, and the scores, flags and questions that follow from them.

Axes are long: (item_id or code, axis, values array, confidence). Lexicons are
tables (axis, category, keyword).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import reference
from .extract import lexicon_tags

DP = 6
KEYS = ["item_id", "code"]

# The axes with their priority in questions, the key axes, values that mark parts, sets and kits.
PRIORITY = {
    "quantitative_rules": 10, "completeness": 9, "processing_state": 8, "material": 7,
    "legal_scope": 6, "function_use": 5, "physical_form": 4, "object_nature": 3,
}
KEY_AXES = ["material", "processing_state", "function_use", "completeness"]
PARTS_VALUES = ["parts", "component", "accessory", "module"]
SET_VALUES = ["set", "kit", "assortment"]
KIT_VALUES = ["ckd", "skd", "knockdown", "unassembled"]
# Chapters that a value favours, and by how much.
BOOSTS = [
    ("object_nature", ["substance"], ["28", "29", "30", "31", "32", "33", "34", "35", "38"], 1.15),
    ("processing_state", ["frozen"], ["02", "03", "04", "07", "08", "16", "19", "20", "21"], 1.1),
    ("completeness", PARTS_VALUES, ["84", "85", "87", "90"], 1.1),
]
MIXTURE_WORDS = ["재질", "성분", "소재", "합금", "혼합", "alloy", "mixture"]


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def code_index(card_keywords: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(code, axis, values): what the lexicon finds in each code's card keywords."""
    texts = card_keywords.groupBy(F.col("code").alias("item_id")).agg(F.array_join(F.array_sort(F.collect_set("keyword")), " ").alias("norm"))
    return lexicon_tags(texts, lexicon).select(F.col("item_id").alias("code"), "axis", "values")


def attributes(items: DataFrame, tags: DataFrame, quantities: DataFrame) -> DataFrame:
    """One row an item: an array of values for each axis (empty where there are none), and has_quant.

    ``tags``: item_id, axis, values; ``quantities``: item_id and an array quantities.
    """
    axes = [a for a in PRIORITY if a != "quantitative_rules"]
    wide = tags.groupBy("item_id").pivot("axis", axes).agg(F.first("values"))
    rows = items.select("item_id").distinct().join(wide.hint("merge"), "item_id", "left").join(quantities.select("item_id", "quantities").hint("merge"), "item_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("item_id", *(F.coalesce(a, none).alias(a) for a in axes), (F.coalesce(F.size("quantities"), F.lit(0)) > 0).alias("has_quant"))


def flags(attrs: DataFrame) -> DataFrame:
    """Adds is_parts, is_set, is_ckd_skd and is_incomplete, by the values of completeness."""
    has = lambda values: F.arrays_overlap("completeness", strings(values))
    return attrs.withColumns({"is_parts": has(PARTS_VALUES), "is_set": has(SET_VALUES), "is_ckd_skd": has(KIT_VALUES), "is_incomplete": has(["incomplete"])})


def policy(items: DataFrame, axes: DataFrame) -> DataFrame:
    """Per item: the axes sure enough for a hard exclusion (confidence .8), and whether to ask (three of four key axes missing)."""
    sure = F.array_sort(F.collect_list(F.when(F.col("confidence") >= 0.8, F.col("axis"))))
    known = F.count(F.when(F.col("axis").isin(KEY_AXES) & (F.size("values") > 0), 1))
    rows = axes.groupBy("item_id").agg(sure.alias("hard_axes"), known.alias("n"))
    rows = items.select("item_id").distinct().join(rows.hint("merge"), "item_id", "left")
    return rows.select("item_id", F.coalesce("hard_axes", F.array().cast("array<string>")).alias("hard_axes"), (F.coalesce("n", F.lit(0)) <= 1).alias("ask"))


def quantity_axis(candidates: DataFrame, quantities: DataFrame, rules: DataFrame) -> DataFrame:
    """f_quant_rule_match_score: .5 if the item has quantities and the code a quantity rule, 1 if one has the same property."""
    asked = candidates.select(*KEYS).join(quantities.select("item_id").distinct(), "item_id").join(rules.select("code").distinct(), "code").withColumn("_some", F.lit(0.5))
    same = quantities.select("item_id", "property").distinct().join(rules.select("code", "property").distinct(), "property").select(*KEYS).distinct().withColumn("_same", F.lit(1.0))
    rows = candidates.select(*KEYS).join(asked, KEYS, "left").join(same, KEYS, "left")
    return rows.select(*KEYS, F.when(F.col("_some").isNotNull(), F.coalesce("_same", "_some")).otherwise(0.0).alias("f_quant_rule_match_score"))


def boosted(scored: DataFrame, matches: DataFrame, axis_sums: DataFrame, conflicts: DataFrame, attrs: DataFrame, mixture: DataFrame | None = None) -> DataFrame:
    """Scores of candidates (item_id, code, score) times 1 + .1 matches, 1 + .15 axis score, 1 - .3 conflict and the chapters' boosts.

    ``matches``: item_id, code, n; ``axis_sums``: item_id, code, axis_score;
    ``conflicts``: item_id, code, f_conflict_penalty; ``attrs`` has the axes of
    items as arrays; ``mixture``: item_id, code, keyword of items with the
    mixture signal, each mixture keyword counts 1.2.
    """
    rows = scored.join(matches, KEYS, "left").join(axis_sums, KEYS, "left").join(conflicts, KEYS, "left")
    rows = rows.join(attrs.select("item_id", *{a for a, *_ in BOOSTS}), "item_id", "left")
    zero = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    factor = (1 + 0.1 * zero("n")) * (1 + 0.15 * zero("axis_score")) * (1 - 0.3 * zero("f_conflict_penalty"))
    for axis, values, chapters, by in BOOSTS:
        fits = F.coalesce(F.arrays_overlap(axis, strings(values)), F.lit(False)) & F.substring("code", 1, 2).isin(chapters)
        factor = factor * F.when(fits, by).otherwise(1.0)
    if mixture is not None:
        hits = mixture.filter(F.exists(strings(MIXTURE_WORDS), lambda w: F.contains(F.col("keyword"), w))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_m"))
        rows = rows.join(hits, KEYS, "left")
        factor = factor * F.pow(F.lit(1.2), F.coalesce("_m", F.lit(0)))
    return rows.select(*KEYS, F.round(F.col("score") * factor, DP).alias("score"))


def conflicts(ranked: DataFrame, index: DataFrame, items: DataFrame, quantity_codes: DataFrame, n: int = 5) -> DataFrame:
    """(item_id, axis, score): how much the first n candidates of an item differ on an axis.

    As many as their different values, from two on, if two of them have any
    axis; parts beside complete goods add 3; quantitative_rules counts
    codes with a quantity rule (``quantity_codes``: code) for items without quantities
    (``items``: item_id, has_quant). Only tables of codes may be broadcast.
    """
    first = ranked.filter(F.col("rank") <= n).select(*KEYS)
    met = first.join(reference(index.select("code", "axis", F.explode("values").alias("value")), "code-values"), "code")
    two = met.groupBy("item_id").agg(F.countDistinct("code").alias("k")).filter("k > 1").select("item_id").hint("merge")
    by_axis = met.join(two, "item_id", "left_semi").groupBy("item_id", "axis").agg(F.collect_set("value").alias("v"))
    extra = F.when((F.col("axis") == "completeness") & F.array_contains("v", "parts") & F.array_contains("v", "complete"), 3.0).otherwise(0.0)
    by_axis = by_axis.select("item_id", "axis", (F.when(F.size("v") > 1, F.size("v").cast("double")).otherwise(0.0) + extra).alias("score"))
    amounts = reference(quantity_codes.select("code").distinct(), "quantity-codes")
    plain = first.join(items.filter("not has_quant").select("item_id").hint("merge"), "item_id", "left_semi").join(amounts, "code", "left_semi")
    plain = plain.join(two, "item_id", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return by_axis.union(plain.select("item_id", F.lit("quantitative_rules"), "score")).filter("score > 0")


def priority(axis: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), axis), F.lit(1))


def conflict_questions(conflicts: DataFrame, texts: DataFrame, n: int = 3) -> DataFrame:
    """The first question (axis, question) of the n axes with the highest conflict times priority, ties by axis."""
    w = W.partitionBy("item_id").orderBy(F.desc(F.col("score") * priority(F.col("axis"))), F.desc(priority(F.col("axis"))), "axis")
    rows = conflicts.join(texts, "axis").withColumn("number", F.row_number().over(w)).filter(F.col("number") <= n)
    return rows.select("item_id", "number", "axis", "question")


def missing_axis_questions(items: DataFrame, axes: DataFrame, texts: DataFrame, n: int = 2) -> DataFrame:
    """The question (axis, question) of an item's n missing axes of highest priority: without values or of confidence below .3."""
    known = axes.filter((F.size("values") > 0) & (F.col("confidence") >= 0.3)).groupBy("item_id").agg(F.collect_set("axis").alias("_known"))
    rows = items.select("item_id").distinct().join(known.hint("merge"), "item_id", "left").crossJoin(F.broadcast(texts))  # one question an axis: eight rows
    lacks = ~F.coalesce(F.array_contains("_known", F.col("axis")), F.lit(False))
    w = W.partitionBy("item_id").orderBy(F.desc(priority(F.col("axis"))), "axis")
    rows = rows.filter(lacks).withColumn("number", F.row_number().over(w)).filter(F.col("number") <= n)
    return rows.select("item_id", "number", "axis", "question")
