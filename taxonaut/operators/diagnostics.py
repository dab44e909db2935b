"""Diagnostics over predictions, gate results, evidence and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DP = 6


def buckets(items: DataFrame, ranked: DataFrame, train_counts: DataFrame, facts: DataFrame | None = None, gate: DataFrame | None = None, short: int = 20, rare: int = 5, ambiguous: float = 0.1) -> DataFrame:
    """Per bucket: items and top-1/3/5 hits. An item may be in several buckets or none.

    ``items``: item_id, text, true_code; ``ranked``: item_id, code, score, rank;
    ``train_counts``: code, n; ``facts``: item_id, sufficient; ``gate``:
    item_id, code, passed (of the true code).
    """
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    rows = ranked.join(items.select("item_id", "true_code"), "item_id").groupBy("item_id").agg(at(1).alias("s1"), at(2).alias("s2"), F.min(F.when(F.col("code") == F.col("true_code"), F.col("rank"))).alias("hit"))
    rows = items.join(rows, "item_id", "left").join(train_counts.select(F.col("code").alias("true_code"), "n"), "true_code", "left")
    none = F.lit(False)
    if facts is not None:
        rows = rows.join(facts.select("item_id", "sufficient"), "item_id", "left")
    if gate is not None:
        rows = rows.join(gate.select("item_id", F.col("code").alias("true_code"), "passed"), ["item_id", "true_code"], "left")
    tests = [
        ("short_text", F.length("text") < short), ("rare_class", F.coalesce("n", F.lit(0)) < rare), ("ambiguous", F.coalesce(F.col("s1") - F.col("s2") < ambiguous, none)),
        ("fact_insufficient", F.coalesce(~F.col("sufficient"), none) if facts is not None else none), ("legal_conflict", F.coalesce(~F.col("passed"), none) if gate is not None else none),
    ]
    rows = rows.withColumn("bucket", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in tests)))))
    hit = lambda k: F.sum(F.coalesce(F.col("hit") <= k, none).cast("int")).alias(f"top{k}")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), hit(1), hit(3), hit(5))


def usage(evidence: DataFrame) -> DataFrame:
    """Share of items with evidence (item_id, kind) of each kind, and the mean number."""
    per = evidence.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    items = evidence.select("item_id").distinct().agg(F.count(F.lit(1)).alias("items"))
    return per.groupBy("kind").agg(F.count(F.lit(1)).alias("used"), F.sum("n").alias("n")).join(items).select("kind", F.round(F.col("used") / F.col("items"), DP).alias("usage_rate"), F.round(F.col("n") / F.col("items"), DP).alias("mean"))


def mode_separation(rows: DataFrame) -> DataFrame:
    """Per mode: rows that use a retriever, a ranker or a model score; kb_only may use none."""
    n = lambda c: F.sum(c.cast("int"))
    out = rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), n(F.col("retriever_used")).alias("retriever"), n(F.col("ranker_used")).alias("ranker"), n(F.col("score_ml") > 0).alias("ml"))
    return out.withColumn("valid", (F.col("mode") != "kb_only") | (F.col("retriever") + F.col("ranker") + F.col("ml") == 0))


def latency(rows: DataFrame, column: str) -> DataFrame:
    q = lambda p: F.round(F.percentile(column, F.lit(p)), DP)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(column), DP).alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"))


def axis_statistics(items: DataFrame, axes: DataFrame) -> DataFrame:
    """Per axis: share of items with a value, mean number of values and mean confidence."""
    total = items.agg(F.count(F.lit(1)).alias("total"))
    rows = axes.groupBy("axis").agg(F.count(F.lit(1)).alias("k"), F.avg(F.size("values")).alias("v"), F.avg("confidence").alias("c"))
    return rows.join(total).select("axis", F.round(F.col("k") / F.col("total"), DP).alias("extraction_rate"), F.round("v", DP).alias("mean_values"), F.round("c", DP).alias("mean_confidence"))


def feature_distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: mean, p95, extremes and non-zero share; one scan for all features, rows alike in them counted first."""
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    long = counted.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("n", "s.*")
    n = lambda c: F.sum(F.when(c, F.col("n")))
    mean = F.sum(F.col("x") * F.col("n")) / n(F.col("x").isNotNull())
    nonzero = F.coalesce(n(F.col("x") != 0), F.when(n(F.col("x").isNotNull()) > 0, 0)) / n(F.col("x").isNotNull())
    return long.groupBy("feature").agg(F.round(mean, DP).alias("mean"), F.round(F.percentile("x", F.lit(0.95), F.col("n")), DP).alias("p95"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(nonzero, DP).alias("nonzero"))


def shuffled_feature(rows: DataFrame, column: str, seed: int, key: str = "row_id") -> DataFrame:
    """Rows with one feature's values permuted: values in hash order meet rows in another hash order.

    Ranks are dense over seeded buckets (see split.shuffled), so both orders
    agree on positions without collecting the column.
    """
    from .split import shuffled

    one = W.partitionBy("_b").orderBy("_h", key)

    def placed(s: int) -> DataFrame:
        return rows.withColumn("_h", shuffled(F.col(key), s)).withColumn("_b", F.substring("_h", 1, 2))

    a = placed(seed).withColumn("_r", F.row_number().over(one))
    b = placed(seed).select(key, "_b", "_h", F.col(column).alias("_v"))
    n = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    b = b.withColumn("_r", F.row_number().over(one)).join(n, "_b").select("_b", (F.col("_r") % F.col("_n") + 1).alias("_r"), "_v")
    return a.join(b, ["_b", "_r"]).drop("_b", "_r", "_h", column).withColumnRenamed("_v", column)


def missing_facts(checks: DataFrame) -> DataFrame:
    """Share of candidates with a missing hard or soft fact and mean counts."""
    rate = lambda c: F.round(F.avg((F.col(c) > 0).cast("int")), DP)
    return checks.agg(F.count(F.lit(1)).alias("n"), rate("missing_hard").alias("hard_rate"), rate("missing_soft").alias("soft_rate"), F.round(F.avg("satisfied"), DP).alias("mean_satisfied"))


def gate_exclusions(gated: DataFrame, truth: DataFrame) -> DataFrame:
    """How often the true code of an item was gated out, by chapter."""
    rows = gated.join(truth.withColumnRenamed("true_code", "code"), ["item_id", "code"])
    return rows.groupBy(F.substring("code", 1, 2).alias("chapter")).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("passed")).cast("int")).alias("excluded"))


def case_comparison(cases: DataFrame) -> DataFrame:
    """Per mode: share of cases with rules, 10- and 6-digit codes, rejected codes, reasoning; mean confidence."""
    share = lambda c: F.round(F.avg(c.cast("int")), DP)
    return cases.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), share(F.size("applied_rules") > 0).alias("rules"), share(F.col("code10") != "").alias("code10"), share(F.col("code6") != "").alias("code6"),
        share(F.size("rejected_codes") > 0).alias("rejected"), share(F.size("decisive_reasoning") > 0).alias("decisive"), F.round(F.avg("confidence"), DP).alias("confidence"),
    )


def kb_statistics(cards: DataFrame) -> DataFrame:
    """Codes, chapters, keywords and mean keywords of card keywords (code, keyword)."""
    per = cards.groupBy("code").agg(F.countDistinct("keyword").alias("k"))
    rows = per.agg(F.count(F.lit(1)).alias("codes"), F.countDistinct(F.substring("code", 1, 2)).alias("chapters"), F.round(F.avg("k"), DP).alias("mean_keywords"))
    return rows.join(cards.agg(F.countDistinct("keyword").alias("keywords")))
