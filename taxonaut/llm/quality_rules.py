"""Quality rules: text statistics and a hashed n-gram likelihood ratio; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words_of


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of three that occur twice or more in ``_w``.

    Windows are hashed to 64 bits and sorted with their positions, so equal
    ones are neighbours: n log n in the length, however long the text.
    """
    n = F.size("_w")
    window = lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p"))
    df = df.withColumn("_s", F.when(n > 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))))
    twin = lambda x, i: F.coalesce(F.get("_s", F.greatest(i - 1, F.lit(0)))["h"] == x["h"], F.lit(False)) & (i > 0) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_t", F.sort_array(F.transform(F.filter("_s", twin), lambda x: x["p"])))
    gaps = F.zip_with("_t", F.slice("_t", 2, F.greatest(F.size("_t"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s", "_t")


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words and base counts of each row: _w, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("_x"), "\n"), lambda x: x.rlike(SPACES.replace("[", "[^", 1)))
    df = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("_x"), words_of(F.col(text)).alias("_w"))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", (F.length("_x") - F.length(F.regexp_replace("_x", r"[^\x20\x09-\x0D]+", ""))).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_x", F.lit(r"[#*$%&|<>]")).cast("long"))
    df = df.withColumn("_l", lines).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    return _repeat_words(df.drop("_x", "_l"))


def grams(words: Column, buckets: int) -> Column:
    """Hashed unigrams and bigrams of a word array."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")))
    return F.concat(one, F.array_compact(two))


def likelihood_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = 8192, smoothing: float = 1.0, broadcast_rows: int = 2_000_000, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """log(target / raw) of each hash bucket, from two smoothed multinomials.

    ``trusted`` holds the ids of the target documents (repeated and null ids
    do no harm); raw is all documents. Counts cover every word of every
    document and are summed map-side, so ``buckets`` rows reach the driver.
    Up to ``broadcast_rows`` trusted ids are broadcast (some 32 MB); more are
    joined by a shuffle of the texts, with the same counts.
    """
    marks = trusted.select(F.col(trusted.columns[0]).alias("_id")).dropna().distinct().withColumn("_in", F.lit(1))
    if marks.count() <= broadcast_rows:  # else both sides are shuffled by id
        marks = F.broadcast(marks)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_x")).join(marks, "_id", "left")
    rows = rows.select(F.coalesce("_in", F.lit(0)).alias("_in"), words_of(F.col("_x")).alias("_w"))
    rows = rows.select("_in", F.explode(grams(F.col("_w"), buckets)).alias("bucket"))
    found = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_in").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for row in found:
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    n_raw, n_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    return [math.log((t + smoothing) / n_target) - math.log((r + smoothing) / n_raw) for t, r in zip(target, raw)]


def judge(docs: DataFrame, ratios: list[float], threshold: float = -0.05, min_words: int = 50, max_repeat_percent: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base statistics and verdict of every document.

    ``score`` is the mean log likelihood ratio of the hashed uni- and bigrams
    (0 without words); a document is kept if it passes the base rules and its
    score is at least ``threshold``. A null text has no words and so fails.
    Each row is judged alone: repeated rows get equal results, no rows give
    none, other columns are ignored. No shuffle; long texts cost n log n.
    """
    df = statistics(docs, doc_id, text)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    df = df.withColumn("_g", grams(F.col("_w"), len(ratios))).drop("_w")
    total = F.aggregate("_g", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    df = df.withColumn("score", F.when(F.size("_g") > 0, total / F.size("_g")).otherwise(0.0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
