"""Benchmark decontamination by winnowed fingerprints; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: Everything that parts words, in lower-cased text: ASCII other than digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """The lower-cased words of a text as an array; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), "")


def gram_words(length: int) -> int:
    """Words of a k-gram for windows of ``length`` words: half of them, so each window holds about as many k-grams."""
    return (length + 1) // 2


def gram_hashes(words: Column, length: int) -> Column:
    """Hashes of all k-grams of a text of ``length`` words or more, else null."""
    k = gram_words(length)
    gram = lambda i: F.xxhash64(F.lit(length), *(F.get(words, i + j) for j in range(k)))
    return F.when(F.size(words) >= length, F.transform(F.sequence(F.lit(0), F.size(words) - k), gram))


def least_hashes(grams: Column, length: int) -> Column:
    """The least k-gram hash of each window of ``length`` words, by the window's first word."""
    width = length - gram_words(length) + 1
    return F.transform(F.sequence(F.lit(0), F.size(grams) - width), lambda i: F.array_min(F.slice(grams, i + 1, width)))


def with_minima(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """Adds ``_m<length>``: the windows' least hashes, for each length; null for texts that are too short."""
    for n in lengths:
        df = df.withColumn(f"_g{n}", gram_hashes(F.col(words), n))
    for n in lengths:
        df = df.withColumn(f"_m{n}", F.when(F.col(f"_g{n}").isNotNull(), least_hashes(F.col(f"_g{n}"), n))).drop(f"_g{n}")
    return df


def fingerprints(words: Column, minima: Column, starts: Column, length: int) -> Column:
    """One struct (h, s, n, seg) for each run of windows with equal least hash: the hash, the first window's place, the windows' length and the run's words."""
    beyond = lambda i: F.coalesce(F.get(starts, i + 1), F.size(minima))
    one = lambda s, i: F.struct(F.get(minima, s).alias("h"), s.alias("s"), F.lit(length).alias("n"), F.slice(words, s + 1, beyond(i) - s + length - 1).alias("seg"))
    return F.transform(starts, one)


def changes(minima: Column) -> Column:
    """Places at which the least hash isn't that of the window before."""
    return F.filter(F.sequence(F.lit(0), F.size(minima) - 1), lambda i: (i == 0) | (F.get(minima, i) != F.get(minima, i - 1)))


def windows_of(words: Column, length: Column, first: Column) -> Column:
    """Structs (win, s) of all windows of ``length`` words: their words joined by spaces, and their place."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - length), lambda i: F.struct(F.array_join(F.slice(words, i + 1, length), " ").alias("win"), (first + i).alias("s")))


def benchmark_windows(items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the items: win, n (its words), h (its least k-gram hash), items (sorted ids as strings).

    An item of fewer than ``window`` words is one window; one without words has none.
    """
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), plain_words(F.col(text)).alias("w"))
    rows = rows.withColumn("n", F.least(F.size("w"), F.lit(window))).filter("n > 0")
    rows = rows.select("item", "n", F.explode(windows_of(F.col("w"), F.col("n"), F.lit(0))).alias("x")).select("item", "n", "x.win")
    wins = rows.groupBy("win", "n").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("_w", F.split("win", " "))
    least = F.lit(None).cast("long")
    for n in range(1, window + 1):
        least = F.when(F.col("n") == n, F.array_min(gram_hashes(F.col("_w"), n))).otherwise(least)
    return wins.select("win", "n", least.alias("h"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_hashes: int = 2_000_000, broadcast_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    Both sides are winnowed: of the k-grams in each window the least hash is
    kept, so equal windows have equal fingerprints and none is missed. Runs of
    a document's windows with one fingerprint are one row that carries the
    run's words; those whose fingerprint an item has are extended, window by
    window, and compared word by word. Items of fewer than ``window`` words
    are one window; windows of each such length are winnowed likewise.

    Returns doc_id, n_words, n_hit (words inside windows that some item has),
    n_items, items_sha256 (of their ids, sorted as strings, joined by commas),
    contaminated, items (those ids) and spans (merged runs of hit words: from,
    to, end exclusive).

    Null and empty texts have no words; a null item id is an item called
    "null"; rows of one item id are one item. Repeated documents are judged
    each, null ids are ids like others, no rows give none; other columns are
    ignored. Fingerprints are broadcast up to ``broadcast_hashes`` and windows
    up to ``broadcast_bytes``; beyond that both are met by shuffles, in which
    documents' own rows have keys of their own and so make no hot key.
    """
    wins = written(benchmark_windows(items, window, item_id, item_text), "benchmark-windows")
    size = wins.agg(F.sum(F.length("win") + F.expr("aggregate(items, 0L, (a, x) -> a + length(x) + 8)") + 32)).first()[0] or 0
    lengths = sorted(r.n for r in wins.select("n").distinct().collect())  # 1 to window
    hashes = wins.select("h", F.lit(True).alias("known")).distinct()
    hashes = F.broadcast(hashes) if hashes.count() <= broadcast_hashes else hashes
    wins = F.broadcast(wins.select("win", "items")) if size <= broadcast_bytes else wins.select("win", "items")

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("key"), plain_words(F.col(text)).alias("w"))
    rows = with_minima(rows.withColumn("part", F.spark_partition_id()), "w", lengths)
    found = []
    for n in lengths:
        m = F.col(f"_m{n}")
        rows = rows.withColumn(f"_s{n}", F.when(m.isNotNull(), changes(m)))
        found.append(F.when(m.isNotNull(), fingerprints(F.col("w"), m, F.col(f"_s{n}"), n)).otherwise(F.array()))
    own = F.struct(F.xxhash64("doc_id", "key").alias("h"), F.lit(-1).alias("s"), F.lit(0).alias("n"), F.lit(None).cast("array<string>").alias("seg"))  # a document's own row, whether or not it is hit
    rows = rows.select("doc_id", "key", "part", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(F.array(own), *found)).alias("f")).select("doc_id", "key", "part", "n_words", "f.*")
    rows = rows.join(hashes, "h", "left").filter("s < 0 or known")
    nothing = F.array(F.struct(F.concat(F.lit(" "), "key").alias("win"), F.lit(-1).alias("s")))
    rows = rows.select("doc_id", "key", "part", "n_words", "n", F.explode(F.when(F.col("s") < 0, nothing).otherwise(windows_of(F.col("seg"), F.col("n"), F.col("s")))).alias("x"))
    rows = rows.select("doc_id", "key", "part", "n_words", "n", "x.*").join(wins, "win", "left").filter("s < 0 or items is not null")

    own = F.sum(F.when(F.col("s") < 0, 1).otherwise(0)).cast("int").alias("copies")
    hit = F.col("s") >= 0
    out = rows.groupBy("doc_id", "key", "part", "n_words").agg(own, F.sort_array(F.collect_set(F.when(hit, F.struct("s", (F.col("s") + F.col("n")).alias("e"))))).alias("_h"), F.collect_set(F.when(hit, F.col("items"))).alias("_i"))
    words = F.sort_array(F.array_distinct(F.flatten(F.transform("_h", lambda x: F.sequence(x["s"], x["e"] - 1)))))
    out = out.withColumn("_p", words).withColumn("n_hit", F.size("_p").cast("long")).withColumn("spans", runs_of(F.col("_p")))
    out = out.withColumn("items", F.array_sort(F.array_distinct(F.flatten("_i")))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")


def runs_of(places: Column) -> Column:
    """Structs (start, end), end exclusive, of the runs in sorted distinct places."""
    start = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) != x - 1))
    end = F.filter(places, lambda x, i: F.coalesce(F.get(places, i + 1) != x + 1, F.lit(True)))
    return F.zip_with(start, end, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
