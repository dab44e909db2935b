"""The subcodes of a code: their table with what they inherit, and which of them fits an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize, section_of, tokenize
from ..sources.scratch import reference, spread

DP = 6
KEYS = ["item_id", "code"]


def ancestors(codes: DataFrame) -> DataFrame:
    """(subcode, distance, ancestor): the subcode itself, its code, its chapter and its section (S and the number), as far as there are any."""
    chapter = F.substring("subcode", 1, 2)
    section = F.concat(F.lit("S"), section_of(chapter.cast("int")).cast("string"))
    line = F.array(F.col("subcode"), F.substring("subcode", 1, 4), chapter, section)
    rows = codes.select("subcode").distinct().select("subcode", F.posexplode(line).alias("distance", "ancestor"))
    return rows.filter("ancestor is not null")


def nearest(codes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(subcode, name, value, ancestor, distance): of each attribute (ancestor, name, value) the one that is nearest to a subcode.

    All attributes of all levels meet the closure in one join. At equal
    distance the least value counts.
    """
    rows = ancestors(codes).join(attributes, "ancestor")
    best = rows.groupBy("subcode", "name").agg(F.min(F.struct("distance", "value", "ancestor")).alias("b"))
    return best.select("subcode", "name", "b.value", "b.ancestor", "b.distance")


def assembled(hierarchy: DataFrame, notes: DataFrame, cases: DataFrame, titles: DataFrame) -> DataFrame:
    """The table of subcodes: subcode, code, title, title_from, keywords, notes, case_count.

    ``hierarchy``: subcode, title, keywords; ``notes``: code6, contents;
    ``cases``: subcode, one row a case; ``titles``: code, title of codes and
    chapters. Subcodes of any of the first three are there. A blank title is
    that of the nearest ancestor which has one; ``title_from`` names it.
    """
    counts = cases.filter(F.length("subcode") == 6).groupBy("subcode").agg(F.count(F.lit(1)).alias("case_count"))
    rows = hierarchy.select("subcode", "title", "keywords").join(notes.select(F.col("code6").alias("subcode"), F.col("contents").alias("notes")), "subcode", "full_outer").join(counts, "subcode", "full_outer")
    named = rows.select(F.col("subcode").alias("ancestor"), F.col("title").alias("value")).union(titles.select("code", "title")).filter(F.trim("value") != "")
    near = nearest(rows, named.withColumn("name", F.lit("title"))).select("subcode", F.col("value").alias("_title"), F.col("ancestor").alias("title_from"))
    none = F.array().cast("array<string>")
    return rows.join(near, "subcode", "left").select(
        "subcode", F.substring("subcode", 1, 4).alias("code"), F.coalesce("_title", F.lit("")).alias("title"), "title_from",
        F.coalesce("keywords", none).alias("keywords"), F.coalesce("notes", none).alias("notes"), F.coalesce("case_count", F.lit(0)).alias("case_count"),
    )


def words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, " "), ""))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def note_weights(subcodes: DataFrame) -> DataFrame:
    """(subcode, _n): for each word of a subcode's notes half the sum of 1 / the number of different words, over the notes that have it.

    An item's share of the words of all notes is the sum over its own words,
    so it costs these and not the notes, which are as many as there are parts.
    """
    notes = subcodes.select("subcode", F.explode("notes").alias("note")).groupBy("subcode", "note").agg(F.count(F.lit(1)).alias("k"))
    notes = notes.select("subcode", "k", words(normalize(F.col("note"))).alias("w")).filter(F.size("w") > 0)
    each = notes.select("subcode", (0.5 * F.col("k") / F.size("w")).alias("g"), F.explode("w").alias("word")).groupBy("subcode", "word").agg(F.sum("g").alias("g"))
    return each.groupBy("subcode").agg(F.map_from_entries(F.collect_list(F.struct("word", "g"))).alias("_n"))


def subcode_scores(candidates: DataFrame, subcodes: DataFrame, items: DataFrame, axes: DataFrame) -> DataFrame:
    """Every subcode of a candidate with its four scores: keyword + 2 note + 1.5 material + case.

    keyword: 1 for a keyword in the text, .5 for one that is a token only, .3
    for each token of the title; note: for each note half the share of its
    words that the text has, at most 1; material: the share of the item's
    materials that keywords and title name; case: cases / 20, at most 1.
    ``subcodes`` as of :func:`assembled`; ``items``: item_id, norm, tokens;
    ``axes``: item_id, axis, values.
    """
    prepared = subcodes.select(
        "subcode", "code", "case_count", F.transform("keywords", lambda k: F.lower(k)).alias("_k"), F.array_distinct(tokenize(F.col("title"))).alias("_t"),
        F.lower(F.concat_ws(" ", F.array_join("keywords", " "), "title")).alias("_all"),
    )
    prepared = reference(prepared.join(note_weights(subcodes).hint("merge"), "subcode", "left"), "subcodes")
    mine = axes.filter("axis = 'material'").select("item_id", F.transform("values", lambda v: F.lower(v)).alias("_m"))
    rows = spread(candidates.select(*KEYS), "item_id").hint("merge").join(items.select("item_id", "norm", "tokens"), "item_id").join(mine.hint("merge"), "item_id", "left")
    rows = rows.withColumn("_w", words(F.col("norm"))).join(prepared, "code")
    hit = lambda k: F.when(F.contains(F.col("norm"), k), 1.0).when(F.array_contains("tokens", k), 0.5).otherwise(0.0)
    keyword = total(F.transform("_k", hit)) + 0.3 * F.size(F.array_intersect("_t", F.array_distinct("tokens")))
    note = total(F.transform("_w", lambda w: F.coalesce(F.try_element_at("_n", w), F.lit(0.0))))
    named = F.size(F.filter("_m", lambda m: F.contains(F.col("_all"), m)))
    material = F.when(F.size("_m") > 0, named / F.size("_m")).otherwise(0.0)
    scores = {"keyword_score": keyword, "note_score": F.least(note, F.lit(1.0)), "material_score": material, "case_score": F.least(F.col("case_count") / 20, F.lit(1.0))}
    rows = rows.select(*KEYS, "subcode", *(F.round(c, DP).alias(n) for n, c in scores.items()))
    return rows.withColumn("score", F.round(F.col("keyword_score") + 2.0 * F.col("note_score") + 1.5 * F.col("material_score") + F.col("case_score"), DP))


def resolved(scored: DataFrame, n: int = 3) -> DataFrame:
    """The n best subcodes of each candidate, ties to the smaller one, with their position."""
    w = W.partitionBy(*KEYS).orderBy(F.desc("score"), "subcode")
    return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
