"""Profiles of codes from commentaries, and joins of notes, cases and synonyms with items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import matched, normalize, once, unmarked
from ..sources.scratch import reference
from .match import contained

# Patterns of a commentary's scope, examples, references, attributes; conditions in notes.
SCOPE = [r"이 호에는\s+(.+?)\s*[을를이가]\s*분류", r"이 호에\s+(.+?)\s*[을를이가]\s*분류", r"여기에는\s+(.+?)\s*[을를이가]\s*포함"]
EXAMPLES = [r"예[:\s]+([^\.]+)", r"예를 들[면어]\s*[,:]?\s*([^\.]+)", r"다음[을를]?\s*포함[한하]다[:\s]*([^\.]+)"]
REFERENCES = [r"제(\d{4})호[로에]?\s*분류", r"(\d{4})호[로에]?\s*분류", r"제외[하한]고.+?제(\d{4})호", r"다만.+?제(\d{4})호"]
ATTRIBUTES = {"재질": r"재질[이가]?\s*(.+?)[인으로]", "용도": r"용도[가이]?\s*(.+?)[인인으로]", "가공상태": r"(신선|냉장|냉동|건조|염장|훈제|가공)", "형태": r"(분말|액체|고체|기체|펠릿)"}
CONDITIONS = ["경우", "때에는", "한정", "only if", "provided that", "when"]


def found(text: Column, patterns: list[str], flags: str = "") -> Column:
    """All first groups of several patterns, pattern by pattern."""
    return F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(flags + p), 1) for p in patterns))


def pieces(texts: Column, split: str, low: int, high: int) -> Column:
    """Trimmed parts of texts, of low to high characters, distinct, in order."""
    parts = F.transform(F.flatten(F.transform(texts, lambda t: F.split(t, split))), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p).between(low, high)))


def scope_keywords(content: Column) -> Column:
    """Words of what a heading covers, but for bare codes; ten at most."""
    words = pieces(found(content, SCOPE, "(?s)"), r"[,·\s]+", 2, 20)
    return F.slice(F.filter(words, lambda w: ~w.rlike(r"^[0-9\(\)호류]+$")), 1, 10)


def includes(content: Column, title: Column) -> Column:
    """Parts of the title, then examples; fifteen at most."""
    named = pieces(F.array(F.coalesce(title, F.lit(""))), r"[,·\(\)]+", 2, 15)
    examples = pieces(found(content, EXAMPLES), r"[,·\s]+", 2, 15)
    return F.slice(F.array_union(named, examples), 1, 15)


def excludes(content: Column, code: Column) -> Column:
    """Other headings that a commentary refers to, each once with the text around its first reference; five at most.

    References come pattern by pattern; the reason is a reference with the 50
    characters on either side, without blank ends, cut to 100.
    """
    reason = lambda m: F.substring(F.trim(F.concat(m["prior"], m["match"], m["later"])), 1, 100)
    every = F.filter(found(unmarked(content), REFERENCES), lambda c: c != code)
    wanted = F.slice(F.array_distinct(every), 1, 5)

    def first(codes: Column) -> Column:
        """Of each pattern the first reference to each code is looked at, not all of them."""
        places = lambda bodies: once(F.transform(bodies, lambda b: b["g1"]), lambda own: F.filter(F.transform(codes, lambda c: (F.array_position(own, c) - 1).cast("int")), lambda i: i >= 0))
        around = [F.transform(matched(content, p, 1, 50, places), lambda m: F.struct(m["g1"].alias("code"), reason(m).alias("reason"))) for p in REFERENCES]
        return once(F.concat(*around), lambda some: F.transform(codes, lambda c: F.get(F.filter(some, lambda x: x["code"] == c), F.lit(0))))

    return once(wanted, first)


def key_attributes(content: Column) -> Column:
    """Array of (name, values) of the attributes that a commentary decides by; values of ten characters at most, five each."""
    each = []
    for name, pattern in ATTRIBUTES.items():
        values = F.array_distinct(F.filter(F.transform(found(content, [pattern]), lambda x: F.trim(x)), lambda v: F.length(v) <= 10))
        each.append(F.struct(F.lit(name).alias("name"), F.slice(values, 1, 5).alias("values")))
    return F.filter(F.array(*each), lambda a: F.size(a["values"]) > 0)


def cards(commentary: DataFrame) -> DataFrame:
    """Cards of commentaries (code, title, content, chapter) with a code of four characters."""
    c = F.col("content")
    return commentary.filter(F.length("code") == 4).select(
        "code", "title", F.coalesce("chapter", F.substring("code", 1, 2)).alias("chapter"), scope_keywords(c).alias("scope"), includes(c, F.col("title")).alias("includes"),
        excludes(c, F.col("code")).alias("excludes"), key_attributes(c).alias("key_attributes"),
    )


def note_id(level: Column, section: Column, chapter: Column, number: Column) -> Column:
    number = number.cast("string")
    two = F.lpad(chapter.cast("string"), 2, "0")
    return F.when(level == "section", F.concat(F.lit("section_"), section.cast("string"), F.lit("_"), number)).when(level.isin("chapter", "subheading"), F.concat(level, F.lit("_"), two, F.lit("_"), number)).otherwise(F.concat(F.lit("unknown_"), number))


def note_scope(level: Column, section: Column, chapter: Column) -> Column:
    return F.when(level == "section", F.concat(F.lit("section_"), section.cast("string"))).when(chapter > 0, F.concat(F.lit("chapter_"), F.lpad(chapter.cast("string"), 2, "0"))).otherwise("unknown")


def built_text(name: Column, description: Column, with_description: bool = True) -> Column:
    """Name and description as one text; nulls are left out."""
    return F.trim(F.concat_ws(" ", name, description) if with_description else F.coalesce(name, F.lit("")))


def flattened(parts: Column) -> Column:
    """Of each struct (reason, text, value, description) the first field that isn't blank; others are dropped."""
    one = lambda x: F.coalesce(*(F.nullif(F.trim(x[c]), F.lit("")) for c in ("reason", "text", "value", "description")))
    return F.array_compact(F.transform(parts, one))


def search_notes(queries: DataFrame, notes: DataFrame, n: int = 10) -> DataFrame:
    """The n best notes (note_id, note_content, keywords) of each query (item_id, norm): 1 a keyword in it, .5 if the note holds it.

    Both are equi-joins of words (match.contained); the second way round the
    queries are the terms.
    """
    words = notes.select("note_id", F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("term"))
    first = contained(queries, words, 1).join(words, "term").groupBy("item_id", "note_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    held = contained(notes.select(F.col("note_id").alias("item_id"), F.lower("note_content").alias("norm")), queries.select(F.col("norm").alias("term")), 1)
    held = reference(held.select(F.col("item_id").alias("note_id"), F.col("term").alias("norm")), "held")  # else the queries may be what is broadcast
    second = queries.select("item_id", "norm").join(held, "norm").select("item_id", "note_id", F.lit(0.5).alias("score"))
    rows = first.union(second).groupBy("item_id", "note_id").agg(F.sum("score").alias("score"))
    w = W.partitionBy("item_id").orderBy(F.desc("score"), "note_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def insufficient(pairs: DataFrame) -> DataFrame:
    """Adds insufficient and question to items (norm) met with notes (note_content, keywords): a conditional note, none of whose keywords is in the text."""
    conditional = F.col("note_content").rlike("(?i)" + "|".join(CONDITIONS))
    known = F.exists("keywords", lambda k: F.contains(F.col("norm"), normalize(k)))
    lacks = conditional & (F.size("keywords") > 0) & ~F.coalesce(known, F.lit(False))
    return pairs.withColumn("insufficient", lacks).withColumn("question", F.when(lacks, F.concat(F.lit("주규정 확인 필요: "), F.substring("note_content", 1, 100))))


def case_conflicts(items: DataFrame, cases: DataFrame, n: int = 5) -> DataFrame:
    """Cases (case_id, code, materials) of another code than an item's (item_id, norm, code) one of whose materials is in its text; the first n."""
    words = cases.select("case_id", F.col("code").alias("case_code"), F.explode(F.array_distinct(F.transform("materials", F.lower))).alias("term")).filter("term <> ''")
    words = reference(first_cases(words, n), "first-cases")
    met = contained(items, words, 1).join(items.select("item_id", "code").hint("merge"), "item_id").join(words, "term").filter(F.col("case_code") != F.col("code"))
    w = W.partitionBy("item_id").orderBy("case_id", "case_code")
    rows = met.select("item_id", "case_id", "case_code").distinct().withColumn("position", F.row_number().over(w))
    return rows.filter(F.col("position") <= n)


def first_cases(words: DataFrame, n: int) -> DataFrame:
    """Of cases by material (case_id, case_code, term) those that can be among the first n of another code than an item's: 2n a material.

    Of one code no more than n count. Whatever code an item has, at most n of
    the first 2n are then of it, so n of other codes are among them.
    """
    place = lambda keys: F.row_number().over(W.partitionBy(*keys).orderBy("case_id", "case_code"))
    rows = words.filter("case_code is not null").distinct().withColumn("_r", place(["term", "case_code"])).filter(F.col("_r") <= n)
    return rows.withColumn("_r", place(["term"])).filter(F.col("_r") <= 2 * n).drop("_r")


def augmented(items: DataFrame, synonyms: DataFrame, sparse: int = 10, most: int = 2, seed: int = 42) -> DataFrame:
    """Items (item_id, text, code) of classes with fewer than ``sparse`` rows again, up to ``most`` times, with one term replaced by a synonym (term, alias).

    Which ones is drawn by a seeded hash; texts that don't change are left out.
    """
    rare = items.groupBy("code").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") < sparse).select("code")
    rows = items.join(rare, "code", "left_semi")
    hits = contained(rows.select("item_id", F.lower("text").alias("norm")), synonyms, 1).join(synonyms, "term")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item_id").cast("string"), "term", "alias").cast("binary"))
    w = W.partitionBy("item_id").orderBy(draw, "term", "alias")
    picked = hits.withColumn("number", F.row_number().over(w)).filter(F.col("number") <= most)
    out = picked.join(rows, "item_id")
    at = F.expr("locate(term, lower(text))")
    new = F.concat(F.expr("substring(text, 1, locate(term, lower(text)) - 1)"), F.col("alias"), F.expr("substring(text, locate(term, lower(text)) + length(term))"))
    return out.filter(at > 0).select("item_id", "number", "code", new.alias("text"), F.col("text").alias("original")).filter("text <> original").drop("original")


def overlaid(cases: DataFrame, second: DataFrame, low: float = 0.5) -> DataFrame:
    """Cases of confidence below ``low`` with empty fields filled from a second extraction (by case_id), .2 more and source hybrid.

    Both have case_id, applied_rules, rejected_codes, decisive_reasoning.
    """
    fields = ["applied_rules", "rejected_codes", "decisive_reasoning"]
    other = second.select("case_id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_some"))
    rows = cases.join(other, "case_id", "left").withColumn("_use", (F.col("confidence") < low) & F.coalesce("_some", F.lit(False)))
    filled = {c: F.when(F.col("_use") & (F.size(c) == 0) & (F.coalesce(F.size(f"_{c}"), F.lit(0)) > 0), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    rows = rows.withColumns(filled).withColumn("source", F.when(F.col("_use"), "hybrid").otherwise("rules"))
    return rows.withColumn("confidence", F.when(F.col("_use"), F.round(F.least(F.lit(1.0), F.col("confidence") + 0.2), 6)).otherwise(F.col("confidence"))).drop("_use", "_some", *(f"_{c}" for c in fields))
