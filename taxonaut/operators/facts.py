"""Facts, questions and context lines that are built from cards, commentaries, notes and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept, reference, spread
from .axes import SET_VALUES, strings
from .extract import SIGNALS, signals
from .match import Profiles
from .scorers import low_confidence

# Keywords of required facts.
FACT_WORDS = {
    "object_nature": ["말", "소", "돼지", "면양", "염소", "닭", "오리", "거위", "의자", "책상", "침대", "가방", "신발", "의류", "기계", "장치", "기구", "도구", "부품"],
    "material": [
        "플라스틱", "폴리에틸렌", "폴리프로필렌", "PVC", "금속", "철", "강", "알루미늄", "구리", "목재", "나무", "대나무", "종이",
        "유리", "도자기", "석재", "고무", "가죽", "직물", "면", "양모",
    ],
    "processing_state": ["신선한", "냉장", "냉동", "건조", "훈제", "살아 있는", "죽은", "가공", "조리"],
    "completeness": ["완성", "미조립", "조립", "부분품", "구성품"],
}
LEXICON = [(axis, word) for axis, words in FACT_WORDS.items() for word in words]
# The question of an attribute, and what each chapter is divided by.
QUESTIONS = {
    "material": "주요 재질이 무엇인가요?", "use": "주요 용도가 무엇인가요?", "processing": "가공 상태가 어떻게 되나요?",
    "form": "물품의 형태가 어떻게 되나요?", "size": "크기/중량 기준이 있나요?", "component": "주요 구성 성분이 무엇인가요?",
}
CRITERIA = {
    "01": ["processing"], "02": ["processing", "form"], "03": ["processing", "form"], "04": ["processing"], "07": ["processing"], "08": ["processing"], "09": ["processing", "form"],
    "28": ["form", "component"], "29": ["component"], "30": ["use", "form"], "32": ["use"], "33": ["use"], "34": ["use"], "39": ["form", "use"], "40": ["form", "use"],
    "50": ["material"], "51": ["material"], "52": ["material"], "54": ["material"], "55": ["material"], "61": ["material", "use"], "62": ["material", "use"], "63": ["use"], "64": ["material", "use"],
    "72": ["form"], "73": ["use", "form"], "74": ["form"], "76": ["form"], "84": ["use", "component"], "85": ["use", "component"], "87": ["use"], "90": ["use"], "94": ["material", "use"], "95": ["use"],
}
DEFAULT_CRITERIA = ["use", "material"]
HINTS = {"material": "재질|재료|소재", "use": "용도|목적|사용"}
# Lines of the signal section.
NO_SIGNAL = "## GRI 신호\n특별한 GRI 신호가 감지되지 않았습니다. GRI 1(호의 용어)에 따라 분류하세요."
SIGNAL_HEAD = "## GRI 신호 (주의 필요)"
SIGNAL_LINES = {
    "incomplete": ("- **GRI 2(a) 감지**: 미완성/미조립 관련 (", ")\n  → 완성품으로 분류 가능 여부 판단 필요"),
    "mixture": ("- **GRI 2(b) 감지**: 혼합물/복합재료 관련 (", ")\n  → 본질적 특성을 부여하는 성분 기준으로 분류"),
    "multi_candidate": ("- **GRI 3 감지**: 세트/복수 후보 관련 (", ")\n  → 가장 구체적인 호 또는 본질적 특성 기준 적용"),
    "containers": ("- **GRI 5 감지**: 케이스/포장 관련 (", ")\n  → 내용물 기준 분류 (별도 거래 제외)"),
}
NOTE_LINE = "- **GRI 1 참조**: 주규정/해설서 참조 감지"


def card_facts(cards: DataFrame, lexicon: list[tuple[str, str]] = LEXICON) -> DataFrame:
    """Required facts of cards (code, title, includes, excludes): (code, axis, operator, value, hardness, source).

    Keywords of the lexicon in the title or an include must be contained
    (soft), those in an exclude must not (hard). Of an axis and value the first
    source counts: title, includes, excludes. The lexicon is part of the
    expression, so nothing is joined.
    """
    none = F.array().cast("array<string>")
    sources = [F.array("title"), F.coalesce("includes", none), F.coalesce("excludes", none)]
    texts = F.concat(*(F.arrays_zip(F.array_repeat(F.lit(i), F.size(s)).alias("at"), s.alias("text")) for i, s in enumerate(sources)))
    words = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(w).alias("value")) for a, w in lexicon))
    rows = cards.select("code", F.explode(texts).alias("t")).filter("t.text is not null")
    rows = rows.select("code", "t.at", F.explode(F.filter(words, lambda w: F.contains(F.col("t.text"), w["value"]))).alias("w"))
    first = rows.groupBy("code", F.col("w.axis").alias("axis"), F.col("w.value").alias("value")).agg(F.min("at").alias("at"))
    name = lambda *names: F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1)
    return first.select("code", "axis", name("contains", "contains", "not_contains").alias("operator"), "value", name("soft", "soft", "hard").alias("hardness"), name("title", "includes", "excludes").alias("source"))


def question_keys(code: Column, content: Column, n: int = 3) -> Column:
    """What a heading's goods differ by: its chapter's criteria, then what its commentary mentions; n at most."""
    by_chapter = F.create_map(*(x for c, keys in CRITERIA.items() for x in (F.lit(c), strings(keys))))
    keys = F.coalesce(F.try_element_at(by_chapter, F.substring(code, 1, 2)), strings(DEFAULT_CRITERIA))
    hints = F.array_compact(F.array(*(F.when(content.rlike(pattern), F.lit(key)) for key, pattern in HINTS.items())))
    return F.slice(F.array_union(keys, hints), 1, n)


def question_templates(commentary: DataFrame) -> DataFrame:
    """Questions (code, chapter, position, key, question) of commentaries (code, content) with a code of four characters."""
    texts = F.create_map(*(F.lit(x) for pair in QUESTIONS.items() for x in pair))
    rows = commentary.filter(F.length("code") == 4).select("code", F.posexplode(question_keys(F.col("code"), F.coalesce("content", F.lit("")))).alias("p", "key"))
    return rows.select("code", F.substring("code", 1, 2).alias("chapter"), (F.col("p") + 1).alias("position"), "key", F.element_at(texts, F.col("key")).alias("question"))


def case_features(attrs: DataFrame) -> DataFrame:
    """The features of a case from its attributes (one array of values an axis): first function and form, materials, set, electrical."""
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return attrs.select(
        "item_id", first("function_use").alias("primary_function"), "material", first("physical_form").alias("structure"),
        F.arrays_overlap("completeness", strings(SET_VALUES)).alias("is_set"), F.array_contains("function_use", "electrical").alias("is_electrical"),
    )


def subheading_notes(notes: DataFrame) -> DataFrame:
    """(code6, contents) of notes (note_no, level, note_type, codes, content) on subheadings, in the order of their numbers; codes of six digits or more."""
    about = (F.col("level") == "subheading") | F.contains(F.coalesce("note_type", F.lit("")), F.lit("소호"))
    rows = notes.filter(about).select("note_no", "content", F.explode("codes").alias("c")).filter(F.length("c") >= 6)
    every = F.array_sort(F.collect_list(F.struct("note_no", F.coalesce("content", F.lit("")).alias("content"))))
    return rows.groupBy(F.substring("c", 1, 6).alias("code6")).agg(F.transform(every, lambda x: x["content"]).alias("contents"))


def weak_tags(cases: DataFrame, name: str = "name", rationale: str = "rationale", description: str = "description") -> DataFrame:
    """Cases with the signals of all that is written in them."""
    return signals(cases.withColumn("_all", F.concat_ws(" ", name, rationale, description)), "_all").drop("_all")


def tag_counts(tagged: DataFrame) -> DataFrame:
    """One row: how many cases there are, and how many have each signal."""
    return tagged.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col(s).cast("long")), F.lit(0)).alias(s) for s in SIGNALS), F.coalesce(F.sum((F.col("parts_n") > 0).cast("long")), F.lit(0)).alias("parts"))


def signal_context(found: DataFrame, n: int = 3) -> DataFrame:
    """The section of a context that tells of the rules' signals: item_id, section.

    ``found``: item_id, an array of matched keywords a signal (null where it
    isn't set) and note_like; three keywords of each are named.
    """
    lines = [F.concat(F.lit(head), F.array_join(F.slice(c, 1, n), ", "), F.lit(tail)) for c, (head, tail) in SIGNAL_LINES.items()]
    lines.append(F.when(F.col("note_like"), NOTE_LINE))
    some = F.concat_ws("\n", F.lit(SIGNAL_HEAD), *lines)
    return found.select("item_id", F.when(some == SIGNAL_HEAD, NO_SIGNAL).otherwise(some).alias("section"))


def with_gate(features: DataFrame, gated: DataFrame) -> DataFrame:
    """Features (item_id, code, ...) with the gate's note support and whether it excludes; 0 where it has no row."""
    rows = features.join(gated.select("item_id", "code", F.col("include_support").alias("_i"), F.col("passed").alias("_p")), ["item_id", "code"], "left")
    return rows.withColumn("f_note_support_sum", F.coalesce("_i", F.lit(0.0))).withColumn("f_note_hard_exclude", (~F.coalesce("_p", F.lit(True))).cast("int")).drop("_i", "_p")


def overlaid_axes(found: DataFrame, supplied: DataFrame) -> DataFrame:
    """Axes (item_id, axis, values, confidence) of each item: those that another extraction supplies where it has any for the item, else the found ones."""
    given = supplied.filter(F.size("values") > 0).select("item_id", "axis", "values", "confidence")
    rest = found.select("item_id", "axis", "values", "confidence").join(given.select("item_id").distinct(), "item_id", "left_anti")
    return given.withColumn("supplied", F.lit(True)).unionByName(rest.withColumn("supplied", F.lit(False)))


def ranking_rows(features: DataFrame, labels: DataFrame, gated: DataFrame) -> DataFrame:
    """Rows to train a ranker on: candidates with features of labelled items (item_id, true_code) that pass the gate, and their label.

    Items whose true code the gate excludes are left out; so are items that
    don't have it among their candidates.
    """
    failed = gated.filter("not passed").select("item_id", "code")
    rows = features.join(failed, ["item_id", "code"], "left_anti").join(labels.select("item_id", "true_code"), "item_id")
    rows = rows.withColumn("label", (F.col("code") == F.col("true_code")).cast("int"))
    usable = rows.filter("label = 1").select("item_id").distinct()
    return rows.join(usable, "item_id", "left_semi").drop("true_code")


def ranking_rows_over_profiles(profiles: Profiles, features: DataFrame, labels: DataFrame, gated: DataFrame) -> DataFrame:
    """The rows of ranking_rows from features and gate of profiles (profile as item_id), labels of items.

    Whether an item is used is looked up by profile and true code, so rows of
    items, many each, are never shuffled.
    """
    failed = gated.filter("not passed").select("item_id", "code")
    left = kept(features.join(failed, ["item_id", "code"], "left_anti").withColumnRenamed("item_id", "profile"), "not-excluded")
    true = reference(left.select("profile", F.col("code").alias("true_code")).distinct(), "true-codes")
    used = profiles.of.hint("merge").join(labels.select("item_id", "true_code"), "item_id").join(true, ["profile", "true_code"], "left_semi")
    rows = spread(kept(used, "used"), "item_id", 20_000).join(reference(left, "left"), "profile")
    return rows.select(*features.columns, (F.col("code") == F.col("true_code")).cast("int").alias("label"))


def smoke_statistics(ranked: DataFrame, signalled: DataFrame) -> DataFrame:
    """One row of a trial run: items, those with candidates, with a signal and of low confidence.

    ``ranked``: item_id, code, score, rank; ``signalled``: item_id and
    any_signal of every item. Without a score confidence is low.
    """
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    rows = signalled.join(ranked.groupBy("item_id").agg(at(1).alias("p1"), at(2).alias("p2")), "item_id", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("n"), n(F.col("p1").isNotNull()).alias("with_candidates"), n(F.coalesce("any_signal", F.lit(False))).alias("with_signal"), n(low_confidence(F.col("p1"), F.col("p2"))).alias("low_confidence"))


def feature_vector(rows: DataFrame, names: list[str]) -> DataFrame:
    """Item, code and the named features as one array of doubles in this order; a null is 0."""
    return rows.select("item_id", "code", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names)).alias("features"))
