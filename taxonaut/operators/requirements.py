"""What legal notes and texts demand in figures and words: quantity facts, required facts of notes, facts that codes inherit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matched, normalize, once, section_of
from .profiles import note_id, note_scope

# Patterns of quantities (number, unit), their property and the unit where the pattern has none.
QUANTITIES = [
    (r"(\d+(?:\.\d+)?)\s*(%|퍼센트|percent)", "percent", None),
    (r"함량\s*[:\s]*(\d+(?:\.\d+)?)\s*(%|g|mg|kg)?", "content", None),
    (r"(\d+(?:\.\d+)?)\s*(%|g|mg|kg)\s*(?:이상|이하|초과|미만|함유)", "content", None),
    (r"농도\s*[:\s]*(\d+(?:\.\d+)?)\s*(%|ppm|mol)?", "concentration", None),
    (r"순도\s*[:\s]*(\d+(?:\.\d+)?)\s*%?", "purity", "percent"),
    (r"중량\s*[:\s]*(\d+(?:\.\d+)?)\s*(g|kg|mg|톤|ton)?", "weight", None),
    (r"(\d+(?:\.\d+)?)\s*(g|kg|mg)\s*(?:이상|이하|초과|미만)", "weight", None),
    (r"(\d+(?:\.\d+)?)\s*(ml|l|리터|cc)", "volume", None),
    (r"(\d+(?:\.\d+)?)\s*:\s*(\d+(?:\.\d+)?)", "ratio", None),
    (r"(\d+(?:\.\d+)?)\s*(mm|cm|m|인치|inch)", "dimension", None),
    (r"밀도\s*[:\s]*(\d+(?:\.\d+)?)\s*(g/cm3|kg/m3)?", "density", None),
]
# Words of comparison in the order in which they are looked for.
OPERATORS = [("이상", ">="), ("이하", "<="), ("초과", ">"), ("미만", "<")]

# Words of required facts.
MATERIALS = [
    "플라스틱", "폴리에틸렌", "폴리프로필렌", "PVC", "나일론",
    "금속", "철", "강", "알루미늄", "구리", "금", "은",
    "목재", "나무", "대나무", "종이", "판지",
    "유리", "도자기", "세라믹", "석재", "대리석",
    "고무", "가죽", "직물", "면", "양모", "실크", "합성섬유",
]
STATES = [
    "신선한", "냉장", "냉동", "건조", "훈제", "염장",
    "조리", "가열", "살균", "멸균",
    "미가공", "반가공", "가공",
]
COMPLETENESS = ["완성", "미완성", "미조립", "조립", "분해", "부분품", "구성품", "반제품"]
USES = ["식용", "공업용", "의료용", "가정용", "산업용", "포장용", "건축용", "장식용", "운송용"]
WORDS = {"material": MATERIALS, "processing": STATES, "completeness": COMPLETENESS, "function": USES}
# Amounts in notes, what they measure and their unit; clauses that exclude; types of notes.
AMOUNTS = [(r"100분의\s*(\d+)", "percentage", "%"), (r"(\d+)\s*%", "percentage", "%"), (r"(\d+)\s*킬로그램", "weight", "kg"), (r"(\d+)\s*그램", "weight", "g"), (r"(\d+)\s*리터", "volume", "L")]
EXCLUSIONS = [r"다만[,\s]+(.+?)[은는이가를]?\s*제외한다", r"그러나[,\s]+(.+?)[은는이가를]?\s*포함하지\s*않는다"]
TYPES = [("exclude", r"제외한다|포함하지\s*않는다"), ("redirect", r"제\d{4}호.*분류"), ("include", r"포함한다|여기에는"), ("definition", r"이란|라\s*함은")]


def quantity_facts(text: Column, normalized: bool = True, window: int = 10) -> Column:
    """Array of (value, unit, property, operator, span), pattern by pattern, matches left to right.

    The operator is the first word of comparison within ``window`` characters
    around the match, '=' without one. Patterns run on the normalised text,
    which has lost %, points and colons, or on the text in lower case; matches
    of different patterns may overlap and all count.
    """
    return once(normalize(text) if normalized else F.lower(F.coalesce(text, F.lit(""))), lambda body: facts_of(body, window))


def facts_of(body: Column, window: int) -> Column:
    """The facts of :func:`quantity_facts` in a text that is ready for the patterns."""
    found = []
    for pattern, prop, unit in QUANTITIES:
        with_unit = unit is None
        near = lambda m: F.concat(m["prior"], m["match"], m["later"])
        operator = lambda m: F.coalesce(*(F.when(F.contains(near(m), F.lit(w)), F.lit(s)) for w, s in OPERATORS), F.lit("="))
        own = (lambda m: F.nullif(m["g2"], F.lit(""))) if with_unit else (lambda m, u=unit: F.lit(u))
        made = lambda m, own=own, prop=prop: F.struct(m["g1"].cast("double").alias("value"), own(m).alias("unit"), F.lit(prop).alias("property"), operator(m).alias("operator"), m["match"].alias("span"))
        found.append(F.transform(matched(body, pattern, 2 if with_unit else 1, window), one_argument(made)))
    return F.concat(*found)


def one_argument(f):
    """Spark counts a lambda's arguments, those with defaults too."""
    return lambda m: f(m)


def note_kind(content: Column) -> Column:
    """exclude, redirect, include, definition or general; the first whose pattern is there."""
    return F.coalesce(*(F.when(content.rlike(p), F.lit(k)) for k, p in TYPES), F.lit("general"))


def note_facts(notes: DataFrame) -> DataFrame:
    """Required facts of notes (level, section_num, chapter_num, note_number, note_content): note_id, note_type, scope, axis, operator, value, basis, hardness, confidence.

    Words of four axes must be contained (soft), or in notes that exclude must
    not (hard); a material counts in either case of its letters. Amounts are
    compared by the words in the twenty characters from where their number
    first stands. Clauses that exclude something give up to 30 characters of
    it, hard, if they are longer than five. Each fact of a note counts once;
    notes without facts give no rows. Null contents have no facts.
    """
    content = F.coalesce(F.col("note_content"), F.lit(""))
    rows = notes.select(
        note_id(F.col("level"), F.col("section_num"), F.col("chapter_num"), F.col("note_number")).alias("note_id"), note_kind(content).alias("note_type"),
        note_scope(F.col("level"), F.col("section_num"), F.col("chapter_num")).alias("scope"), content.alias("_c"),
    )
    out = F.col("note_type") == "exclude"
    fact = lambda axis, op, value, basis, hard, conf: F.struct(F.lit(axis).alias("axis"), op.alias("operator"), value.alias("value"), F.lit(basis).cast("string").alias("basis"), F.when(hard, "hard").otherwise("soft").alias("hardness"), F.lit(conf).alias("confidence"))
    parts = []
    for axis, words in WORDS.items():
        body = F.lower("_c") if axis == "material" else F.col("_c")
        held = F.filter(F.array(*map(F.lit, words)), containing(body, axis == "material"))
        parts.append(F.transform(held, word_fact(fact, axis, out)))
    for pattern, basis, unit in AMOUNTS:
        parts.append(F.transform(F.regexp_extract_all("_c", F.lit(pattern), 1), amount_fact(fact, basis, unit, out)))
    for pattern in EXCLUSIONS:
        targets = F.filter(F.transform(F.regexp_extract_all("_c", F.lit(pattern), 1), lambda t: F.trim(F.substring(t, 1, 30))), lambda t: F.length(t) > 5)
        parts.append(F.transform(targets, lambda t: fact("legal", F.lit("not_contains"), t, None, F.lit(True), 0.9)))
    return rows.select("note_id", "note_type", "scope", F.explode(F.array_distinct(F.concat(*parts))).alias("f")).select("note_id", "note_type", "scope", "f.*")


def containing(body: Column, lower: bool):
    return lambda w: F.contains(body, F.lower(w) if lower else w)


def word_fact(fact, axis: str, out: Column):
    return lambda w: fact(axis, F.when(out, "not_contains").otherwise("contains"), w, None, out, 0.8)


def amount_fact(fact, basis: str, unit: str, out: Column):
    def made(value: Column) -> Column:
        near = F.substring(F.col("_c"), F.instr(F.col("_c"), value), F.lit(20))
        op = F.when(near.rlike("초과|이상"), "gte").when(near.rlike("미만|이하"), "lte").otherwise("eq")
        return fact("quant", op, F.concat(value, F.lit(unit)), basis, out, 0.9)

    return made


def inherited_facts(codes: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of each code (code): those of its chapter's notes and its section's, by scope; code, then the facts' columns.

    A fact that the chapter and the section both state is inherited from the
    chapter alone (``nearest``: chapter or section). Codes meet each different
    fact of a scope once, not every note that states it.
    """
    chapter = F.substring("code", 1, 2)
    base = codes.select("code").distinct()
    levels = base.select("code", F.lit("chapter").alias("nearest"), F.concat(F.lit("chapter_"), chapter).alias("scope")).union(base.select("code", F.lit("section"), F.concat(F.lit("section_"), section_of(chapter.cast("int")).cast("string"))))
    fact = ["axis", "operator", "value"]
    same = ["code", *fact]
    stated = facts.groupBy("scope", *fact).agg(F.min(F.struct("note_id", "hardness", "basis", "confidence")).alias("s"))
    rows = levels.join(stated, "scope").select(*same, "nearest", "s.*")
    first = rows.groupBy(*same).agg(F.min(F.struct("nearest", "note_id", "hardness", "basis", "confidence")).alias("f"))  # chapter sorts before section
    return first.select(*same, "f.nearest", "f.note_id", "f.hardness", "f.basis", "f.confidence")
