"""Text functions: normalisation, tokens, keywords, matching, cutting, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as tokens.
STOPWORDS_KO = """
것 등 및 의 이 가 을 를 에 로 으로 한 하는 된 되는 있는 없는 같은 위한 대한 또는 그 이러한 해당 경우 때 수 더 매우
분류 포함 제외 규정 따라 관세 율표 기타 제품 부품 용 그밖의 밖의 기타의 물품 상품 품목 종류 형태 방식
""".split()
STOPWORDS_EN = """
the a an of for and or in on at to with from by as is are was were be been other others etc nes nec not elsewhere specified
including excluding whether such those these product products item items article articles type types kind kinds part parts
""".split()
STOPWORDS = STOPWORDS_KO + STOPWORDS_EN

# First and last chapter of each section.
SECTIONS = [
    (1, 1, 5), (2, 6, 14), (3, 15, 15), (4, 16, 24), (5, 25, 27), (6, 28, 38), (7, 39, 40), (8, 41, 43), (9, 44, 46), (10, 47, 49), (11, 50, 63),
    (12, 64, 67), (13, 68, 70), (14, 71, 71), (15, 72, 83), (16, 84, 85), (17, 86, 89), (18, 90, 92), (19, 93, 93), (20, 94, 96), (21, 97, 97), (22, 98, 99),
]
ROMAN = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXII".split()


def normalize(text: Column) -> Column:
    """Lower case, without bracketed parts and marks, units apart from numbers, single spaces; null gives ''."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}"):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, r"(?iU)(\d+)(인치|cm|mm|kg|g|ml|l|개|ea|pcs)", "$1 $2")
    out = F.regexp_replace(out, r"(?U)[^\w\s가-힣]", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def tokenize(text: Column, remove_stopwords: bool = True) -> Column:
    """Words of the normalised text; after each, its Hangul runs of two or more that differ from it."""
    raw = F.array_remove(F.split(normalize(text), " "), "")
    with_runs = lambda t: F.concat(F.array(t), F.filter(F.regexp_extract_all(t, F.lit("([가-힣]{2,})"), 1), lambda p: p != t))
    out = F.flatten(F.transform(raw, with_runs))
    if not remove_stopwords:
        return out
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(out, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def hangul_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([가-힣]{2,})"), 1)


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{2,})"), 1)


def keywords(text: Column, min_len: int = 2, max_count: int = 10) -> Column:
    """The first distinct tokens."""
    kept = F.filter(tokenize(text), lambda t: F.length(t) >= min_len)
    return F.slice(F.array_distinct(kept), 1, max_count)


def contains(text: Column, term: Column) -> Column:
    """Whether the normalised term (two characters at least) is in the normalised text."""
    return (F.length(normalize(term)) >= 2) & F.contains(normalize(text), normalize(term))


def overlap(text: Column, terms: Column) -> Column:
    """Tokens that the text shares with an array of terms."""
    return F.array_intersect(F.array_distinct(tokenize(text)), tokenize(F.array_join(terms, " ")))


def match_method(text: Column, term: Column) -> Column:
    """substring, token, or null."""
    return F.when(contains(text, term), "substring").when(F.arrays_overlap(tokenize(text), tokenize(term)), "token")


def term_key(text: Column) -> Column:
    """A thesaurus term: lower case, marks as spaces."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s가-힣]", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def char_grams(token: Column, n: int) -> Column:
    """Runs of n characters in a token."""
    at = F.when(F.length(token) >= n, F.sequence(F.lit(1), F.length(token) - (n - 1)))
    return F.coalesce(F.transform(at, lambda i: F.substring(token, i, F.lit(n))), F.array().cast("array<string>"))


def bm25_tokens(text: Column) -> Column:
    """White-space words, then each word's character 2- and 3-grams."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    grams = F.flatten(F.transform(words, lambda w: F.concat(char_grams(w, 2), char_grams(w, 3))))
    return F.concat(words, grams)


def padded_grams(text: Column, low: int = 1, high: int = 2) -> Column:
    """Character n-grams inside words that are padded with a space on both sides."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.concat(*(char_grams(w, n) for n in range(low, high + 1)))))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters and "...": back to the last space if that lies past 70 % of them."""
    head = F.substring(text, 1, most)
    back = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    cut = F.when(F.length(back) > 0.7 * most, back).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def sentences(text: Column, pattern: str = r"[.。]\s*", least: int = 10) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda x: F.trim(x)), lambda s: F.length(s) >= least)


def row_id(*parts: Column) -> Column:
    """12 hex digits of the parts joined by _."""
    return F.substring(F.md5(F.concat_ws("_", *parts).cast("binary")), 1, 12)


def rule_key(code: Column, kind: Column, text: Column) -> Column:
    """code_kind_ and 8 hex digits of the text's first 100 characters."""
    return F.concat_ws("_", code, kind, F.substring(F.sha2(F.substring(text, 1, 100).cast("binary"), 256), 1, 8))


def rule_source(kind: Column) -> Column:
    return F.when(kind.isin("include_rule", "exclude_rule"), "legal_note").when(kind == "definition", "heading").otherwise("commentary")


def roman(text: Column) -> Column:
    """Roman numeral of 1 to 22 as a number, else null."""
    table = F.create_map(*(x for i, r in enumerate(ROMAN) for x in (F.lit(r), F.lit(i + 1))))
    return F.try_element_at(table, F.upper(F.trim(text)))


def chapter_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"제\s*(\d+)\s*류", 1), F.lit("")).cast("int")


def section_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"제\s*(\d+)\s*부", 1), F.lit("")).cast("int")


def section_of(chapter: Column) -> Column:
    """Section of a chapter number, else null."""
    out = F.lit(None).cast("int")
    for section, low, high in reversed(SECTIONS):
        out = F.when(chapter.between(low, high), section).otherwise(out)
    return out


def error_type(true: Column, pred: Column) -> Column:
    """chapter, heading or subheading error of a wrong prediction."""
    wrong_chapter = F.substring(true, 1, 2) != F.substring(pred, 1, 2)
    wrong_heading = F.substring(true, 1, 4) != F.substring(pred, 1, 4)
    return F.when(wrong_chapter, "chapter_error").when(wrong_heading, "heading_error").otherwise("subheading_error")


def route(confidence: Column, auto: float = 0.7, review: float = 0.4) -> Column:
    return F.when(confidence >= auto, "AUTO").when(confidence >= review, "ASK").otherwise("REVIEW")


def enriched(text: Column, materials: Column, use: Column, is_set: Column, is_electrical: Column) -> Column:
    """Structured input as one text: parts joined by |; materials are (name, ratio, unit) structs."""
    one = lambda m: F.when(m["ratio"].isNotNull(), F.concat(m["name"], F.lit(" "), F.round(m["ratio"] * 100).cast("int").cast("string"), F.lit("%"))).otherwise(m["name"])
    some = F.when(F.size(materials) > 0, F.concat(F.lit("재질: "), F.array_join(F.transform(materials, one), ", ")))
    return F.concat_ws(" | ", text, some, F.when(F.length(use) > 0, F.concat(F.lit("용도: "), use)), F.when(is_set, "세트물품"), F.when(is_electrical, "전기식"))


def quantity_holds(value: Column, op: Column, threshold: Column) -> Column:
    """value op threshold for >= <= > < =, where = allows 0.001; any other op is false."""
    out = F.when(op == ">=", value >= threshold).when(op == "<=", value <= threshold).when(op == ">", value > threshold).when(op == "<", value < threshold)
    return F.coalesce(out.when(op == "=", F.abs(value - threshold) < 0.001).otherwise(False), F.lit(False))


def marks_of(groups: int) -> list[str]:
    """The control characters that :func:`matched` puts around matches."""
    return [chr(1), *(chr(2 + i) for i in range(groups + 1)), chr(3 + groups)]


def unmarked(text: Column, groups: int = 1) -> Column:
    """The text as patterns see it: control characters that serve as marks count as spaces."""
    marks = marks_of(groups)
    return F.translate(F.coalesce(text, F.lit("")), "".join(marks), " " * len(marks))


def matched(text: Column, pattern: str, groups: int = 1, window: int = 0, places: Callable[[Column], Column] | None = None) -> Column:
    """Every match of a pattern, left to right: an array of structs (match, g1, ..., prior, later).

    ``prior`` and ``later`` are the ``window`` characters around the match, as
    far as the text goes. A group that took no part is ''. One pass marks the
    matches; the windows come from the pieces between the marks, as many as
    they can reach into. Spark copies an array for each slice of it, so where
    a text has many matches and few are needed, ``places`` gives the indices
    (from 0) of these, in an array of all (match, g1, ...).
    """
    marks = marks_of(groups)
    clean = unmarked(text, groups)
    template = marks[0] + "$0" + "".join(f"{marks[i]}${i}" for i in range(1, groups + 1)) + marks[groups + 1]
    return once(F.split(F.regexp_replace(clean, pattern, template), marks[0]), lambda parts: surrounded(parts, marks, groups, window, places))


def surrounded(parts: Column, marks: list[str], groups: int, window: int, places: Callable[[Column], Column] | None = None) -> Column:
    """The structs of :func:`matched` from the pieces of a marked text."""
    bodies = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.struct(F.substring_index(x, marks[1], 1).alias("match"), *(between(x, marks[i], marks[i + 1]).alias(f"g{i}") for i in range(1, groups + 1)), F.substring_index(x, marks[groups + 1], -1).alias("rest")))

    def taken(bodies: Column, plain: Column) -> Column:
        reach = window + 1  # pieces after the first have a character at least
        before = lambda i: F.array_join(F.slice(plain, F.greatest(i + 1 - reach, F.lit(0)) + 1, F.least(i + 1, F.lit(reach))), "")
        after = lambda b, i: F.concat(b["rest"], F.array_join(F.slice(plain, i + 3, reach), ""))
        around = lambda b, i: (F.when(F.lit(window) > 0, F.right(before(i), F.lit(window))).otherwise(""), F.substring(after(b, i), 1, window) if window else F.lit(""))
        made = lambda b, i: F.struct(b["match"].alias("match"), *(b[f"g{g}"].alias(f"g{g}") for g in range(1, groups + 1)), around(b, i)[0].alias("prior"), around(b, i)[1].alias("later"))
        return F.transform(bodies, made) if places is None else F.transform(places(bodies), lambda i: made(F.get(bodies, i), i))

    joined = lambda bodies: F.concat(F.array(F.get(parts, F.lit(0))), F.transform(bodies, lambda b: F.concat(b["match"], b["rest"])))
    return once(bodies, lambda found: once(joined(found), lambda plain: taken(found, plain)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda Spark computes an expression anew wherever, and as often as, it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def between(text: Column, start: str, end: str) -> Column:
    """What lies between the first ``start`` and the first ``end`` after it."""
    return F.substring_index(F.substring(text, F.instr(text, start) + 1, F.length(text)), end, 1)
