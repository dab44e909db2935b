"""Information extraction by patterns and lexicons, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import STOPWORDS_KO, normalize, sentences

# Keywords and patterns of the five signals.
SIGNALS = {
    "note_like": (
        [
            "주", "류주", "장주", "호주", "소호주",
            "제1류", "제2류", "제3류", "제4류", "제5류",
            "제6류", "제7류", "제8류", "제9류", "제10류",
            "해설서", "품목분류", "통칙", "관세율표",
            "부의주", "류의주", "장의주",
            "note", "chapter note", "section note", "heading note",
            "subheading note", "legal note", "explanatory note",
        ],
        [r"제\s*\d+\s*류", r"제\s*\d+\s*장", r"\d+류\s*주", r"chapter\s*\d+", r"section\s*[ivx]+"],
    ),
    "incomplete": (
        [
            "미조립", "조립용", "분해", "반제품", "미완성",
            "조립식", "조립품", "녹다운", "분리", "해체",
            "미가공", "반가공", "부분품", "구성품",
            "조립전", "조립 전", "분해상태", "분해 상태",
            "ckd", "skd", "knockdown", "knock-down", "knock down",
            "unassembled", "disassembled", "incomplete", "unfinished",
            "semi-finished", "semifinished", "partially",
            "kit", "kits", "assembly", "to be assembled",
        ],
        [r"c\.?k\.?d", r"s\.?k\.?d", r"미\s*조립", r"반\s*제품"],
    ),
    "mixtures": (
        [
            "혼합", "블렌드", "함유", "합금", "코팅",
            "복합", "적층", "충전", "첨가", "배합",
            "성분", "재질", "소재", "원료",
            "피복", "도금", "접합", "라미네이트",
            "함량", "비율", "농도",
            "mixture", "mixed", "blend", "blended", "alloy",
            "coated", "coating", "composite", "laminated", "laminate",
            "filled", "combined", "compound", "compounded",
            "containing", "consists", "made of", "composed",
            "plated", "clad", "covered",
        ],
        [r"\d+\s*%", r"\d+\s*퍼센트", r"함량\s*\d+", r"비율\s*\d+"],
    ),
    "multi_candidate": (
        [
            "세트", "본질적", "혼용", "복수", "겸용",
            "다용도", "다기능", "복합기", "일체형",
            "구성품", "조합", "묶음", "패키지",
            "키트", "콤보", "셋트",
            "set", "sets", "essential", "essential character",
            "multi-purpose", "multipurpose", "multi-function",
            "combo", "combination", "package", "kit",
            "put up", "retail sale", "together",
        ],
        [r"세트\s*구성", r"\d+\s*종\s*세트", r"본질적\s*특성"],
    ),
    "containers": (
        [
            "케이스", "보관함", "전용케이스", "전용 케이스",
            "포장용기", "하드케이스", "소프트케이스",
            "가방", "파우치", "박스", "상자",
            "용기", "컨테이너", "보관",
            "case", "cases", "container", "containers",
            "box", "boxes", "pouch", "bag", "bags",
            "packaging", "packing", "storage",
            "specially shaped", "fitted",
        ],
        [r"전용\s*케이스", r"보관\s*용", r"케이스\s*포함"],
    ),
}
PARTS = [
    "부품", "부속품", "부속", "액세서리", "교체품", "소모품", "예비품", "예비부품", "스페어",
    "part", "parts", "accessory", "accessories", "component", "components", "spare", "spares", "replacement", "consumable",
]
HARD = ["제외한다", "제외된다", "해당하지 아니한다", "해당하지 않는다", "해당되지 아니한다", "해당되지 않는다", "분류하지 아니한다", "분류하지 않는다", "분류되지 아니한다", "포함하지 아니한다", "포함하지 않는다", "포함되지 아니한다", "적용하지 아니한다", "적용하지 않는다", "이 류에서", "이 호에서", "이 절에서", "다음 각 목의 것은 제외", "다음의 것은 제외"]
EXCLUDE_NOTE = [r"제외한다", r"포함하지\s*않는다", r"분류하지\s*않는다", r"해당하지\s*않는다", r"제외된다", r"적용하지\s*않는다", r"is\s+excluded", r"does\s+not\s+include", "excluding", "except"]
REDIRECT_NOTE = [r"제\d{4}호[에로]?\s*분류", r"제\d{2}류[에로]?\s*분류", r"제\d+호\s*참조", r"classify\s+(?:in|under|to)\s+heading\s+\d{4}", r"refer\s+to\s+heading"]
INCLUDE_NOTE = [r"포함(?:한다|된다)", r"이\s*호에는", r"여기에는", r"(?:includes?|including|comprise)", r"classified\s+(?:in|under)"]
DEFINITION_NOTE = [r"(?:이란|라\s*함은|means?|defined\s+as)"]
APPLIED = [r"통칙\s*제?\s*(\d)\s*호", r"일반통칙\s*제?\s*(\d)", r"해석.*통칙\s*제?\s*(\d)", r"GRI\s*(\d)", r"Rule\s*(\d)"]
REJECTED = [r"제?(\d{4})\.?(\d{2})?\s*호?\s*(?:가\s*아니|에서\s*제외|에\s*해당하지|로\s*분류하지)", r"제?(\d{4})\.?(\d{2})?\s*호?\s*(?:아닌|제외|불해당)"]


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def signals(texts: DataFrame, text: str = "text", raw: bool = True) -> DataFrame:
    """Adds, for each signal, how many keywords and patterns match, a flag and a confidence of 0.3 a match up to 1.

    Keywords are looked for in the normalised text; patterns in the raw text,
    or in the normalised one, which has lost % and dots (``raw=False``).
    """
    norm = normalize(F.col(text))
    rows = texts.withColumn("_norm", norm)
    where = F.lower(F.coalesce(F.col(text), F.lit(""))) if raw else F.col("_norm")
    for name, (words, patterns) in SIGNALS.items():
        kws = F.array(*(F.lit(w) for w in sorted({w.replace("-", " ").strip() for w in words if len(w) >= 2})))
        count = F.size(F.filter(kws, lambda k: F.contains(F.col("_norm"), k)))
        for p in patterns:
            count = count + where.rlike(f"(?i){p}").cast("int")
        rows = rows.withColumn(f"{name}_n", count).withColumn(name, F.col(f"{name}_n") > 0).withColumn(f"{name}_confidence", F.round(F.least(F.lit(1.0), 0.3 * F.col(f"{name}_n")), 6))
    parts = F.size(F.filter(F.array(*map(F.lit, PARTS)), lambda k: F.contains(F.col("_norm"), k)))
    rows = rows.withColumn("parts_n", parts).withColumn("parts_confidence", F.round(F.least(F.lit(1.0), 0.4 * F.col("parts_n")), 6))
    return rows.drop("_norm")


def matched_keywords(texts: DataFrame, text: str = "text") -> DataFrame:
    """item_id and for each signal the keywords that the normalised text has, sorted; null where there are none."""
    norm = texts.select("item_id", normalize(F.col(text)).alias("_norm"))
    found = {}
    for name, (keywords, _) in SIGNALS.items():
        kws = F.array(*(F.lit(w) for w in sorted({w.replace("-", " ").strip() for w in keywords if len(w) >= 2})))
        held = F.filter(kws, lambda k: F.contains(F.col("_norm"), k))
        found[name] = F.when(F.size(held) > 0, held)
    return norm.select("item_id", *(c.alias(n) for n, c in found.items()))


def lexicon_tags(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Categories of (axis, category, keyword) found in (item_id, norm): per item and axis the values, matches and confidence.

    confidence = min(1, 0.3 x matches + 0.2).
    """
    from .match import contained

    hits = contained(items, lexicon.select(F.col("keyword").alias("term"))).join(lexicon.withColumnRenamed("keyword", "term"), "term")
    out = hits.groupBy("item_id", "axis").agg(F.array_sort(F.collect_set("category")).alias("values"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.3 * F.col("n") + 0.2), 6))


#: Unit of each quantity with its property.
UNITS = [("%", "ratio"), ("kg", "weight"), ("g", "weight"), ("mm", "size"), ("cm", "size"), ("ml", "volume"), ("l", "volume"), ("v", "voltage"), ("w", "power")]


def quantities(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds quantities: an array of (value, unit, property) for numbers with a unit, units in the order above."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    parts = []
    for unit, prop in UNITS:
        found = F.regexp_extract_all(body, F.lit(rf"(\d+(?:\.\d+)?)\s*{unit}(?![a-z0-9%])"), 1)
        parts.append(F.transform(found, quantity(unit, prop)))
    return texts.withColumn("quantities", F.concat(*parts))


def quantity(unit: str, prop: str):
    return lambda v: F.struct(v.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(prop).alias("property"))


def chunks(commentary: DataFrame, code: str = "code", content: str = "content") -> DataFrame:
    """Sentences of a commentary with their type, redirect target, signals and strength; general ones are dropped."""
    rows = commentary.select(F.col(code).alias("code"), F.posexplode(sentences(F.col(content))).alias("position", "text"))
    has = lambda p: F.col("text").rlike(p)
    kind = (
        F.when(has("이 호에는?.+분류"), "definition").when(has(r"제외|제(\d{4})호[로에]|다만|그러나"), "exclude_rule").when(has("포함|해당|분류[된하]"), "include_rule")
        .when(has(r"예[:\s]|예를 들"), "example").when(has("주의|유의|참고|단,"), "note").otherwise("general")
    )
    target = F.nullif(F.regexp_extract("text", r"제?(\d{4})호", 1), F.lit(""))
    rows = rows.withColumn("chunk_type", kind).filter("chunk_type <> 'general'")
    rows = rows.withColumn("target_code", F.when((F.col("chunk_type") == "exclude_rule") & (target != F.col("code")), target))
    rows = rows.withColumn("strength", strength(F.col("text"), F.col("chunk_type")))
    words = F.filter(F.regexp_extract_all("text", F.lit("([가-힣]{2,10})"), 1), lambda w: ~F.array_contains(F.array(*map(F.lit, STOPWORDS_KO)), w))
    return frequent_words(rows.withColumn("words", words), ["code", "position"], 5)


def frequent_words(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Replaces the array words by signals: the n most frequent, ties by first place."""
    count = lambda w: F.size(F.filter("words", lambda x: x == w))
    ranked = F.array_sort(F.transform(F.array_distinct("words"), lambda w, i: F.struct((-count(w)).alias("c"), i.alias("i"), w.alias("w"))))
    return rows.withColumn("signals", F.slice(F.transform(ranked, lambda s: s["w"]), 1, n)).drop("words")


def strength(text: Column, kind: Column) -> Column:
    return F.when((kind == "exclude_rule") & F.exists(F.array(*map(F.lit, HARD)), lambda p: F.contains(F.lower(text), p)), "hard").otherwise("soft")


def note_type(content: Column) -> Column:
    """exclude, redirect, include, definition or general; the first that matches."""
    return (
        F.when(content.rlike(any_of(EXCLUDE_NOTE)), "exclude").when(content.rlike(any_of(REDIRECT_NOTE)), "redirect")
        .when(content.rlike(any_of(INCLUDE_NOTE)), "include").when(content.rlike(any_of(DEFINITION_NOTE)), "definition").otherwise("general")
    )


def note_keywords(content: Column, n: int = 10) -> Column:
    """Quoted terms, noun phrases, heading references; distinct, 2 to 30 characters, the first n."""
    quoted = F.transform(F.regexp_extract_all(content, F.lit("[\"']([^\"']{2,30})[\"']"), 1), lambda x: F.trim(x))
    nouns = F.regexp_extract_all(content, F.lit(r"([가-힣]{2,15})\s*(?:의\s*것|으로\s*한\s*것|이?나\s*것)"), 1)
    heads = F.transform(F.regexp_extract_all(content, F.lit(r"제(\d{4})호"), 1), lambda h: F.concat(F.lit("제"), h, F.lit("호")))
    return F.slice(F.array_distinct(F.filter(F.concat(quoted, nouns, heads), lambda k: F.length(k).between(2, 30))), 1, n)


def redirect_target(content: Column) -> Column:
    heading = F.nullif(F.regexp_extract(content, r"제(\d{4})호", 1), F.lit(""))
    chapter = F.nullif(F.regexp_extract(content, r"제(\d{2})류", 1), F.lit(""))
    return F.coalesce(heading, F.concat(chapter, F.lit("00")))


def notes(rows: DataFrame, content: str = "note_content") -> DataFrame:
    c = F.coalesce(F.col(content), F.lit(""))
    return rows.withColumns({"note_type": note_type(c), "keywords": note_keywords(c), "redirect_to": redirect_target(c)})


def notes_from_lines(lines: DataFrame, start: Column, heading: Column, item: Column, doc: str = "doc", line_no: str = "line_no", text: str = "text", least: int = 10) -> DataFrame:
    """Numbered notes from lines: headings carried forward, lines of one item joined, short ones dropped.

    ``heading`` is the heading that a line names (else null), ``start`` says
    that a block of notes begins, ``item`` that a numbered item begins.
    Returns doc, heading, note_number, note_content.
    """
    w = W.partitionBy(doc).orderBy(line_no)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = lines.select(doc, line_no, text, heading.alias("_h"), start.alias("_b"), item.alias("_i"))
    rows = rows.withColumn("heading", F.last("_h", ignorenulls=True).over(upto))
    rows = rows.withColumn("block", F.sum(F.when(F.col("_b") | F.col("_h").isNotNull(), 1).otherwise(0)).over(upto))
    inside = W.partitionBy(doc, "block").orderBy(line_no).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.max(F.col("_b").cast("int")).over(inside)).withColumn("note_number", F.sum(F.col("_i").cast("int")).over(inside))
    rows = rows.filter("open = 1 and note_number > 0 and _h is null and not _b")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line_no, text))), lambda s: s[text]), " ")
    out = rows.groupBy(doc, "block", "note_number").agg(F.first("heading").alias("heading"), joined.alias("note_content"))
    return out.filter(F.length("note_content") > least).select(doc, "block", "heading", "note_number", "note_content")


def html_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Text lines of marked-up pages: split at block tags, other tags removed, blank lines dropped."""
    blocks = F.split(F.col(html), r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|td|table|br|section|article|body|head|title|header|footer|nav)[^>]*>")
    clean = F.transform(blocks, lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"<[^>]*>", " "), r"\s+", " ")))
    return pages.select(key, F.posexplode(F.filter(clean, lambda b: F.length(b) > 0)).alias("line_no", "text"))


def parsed_code(code: Column) -> Column:
    """Struct of the first 4, 6 and 10 digits of a decision code; '' where absent."""
    clean = F.regexp_replace(F.coalesce(code, F.lit("")), r"[제호\s]", "")
    ten, six, four = r"(\d{4})\.?(\d{2})-?(\d{4})", r"(\d{4})\.?(\d{2})", r"(\d{4})"
    has10, has6 = clean.rlike(ten), clean.rlike(six)
    g = lambda p, i: F.regexp_extract(clean, p, i)
    head = F.when(has10, g(ten, 1)).when(has6, g(six, 1)).otherwise(g(four, 1))
    sub = F.when(has10, F.concat(g(ten, 1), g(ten, 2))).when(has6, F.concat(g(six, 1), g(six, 2))).otherwise("")
    return F.struct(head.alias("code4"), sub.alias("code6"), F.when(has10, F.concat(g(ten, 1), g(ten, 2), g(ten, 3))).otherwise("").alias("code10"))


def applied_rules(text: Column) -> Column:
    found = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1) for p in APPLIED))
    ids = F.transform(found, lambda n: F.concat(F.lit("GRI"), n))
    return F.array_distinct(F.concat(ids, F.when(text.rlike(r"(?i)소호|제6호|GRI\s*6"), F.array(F.lit("GRI6"))).otherwise(F.array().cast("array<string>"))))


def rejected_codes(text: Column) -> Column:
    parts = []
    for p in REJECTED:
        a, b = F.regexp_extract_all(text, F.lit(p), 1), F.regexp_extract_all(text, F.lit(p), 2)
        parts.append(F.zip_with(a, b, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))))
    return F.array_distinct(F.concat(*parts))


def decisive_sentences(text: Column) -> Column:
    kept = F.filter(sentences(text, r"[.\n;]"), lambda s: s.rlike("(?:분류|해당|적용|결정)[하됨]"))
    return F.slice(F.transform(kept, lambda s: F.substring(s, 1, 300)), 1, 3)


def mentions_essence(text: Column) -> Column:
    return text.rlike(r"(?i)본질적\s*특성|essential\s*character|주된\s*(?:성분|재질|기능|특성)")


def normalized_cases(cases: DataFrame) -> DataFrame:
    """(case_id, decision_code, heading, rationale, materials array) as normalised cases with a completeness score."""
    t = F.coalesce(F.col("rationale"), F.lit(""))
    rows = cases.withColumn("_c", parsed_code(F.col("decision_code"))).select(
        "case_id", F.when(F.col("_c.code4") == "", F.substring(F.coalesce("heading", F.lit("")), 1, 4)).otherwise(F.col("_c.code4")).alias("code4"), F.col("_c.code6").alias("code6"), F.col("_c.code10").alias("code10"),
        applied_rules(t).alias("applied_rules"), rejected_codes(t).alias("rejected_codes"), decisive_sentences(t).alias("decisive_reasoning"), mentions_essence(t).alias("essential_character"), "materials",
    )
    depth = F.when(F.col("code10") != "", 0.4).when(F.col("code6") != "", 0.3).when(F.col("code4") != "", 0.2).otherwise(0.0)
    some = lambda c, v: F.when(F.size(c) > 0, v).otherwise(0.0)
    score = depth + some("applied_rules", 0.2) + some("decisive_reasoning", 0.2) + some("materials", 0.1) + some("rejected_codes", 0.1)
    return rows.withColumn("confidence", F.round(score, 2))


def parsed_answer(text: Column, schema: str) -> Column:
    """JSON of an answer: as it is, in a fence, or from the first to the last brace."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parse = lambda c: F.when(F.trim(c).startswith("{"), F.from_json(c, schema, {"mode": "PERMISSIVE"}))
    return F.coalesce(parse(text), parse(fenced), parse(braces))


def case_terms(cases: DataFrame, name: str = "name", description: str = "description") -> DataFrame:
    """Terms of a case: parts of its name (2 to 50 characters) and bracketed terms of its description (2 to 30)."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(name), F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda t: F.length(t).between(2, 50))
    inside = F.filter(F.transform(F.regexp_extract_all(F.coalesce(F.col(description), F.lit("")), F.lit(r"\(([^)]+)\)"), 1), lambda x: F.trim(x)), lambda t: F.length(t).between(2, 30))
    return cases.withColumn("term", F.explode(F.concat(parts, inside)))


def subcodes(records: DataFrame, cases: DataFrame) -> DataFrame:
    """(code, name, position) grouped by the first six digits: first title, tokens, full codes, number of cases (case-only codes too)."""
    digits = F.regexp_replace("code", r"\D", "")
    rows = records.withColumn("_d", digits).filter(F.length("_d") >= 6).withColumn("subcode", F.substring("_d", 1, 6))
    tokens = F.regexp_extract_all(F.lower("name"), F.lit("([가-힣]{2,}|[a-z]{3,})"), 1)
    titles = rows.groupBy("subcode").agg(F.min_by("name", "position").alias("title"), F.array_sort(F.collect_set("_d")).alias("codes"))
    words = rows.select("subcode", F.explode(tokens).alias("w")).groupBy("subcode").agg(F.array_sort(F.collect_set("w")).alias("keywords"))
    counts = cases.select(F.substring(F.regexp_replace("code", r"\D", ""), 1, 6).alias("subcode")).filter(F.length("subcode") == 6).groupBy("subcode").agg(F.count(F.lit(1)).alias("case_count"))
    out = titles.join(words, "subcode", "left").join(counts, "subcode", "full_outer")
    return out.select("subcode", F.substring("subcode", 1, 4).alias("code"), "title", "keywords", "codes", F.coalesce("case_count", F.lit(0)).alias("case_count"))
