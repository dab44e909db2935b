"""Queries of quantity facts, references with their reasons, required facts of notes and what codes inherit of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import profiles, requirements
from ..sources.scratch import spread
from .axis_queries import COMM, commentary
from .fixtures import ITEMS, items
from .match_queries import norm_sql

#: What a part's description says of its size, by its key.
AMOUNTS = [
    "함량 {}% 이상", "{} 퍼센트 이하", "농도 {} ppm 초과", "순도 {}", "중량 {}kg 미만 {} ml", "{} g 이상 길이 {}cm",
    "{}:{} 비율", "두께 {}.5 mm", "밀도 {} g/cm3", "{} 리터 및 {} mg 함유", "중량 {} 톤 초과 {} percent",
]


def measured(s, d):
    """item_id and a text that ends with an amount."""
    phrase = F.element_at(F.array(*map(F.lit, AMOUNTS)), (F.col("item_id") % len(AMOUNTS) + 1).cast("int"))
    return spread(items(s, d), "item_id").select("item_id", F.concat("p_name", F.lit(" "), F.replace(phrase, F.lit("{}"), F.col("p_size").cast("string"))).alias("text"))


def quantity_rows(s, d):
    """Facts of the normalised and of the raw text."""
    rows = measured(s, d).withColumn("mode", F.explode(F.array(F.lit("normalized"), F.lit("raw"))))
    facts = F.when(F.col("mode") == "raw", requirements.quantity_facts(F.col("text"), False)).otherwise(requirements.quantity_facts(F.col("text")))
    return rows.select("item_id", "mode", F.explode(facts).alias("f")).select("item_id", "mode", "f.*")


def matched_sql(source: str, key: str, text: str, pattern: str, groups: int, window: int) -> str:
    """A SELECT of key, i, match, g1 .., prior, later: every match with the characters around it."""
    marks = "chr(2) || '\\1' || chr(3)" + (" || '\\2' || chr(4)" if groups == 2 else "")
    last = f"chr({2 + groups})"
    strip = lambda x: f"regexp_replace({x}, chr(2) || '[^' || {last} || ']*' || {last}, '', 'g')"
    group = lambda g: f"split_part(split_part(parts[i], chr({1 + g}), 2), chr({2 + g}), 1) AS g{g}"
    return f"""SELECT {key}, i, split_part(parts[i], chr(2), 1) AS match, {', '.join(map(group, range(1, groups + 1)))}, right({strip("array_to_string(parts[1:i - 1], '')")}, {window}) AS prior,
  substr({strip("array_to_string(parts[i:], '')")}, length(split_part(parts[i], chr(2), 1)) + 1, {window}) AS later
  FROM (SELECT {key}, parts, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT {key}, string_split(regexp_replace({text}, '{pattern}', chr(1) || '\\0' || {marks}, 'g'), chr(1)) AS parts FROM {source}))"""


def quantities_sql() -> str:
    texts = ", ".join(f"'{x}'" for x in AMOUNTS)
    out = f"WITH {ITEMS}, ms AS (SELECT item_id, p_name || ' ' || replace(([{texts}])[item_id % {len(AMOUNTS)} + 1], '{{}}', CAST(p_size AS VARCHAR)) AS text FROM items), bd AS (SELECT item_id, 'normalized' AS mode, {norm_sql('text')} AS body FROM ms UNION ALL SELECT item_id, 'raw', lower(text) FROM ms)"
    parts = []
    for pattern, prop, unit in requirements.QUANTITIES:
        groups = 2 if unit is None else 1
        own = "nullif(g2, '')" if unit is None else f"'{unit}'"
        near = "prior || match || later"
        op = "CASE " + " ".join(f"WHEN contains({near}, '{w}') THEN '{s}'" for w, s in requirements.OPERATORS) + " ELSE '=' END"
        parts.append(f"SELECT item_id, mode, CAST(g1 AS DOUBLE) AS value, {own} AS unit, '{prop}' AS property, {op} AS operator, match AS span FROM ({matched_sql('bd', 'item_id, mode', 'body', pattern, groups, 10)})")
    return out + " " + " UNION ALL ".join(parts)


def reasons_sql() -> str:
    parts = [f"SELECT code, {k} AS k, i, g1 AS target, left(trim(prior || match || later), 100) AS reason FROM ({matched_sql('comm', 'code', 'content', p, 1, 50)})" for k, p in enumerate(profiles.REFERENCES)]
    return f"""WITH {COMM}, m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT code, target, min(k * 100000 + i) AS place, arg_min(reason, k * 100000 + i) AS reason FROM m WHERE target <> code GROUP BY code, target)
SELECT code, target, reason, CAST(row_number() OVER (PARTITION BY code ORDER BY place) AS INT) AS position FROM f QUALIFY position <= 5"""


def reasons(s, d):
    rows = commentary(s, d).select("code", F.posexplode(profiles.excludes(F.col("content"), F.col("code"))).alias("p", "x"))
    return rows.select("code", F.col("x.code").alias("target"), F.col("x.reason").alias("reason"), (F.col("p") + 1).alias("position"))


#: What a part makes of a note, by its key.
CLAUSES = [
    "이 류에는 냉동 또는 건조한 {}을 포함한다", "다만, {}으로 만든 식용 물품은 제외한다", "{}이란 플라스틱 함유량이 100분의 50 이상인 것", "중량이 20 킬로그램 미만인 미조립 {}",
    "제8501호로 분류하는 PVC {}", "의료용 {} 30% 초과", "그러나 합성섬유 {}를 포함하지 않는다", "기타 {}",
]


def note_rows(s, d):
    """A note for each part: of a section, a chapter or a subheading by turns."""
    i = F.col("item_id")
    clause = F.element_at(F.array(*map(F.lit, CLAUSES)), (i % len(CLAUSES) + 1).cast("int"))
    level = F.element_at(F.array(F.lit("section"), F.lit("chapter"), F.lit("subheading")), (i % 3 + 1).cast("int"))
    content = F.replace(clause, F.lit("{}"), F.col("p_name"))
    return spread(items(s, d), "item_id").select(level.alias("level"), t.section_of(F.substring("code", 1, 2).cast("int")).alias("section_num"), F.substring("code", 1, 2).cast("int").alias("chapter_num"), i.alias("note_number"), content.alias("note_content"))


def fact_rows(s, d):
    return requirements.note_facts(note_rows(s, d))


def inherited(s, d):
    return requirements.inherited_facts(items(s, d), fact_rows(s, d)).select("code", "axis", "operator", "value", "nearest", "note_id", "hardness")


def note_facts_sql() -> str:
    clauses = ", ".join(f"'{x}'" for x in CLAUSES)
    kind = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{k}'" for k, p in requirements.TYPES) + " ELSE 'general' END"
    words = ", ".join(f"('{a}', '{w}')" for a, ws in requirements.WORDS.items() for w in ws)
    near = "substr(c, instr(c, v), 20)"
    op = f"CASE WHEN regexp_matches({near}, '초과|이상') THEN 'gte' WHEN regexp_matches({near}, '미만|이하') THEN 'lte' ELSE 'eq' END"
    amounts = " UNION ALL ".join(f"SELECT note_id, note_type, scope, 'quant', {op}, v || '{u}', '{b}', hard, 0.9 FROM (SELECT *, unnest(regexp_extract_all(c, '{p}', 1)) AS v FROM nk)" for p, b, u in requirements.AMOUNTS)
    outs = " UNION ALL ".join(f"SELECT note_id, note_type, scope, 'legal', 'not_contains', trim(left(v, 30)), NULL, 'hard', 0.9 FROM (SELECT *, unnest(regexp_extract_all(c, '{p}', 1)) AS v FROM nk) WHERE length(trim(left(v, 30))) > 5" for p in requirements.EXCLUSIONS)
    sections = ", ".join(map(str, t.SECTIONS))
    return f"""{ITEMS}, sec(section, low, high) AS (VALUES {sections}),
nt AS (SELECT item_id, ['section', 'chapter', 'subheading'][item_id % 3 + 1] AS level, section, left(code, 2) AS chapter, replace(([{clauses}])[item_id % {len(CLAUSES)} + 1], '{{}}', p_name) AS c FROM items LEFT JOIN sec ON CAST(left(code, 2) AS INT) BETWEEN low AND high),
nk AS MATERIALIZED (SELECT level || '_' || CASE WHEN level = 'section' THEN CAST(section AS VARCHAR) ELSE chapter END || '_' || item_id AS note_id, {kind} AS note_type, CASE WHEN level = 'section' THEN 'section_' || section ELSE 'chapter_' || chapter END AS scope, CASE WHEN {kind} = 'exclude' THEN 'hard' ELSE 'soft' END AS hard, c FROM nt),
wd(axis, w) AS (VALUES {words}),
nf AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT note_id, note_type, scope, axis, CASE WHEN note_type = 'exclude' THEN 'not_contains' ELSE 'contains' END AS operator, w AS value, NULL AS basis, hard AS hardness, 0.8 AS confidence FROM nk JOIN wd ON contains(c, w) OR (axis = 'material' AND contains(lower(c), lower(w)))
  UNION ALL {amounts} UNION ALL {outs}))"""


NOTE_FACTS = note_facts_sql()

QUERIES = {
    "x3_quantity_facts": (quantity_rows, quantities_sql()),
    "x9_reasons": (reasons, reasons_sql()),
    "x16_note_facts": (fact_rows, f"WITH {NOTE_FACTS} SELECT note_id, note_type, scope, axis, operator, value, basis, hardness, CAST(confidence AS DOUBLE) AS confidence FROM nf"),
    "x16_inherited_facts": (inherited, f"WITH {NOTE_FACTS}, cs AS (SELECT DISTINCT code, left(code, 2) AS chapter FROM items), lv AS (SELECT code, 'chapter' AS nearest, 'chapter_' || chapter AS scope FROM cs UNION ALL SELECT code, 'section', 'section_' || section FROM cs JOIN sec ON CAST(chapter AS INT) BETWEEN low AND high), h AS (SELECT code, axis, operator, value, nearest, note_id, hardness FROM lv JOIN nf ON nf.scope = lv.scope) SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY code, axis, operator, value ORDER BY nearest, note_id, hardness) = 1"),
}
