"""Queries of text functions, extraction from commentaries, attribute axes, facts, composed scorers and their results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as t
from ..operators import attributes, axes, cascade, diagnostics, extract, gate, match, profiles, scorers, split, steps
from ..sources.scratch import spread
from .fixtures import ITEMS, PRED, items, predictions, predictions_sql, table
from .match_queries import FEATURES, KB, all_features, cards, kb_of, ml_items, norm_sql, rules, tokens_of, tokens_sql
from .metric_queries import QUERIES as METRICS
from .step_queries import PASSED, passed
from .text_queries import GATE, alias_table, gate_of, gated, note_profiles, note_table

PREP = ITEMS + f", prep AS (SELECT item_id, code, p_name, {norm_sql('text')} AS norm, {tokens_sql('text')} AS tokens FROM items)"


def firsts(expr: str) -> str:
    """DuckDB: the distinct entries of a list in order."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def docs(s, d):
    return table(s, d, "documents")


# ---- commentaries: one a code, made of a sentence for each part ----


def commentary(s, d):
    two = F.lpad(((F.col("item_id") * 7) % 97 + 1).cast("string"), 2, "0")
    i = F.col("item_id") % 6
    name = F.regexp_replace("p_name", " ", ", ")
    sentence = (
        F.when(i == 0, F.concat(F.lit("이 호에는 "), name, F.lit(" 을 분류한다"))).when(i == 1, F.concat(F.lit("다만 제"), two, F.lit("01호로 분류하는 "), name, F.lit("은 제외한다")))
        .when(i == 2, F.concat(F.lit("예: "), name, F.lit(" 등을 포함한다"))).when(i == 3, F.concat(F.lit("재질이 "), F.lower("p_type"), F.lit("으로 된 냉동 분말은 유의한다")))
        .when(i == 4, F.concat(F.lit("본질적 특성이 '"), "p_name", F.lit("'인 것을 통칙 제"), (F.col("item_id") % 5 + 1).cast("string"), F.lit("호로 분류함"))).otherwise(F.concat(two, F.lit("02호가 아니고 "), name, F.lit("의 것에 한정한 경우")))
    )
    rows = items(s, d).select("item_id", "code", "p_type", "p_name", sentence.alias("sentence"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "sentence"))), lambda x: x["sentence"]), ". ")
    rows = spread(rows, "code", 10_000).groupBy("code").agg(text.alias("content"), F.max("p_type").alias("_t"), F.min("p_name").alias("_n"))  # dealt by size, as a text is worked on for long
    return rows.select("code", F.concat_ws(", ", "_t", "_n").alias("title"), "content", F.substring("code", 1, 2).alias("chapter"))


COMM = ITEMS + """,
sen AS (SELECT *, lpad(CAST((item_id * 7) % 97 + 1 AS VARCHAR), 2, '0') AS two, replace(p_name, ' ', ', ') AS name FROM items),
comm AS (SELECT code, string_agg(CASE item_id % 6 WHEN 0 THEN '이 호에는 ' || name || ' 을 분류한다' WHEN 1 THEN '다만 제' || two || '01호로 분류하는 ' || name || '은 제외한다' WHEN 2 THEN '예: ' || name || ' 등을 포함한다'
  WHEN 3 THEN '재질이 ' || lower(p_type) || '으로 된 냉동 분말은 유의한다' WHEN 4 THEN '본질적 특성이 ''' || p_name || '''인 것을 통칙 제' || CAST(item_id % 5 + 1 AS VARCHAR) || '호로 분류함' ELSE two || '02호가 아니고 ' || name || '의 것에 한정한 경우' END, '. ' ORDER BY item_id) AS content,
  max(p_type) || ', ' || min(p_name) AS title FROM sen GROUP BY code)"""


def over_comm(name: str, column):
    """A query of one column, a function of the content, for each commentary."""
    return lambda s, d: commentary(s, d).select("code", column(F.col("content")).alias(name))


def joined(array):
    return F.array_join(array, "|")


def found_sql(patterns: list[str], flags: str = "") -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all(content, '{flags}{p}', 1)" for p in patterns) + (", [])" if len(patterns) == 1 else ")")


def split_sql(texts: str, pattern: str, low: int, high: int) -> str:
    return f"list_filter(list_transform(flatten(list_transform({texts}, lambda m: string_split_regex(m, '{pattern}'))), lambda w: trim(w)), lambda w: length(w) BETWEEN {low} AND {high})"


SCOPE_SQL = f"WITH {COMM}, w AS (SELECT code, list_filter({split_sql(found_sql(profiles.SCOPE, '(?s)'), '[,·\\s]+', 2, 20)}, lambda w: NOT regexp_matches(w, '^[0-9\\(\\)호류]+$')) AS l FROM comm) SELECT code, array_to_string(list_slice({firsts('l')}, 1, 10), '|') AS scope FROM w"
INCLUDES_SQL = f"WITH {COMM}, w AS (SELECT code, list_concat({split_sql('[title]', '[,·\\(\\)]+', 2, 15)}, {split_sql(found_sql(profiles.EXAMPLES), '[,·\\s]+', 2, 15)}) AS l FROM comm) SELECT code, array_to_string(list_slice({firsts('l')}, 1, 15), '|') AS includes FROM w"
EXCLUDES_SQL = f"WITH {COMM}, w AS (SELECT code, list_filter({found_sql(profiles.REFERENCES)}, lambda c: c <> code) AS l FROM comm) SELECT code, array_to_string(list_slice({firsts('l')}, 1, 5), '|') AS excludes FROM w"


def attributes_sql() -> str:
    one = lambda p: f"list_filter(list_transform(regexp_extract_all(content, '{p}', 1), lambda v: trim(v)), lambda v: length(v) <= 10)"
    cols = ", ".join(f"{one(p)} AS l{i}" for i, p in enumerate(profiles.ATTRIBUTES.values()))
    text = ", ".join(f"CASE WHEN len(l{i}) > 0 THEN '{n}=' || array_to_string(list_slice({firsts(f'l{i}')}, 1, 5), '/') END" for i, n in enumerate(profiles.ATTRIBUTES))
    return f"WITH {COMM}, w AS (SELECT code, {cols} FROM comm) SELECT code, concat_ws('|', {text}) AS attributes FROM w"


def chunk_rows(s, d):
    return extract.chunks(commentary(s, d)).select("code", "position", "chunk_type", "target_code", "strength")


HARD_SQL = "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in extract.HARD) + ")"
CHUNKS_SQL = f"""WITH {COMM}, l AS (SELECT code, list_filter(list_transform(string_split_regex(content, '[.。]\\s*'), lambda x: trim(x)), lambda x: length(x) >= 10) AS l FROM comm),
c AS (SELECT code, unnest(l) AS text, unnest(range(len(l))) AS position FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(text, '이 호에는?.+분류') THEN 'definition' WHEN regexp_matches(text, '제외|제(\\d{{4}})호[로에]|다만|그러나') THEN 'exclude_rule' WHEN regexp_matches(text, '포함|해당|분류[된하]') THEN 'include_rule'
  WHEN regexp_matches(text, '예[:\\s]|예를 들') THEN 'example' WHEN regexp_matches(text, '주의|유의|참고|단,') THEN 'note' ELSE 'general' END AS chunk_type FROM c)
SELECT code, CAST(position AS INT) AS position, chunk_type, CASE WHEN chunk_type = 'exclude_rule' AND regexp_extract(text, '제?(\\d{{4}})호', 1) NOT IN ('', code) THEN regexp_extract(text, '제?(\\d{{4}})호', 1) END AS target_code,
  CASE WHEN chunk_type = 'exclude_rule' AND {HARD_SQL} THEN 'hard' ELSE 'soft' END AS strength FROM k WHERE chunk_type <> 'general'"""

APPLIED_SQL = "list_concat(" + "list_concat(".join(f"regexp_extract_all(content, '(?i){p}', 1), " for p in extract.APPLIED) + "[]" + ")" * len(extract.APPLIED)
REJECTED_SQL = "list_concat(" + ", ".join(f"list_transform(list_zip(regexp_extract_all(content, '{p}', 1), regexp_extract_all(content, '{p}', 2)), lambda z: z[1] || coalesce(z[2], ''))" for p in extract.REJECTED) + ")"
DECISIVE_SQL = "list_slice(list_transform(list_filter(list_transform(string_split_regex(content, '[.\\n;]'), lambda x: trim(x)), lambda x: length(x) >= 10 AND regexp_matches(x, '(?:분류|해당|적용|결정)[하됨]')), lambda x: left(x, 300)), 1, 3)"
KEYWORDS_SQL = """list_filter(list_concat(list_transform(regexp_extract_all(content, '["'']([^"'']{2,30})["'']', 1), lambda x: trim(x)), regexp_extract_all(content, '([가-힣]{2,15})\\s*(?:의\\s*것|으로\\s*한\\s*것|이?나\\s*것)', 1), list_transform(regexp_extract_all(content, '제(\\d{4})호', 1), lambda h: '제' || h || '호')), lambda k: length(k) BETWEEN 2 AND 30)"""


def signals_sql() -> str:
    cols, outs = [], []
    for name, (words, patterns) in extract.SIGNALS.items():
        kws = ", ".join(f"'{w}'" for w in sorted({w.replace("-", " ").strip() for w in words if len(w) >= 2}))
        pats = " + ".join(f"CAST(regexp_matches(lower(text), '(?i){p}') AS INT)" for p in patterns)
        cols.append(f"len(list_filter([{kws}], lambda k: contains(norm, k))) + {pats} AS {name}_n")
        outs.append(f"CAST({name}_n AS INT) AS {name}_n, round(least(1, 0.3 * {name}_n), 6) AS {name}_confidence")
    parts = ", ".join(f"'{w}'" for w in extract.PARTS)
    return f"WITH n AS (SELECT doc_id, text, {norm_sql('text')} AS norm FROM documents), c AS (SELECT doc_id, {', '.join(cols)}, len(list_filter([{parts}], lambda k: contains(norm, k))) AS parts_n FROM n) SELECT doc_id, {', '.join(outs)}, CAST(parts_n AS INT) AS parts_n, round(least(1, 0.4 * parts_n), 6) AS parts_confidence FROM c"


HTML_SQL = r"""WITH b AS (SELECT page_id, list_filter(list_transform(string_split_regex(html, '(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|td|table|br|section|article|body|head|title|header|footer|nav)[^>]*>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) > 0) AS l FROM pages)
SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS line_no, unnest(l) AS text FROM b"""


def term_counts(s, d):
    rows = docs(s, d).select("doc_id", F.substring_index("text", "\n", 1).alias("name"), F.col("text").alias("description"))
    return extract.case_terms(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


TERMS_SQL = r"""SELECT doc_id, len(list_filter(list_transform(string_split_regex(string_split(text, chr(10))[1], '[;,]'), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 50)) + len(list_filter(list_transform(regexp_extract_all(text, '\(([^)]+)\)', 1), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 30)) AS n FROM documents"""
TERMS_SQL = f"SELECT * FROM ({TERMS_SQL}) WHERE n > 0"


def answers(s, d):
    """Event properties as answers of a model: as they are, in a fence, or in a sentence."""
    e = table(s, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("It is "), "props", F.lit(" I think")))
    return e.select("event_id", extract.parsed_answer(text, "k long")["k"].alias("k"))


def subcode_table(s, d):
    it = items(s, d)
    out = extract.subcodes(it.select(F.col("subcode").alias("code"), F.col("p_name").alias("name"), F.col("item_id").alias("position")), it.filter("p_size > 20").select(F.col("subcode").alias("code")))
    return out.select("subcode", "code", "title", joined(F.col("keywords")).alias("keywords"), "case_count")


# ---- attribute axes ----

#: A small lexicon over the words of part names and types.
LEXICON = [
    ("object_nature", "machine", "gear"), ("object_nature", "machine", "widget"), ("object_nature", "product", "gizmo"), ("object_nature", "substance", "anvil"),
    ("material", "ferrous", "red"), ("material", "alloy", "blue"), ("processing_state", "fresh", "new"), ("processing_state", "processed", "old"), ("processing_state", "frozen", "cold"),
    ("processing_state", "cooked", "hot"), ("function_use", "trade", "economy"), ("function_use", "sale", "promo"), ("physical_form", "flat", "plate"), ("physical_form", "round", "ring"),
    ("physical_form", "round", "rod"), ("completeness", "parts", "bolt"), ("completeness", "set", "ring"), ("completeness", "complete", "gizmo"), ("legal_scope", "usual", "standard"),
]
QUESTIONS = [(a, f"Which {a}?") for a in axes.PRIORITY]
LEX = "lex(axis, category, keyword) AS (VALUES " + ", ".join(map(str, LEXICON)) + ")"
AXES = PREP + f""", {LEX},
ia0 AS (SELECT item_id, axis, list_sort(list(DISTINCT category)) AS vals, count(*) AS n FROM prep JOIN lex ON contains(norm, keyword) GROUP BY item_id, axis),
ia AS (SELECT *, round(least(1, 0.3 * n + 0.2), 6) AS confidence FROM ia0),
ck AS (SELECT DISTINCT code, unnest(string_split(lower(p_name), ' ')) AS keyword FROM items WHERE item_id % 2 = 0),
ca AS (SELECT code, axis, list_sort(list(DISTINCT category)) AS vals FROM ck JOIN lex ON contains(ck.keyword, lex.keyword) GROUP BY code, axis),
cd0 AS (SELECT a.item_id, b.code, min(b.item_id - a.item_id) AS k FROM items a JOIN items b ON b.item_id BETWEEN a.item_id AND a.item_id + 3 GROUP BY a.item_id, b.code),
cd AS (SELECT item_id, code, row_number() OVER (PARTITION BY item_id ORDER BY k) AS rank FROM cd0)"""


def lexicon(s):
    return s.createDataFrame(LEXICON, "axis string, category string, keyword string")


def question_table(s):
    return s.createDataFrame(QUESTIONS, "axis string, question string")


def item_axes(s, d):
    return extract.lexicon_tags(tokens_of(s, d), lexicon(s))


def code_axes(s, d):
    return axes.code_index(cards(s, d), lexicon(s))


def neighbours(s, d):
    """Candidates of an item: the codes of itself and of the next three parts, in that order."""
    it = spread(items(s, d), "item_id")
    near = it.select("code", F.posexplode(F.sequence(F.col("item_id") - 3, F.col("item_id"))).alias("_p", "item_id")).withColumn("k", 3 - F.col("_p"))
    near = near.join(it.select("item_id").hint("merge"), "item_id", "left_semi").groupBy("item_id", "code").agg(F.min("k").alias("k"))
    return near.select("item_id", "code", F.row_number().over(W.partitionBy("item_id").orderBy("k")).alias("rank"))


def sizes(s, d):
    """Quantities of items: a size where it is above 10."""
    return items(s, d).filter("p_size > 10").select("item_id", F.lit("size").alias("property"), F.col("p_size").cast("double").alias("quantity"))


def quantity_arrays(s, d):
    return sizes(s, d).groupBy("item_id").agg(F.collect_list("quantity").alias("quantities"))


def size_rules(s, d):
    """A quantity rule for each code: sizes above 40 are excluded (hard in even chapters); weights for codes of type 3."""
    codes = items(s, d).select("code").distinct()
    chapter = F.substring("code", 1, 2).cast("int")
    return codes.select("code", F.when(F.substring("code", 4, 1) == "3", "weight").otherwise("size").alias("property"), F.lit(">").alias("op"), F.lit(40.0).alias("value"), F.lit("exclude").alias("polarity"), F.when(chapter % 2 == 0, "hard").otherwise("soft").alias("strength"))


def attribute_rows(s, d):
    return axes.flags(axes.attributes(items(s, d), item_axes(s, d), quantity_arrays(s, d)))


AXIS_NAMES = [a for a in axes.PRIORITY if a != "quantitative_rules"]
ATTR = AXES + ", att AS (SELECT items.item_id, " + ", ".join(f"coalesce(max(CASE WHEN axis = '{a}' THEN vals END), []) AS {a}" for a in AXIS_NAMES) + ", any_value(p_size) > 10 AS has_quant FROM items LEFT JOIN ia ON ia.item_id = items.item_id GROUP BY items.item_id)"
AXIS_SCORE = ATTR + """, jac AS (SELECT cd.item_id, cd.code, ia.axis, round(least(len(list_intersect(ia.vals, ca.vals)) / len(list_distinct(list_concat(ia.vals, ca.vals))) * confidence, 1), 6) AS score FROM cd JOIN ia ON cd.item_id = ia.item_id JOIN ca ON ca.code = cd.code AND ca.axis = ia.axis),
cpen AS (SELECT cd.item_id, cd.code, round(least(CASE WHEN list_contains(ic.vals, 'complete') AND list_contains(kc.vals, 'parts') THEN 0.3 ELSE 0 END + CASE WHEN list_contains(ic.vals, 'parts') AND list_contains(kc.vals, 'complete') THEN 0.2 ELSE 0 END
  + CASE WHEN list_has_any(ip.vals, ['fresh', 'raw']) AND list_has_any(kp.vals, ['cooked', 'processed', 'refined', 'assembled']) THEN 0.2 ELSE 0 END + CASE WHEN list_has_any(ip.vals, ['cooked', 'processed', 'refined', 'assembled']) AND list_has_any(kp.vals, ['fresh', 'raw']) THEN 0.2 ELSE 0 END, 1), 6) AS f_conflict_penalty
  FROM cd LEFT JOIN ia ic ON ic.item_id = cd.item_id AND ic.axis = 'completeness' LEFT JOIN ia ip ON ip.item_id = cd.item_id AND ip.axis = 'processing_state'
  LEFT JOIN ca kc ON kc.code = cd.code AND kc.axis = 'completeness' LEFT JOIN ca kp ON kp.code = cd.code AND kp.axis = 'processing_state'),
ov AS (SELECT cd.item_id, cd.code, count(v) AS n FROM cd LEFT JOIN (SELECT i.item_id, c.code, unnest(list_intersect(i.vals, c.vals)) AS v FROM ia i JOIN ca c ON i.axis = c.axis) m ON m.item_id = cd.item_id AND m.code = cd.code GROUP BY cd.item_id, cd.code)"""


def overlaps(s, d, names=("processing_state", "material", "function_use", "physical_form")):
    long = lambda df, key: df.select(key, "axis", F.explode("values").alias("value"))
    return attributes.overlap_counts(neighbours(s, d), long(item_axes(s, d), "item_id"), long(code_axes(s, d), "code"), names)


def boosts(s, d):
    cand, ia, ca = neighbours(s, d), item_axes(s, d), code_axes(s, d)
    met = cand.join(ia.select("item_id", "axis", "values"), "item_id").join(ca.select("code", "axis", F.col("values").alias("other")), ["code", "axis"])
    matches = met.groupBy("item_id", "code").agg(F.sum(F.size(F.array_intersect("values", "other"))).alias("n"))
    sums = gate.axis_scores(cand, ia, ca).groupBy("item_id", "code").agg(F.sum("score").alias("axis_score"))
    return axes.boosted(cand.withColumn("score", (10 - F.col("rank")) * 1.0000123), matches, sums, attributes.conflict_penalty(cand, ia, ca), axes.attributes(items(s, d), ia, quantity_arrays(s, d)))


BOOST_SQL = " * ".join(f"CASE WHEN list_has_any({a}, {v}) AND left(cd.code, 2) IN ({', '.join(map(repr, c))}) THEN {by} ELSE 1 END" for a, v, c, by in axes.BOOSTS)


def axis_clashes(s, d):
    codes = size_rules(s, d).filter("property = 'size'").select("code")
    return axes.conflicts(neighbours(s, d), code_axes(s, d), attribute_rows(s, d), codes)


CLASH = ATTR + """, mt AS (SELECT cd.item_id, cd.code, axis, unnest(vals) AS v FROM cd JOIN ca ON ca.code = cd.code WHERE rank <= 5), tw AS (SELECT item_id FROM mt GROUP BY item_id HAVING count(DISTINCT code) > 1),
cf AS (SELECT item_id, axis, CASE WHEN count(DISTINCT v) > 1 THEN count(DISTINCT v) ELSE 0 END + CASE WHEN axis = 'completeness' AND bool_or(v = 'parts') AND bool_or(v = 'complete') THEN 3 ELSE 0 END AS score FROM mt WHERE item_id IN (SELECT item_id FROM tw) GROUP BY item_id, axis
  UNION ALL SELECT cd.item_id, 'quantitative_rules', count(*) FROM cd JOIN att ON att.item_id = cd.item_id WHERE NOT has_quant AND rank <= 5 AND substr(cd.code, 4, 1) <> '3' AND cd.item_id IN (SELECT item_id FROM tw) GROUP BY cd.item_id),
cg AS (SELECT item_id, axis, CAST(score AS DOUBLE) AS score FROM cf WHERE score > 0), pr(axis, priority) AS (VALUES """ + ", ".join(map(str, axes.PRIORITY.items())) + ")"


def fact_table(s, d):
    """A fact for each value of a code's axes: hard where it is about completeness."""
    rows = code_axes(s, d).select("code", "axis", F.explode("values").alias("value"))
    return rows.select("code", "axis", F.when(F.col("axis") == "material", "contains").when(F.col("axis") == "physical_form", "not_contains").otherwise("eq").alias("operator"), "value", F.when(F.col("axis").isin("completeness", "physical_form"), "hard").otherwise("soft").alias("hardness"))


FACTS = AXES + """, fc AS (SELECT code, axis, unnest(vals) AS value FROM ca),
fo AS (SELECT cd.item_id, cd.code, fc.axis, fc.value, coalesce(ia.vals, []) AS vals, CASE fc.axis WHEN 'physical_form' THEN NOT coalesce(list_bool_or(list_transform(ia.vals, lambda v: contains(v, fc.value))), FALSE) WHEN 'material' THEN coalesce(list_bool_or(list_transform(ia.vals, lambda v: contains(v, fc.value))), FALSE) ELSE list_contains(coalesce(ia.vals, []), fc.value) END AS ok,
  fc.axis = 'completeness' OR (fc.axis = 'physical_form' AND coalesce(confidence, 0) >= 0.3) AS hard FROM cd JOIN fc ON fc.code = cd.code LEFT JOIN ia ON ia.item_id = cd.item_id AND ia.axis = fc.axis),
fk AS (SELECT item_id, code, sum(CAST(ok AS INT)) AS satisfied, sum(CAST(NOT ok AND hard AS INT)) AS missing_hard, sum(CAST(NOT ok AND NOT hard AS INT)) AS missing_soft FROM fo GROUP BY item_id, code)"""


def checks(s, d):
    return gate.fact_check(neighbours(s, d), fact_table(s, d), item_axes(s, d))


# ---- composed scorers ----


def kb_only(s, d):
    x = note_profiles(s, d)
    return x.of_items(scorers.kb_only(kb_of(x, s, d), gate_of(x, s, d)))


def hybrid(s, d):
    return with_model(s, d, ml_items(s, d))


def with_model(s, d, ml):
    """The hybrid scorer with the codes of a model."""
    x = note_profiles(s, d)
    by_card, by_rule = match.card_scores(x.items, cards(s, d), x.found), match.rule_scores(x.items, rules(s, d), x.found)
    return scorers.hybrid_over_profiles(x, ml, kb_of(x, s, d), gate_of(x, s, d), by_card, by_rule, items(s, d).filter("item_id % 3 = 0"))


HYBRID = FEATURES + GATE[len(KB):].replace("cand AS", "gcand AS").replace("FROM cand c", "FROM gcand c")
KB_ONLY = GATE + ", ko AS (SELECT gs.item_id, gs.code, kb.score FROM gs JOIN kb ON kb.item_id = gs.item_id AND kb.code = gs.code WHERE passed UNION ALL SELECT DISTINCT item_id, redirect_to, 0.5 FROM gs g WHERE redirect_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gs h WHERE h.item_id = g.item_id AND h.code = g.redirect_to))"


def best(name: str, k: int) -> str:
    return f"SELECT item_id, code, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, code) AS INT) AS rank FROM {name} QUALIFY rank <= {k}"


def with_first(s, d):
    p = predictions(s, d)
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    return p.groupBy("item_id").agg(at(1).alias("p1"), at(2).alias("p2"))


FIRST2 = PRED + ", p AS (SELECT item_id, max(CASE WHEN rank = 1 THEN score END) AS p1, max(CASE WHEN rank = 2 THEN score END) AS p2 FROM pred GROUP BY item_id)"


def post(s, d):
    rows = with_first(s, d).select("item_id", F.col("p1").alias("answer_raw"), (F.col("p2") / 2).alias("best_rrf"), (F.col("item_id") % 2 == 0).alias("has_signals"), (F.col("item_id") % 7 == 0).alias("is_fallback"))
    out = scorers.post_processed(predictions(s, d).select("item_id", "code", "rank"), passed(s, d), rows)
    return out.select("item_id", "best", joined(F.col("codes")).alias("codes"), "confidence")


CALIBRATED = "CASE WHEN item_id % 7 = 0 THEN least((CASE WHEN item_id % 2 = 0 THEN least(raw, 0.9) ELSE raw END) * 0.8, 0.5) ELSE (CASE WHEN item_id % 2 = 0 THEN least(raw, 0.9) ELSE raw END) END"
POST = PASSED + f""", p AS (SELECT item_id, max(CASE WHEN rank = 1 THEN score END) AS p1, max(CASE WHEN rank = 2 THEN score END) AS p2 FROM pred GROUP BY item_id),
po AS (SELECT ps.item_id, list(code ORDER BY NOT passed, rank) AS codes, bool_or(passed) AS anyone, any_value(p1) AS p1, any_value(p2) AS p2 FROM ps JOIN p ON p.item_id = ps.item_id GROUP BY ps.item_id),
pq AS (SELECT *, 0.5 * p1 + 0.3 * least(1.5 * p2, 1) + 0.2 * CASE WHEN anyone THEN 1 ELSE 0.3 END AS raw FROM po)
SELECT item_id, codes[1] AS best, array_to_string(codes, '|') AS codes, round(greatest(least({CALIBRATED}, 1), 0), 6) AS confidence FROM pq"""


def conflicting_cases(s, d):
    it = tokens_of(s, d).join(items(s, d).select("item_id", "code").hint("merge"), "item_id")
    cases = items(s, d).filter("p_size > 45").select(F.col("item_id").alias("case_id"), "code", F.slice(F.split("p_name", " "), 2, 1).alias("materials"))
    return profiles.case_conflicts(it, cases)


def more_items(s, d):
    return profiles.augmented(items(s, d).select("item_id", "text", "code"), alias_table(s, d).select("term", "alias")).select("item_id", "number", "text")


def note_pairs(s, d):
    notes = note_table(s, d).select("chapter_num", F.when(F.col("chapter_num") % 2 == 0, F.concat("note_content", F.lit(" 한정"))).otherwise(F.col("note_content")).alias("note_content"), "keywords")
    it = tokens_of(s, d).join(items(s, d).select("item_id", F.pmod(F.substring("code", 1, 2).cast("int") + F.col("item_id") % 3, F.lit(26)).alias("chapter_num")), "item_id")
    return profiles.insufficient(it.join(notes, "chapter_num")).select("item_id", "insufficient")


NOTES = PREP + """, occ AS (SELECT item_id, unnest(string_split(lower(p_name), ' ')) AS term, code FROM items),
nw AS (SELECT CAST(left(code, 2) AS INT) AS chapter, term AS word, count(*) AS score FROM occ GROUP BY 1, 2), nr AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY score DESC, word) AS r FROM nw),
note AS (SELECT chapter, list(word ORDER BY r) AS kws FROM nr WHERE r <= 3 GROUP BY chapter)"""


def overlay(s, d):
    """Cases of commentaries; a second extraction for those of chapters divisible by 3."""
    c = commentary(s, d).select(F.col("code").alias("case_id"), F.lit(None).cast("string").alias("decision_code"), "code", F.col("content").alias("rationale"), F.array().cast("array<string>").alias("materials"))
    cases = extract.normalized_cases(c.withColumn("heading", F.lit(None).cast("string")).withColumn("rationale", F.when(F.col("code").endswith("1"), F.lit("")).otherwise(F.col("rationale"))))
    second = c.filter(F.substring("code", 1, 2).cast("int") % 3 == 0).select("case_id", F.array(F.lit("GRI1")).alias("applied_rules"), F.array(F.lit("010101")).alias("rejected_codes"), F.array(F.lit("second")).alias("decisive_reasoning"))
    out = profiles.overlaid(cases, second)
    return out.select("case_id", joined("applied_rules").alias("applied_rules"), F.size("rejected_codes").alias("rejected"), F.size("decisive_reasoning").alias("reasons"), "confidence", "source")


OVERLAY = COMM + f""", cc AS (SELECT code AS case_id, CASE WHEN ends_with(code, '1') THEN '' ELSE content END AS content FROM comm),
ce AS (SELECT case_id, {APPLIED_SQL} AS a0, {REJECTED_SQL} AS r0, {DECISIVE_SQL} AS e0 FROM cc),
cx AS (SELECT case_id, list_transform({firsts('a0')}, lambda n: 'GRI' || n) AS a, len(list_distinct(r0)) AS r, len(e0) AS e FROM ce),
cy AS (SELECT *, round(CASE WHEN len(a) > 0 THEN 0.2 ELSE 0 END + CASE WHEN e > 0 THEN 0.2 ELSE 0 END + CASE WHEN r > 0 THEN 0.1 ELSE 0 END, 2) AS conf FROM cx),
cz AS (SELECT *, conf < 0.5 AND CAST(left(case_id, 2) AS INT) % 3 = 0 AS used FROM cy)
SELECT case_id, CASE WHEN used AND len(a) = 0 THEN 'GRI1' ELSE array_to_string(a, '|') END AS applied_rules, CAST(CASE WHEN used AND r = 0 THEN 1 ELSE r END AS INT) AS rejected, CAST(CASE WHEN used AND e = 0 THEN 1 ELSE e END AS INT) AS reasons,
  CASE WHEN used THEN round(least(1, conf + 0.2), 6) ELSE conf END AS confidence, CASE WHEN used THEN 'hybrid' ELSE 'rules' END AS source FROM cz"""

def normal_cases(s, d):
    """Commentaries as cases: a six-digit decision code for those of even types, no materials."""
    c = commentary(s, d)
    six = F.substring("code", 4, 1).cast("int") % 2 == 0
    rows = c.select(F.col("code").alias("case_id"), F.when(six, F.concat("code", F.lit(".10"))).otherwise(F.concat(F.lit("제"), "code", F.lit("호"))).alias("decision_code"), F.lit(None).cast("string").alias("heading"), F.col("content").alias("rationale"), F.array().cast("array<string>").alias("materials"))
    return extract.normalized_cases(rows)


CASES = COMM + f""", ce AS (SELECT code AS case_id, CASE WHEN CAST(substr(code, 4, 1) AS INT) % 2 = 0 THEN code || '10' ELSE '' END AS code6, len(list_distinct({APPLIED_SQL})) AS a, len(list_distinct({REJECTED_SQL})) AS r, len({DECISIVE_SQL}) AS e FROM comm),
cs AS (SELECT *, round(CASE WHEN code6 <> '' THEN 0.3 ELSE 0.2 END + CASE WHEN a > 0 THEN 0.2 ELSE 0 END + CASE WHEN e > 0 THEN 0.2 ELSE 0 END + CASE WHEN r > 0 THEN 0.1 ELSE 0 END, 2) AS confidence FROM ce)"""


def step_flags(s, d):
    """Step 2 on computed axes: parts and mixtures by the item's own values."""
    attrs = attribute_rows(s, d).select("item_id", F.col("is_parts").alias("incomplete"), F.array_contains("material", "alloy").alias("mixture"))
    one = lambda df, key: df.filter("axis = 'material'").select(key, F.explode("values").alias("material"))
    parts = code_axes(s, d).filter("axis = 'completeness' and array_contains(values, 'parts')").select("code")
    return steps.flagged(neighbours(s, d), attrs, parts, one(code_axes(s, d), "code"), one(item_axes(s, d), "item_id")).select("item_id", "code", "parts_penalty", "material_match")


def mode_rows(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("mode"), (F.col("value") > 50).alias("retriever_used"), (F.col("event_id") % 7 == 0).alias("ranker_used"), (F.col("event_id") % 3).alias("score_ml"))


def question_lists(s, d):
    it = items(s, d)
    first = it.filter("p_size % 2 = 0").select("item_id", F.array(F.lit("a"), F.col("p_type")).alias("questions"))
    second = it.filter("p_size % 3 = 0").select("item_id", F.array(F.lit("b"), F.lit("a"), F.lit("c")).alias("questions"))
    third = it.filter("p_size % 5 = 0").select("item_id", F.array().cast("array<string>").alias("questions"))
    return steps.questions([first, second, third], ["f", "g"]).select("item_id", joined("questions").alias("questions"))


def explained(s, d):
    p = predictions(s, d).filter("rank <= 3")
    rows = p.select("item_id", "code", (F.col("score") + 0.0000037).alias("score"), F.col("rank").alias("supporting"), (3 - F.col("rank")).alias("conflicting"), F.array(F.concat(F.lit("rule:"), "code"), F.repeat("code", 60)).alias("top"))
    return attributes.explanation_text(rows).select("item_id", "code", "explanation")


def chunk_signals(s, d):
    return extract.chunks(commentary(s, d)).select("code", "position", joined("signals").alias("signals"))


STOP_KO = ", ".join(f"'{w}'" for w in t.STOPWORDS_KO)
SIGNALS_SQL = CHUNKS_SQL[: CHUNKS_SQL.index("SELECT code, CAST(position")] + f""", w AS (SELECT code, position, list_filter(regexp_extract_all(text, '[가-힣]{{2,10}}'), lambda w: w NOT IN ({STOP_KO})) AS w FROM k WHERE chunk_type <> 'general'),
u AS (SELECT code, position, unnest(w) AS x, unnest(range(len(w))) AS i FROM w), g AS (SELECT code, position, x, row_number() OVER (PARTITION BY code, position ORDER BY count(*) DESC, min(i)) AS r FROM u GROUP BY code, position, x)
SELECT w.code, CAST(w.position AS INT) AS position, coalesce(string_agg(x, '|' ORDER BY r), '') AS signals FROM w LEFT JOIN g ON g.code = w.code AND g.position = w.position AND r <= 5 GROUP BY w.code, w.position"""

QUERIES = {
    "p14_mode_separation": (lambda s, d: diagnostics.mode_separation(mode_rows(s, d)), "SELECT event_type AS mode, count(*) AS n, sum(CAST(value > 50 AS INT)) AS retriever, sum(CAST(event_id % 7 = 0 AS INT)) AS ranker, sum(CAST(event_id % 3 > 0 AS INT)) AS ml, event_type <> 'kb_only' AS valid FROM events GROUP BY event_type"),
    "x13_chunk_signals": (chunk_signals, SIGNALS_SQL),
    "x26_cases": (lambda s, d: normal_cases(s, d).select("case_id", "code4", "code6", "code10", F.size("applied_rules").alias("a"), F.size("rejected_codes").alias("r"), F.size("decisive_reasoning").alias("e"), "confidence"), f"WITH {CASES} SELECT case_id, case_id AS code4, code6, '' AS code10, a, r, e, confidence FROM cs"),
    "a39_case_comparison": (lambda s, d: diagnostics.case_comparison(normal_cases(s, d).withColumn("mode", F.when(F.col("code6") != "", "six").otherwise("four"))), f"WITH {CASES} SELECT CASE WHEN code6 <> '' THEN 'six' ELSE 'four' END AS mode, count(*) AS n, round(avg(CAST(a > 0 AS INT)), 6) AS rules, 0.0 AS code10, round(avg(CAST(code6 <> '' AS INT)), 6) AS code6, round(avg(CAST(r > 0 AS INT)), 6) AS rejected, round(avg(CAST(e > 0 AS INT)), 6) AS decisive, round(avg(confidence), 6) AS confidence FROM cs GROUP BY 1"),
    "g19_step2": (step_flags, f"WITH {ATTR} SELECT cd.item_id, cd.code, list_contains(completeness, 'parts') AND coalesce(list_contains(kc.vals, 'parts'), FALSE) AS parts_penalty, list_contains(material, 'alloy') AND coalesce(list_has_any(material, km.vals), FALSE) AS material_match FROM cd JOIN att ON att.item_id = cd.item_id LEFT JOIN ca kc ON kc.code = cd.code AND kc.axis = 'completeness' LEFT JOIN ca km ON km.code = cd.code AND km.axis = 'material'"),
    "c7_questions": (question_lists, f"WITH {ITEMS}, q AS (SELECT item_id, list_concat(CASE WHEN p_size % 2 = 0 THEN ['a', p_type] ELSE [] END, CASE WHEN p_size % 3 = 0 THEN ['b', 'a', 'c'] ELSE [] END) AS q FROM items WHERE p_size % 2 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0) SELECT item_id, array_to_string(CASE WHEN len(q) = 0 THEN ['f', 'g'] ELSE list_slice({firsts('q')}, 1, 3) END, '|') AS questions FROM q"),
    "c11_explanation": (explained, f"WITH {PRED} SELECT item_id, code, 'Code ' || code || ' (score ' || printf('%.3f', score + 0.0000037) || ')' || chr(10) || 'Support ' || rank || ', conflict ' || (3 - rank) || chr(10) || '- rule:' || code || chr(10) || '- ' || left(repeat(code, 60), 200) || '...' AS explanation FROM pred WHERE rank <= 3"),
    "t6_contains": (lambda s, d: items(s, d).select("item_id", t.contains(F.col("text"), F.lit("Gear (x)")).alias("hit")), f"WITH {PREP} SELECT item_id, contains(norm, 'gear') AS hit FROM prep"),
    "t7_overlap": (lambda s, d: items(s, d).select("item_id", F.size(t.overlap(F.col("text"), F.array(F.lit("small gear"), F.lit("Ring")))).alias("n")), f"WITH {PREP} SELECT item_id, CAST(len(list_intersect(list_distinct(tokens), ['small', 'gear', 'ring'])) AS INT) AS n FROM prep"),
    "t8_match_method": (lambda s, d: items(s, d).select("item_id", t.match_method(F.col("text"), F.lit("red gear")).alias("method")), f"WITH {PREP} SELECT item_id, CASE WHEN contains(norm, 'red gear') THEN 'substring' WHEN list_has_any(tokens, ['red', 'gear']) THEN 'token' END AS method FROM prep"),
    "t9_term_key": (lambda s, d: docs(s, d).select("doc_id", t.term_key(F.col("text")).alias("key")), r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM documents"),
    "t10_bm25_tokens": (lambda s, d: items(s, d).select("item_id", F.array_join(t.bm25_tokens(F.col("text")), "|").alias("tokens")), f"WITH {ITEMS}, w AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM items) SELECT item_id, array_to_string(list_concat(w, flatten(list_transform(w, lambda x: list_concat(list_transform(range(1, greatest(length(x), 1)), lambda i: substr(x, i, 2)), list_transform(range(1, greatest(length(x) - 1, 1)), lambda i: substr(x, i, 3)))))), '|') AS tokens FROM w"),
    "t11_padded_grams": (lambda s, d: items(s, d).select("item_id", F.array_join(t.padded_grams(F.col("text")), "|").alias("grams")), f"WITH {ITEMS}, w AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM items) SELECT item_id, array_to_string(flatten(list_transform(w, lambda x: list_concat(list_transform(range(1, length(x) + 3), lambda i: substr(' ' || x || ' ', i, 1)), list_transform(range(1, length(x) + 2), lambda i: substr(' ' || x || ' ', i, 2))))), '|') AS grams FROM w"),
    "t14_sentences": (lambda s, d: docs(s, d).select("doc_id", F.size(t.sentences(F.col("text"), r"[.\n;]")).alias("n"), F.get(t.sentences(F.col("text"), r"[.\n;]"), F.lit(0)).alias("first")), r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.\n;]'), lambda x: trim(x)), lambda x: length(x) >= 10) AS l FROM documents) SELECT doc_id, CAST(len(l) AS INT) AS n, l[1] AS first FROM l"),
    "t15_numbers": (lambda s, d: items(s, d).select("item_id", t.chapter_number(F.concat(F.lit("제 "), F.substring("code", 1, 2), F.lit("류 주"))).alias("chapter"), t.section_number(F.concat(F.lit("제"), F.col("p_size").cast("string"), F.lit(" 부"))).alias("section"), t.roman(F.element_at(F.array(*map(F.lit, t.ROMAN)), (F.col("item_id") % 22 + 1).cast("int"))).alias("roman")), f"WITH {ITEMS} SELECT item_id, CAST(left(code, 2) AS INT) AS chapter, CAST(p_size AS INT) AS section, CAST(item_id % 22 + 1 AS INT) AS roman FROM items"),
    "p1_text": (lambda s, d: table(s, d, "part").select("p_partkey", profiles.built_text(F.col("p_name"), F.when(F.col("p_size") > 20, F.col("p_type"))).alias("text")), "SELECT p_partkey, CASE WHEN p_size > 20 THEN p_name || ' ' || p_type ELSE p_name END AS text FROM part"),
    "p2_enriched": (lambda s, d: items(s, d).select("item_id", t.enriched(F.col("p_name"), F.array(F.struct(F.lower("p_type").alias("name"), F.when(F.col("p_size") > 10, F.col("p_size") / 100).alias("ratio"), F.lit("%").alias("unit"))), F.when(F.col("p_size") > 25, F.lit("공구")), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("text")), f"WITH {ITEMS} SELECT item_id, concat_ws(' | ', p_name, '재질: ' || lower(p_type) || CASE WHEN p_size > 10 THEN ' ' || CAST(p_size AS VARCHAR) || '%' ELSE '' END, CASE WHEN p_size > 25 THEN '용도: 공구' END, CASE WHEN p_size % 2 = 0 THEN '세트물품' END, CASE WHEN p_size % 3 = 0 THEN '전기식' END) AS text FROM items"),
    "p3_projection": (lambda s, d: scorers.projected(predictions(s, d).select("item_id", "code", (F.col("score") + 0.0000037).alias("score"), ((F.col("score") + 0.0000007) / 3).alias("confidence"), F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.repeat("code", 50)).alias("evidence"), F.repeat("code", 80).alias("reasoning"))).withColumn("evidence", joined("evidence")), f"WITH {PRED} SELECT item_id, code, round(score + 0.0000037, 4) AS score, round((score + 0.0000007) / 3, 3) AS confidence, array_to_string(list_transform(range(5), lambda i: left(repeat(code, 50), 160)), '|') AS evidence, left(repeat(code, 80), 300) AS reasoning FROM pred"),
    "p5_quantity": (lambda s, d: table(s, d, "part").select("p_partkey", t.quantity_holds(F.col("p_size"), F.element_at(F.array(*map(F.lit, [">=", "<=", ">", "<", "=", "?"])), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit(25.0)).alias("holds")), "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size >= 25 WHEN 1 THEN p_size <= 25 WHEN 2 THEN p_size > 25 WHEN 3 THEN p_size < 25 WHEN 4 THEN p_size = 25 ELSE FALSE END AS holds FROM part"),
    "p7_low_confidence": (lambda s, d: with_first(s, d).select("item_id", scorers.low_confidence(F.col("p1"), F.col("p2")).alias("low")), f"WITH {FIRST2} SELECT item_id, p1 < 0.5 OR p1 - p2 < 0.15 AS low FROM p"),
    "p10_answer_status": (lambda s, d: with_first(s, d).select("item_id", scorers.answer_status(F.col("item_id") % 5 == 0, F.col("p1")).alias("status")), f"WITH {FIRST2} SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'ASK' WHEN p1 >= 0.7 THEN 'AUTO' WHEN p1 >= 0.4 THEN 'REVIEW' ELSE 'ABSTAIN' END AS status FROM p"),
    "p11_hybrid_decision": (lambda s, d: scorers.hybrid_decision(predictions(s, d)), f"WITH {FIRST2}, c AS (SELECT item_id, least(p1, 0.5 + p1 - p2, 1) AS c FROM p) SELECT item_id, round(c, 6) AS confidence, CASE WHEN c < 0.3 THEN 'REVIEW' WHEN c < 0.5 THEN 'ASK' ELSE 'AUTO' END AS status FROM c"),
    "p16_policy": (lambda s, d: axes.policy(items(s, d), item_axes(s, d)).select("item_id", joined("hard_axes").alias("hard_axes"), "ask"), f"WITH {AXES} SELECT items.item_id, coalesce(string_agg(CASE WHEN confidence >= 0.8 THEN axis END, '|' ORDER BY axis), '') AS hard_axes, count(CASE WHEN axis IN ('material', 'processing_state', 'function_use', 'completeness') THEN 1 END) <= 1 AS ask FROM items LEFT JOIN ia ON ia.item_id = items.item_id GROUP BY items.item_id"),
    "p17_flags": (lambda s, d: attribute_rows(s, d).select("item_id", "is_parts", "is_set", "is_ckd_skd", "is_incomplete", "has_quant"), f"WITH {ATTR} SELECT item_id, list_contains(completeness, 'parts') AS is_parts, list_contains(completeness, 'set') AS is_set, FALSE AS is_ckd_skd, FALSE AS is_incomplete, has_quant FROM att"),
    "p18_flattened": (lambda s, d: items(s, d).select("item_id", joined(profiles.flattened(F.array(F.struct(F.when(F.col("p_size") > 30, F.col("p_name")).alias("reason"), F.lit(" ").alias("text"), F.col("p_type").alias("value"), F.lit(None).cast("string").alias("description")), F.struct(F.lit("").alias("reason"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("value"), F.when(F.col("p_size") < 20, F.col("code")).alias("description"))))).alias("parts")), f"WITH {ITEMS} SELECT item_id, concat_ws('|', CASE WHEN p_size > 30 THEN p_name ELSE p_type END, CASE WHEN p_size < 20 THEN code END) AS parts FROM items"),
    "x1_lexicon_tags": (lambda s, d: item_axes(s, d).select("item_id", "axis", joined("values").alias("vals"), "n", "confidence"), f"WITH {AXES} SELECT item_id, axis, array_to_string(vals, '|') AS vals, n, confidence FROM ia"),
    "x2_attributes": (lambda s, d: attribute_rows(s, d).select("item_id", *(joined(a).alias(a) for a in AXIS_NAMES), "has_quant"), f"WITH {ATTR} SELECT item_id, {', '.join(f'''array_to_string({a}, '|') AS {a}''' for a in AXIS_NAMES)}, has_quant FROM att"),
    "x4_signals": (lambda s, d: extract.signals(docs(s, d).select("doc_id", "text")).drop("text", *extract.SIGNALS), signals_sql()),
    "x7_scope": (over_comm("scope", lambda c: joined(profiles.scope_keywords(c))), SCOPE_SQL),
    "x8_includes": (over_comm("includes", lambda c: joined(profiles.includes(c, F.col("title")))), INCLUDES_SQL),
    "x9_excludes": (over_comm("excludes", lambda c: joined(F.transform(profiles.excludes(c, F.col("code")), lambda x: x["code"]))), EXCLUDES_SQL),
    "x10_attributes": (over_comm("attributes", lambda c: joined(F.transform(profiles.key_attributes(c), lambda x: F.concat(x["name"], F.lit("="), F.array_join(x["values"], "/"))))), attributes_sql()),
    "x11_cards": (lambda s, d: profiles.cards(commentary(s, d)).select("code", "title", "chapter", (F.size("scope") > 0).alias("has_scope"), (F.size("excludes") > 0).alias("has_excludes")), f"WITH {COMM} SELECT code, title, left(code, 2) AS chapter, contains(content, '이 호에는 ') AS has_scope, len(list_filter({found_sql(profiles.REFERENCES)}, lambda c: c <> code)) > 0 AS has_excludes FROM comm"),
    "x12_chunks": (chunk_rows, CHUNKS_SQL),
    "x17_note_ids": (lambda s, d: items(s, d).select("item_id", profiles.note_id(F.element_at(F.array(F.lit("section"), F.lit("chapter"), F.lit("subheading"), F.lit("x")), (F.col("item_id") % 4 + 1).cast("int")), F.col("p_size"), F.substring("code", 1, 2).cast("int"), F.col("item_id")).alias("id"), profiles.note_scope(F.when(F.col("item_id") % 4 == 0, "section").otherwise("chapter"), F.col("p_size"), F.substring("code", 1, 2).cast("int")).alias("scope")), f"WITH {ITEMS} SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'section_' || p_size || '_' || item_id WHEN 1 THEN 'chapter_' || left(code, 2) || '_' || item_id WHEN 2 THEN 'subheading_' || left(code, 2) || '_' || item_id ELSE 'unknown_' || item_id END AS id, CASE WHEN item_id % 4 = 0 THEN 'section_' || p_size ELSE 'chapter_' || left(code, 2) END AS scope FROM items"),
    "x19_terms": (term_counts, TERMS_SQL),
    "x20_parsed_code": (lambda s, d: items(s, d).select("item_id", extract.parsed_code(F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("제"), "code", F.lit("호"))).when(F.col("item_id") % 3 == 1, F.concat("code", F.lit("."), F.substring("subcode", 5, 2))).otherwise(F.concat("code", F.lit("."), F.substring("subcode", 5, 2), F.lit("-9000")))).alias("c")).select("item_id", "c.*"), f"WITH {ITEMS} SELECT item_id, code AS code4, CASE WHEN item_id % 3 = 0 THEN '' ELSE subcode END AS code6, CASE WHEN item_id % 3 = 2 THEN subcode || '9000' ELSE '' END AS code10 FROM items"),
    "x21_applied_rules": (over_comm("rules", lambda c: joined(extract.applied_rules(c))), f"WITH {COMM}, w AS (SELECT code, {APPLIED_SQL} AS l FROM comm) SELECT code, array_to_string(list_transform({firsts('l')}, lambda n: 'GRI' || n), '|') AS rules FROM w"),
    "x22_rejected_codes": (over_comm("codes", lambda c: joined(F.array_sort(extract.rejected_codes(c)))), f"WITH {COMM} SELECT code, array_to_string(list_sort(list_distinct({REJECTED_SQL})), '|') AS codes FROM comm"),
    "x23_decisive_sentences": (over_comm("sentences", lambda c: joined(extract.decisive_sentences(c))), f"WITH {COMM} SELECT code, array_to_string({DECISIVE_SQL}, '|') AS sentences FROM comm"),
    "x24_essence": (over_comm("essence", lambda c: extract.mentions_essence(c)), f"WITH {COMM} SELECT code, regexp_matches(content, '(?i)본질적\\s*특성|essential\\s*character|주된\\s*(?:성분|재질|기능|특성)') AS essence FROM comm"),
    "x27_overlay": (overlay, f"WITH {OVERLAY}"),
    "x29_note_keywords": (over_comm("keywords", lambda c: joined(extract.note_keywords(c))), f"WITH {COMM}, w AS (SELECT code, {KEYWORDS_SQL} AS l FROM comm) SELECT code, array_to_string(list_slice({firsts('l')}, 1, 10), '|') AS keywords FROM w"),
    "x30_redirect_target": (over_comm("target", lambda c: extract.redirect_target(c)), f"WITH {COMM} SELECT code, nullif(regexp_extract(content, '제(\\d{{4}})호', 1), '') AS target FROM comm"),
    "x32_html_lines": (lambda s, d: extract.html_lines(table(s, d, "pages")), HTML_SQL),
    "x33_parsed_answer": (answers, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "x35_subcodes": (subcode_table, f"WITH {ITEMS}, w AS (SELECT subcode, unnest(regexp_extract_all(lower(p_name), '[가-힣]{{2,}}|[a-z]{{3,}}')) AS w FROM items), k AS (SELECT subcode, string_agg(DISTINCT w, '|' ORDER BY w) AS keywords FROM w GROUP BY subcode) SELECT items.subcode, left(items.subcode, 4) AS code, min_by(p_name, item_id) AS title, any_value(keywords) AS keywords, sum(CAST(p_size > 20 AS INT)) AS case_count FROM items LEFT JOIN k ON k.subcode = items.subcode GROUP BY items.subcode"),
    "g2_code_index": (lambda s, d: code_axes(s, d).select("code", "axis", joined("values").alias("vals")), f"WITH {AXES} SELECT code, axis, array_to_string(vals, '|') AS vals FROM ca"),
    "g3_axis_scores": (lambda s, d: gate.axis_scores(neighbours(s, d), item_axes(s, d), code_axes(s, d)), f"WITH {AXIS_SCORE} SELECT * FROM jac"),
    "g4_quantity_axis": (lambda s, d: axes.quantity_axis(neighbours(s, d), sizes(s, d), size_rules(s, d)), f"WITH {AXES} SELECT cd.item_id, cd.code, CASE WHEN p_size <= 10 THEN 0 WHEN substr(cd.code, 4, 1) = '3' THEN 0.5 ELSE 1.0 END AS f_quant_rule_match_score FROM cd JOIN items ON items.item_id = cd.item_id"),
    "g5_overlap_counts": (overlaps, f"WITH {AXIS_SCORE}, m AS (SELECT i.item_id, c.code, i.axis, len(list_intersect(i.vals, c.vals)) AS n FROM ia i JOIN ca c ON i.axis = c.axis) SELECT cd.item_id, cd.code, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN axis = '{a}' THEN n END), 0) AS BIGINT) AS f_{a}_match" for a in ("processing_state", "material", "function_use", "physical_form")) + " FROM cd LEFT JOIN m ON m.item_id = cd.item_id AND m.code = cd.code GROUP BY cd.item_id, cd.code"),
    "g5_parts_mismatch": (lambda s, d: attributes.parts_mismatch(neighbours(s, d), attribute_rows(s, d), code_axes(s, d).filter("axis = 'completeness' and array_contains(values, 'parts')")), f"WITH {ATTR} SELECT cd.item_id, cd.code, CAST(NOT list_contains(completeness, 'parts') AND coalesce(list_contains(ca.vals, 'parts'), FALSE) AS INT) AS f_parts_mismatch FROM cd JOIN att ON att.item_id = cd.item_id LEFT JOIN ca ON ca.code = cd.code AND ca.axis = 'completeness'"),
    "g6_conflict_penalty": (lambda s, d: attributes.conflict_penalty(neighbours(s, d), item_axes(s, d), code_axes(s, d)), f"WITH {AXIS_SCORE} SELECT * FROM cpen"),
    "g7_uncertainty": (lambda s, d: gate.uncertainty(item_axes(s, d), items(s, d)), f"WITH {AXES}, u AS (SELECT items.item_id, count(axis) AS n, count(CASE WHEN confidence < 0.5 THEN 1 END) AS low FROM items LEFT JOIN ia ON ia.item_id = items.item_id AND axis IN ('material', 'processing_state', 'function_use', 'completeness') GROUP BY items.item_id) SELECT item_id, round(least(CASE WHEN n <= 1 THEN 0.4 WHEN n = 2 THEN 0.2 ELSE 0 END + 0.1 * low, 1), 6) AS uncertainty_penalty FROM u"),
    "g8_quantity_rules": (lambda s, d: attributes.quantity_rules(neighbours(s, d), size_rules(s, d), sizes(s, d)), f"WITH {AXES}, q AS (SELECT cd.item_id, cd.code, p_size, substr(cd.code, 4, 1) <> '3' AS own, CAST(left(cd.code, 2) AS INT) % 2 = 0 AS hard FROM cd JOIN items ON items.item_id = cd.item_id) SELECT item_id, code, CAST(own AND p_size > 10 AS INT) * 1.0 AS f_quant_match_score, CAST(own AND hard AND p_size > 40 AS INT) AS f_quant_hard_exclude, CAST(p_size <= 10 AS INT) AS f_quant_missing_value FROM q"),
    "g9_boosted": (boosts, f"WITH {AXIS_SCORE}, sm AS (SELECT item_id, code, sum(score) AS s FROM jac GROUP BY item_id, code) SELECT cd.item_id, cd.code, round((10 - rank) * 1.0000123 * (1 + 0.1 * n) * (1 + 0.15 * coalesce(s, 0)) * (1 - 0.3 * f_conflict_penalty) * {BOOST_SQL}, 6) AS score FROM cd JOIN att ON att.item_id = cd.item_id JOIN ov ON ov.item_id = cd.item_id AND ov.code = cd.code JOIN cpen ON cpen.item_id = cd.item_id AND cpen.code = cd.code LEFT JOIN sm ON sm.item_id = cd.item_id AND sm.code = cd.code"),
    "c4_axis_conflicts": (axis_clashes, f"WITH {CLASH} SELECT * FROM cg"),
    "c5_conflict_questions": (lambda s, d: axes.conflict_questions(axis_clashes(s, d), question_table(s)), f"WITH {CLASH} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score * priority DESC, priority DESC, cg.axis) AS INT) AS number, cg.axis, 'Which ' || cg.axis || '?' AS question FROM cg JOIN pr ON pr.axis = cg.axis QUALIFY number <= 3"),
    "c6_missing_axis_questions": (lambda s, d: axes.missing_axis_questions(items(s, d), item_axes(s, d), question_table(s)), f"WITH {CLASH} SELECT items.item_id, CAST(row_number() OVER (PARTITION BY items.item_id ORDER BY priority DESC, pr.axis) AS INT) AS number, pr.axis, 'Which ' || pr.axis || '?' AS question FROM items CROSS JOIN pr WHERE NOT EXISTS (SELECT 1 FROM ia WHERE ia.item_id = items.item_id AND ia.axis = pr.axis AND confidence >= 0.3) QUALIFY number <= 2"),
    "a37_axis_statistics": (lambda s, d: diagnostics.axis_statistics(items(s, d), item_axes(s, d)), f"WITH {AXES} SELECT axis, round(count(*) / (SELECT count(*) FROM items), 6) AS extraction_rate, round(avg(len(vals)), 6) AS mean_values, round(avg(confidence), 6) AS mean_confidence FROM ia GROUP BY axis"),
    "j19_fact_check": (checks, f"WITH {FACTS} SELECT *, round(satisfied / (satisfied + missing_hard + missing_soft), 6) AS rate, missing_hard = 0 AS sufficient FROM fk"),
    "a24_missing_facts": (lambda s, d: diagnostics.missing_facts(checks(s, d)), f"WITH {FACTS} SELECT count(*) AS n, round(avg(CAST(missing_hard > 0 AS INT)), 6) AS hard_rate, round(avg(CAST(missing_soft > 0 AS INT)), 6) AS soft_rate, round(avg(satisfied), 6) AS mean_satisfied FROM fk"),
    "c8_missing_fact_questions": (lambda s, d: gate.missing_fact_questions(neighbours(s, d), fact_table(s, d), item_axes(s, d)).select("item_id", "axis", "value", "codes", "position"), f"WITH {FACTS}, l AS (SELECT item_id, axis, CASE axis WHEN 'material' THEN 'contains' WHEN 'physical_form' THEN 'not_contains' ELSE 'eq' END AS op, value, count(DISTINCT code) AS codes FROM fo WHERE NOT list_contains(vals, value) GROUP BY item_id, axis, value) SELECT item_id, axis, value, codes, CAST(row_number() OVER (PARTITION BY item_id ORDER BY codes DESC, axis, op, value) AS INT) AS position FROM l QUALIFY position <= 3"),
    "c9_insufficient": (note_pairs, f"WITH {NOTES} SELECT item_id, chapter % 2 = 0 AND NOT list_bool_or(list_transform(kws, lambda k: contains(norm, k))) AS insufficient FROM prep JOIN note ON note.chapter = (CAST(left(code, 2) AS INT) + item_id % 3) % 26"),
    "j18_case_conflicts": (conflicting_cases, f"WITH {PREP}, c AS (SELECT item_id AS case_id, code AS case_code, lower(string_split(p_name, ' ')[2]) AS m FROM items WHERE p_size > 45) SELECT item_id, case_id, case_code, CAST(row_number() OVER (PARTITION BY item_id ORDER BY case_id) AS INT) AS position FROM prep JOIN c ON case_code <> code AND contains(norm, m) QUALIFY position <= 5"),
    "j24_augmented": (more_items, f"WITH {ITEMS}, a AS (SELECT DISTINCT string_split(lower(p_name), ' ')[1] AS term, string_split(lower(p_name), ' ')[2] AS alias FROM items), ar AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY alias) AS r FROM a), i AS (SELECT * FROM items WHERE code IN (SELECT code FROM items GROUP BY code HAVING count(*) < 10)), m AS (SELECT item_id, text, term, alias, row_number() OVER (PARTITION BY item_id ORDER BY md5('42:' || CAST(item_id AS VARCHAR) || ':' || term || ':' || alias), term, alias) AS number FROM i JOIN ar ON r <= 4 AND contains(lower(text), term)), x AS (SELECT item_id, number, text AS old, left(text, instr(lower(text), term) - 1) || alias || substr(text, instr(lower(text), term) + length(term)) AS text FROM m WHERE number <= 2) SELECT item_id, CAST(number AS INT) AS number, text FROM x WHERE text <> old"),
    "j25_search_notes": (lambda s, d: profiles.search_notes(tokens_of(s, d), note_table(s, d)), f"WITH {NOTES}, sc AS (SELECT item_id, 'n' || chapter AS note_id, len(list_filter(kws, lambda k: contains(norm, k))) + CASE WHEN contains(array_to_string(kws, ' '), norm) THEN 0.5 ELSE 0 END AS score FROM prep, note) SELECT item_id, note_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, note_id) AS INT) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10"),
    "g16_kb_only": (kb_only, f"WITH {KB_ONLY} {best('ko', 5)}"),
    "g17_hybrid": (hybrid, f"WITH {HYBRID}, hy AS (SELECT item_id, code, score FROM heur h WHERE NOT EXISTS (SELECT 1 FROM gs WHERE gs.item_id = h.item_id AND gs.code = h.code AND NOT passed)) {best('hy', 5)}"),
    "a23_conflict_rate": (lambda s, d: scorers.conflict_rate(split.top_k(match.weighted_score(all_features(s, d)).select("item_id", "code", "score"), 1), gated(s, d)), f"WITH {HYBRID}, t AS ({best('scored', 1)}), f AS (SELECT coalesce(NOT passed, FALSE) AS f FROM t LEFT JOIN gs ON gs.item_id = t.item_id AND gs.code = t.code) SELECT count(*) AS n, sum(CAST(f AS INT)) AS conflicts, round(avg(CAST(f AS INT)), 6) AS rate FROM f"),
    "a30_gate_exclusions": (lambda s, d: diagnostics.gate_exclusions(gated(s, d), items(s, d).select("item_id", F.col("code").alias("true_code"))), f"WITH {GATE} SELECT left(gs.code, 2) AS chapter, count(*) AS n, sum(CAST(NOT passed AS INT)) AS excluded FROM gs JOIN items ON items.item_id = gs.item_id AND items.code = gs.code GROUP BY 1"),
    "g31_answer_confidence": (lambda s, d: cascade.answer_confidence(with_first(s, d).select("item_id", F.col("p1").alias("answer_raw"), (F.col("p2") / 2).alias("best_rrf"), (F.col("item_id") % 3 != 0).alias("gate_passed"), (F.col("item_id") % 2 == 0).alias("has_signals"), (F.col("item_id") % 7 == 0).alias("is_fallback"))).select("item_id", "calibrated"), f"WITH {FIRST2}, pq AS (SELECT item_id, 0.5 * p1 + 0.3 * least(1.5 * p2, 1) + 0.2 * CASE WHEN item_id % 3 <> 0 THEN 1 ELSE 0.3 END AS raw FROM p) SELECT item_id, round(greatest(least({CALIBRATED}, 1), 0), 6) AS calibrated FROM pq"),
    "g32_post_processed": (post, f"WITH {POST}"),
    "g33_fallback": (lambda s, d: scorers.fallback(predictions(s, d), 4).withColumn("codes", joined("codes")), f"WITH {PRED} SELECT item_id, max(CASE WHEN rank = 1 THEN code END) AS best, string_agg(code, '|' ORDER BY rank) AS codes, round(0.3 * max(score), 6) AS confidence FROM pred WHERE rank <= 4 GROUP BY item_id"),
    "u2_answer_candidates": (lambda s, d: scorers.answer_candidates(predictions(s, d, even=True).filter("rank <= 2").select("item_id", "code", F.col("rank").alias("position")), predictions(s, d).select("item_id", "code", "rank"), 5), f"WITH {PRED}, {predictions_sql("pe", True)}, e AS (SELECT item_id, code, 0 AS s, rank FROM pe WHERE rank <= 2 UNION ALL SELECT item_id, code, 1, rank FROM pred), f AS (SELECT item_id, code, min(s * 1000 + rank) AS place FROM e GROUP BY item_id, code) SELECT item_id, code, CAST(row_number() OVER (PARTITION BY item_id ORDER BY place, code) AS INT) AS rank, place < 1000 AS answered FROM f QUALIFY rank <= 5"),
    "a11_all_metrics": (lambda s, d: scorers.all_metrics(predictions(s, d)), f"SELECT a.*, f1_macro, f1_weighted, f1_micro, ece, brier FROM ({METRICS['a6_topk_accuracy'][1]}) a, ({METRICS['a8_f1'][1]}) b, ({METRICS['a14_ece_brier'][1]}) c"),
    "a28_errors_by_feature": (lambda s, d: scorers.errors_by_feature(predictions(s, d).filter("rank = 1 and code <> true_code").select(F.col("score").alias("confidence"), (F.col("item_id") % 3 - 1).alias("f")), "f"), f"WITH {PRED} SELECT item_id % 3 - 1 > 0 AS present, count(*) AS n, round(avg(score), 6) AS confidence FROM pred WHERE rank = 1 AND code <> true_code GROUP BY 1"),
    "w5_adaptive_top_k": (lambda s, d: split.adaptive_top_k(predictions(s, d), with_first(s, d).select("item_id", (F.col("item_id") % 2 == 0).alias("incomplete"), (F.col("item_id") % 3 == 0).alias("mixture"), F.lit(False).alias("has_quantity"), (F.col("item_id") % 4).alias("n_materials"), F.lit(False).alias("is_set")), -15).select("item_id", "code", "rank"), f"WITH {PRED} SELECT item_id, code, CAST(rank AS INT) AS rank FROM pred WHERE rank <= -15 + CASE WHEN item_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN item_id % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN item_id % 4 > 1 THEN 5 ELSE 0 END"),
    "g25_references": (lambda s, d: steps.references(predictions(s, d).select("item_id", "code", F.concat(F.lit("r"), F.substring("code", 1, 2)).alias("rule_id")), predictions(s, d)).select("item_id", joined("rule_ids").alias("rule_ids")), f"WITH {PRED} SELECT item_id, string_agg(DISTINCT 'r' || left(code, 2), '|' ORDER BY 'r' || left(code, 2)) AS rule_ids FROM pred WHERE rank <= 3 GROUP BY item_id"),
}
