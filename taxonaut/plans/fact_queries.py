"""Queries of required facts, question templates, case features, subheading notes, signal counts and contexts, feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import axes, extract, facts, retrieval
from .axis_queries import ATTR, AXES, COMM, LEXICON, attribute_rows, commentary, docs, item_axes, joined, signals_sql
from .fixtures import ITEMS, PRED, items, predictions, table
from .match_queries import FEATURES, all_features, kb_of
from .text_queries import BM25, GATE, gate_of, note_profiles, short_bm25

#: The fixed keywords and those of the made-up axes, which part names have.
WORDS = facts.LEXICON + [(a, k) for a, _, k in LEXICON]
#: Features in their fixed order, as far as one table has them.
NAMES = ["f_ml", "f_lexical", "f_card_hits", "f_rule_inc_hits", "f_rule_exc_hits", "f_not_in_model", "f_specificity", "f_exclude_conflict", "f_note_hard_exclude", "f_note_support_sum"]


def fact_cards(s, d):
    """A card for each code: a title, name and state of some parts as includes and of others as excludes."""
    named = F.concat(F.when(F.col("item_id") % 4 == 2, "냉동 ").otherwise("살아 있는 "), "p_name")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, named)))
    rows = items(s, d).groupBy("code").agg(F.max("p_type").alias("title"), pick(F.col("item_id") % 2 == 0).alias("includes"), pick(F.col("item_id") % 5 == 1).alias("excludes"))
    return rows.withColumn("title", F.concat(F.lower("title"), F.lit(" 기계 부품")))


FACT_SQL = ITEMS + ", w(axis, value) AS (VALUES " + ", ".join(map(str, WORDS)) + """),
nm AS (SELECT code, item_id, CASE WHEN item_id % 4 = 2 THEN '냉동 ' ELSE '살아 있는 ' END || p_name AS text FROM items),
src AS (SELECT code, 1 AS k, lower(max(p_type)) || ' 기계 부품' AS text FROM items GROUP BY code UNION ALL SELECT code, 2, text FROM nm WHERE item_id % 2 = 0 UNION ALL SELECT code, 3, text FROM nm WHERE item_id % 5 = 1),
hit AS (SELECT code, axis, value, min(k) AS k FROM src JOIN w ON contains(text, value) GROUP BY code, axis, value)
SELECT code, axis, ['contains', 'contains', 'not_contains'][k] AS operator, value, ['soft', 'soft', 'hard'][k] AS hardness, ['title', 'includes', 'excludes'][k] AS source FROM hit"""

TEMPLATE_SQL = COMM + ", cr(chapter, crit) AS (VALUES " + ", ".join(f"('{c}', {k!r})" for c, k in facts.CRITERIA.items()) + "), qu(key, question) AS (VALUES " + ", ".join(map(str, facts.QUESTIONS.items())) + """),
h AS (SELECT code, coalesce(crit, ['use', 'material']) AS k, list_concat(CASE WHEN regexp_matches(content, '재질|재료|소재') THEN ['material'] ELSE [] END, CASE WHEN regexp_matches(content, '용도|목적|사용') THEN ['use'] ELSE [] END) AS more FROM comm LEFT JOIN cr ON cr.chapter = left(code, 2)),
e AS (SELECT code, list_concat(k, list_filter(more, lambda m: NOT list_contains(k, m)))[1:3] AS ks FROM h),
x AS (SELECT code, unnest(ks) AS key, unnest(range(len(ks))) + 1 AS position FROM e)
SELECT code, left(code, 2) AS chapter, CAST(position AS INT) AS position, x.key, question FROM x JOIN qu ON qu.key = x.key"""


def feature_rows(s, d):
    return facts.case_features(attribute_rows(s, d)).withColumn("material", joined("material"))


SETS = "[" + ", ".join(f"'{v}'" for v in axes.SET_VALUES) + "]"
CASE_SQL = ATTR + f" SELECT item_id, coalesce(function_use[1], '') AS primary_function, array_to_string(material, '|') AS material, coalesce(physical_form[1], '') AS structure, list_has_any(completeness, {SETS}) AS is_set, list_contains(function_use, 'electrical') AS is_electrical FROM att"


def note_rows(s, d):
    """A note for each part: every third is on a subheading by its level, every fifth by its type."""
    i = F.col("item_id")
    codes = F.array("code", F.concat("subcode", F.lit("00")))
    return items(s, d).select(i.alias("note_no"), F.when(i % 3 == 0, "subheading").otherwise("chapter").alias("level"), F.when(i % 5 == 0, "소호주").alias("note_type"), codes.alias("codes"), F.col("p_name").alias("content"))


def tagged(s, d):
    return facts.weak_tags(docs(s, d).select("doc_id", F.col("source").alias("name"), F.lit(None).cast("string").alias("rationale"), F.col("text").alias("description")))


TAG_SQL = "WITH documents AS (SELECT doc_id, concat_ws(' ', source, text) AS text FROM main.documents), t AS (" + signals_sql() + ") SELECT count(*) AS n, " + ", ".join(f"CAST(sum(CAST({n}_n > 0 AS INT)) AS BIGINT) AS {n}" for n in extract.SIGNALS) + ", CAST(sum(CAST(parts_n > 0 AS INT)) AS BIGINT) AS parts FROM t"

#: Every how many sizes an item has a signal.
EVERY = {"incomplete": 2, "mixture": 3, "multi_candidate": 5, "containers": 7}


def sections(s, d):
    words = F.split(F.lower("p_name"), " ")
    found = items(s, d).select("item_id", *(F.when(F.col("p_size") % k == 0, words).alias(c) for c, k in EVERY.items()), (F.col("p_size") % 4 == 1).alias("note_like"))
    return facts.signal_context(found)


def sections_sql() -> str:
    text = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    lines = [f"CASE WHEN p_size % {EVERY[c]} = 0 THEN {text(head)} || array_to_string(string_split(lower(p_name), ' ')[1:3], ', ') || {text(tail)} END" for c, (head, tail) in facts.SIGNAL_LINES.items()]
    lines.append(f"CASE WHEN p_size % 4 = 1 THEN {text(facts.NOTE_LINE)} END")
    return f"WITH s AS (SELECT p_partkey AS item_id, concat_ws(chr(10), {', '.join(lines)}) AS l FROM part) SELECT item_id, CASE WHEN l = '' THEN {text(facts.NO_SIGNAL)} ELSE {text(facts.SIGNAL_HEAD)} || chr(10) || l END AS section FROM s"


def with_gate(s, d):
    x = note_profiles(s, d)
    return x.of_items(facts.with_gate(kb_of(x, s, d).select("item_id", "code"), gate_of(x, s, d)))


def vectors(s, d):
    rows = facts.feature_vector(all_features(s, d), NAMES)
    return rows.select("item_id", "code", *(F.round(F.get("features", F.lit(i)), 6).alias(f"v{i}") for i in range(len(NAMES))))


def other_axes(s, d):
    """Axes with those of another extraction for items of sizes up to 20: one value of material, none for sizes divisible by 4."""
    own = item_axes(s, d)
    value = F.when(F.col("p_size") % 4 != 0, F.array(F.lower("p_type"))).otherwise(F.array().cast("array<string>"))
    given = items(s, d).filter("p_size <= 20").select("item_id", F.lit("material").alias("axis"), value.alias("values"), F.lit(0.9).alias("confidence"))
    return facts.overlaid_axes(own, given).select("item_id", "axis", joined("values").alias("vals"), "confidence", "supplied")


def training_rows(s, d):
    labels = items(s, d).select("item_id", F.col("code").alias("true_code"))
    x = note_profiles(s, d)
    return facts.ranking_rows_over_profiles(x, kb_of(x, s, d).select("item_id", "code"), labels, gate_of(x, s, d))


def smoke(s, d):
    ranked = predictions(s, d).filter("item_id % 7 <> 0")
    return facts.smoke_statistics(ranked, table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.when(F.col("label") > 0, F.col("label") > 4).alias("any_signal")))


def trace(s, d):
    top = short_bm25(s, d)
    rows = retrieval.traced({"lexical": top, "fused": retrieval.fuse([top.filter("rank <= 10"), top.filter("doc % 2 = 0")])})
    return rows.withColumns({c: joined(c) for c in ("lexical", "fused")})


def case_table(s, d):
    """Vectors as cases: every fourth label has a blank name, every third a code of two characters."""
    label = F.col("label")
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("case_id"), F.when(label % 4 == 0, " ").otherwise(F.concat(F.lit("case "), label)).alias("name"), F.when(label % 3 == 0, "01").otherwise("0101").alias("code"), F.col("embedding").alias("vector"))
    return retrieval.case_vectors(rows).select("case_id", "name", "code", F.size("vector").alias("n"))


VECTOR_SQL = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS v{i}" for i, c in enumerate(NAMES))

QUERIES = {
    "x6_tag_counts": (lambda s, d: facts.tag_counts(tagged(s, d)), TAG_SQL),
    "x15_card_facts": (lambda s, d: facts.card_facts(fact_cards(s, d), WORDS), f"WITH {FACT_SQL}"),
    "x18_question_templates": (lambda s, d: facts.question_templates(commentary(s, d)), f"WITH {TEMPLATE_SQL}"),
    "x25_case_features": (feature_rows, f"WITH {CASE_SQL}"),
    "x36_subheading_notes": (lambda s, d: facts.subheading_notes(note_rows(s, d)).withColumn("contents", joined("contents")), f"WITH {ITEMS} SELECT subcode AS code6, string_agg(p_name, '|' ORDER BY item_id) AS contents FROM items WHERE item_id % 3 = 0 OR item_id % 5 = 0 GROUP BY subcode"),
    "j21_with_gate": (with_gate, f"WITH {GATE} SELECT kb.item_id, kb.code, CAST(coalesce(include_support, 0) AS DOUBLE) AS f_note_support_sum, CAST(NOT coalesce(passed, TRUE) AS INT) AS f_note_hard_exclude FROM kb LEFT JOIN gs ON gs.item_id = kb.item_id AND gs.code = kb.code"),
    "g11_feature_vector": (vectors, f"WITH {FEATURES} SELECT item_id, code, {VECTOR_SQL} FROM feat"),
    "x34_overlaid_axes": (other_axes, f"WITH {AXES}, gv AS (SELECT item_id, p_type FROM items WHERE p_size <= 20 AND p_size % 4 <> 0) SELECT item_id, 'material' AS axis, lower(p_type) AS vals, CAST(0.9 AS DOUBLE) AS confidence, TRUE AS supplied FROM gv UNION ALL SELECT item_id, axis, array_to_string(vals, '|'), confidence, FALSE FROM ia WHERE item_id NOT IN (SELECT item_id FROM gv)"),
    "r7_ranking_rows": (training_rows, f"WITH {GATE}, rr AS (SELECT kb.item_id, kb.code, CAST(kb.code = items.code AS INT) AS label FROM kb JOIN items ON items.item_id = kb.item_id LEFT JOIN gs ON gs.item_id = kb.item_id AND gs.code = kb.code WHERE coalesce(passed, TRUE)) SELECT * FROM rr WHERE item_id IN (SELECT item_id FROM rr WHERE label = 1)"),
    "a46_smoke": (smoke, f"WITH {PRED}, p AS (SELECT item_id, max(CASE WHEN rank = 1 THEN score END) AS p1, max(CASE WHEN rank = 2 THEN score END) AS p2 FROM pred WHERE item_id % 7 <> 0 GROUP BY item_id) SELECT count(*) AS n, count(p1) AS with_candidates, CAST(sum(CAST(label > 4 AS INT)) AS BIGINT) AS with_signal, CAST(sum(CAST(p1 IS NULL OR p1 < 0.5 OR p1 - p2 < 0.15 AS INT)) AS BIGINT) AS low_confidence FROM embeddings LEFT JOIN p ON p.item_id = vec_id"),
    "r6_case_vectors": (case_table, "SELECT vec_id AS case_id, 'case ' || CAST(label AS VARCHAR) AS name, '0101' AS code, CAST(len(embedding) AS INT) AS n FROM embeddings WHERE label % 4 <> 0 AND label % 3 <> 0"),
    "r9_traced": (trace, f"WITH {BM25}, b AS (SELECT * FROM bm WHERE rank <= 30), l AS (SELECT query_id, doc, rank FROM b WHERE rank <= 10 UNION ALL SELECT query_id, doc, rank FROM b WHERE doc % 2 = 0), f AS (SELECT query_id, doc, round(sum(1 / (60 + rank)), 6) AS score FROM l GROUP BY query_id, doc), fr AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM f), x AS (SELECT query_id, 'b' AS w, rank, doc FROM b WHERE rank <= 5 UNION ALL SELECT query_id, 'f', rank, doc FROM fr WHERE rank <= 5) SELECT query_id, coalesce(string_agg(CAST(doc AS VARCHAR), '|' ORDER BY rank) FILTER (w = 'b'), '') AS lexical, coalesce(string_agg(CAST(doc AS VARCHAR), '|' ORDER BY rank) FILTER (w = 'f'), '') AS fused FROM x GROUP BY query_id"),
    "g36_signal_context": (sections, sections_sql()),
}
