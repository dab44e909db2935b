"""Queries whose signals, models and gates are computed from texts, and operators on their own that other queries use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, facts, gate, match, ranking, retrieval, split, steps
from ..sources.scratch import kept
from .axis_queries import FACTS, HYBRID, fact_table, item_axes, joined, neighbours, with_model
from .fixtures import ITEMS, items, table
from .match_queries import BASE, RULE, SPLIT, cards, norm_sql, rule_only_rows, rules, stratified, tokens_of, top
from .ranking_queries import KEYS, NB, SIGNAL, described, over_described
from .step_queries import ASK
from .text_queries import DENSE, GATE, asked, gate_of, gated, note_profiles, vectors


def flags(s, d):
    return extract.signals(described(s, d).select("item_id", "text")).select("item_id", "incomplete", F.col("mixtures").alias("mixture"), "multi_candidate", "containers", "note_like")


def questions(s, d):
    return steps.signal_questions(flags(s, d), ASK).withColumn("questions", joined("questions"))


def questions_sql() -> str:
    lists = ", ".join(f"CASE WHEN {c} THEN {qs!r} ELSE [] END" for c, qs in ASK.items())
    return f"WITH {over_described(ITEMS)}, {SIGNAL}, l AS (SELECT item_id, flatten([{lists}]) AS q FROM sg) SELECT item_id, array_to_string(list_slice(list_filter(q, lambda x, i: list_position(q, x) = i), 1, 2), '|') AS questions FROM l"


def sections(s, d):
    found = extract.matched_keywords(described(s, d)).withColumnRenamed("mixtures", "mixture").drop("note_like")
    return facts.signal_context(found.join(flags(s, d).select("item_id", "note_like"), "item_id"))


def sections_sql() -> str:
    text = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    kws = lambda n: "[" + ", ".join(f"'{w}'" for w in sorted({w.replace('-', ' ').strip() for w in extract.SIGNALS[n][0] if len(w) >= 2})) + "]"
    lines = []
    for c, (head, tail) in facts.SIGNAL_LINES.items():
        held = f"list_filter({kws('mixtures' if c == 'mixture' else c)}, lambda k: contains(norm, k))"
        lines.append(f"CASE WHEN len({held}) > 0 THEN {text(head)} || array_to_string({held}[1:3], ', ') || {text(tail)} END")
    lines.append(f"CASE WHEN note_like THEN {text(facts.NOTE_LINE)} END")
    return f"WITH {over_described(ITEMS)}, {SIGNAL}, p AS (SELECT items.item_id, note_like, {norm_sql('text')} AS norm FROM items JOIN sg ON sg.item_id = items.item_id), s AS (SELECT item_id, concat_ws(chr(10), {', '.join(lines)}) AS l FROM p) SELECT item_id, CASE WHEN l = '' THEN {text(facts.NO_SIGNAL)} ELSE {text(facts.SIGNAL_HEAD)} || chr(10) || l END AS section FROM s"


def fitted(s, d, it):
    coded = it.join(items(s, d).select(*KEYS), "item_id")
    return ranking.naive_bayes_top(ranking.naive_bayes(coded.filter("item_id % 5 <> 0")), it)


def smoke(s, d):
    """A trial run: described items scored by the fitted model, and the signals of their texts."""
    it = kept(match.prepared(described(s, d)), "tokens")
    found = flags(s, d).withColumn("any_signal", F.col("incomplete") | F.col("mixture") | F.col("multi_candidate") | F.col("containers"))
    return facts.smoke_statistics(fitted(s, d, it), found)


def rule_only_gated(s, d):
    """The rule-only scorer with the gate: codes that it excludes go before the five best are taken."""
    x = note_profiles(s, d)
    rows = rule_only_rows(x, s, d).join(gate_of(x, s, d).filter("not passed").select(*KEYS), KEYS, "left_anti")
    return x.of_items(split.top_k(rows, 5))


def hybrid_fitted(s, d):
    """The hybrid scorer with the fitted model as its model."""
    return with_model(s, d, fitted(s, d, kept(tokens_of(s, d), "tokens")).select(*KEYS, "score"))


MODEL = NB.split("\nkbr AS", 1)[0].rstrip(",")
FITTED = HYBRID.replace("ml AS (SELECT item_id + 1 AS item_id, code, 0.5 AS score FROM items)", MODEL.lstrip() + ",\nml AS (SELECT item_id, code, score FROM nbr)")


def similar_cases(s, d):
    """The five labelled vectors most like each asked one, with their labels; its own row is none."""
    near = retrieval.dense(asked(s, d), vectors(s, d), 6).filter("doc <> query_id")
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    return split.top_k(near.select("query_id", "doc", "score"), 5, "query_id", "doc").join(labels, "doc").select("query_id", "doc", "label", "score", "rank")


def known(s, d):
    sides = stratified(s, d)
    test = items(s, d).filter("item_id % 4 = 1").select("item_id", "code")
    return split.known_classes(test, sides.filter("split = 'train'").join(items(s, d).filter("p_size > 25").select("item_id"), "item_id", "left_semi"))


def unions(s, d):
    it = tokens_of(s, d)
    g = kept(gated(s, d), "gate")
    redirects = g.filter("redirect_to is not null").select("item_id", F.col("redirect_to").alias("code"))
    out = match.union_candidates({"model": fitted(s, d, kept(it, "tokens")).filter("rank <= 3"), "kb": g, "redirect": redirects})
    return out.withColumn("sources", joined("sources"))


def single_facts(s, d):
    rows = neighbours(s, d).select("item_id", "code").join(fact_table(s, d), "code").join(item_axes(s, d).select("item_id", "axis", "values"), ["item_id", "axis"], "left")
    return rows.select("item_id", "code", "axis", "value", gate.fact_holds(F.col("values"), F.col("operator"), F.col("value")).alias("holds"))


def true_code_facts(s, d):
    """What the facts of an item's true code lack."""
    true = items(s, d).select(*KEYS).hint("merge")
    asked = neighbours(s, d).join(true, KEYS, "left_semi")  # other candidates needn't be checked
    found = gate.fact_check(asked, fact_table(s, d), item_axes(s, d))
    return found.join(true, KEYS).select("item_id", "code", "satisfied", "missing_hard", "missing_soft", "sufficient")


def first_words(s, d):
    return table(s, d, "documents").select("doc_id", joined(split.first_distinct(F.split(F.lower("text"), "[^a-z]+"), 5)).alias("words"))


QUERIES = {
    "c1_computed_questions": (questions, questions_sql()),
    "g36_computed_context": (sections, sections_sql()),
    "a46_computed_smoke": (smoke, f"WITH {over_described(BASE)},{MODEL}, p AS (SELECT item_id, max(score) AS p1 FROM nbp GROUP BY item_id), r AS (SELECT item_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, code) AS r FROM nbp), q AS (SELECT item_id, max(CASE WHEN r = 1 THEN score END) AS p1, max(CASE WHEN r = 2 THEN score END) AS p2 FROM r GROUP BY item_id), {SIGNAL} SELECT count(*) AS n, count(p1) AS with_candidates, CAST(sum(CAST(incomplete OR mixture OR multi_candidate OR containers AS INT)) AS BIGINT) AS with_signal, CAST(sum(CAST(p1 IS NULL OR p1 < 0.5 OR p1 - coalesce(p2, 0) < 0.15 AS INT)) AS BIGINT) AS low_confidence FROM sg LEFT JOIN q ON q.item_id = sg.item_id"),
    "g15_gated": (rule_only_gated, f"WITH {GATE}{RULE}, ro AS (SELECT kb.item_id, kb.code, round(score + 0.5 * coalesce(score_rule, 0), 6) AS score FROM kb LEFT JOIN rule ON kb.item_id = rule.item_id AND kb.code = rule.code LEFT JOIN gs ON gs.item_id = kb.item_id AND gs.code = kb.code WHERE coalesce(inc_hits, 0) >= coalesce(exc_hits, 0) AND coalesce(passed, TRUE)) {top('ro', 5)}"),
    "g17_fitted": (hybrid_fitted, f"WITH {FITTED}, hy AS (SELECT item_id, code, score FROM heur h WHERE NOT EXISTS (SELECT 1 FROM gs WHERE gs.item_id = h.item_id AND gs.code = h.code AND NOT passed)) {top('hy', 5)}"),
    "j13_similar_cases": (similar_cases, f"WITH {DENSE}, o AS (SELECT query_id, doc, score FROM de WHERE rank <= 6 AND doc <> query_id) SELECT query_id, doc, label, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INT) AS rank FROM o JOIN embeddings ON vec_id = doc QUALIFY rank <= 5"),
    "j22_known_classes": (known, f"WITH {SPLIT} SELECT item_id, code FROM items WHERE item_id % 4 = 1 AND code IN (SELECT split.code FROM split JOIN items i ON i.item_id = split.item_id WHERE split = 'train' AND n >= 3 AND p_size > 25)"),
    "u1_union_candidates": (unions, f"WITH {GATE},{MODEL}, m AS (SELECT item_id, code FROM nbp QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, code) <= 3), e AS (SELECT item_id, code, 0 AS place, 'model' AS name FROM m UNION ALL SELECT item_id, code, 1, 'kb' FROM gs UNION ALL SELECT DISTINCT item_id, redirect_to, 2, 'redirect' FROM gs WHERE redirect_to IS NOT NULL) SELECT item_id, code, string_agg(name, '|' ORDER BY place) AS sources FROM e GROUP BY item_id, code"),
    "u5_known_codes": (lambda s, d: match.known_codes(cards(s, d), rules(s, d)), f"WITH {ITEMS} SELECT DISTINCT code FROM items"),
    "p6_single_fact": (single_facts, f"WITH {FACTS} SELECT item_id, code, axis, value, ok AS holds FROM fo"),
    "a31_true_code_facts": (true_code_facts, f"WITH {FACTS} SELECT fk.item_id, fk.code, satisfied, missing_hard, missing_soft, missing_hard = 0 AS sufficient FROM fk JOIN items ON items.item_id = fk.item_id AND items.code = fk.code"),
    "w12_first_distinct": (first_words, "WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], '|') AS words FROM w"),
}
