"""Queries of the table of subcodes and of the subcodes that fit items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, facts, subheadings
from .axis_queries import AXES, PREP, item_axes, joined
from .fact_queries import note_rows
from .fixtures import items
from .match_queries import norm_sql, tokens_of, tokens_sql


def table_of(s, d):
    """Subcodes of parts up to size 40, those up to 20 without a title; notes of parts; cases of parts above 20."""
    it = items(s, d)
    rows = it.filter("p_size <= 40")
    title = F.min(F.when(F.col("p_size") > 20, F.col("p_name"))).alias("title")
    words = F.array_sort(F.collect_set("w")).alias("keywords")
    hierarchy = rows.groupBy("subcode").agg(title).join(rows.select("subcode", F.explode(F.split(F.lower("p_name"), " ")).alias("w")).groupBy("subcode").agg(words), "subcode")
    even = F.substring("code", 1, 2).cast("int") % 2 == 0
    titles = it.filter(~even).groupBy("code").agg(F.lower(F.max("p_type")).alias("title")).union(it.filter(even).groupBy(F.substring("code", 1, 2)).agg(F.concat(F.lit("chapter "), F.min("p_name"))))
    notes = facts.subheading_notes(note_rows(s, d).filter("note_no % 7 = 0"))
    return subheadings.assembled(hierarchy, notes, it.filter("p_size > 20").select("subcode"), titles)


TABLE = """hi AS (SELECT subcode, min(CASE WHEN p_size > 20 THEN p_name END) AS title FROM items WHERE p_size <= 40 GROUP BY subcode),
hk AS (SELECT subcode, list_sort(list(DISTINCT w)) AS keywords FROM (SELECT subcode, unnest(string_split(lower(p_name), ' ')) AS w FROM items WHERE p_size <= 40) GROUP BY subcode),
hn AS (SELECT subcode, list(p_name ORDER BY item_id) AS notes FROM items WHERE item_id % 7 = 0 AND (item_id % 3 = 0 OR item_id % 5 = 0) GROUP BY subcode),
hc AS (SELECT subcode, count(*) AS case_count FROM items WHERE p_size > 20 GROUP BY subcode),
ct AS (SELECT code, lower(max(p_type)) AS title FROM items WHERE CAST(left(code, 2) AS INT) % 2 = 1 GROUP BY code UNION ALL SELECT left(code, 2), 'chapter ' || min(p_name) FROM items WHERE CAST(left(code, 2) AS INT) % 2 = 0 GROUP BY 1),
every AS (SELECT subcode FROM hi UNION SELECT subcode FROM hn UNION SELECT subcode FROM hc),
sub AS MATERIALIZED (SELECT e.subcode, left(e.subcode, 4) AS code, coalesce(hi.title, a.title, b.title, '') AS title, CASE WHEN hi.title IS NOT NULL THEN e.subcode WHEN a.title IS NOT NULL THEN left(e.subcode, 4) WHEN b.title IS NOT NULL THEN left(e.subcode, 2) END AS title_from,
  coalesce(keywords, []) AS keywords, coalesce(notes, []) AS notes, coalesce(case_count, 0) AS case_count FROM every e LEFT JOIN hi ON hi.subcode = e.subcode LEFT JOIN hk ON hk.subcode = e.subcode LEFT JOIN hn ON hn.subcode = e.subcode LEFT JOIN hc ON hc.subcode = e.subcode
  LEFT JOIN ct a ON a.code = left(e.subcode, 4) LEFT JOIN ct b ON b.code = left(e.subcode, 2))"""


def table_rows(s, d):
    return table_of(s, d).select("subcode", "code", "title", "title_from", joined("keywords").alias("keywords"), joined("notes").alias("notes"), "case_count")


def scored(s, d):
    return subheadings.subcode_scores(items(s, d).select("item_id", "code"), table_of(s, d), tokens_of(s, d), item_axes(s, d))


def counts(s, d):
    """Cases of six-digit codes alone."""
    return extract.subcodes(items(s, d).limit(0).select("code", F.col("p_name").alias("name"), F.col("item_id").alias("position")), items(s, d).filter("p_size > 20").select(F.col("subcode").alias("code"))).select("subcode", "code", "case_count")


WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> ''))"
SCORES = AXES + ", " + TABLE + f""",
st AS (SELECT *, list_distinct({tokens_sql('title')}) AS tt, list_transform(notes, lambda n: {WORDS.format(norm_sql('n'))}) AS nw, lower(concat_ws(' ', array_to_string(keywords, ' '), title)) AS whole FROM sub),
sx AS (SELECT p.item_id, p.code, st.subcode, list_sum(list_append(list_transform(keywords, lambda k: CASE WHEN contains(norm, k) THEN 1.0 WHEN list_contains(tokens, k) THEN 0.5 ELSE 0 END), 0.0)) + 0.3 * len(list_intersect(tt, tokens)) AS kw,
  least(list_sum(list_append(list_transform(nw, lambda n: CASE WHEN len(n) > 0 THEN 0.5 * len(list_intersect(n, {WORDS.format('norm')})) / len(n) ELSE 0 END), 0.0)), 1) AS note, coalesce(len(list_filter(m.vals, lambda v: contains(whole, lower(v)))) / len(m.vals), 0) AS mat, least(case_count / 20, 1) AS cas
  FROM prep p JOIN st ON st.code = p.code LEFT JOIN ia m ON m.item_id = p.item_id AND m.axis = 'material'),
sy AS (SELECT item_id, code, subcode, round(kw, 6) AS keyword_score, round(note, 6) AS note_score, round(CAST(mat AS DOUBLE), 6) AS material_score, round(CAST(cas AS DOUBLE), 6) AS case_score FROM sx),
sz AS (SELECT *, round(keyword_score + 2 * note_score + 1.5 * material_score + case_score, 6) AS score FROM sy)"""

QUERIES = {
    "j26_subcode_table": (table_rows, f"WITH {PREP}, {TABLE} SELECT subcode, code, title, title_from, array_to_string(keywords, '|') AS keywords, array_to_string(notes, '|') AS notes, case_count FROM sub"),
    "j17_subcode_scores": (scored, f"WITH {SCORES} SELECT item_id, code, subcode, CAST(keyword_score AS DOUBLE) AS keyword_score, CAST(note_score AS DOUBLE) AS note_score, material_score, case_score, CAST(score AS DOUBLE) AS score FROM sz"),
    "j17_resolved": (lambda s, d: subheadings.resolved(scored(s, d)).select("item_id", "code", "subcode", "position"), f"WITH {SCORES} SELECT item_id, code, subcode, CAST(row_number() OVER (PARTITION BY item_id, code ORDER BY score DESC, subcode) AS INT) AS position FROM sz QUALIFY position <= 3"),
    "a3_case_counts": (counts, f"WITH {PREP} SELECT subcode, code, count(*) AS case_count FROM items WHERE p_size > 20 GROUP BY subcode, code"),
}
