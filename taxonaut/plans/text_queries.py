"""Queries of retrieval, extraction, gate, decisions, diagnostics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import diagnostics, extract, gate, match, metrics, models, retrieval, split
from .fixtures import ITEMS, PRED, items, predictions, table
from .match_queries import BASE, FEATURES, KB, all_features, cards, kb_of, name_terms, tokens_of

TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda t: t <> '')"


def documents(spark, sf_dir):
    tokens = F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", tokens.alias("tokens"))


def questions(spark, sf_dir):
    tokens = F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", tokens.alias("tokens"))


BM25 = f"""
dt AS (SELECT doc_id, lang, {TOKENS.format('text')} AS t FROM documents), qt AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS t FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt), dx AS (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM dt),
po AS (SELECT token, doc_id, count(*) AS tf, any_value(dl) AS dl FROM dx GROUP BY token, doc_id),
df AS (SELECT token, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po GROUP BY token),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
qx AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest(t) AS token FROM qt) GROUP BY query_id, token),
sc AS (SELECT query_id, doc_id AS doc, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM st)))) AS score FROM qx JOIN idf ON qx.token = idf.token JOIN po ON po.token = qx.token GROUP BY query_id, doc_id),
bm AS (SELECT query_id, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc) AS INT) AS rank FROM sc WHERE round(score, 6) > 0)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def asked(spark, sf_dir):
    return vectors(spark, sf_dir).filter("doc % 10 = 3").withColumnRenamed("doc", "query_id")


DENSE = """
v AS (SELECT vec_id, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), nv AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id),
ds AS (SELECT a.vec_id AS query_id, b.vec_id AS doc, round(sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)), 6) AS score FROM v a JOIN v b ON a.d = b.d JOIN nv na ON na.vec_id = a.vec_id JOIN nv nb ON nb.vec_id = b.vec_id WHERE a.vec_id % 10 = 3 GROUP BY a.vec_id, b.vec_id),
de AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INT) AS rank FROM ds)"""


def short_bm25(s, d):
    return retrieval.bm25(questions(s, d), documents(s, d))


def fused(s, d):
    top = short_bm25(s, d)
    other = top.withColumn("rank", F.col("rank") * 2)
    return retrieval.fuse([top.filter("rank <= 10"), other.filter("doc % 2 = 0")])


def passages(s, d):
    """The lines of all documents that aren't blank, each a document of its own: doc_id is document:line."""
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(F.trim("text") != "")
    key = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.lpad(F.col("pos").cast("string"), 6, "0"))
    return lines.select(key.alias("doc_id"), "text", F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "").alias("tokens"))


def passage_contexts(s, d):
    """Contexts of the best passages of whole documents, in the operator's own budget."""
    rows = passages(s, d)
    top = retrieval.bm25(questions(s, d), rows).join(rows.select(F.col("doc_id").alias("doc"), F.col("text").alias("block")), "doc")
    return retrieval.budgeted_context(top.select("query_id", "rank", "block"))


PASSAGES = f"""
ln AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
passages AS (SELECT CAST(doc_id AS VARCHAR) || ':' || lpad(CAST(pos AS VARCHAR), 6, '0') AS doc_id, lang, text FROM ln WHERE trim(text) <> ''),{BM25.replace("FROM documents", "FROM passages")}"""


def alias_table(s, d):
    """Each word of a part name with up to four words that it stands beside, as synonyms."""
    rows = items(s, d).select(F.split(F.lower("p_name"), " ").alias("w")).select(F.get("w", F.lit(0)).alias("term"), F.get("w", F.lit(1)).alias("alias")).distinct()
    return split.top_k(rows.withColumn("score", F.lit(0.0)), 4, "term", "alias").select("term", "alias", F.col("rank").alias("position"))


def expanded(s, d):
    rows = items(s, d).select(F.col("item_id").alias("query_id"), "text", F.split(F.lower("p_name"), " ").alias("tokens"))
    return retrieval.expand(rows, alias_table(s, d)).select("query_id", "expanded")


def turns(s, d):
    """Conversation turns as lines: a user turn begins an item; turn 0 opens the block."""
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line_no"), "role", "text")
    return extract.notes_from_lines(rows, F.col("line_no") == 0, F.lit(None).cast("string"), F.col("role") == "user")


TURNS = """WITH w AS (SELECT conv_id AS doc, turn, text, role, sum(CASE WHEN turn = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations),
x AS (SELECT *, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY doc, block ORDER BY turn ROWS UNBOUNDED PRECEDING) AS note_number FROM w WHERE block > 0)
SELECT doc, block, CAST(NULL AS VARCHAR) AS heading, note_number, string_agg(text, ' ' ORDER BY turn) AS note_content FROM x WHERE note_number > 0 AND turn > 0 GROUP BY doc, block, note_number HAVING length(string_agg(text, ' ' ORDER BY turn)) > 10"""

NOTE = "CASE WHEN regexp_matches(text, '(?i)is\\s+excluded|does\\s+not\\s+include|excluding|except') THEN 'exclude' WHEN regexp_matches(text, '(?i)classify\\s+(in|under|to)\\s+heading\\s+\\d{4}|refer\\s+to\\s+heading') THEN 'redirect' WHEN regexp_matches(text, '(?i)includes?|including|comprise|classified\\s+(in|under)') THEN 'include' WHEN regexp_matches(text, '(?i)means?|defined\\s+as') THEN 'definition' ELSE 'general' END"
UNIT_SQL = "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(text) || ' ', '(\\d+(?:\\.\\d+)?)\\s*{u}[^a-z0-9%]')) AS n_{n}" for u, n in (("kg", "kg"), ("cm", "cm"))) + " FROM documents"


def note_table(s, d):
    """Notes for the gate: one a chapter, with the chapter's most frequent name words as keywords, its type by turn."""
    rows = items(s, d).select(F.substring("code", 1, 2).cast("int").alias("chapter_num"), F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("chapter_num", "word").agg(F.count(F.lit(1)).alias("score"))
    top = split.top_k(rows, 3, "chapter_num", "word").groupBy("chapter_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    kind = F.when(F.col("chapter_num") % 3 == 0, "exclude").when(F.col("chapter_num") % 3 == 1, "include").otherwise("redirect")
    return top.select(F.concat(F.lit("n"), "chapter_num").alias("note_id"), kind.alias("note_type"), F.array_join("keywords", " ").alias("note_content"), "keywords", F.when(kind == "redirect", "0100").alias("redirect_to"), F.lit(None).cast("int").alias("section_num"), "chapter_num", F.col("chapter_num").alias("position"))


def note_profiles(s, d):
    """Items by the name words and the notes' words that they match."""
    notes = note_table(s, d)
    keywords = notes.select(F.explode("keywords").alias("term")).select(t.normalize(F.col("term")).alias("term"))
    words = notes.select(F.explode(F.split(t.normalize(F.col("note_content")), " ")).alias("word"))
    return match.profiles(tokens_of(s, d), name_terms(s, d).union(keywords), words)


def gate_of(x, s, d):
    """The gate over the ten best codes of each profile."""
    cand = split.top_k(kb_of(x, s, d), 10).select("item_id", "code")
    scores = gate.note_scores(cand, x.items, note_table(s, d))
    return gate.gate_scores(scores, cand, gate.heading_terms(match.keyword_hits(x.items, cards(s, d), x.found)))


def gated(s, d):
    x = note_profiles(s, d)
    return x.of_items(gate_of(x, s, d))


GATE = KB + """,
cand AS (SELECT item_id, code FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, code) AS rank FROM kb) WHERE rank <= 10),
nw AS (SELECT CAST(left(code, 2) AS INT) AS chapter, term AS word, count(*) AS score FROM occ GROUP BY 1, 2), nr AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY score DESC, word) AS r FROM nw),
note AS (SELECT chapter, list(word ORDER BY r) AS kws, CASE chapter % 3 WHEN 0 THEN 'exclude' WHEN 1 THEN 'include' ELSE 'redirect' END AS kind FROM nr WHERE r <= 3 GROUP BY chapter),
ns AS (SELECT c.item_id, c.code, kind, round(least(list_sum(list_transform(kws, lambda k: CASE WHEN contains(norm, k) THEN 0.3 WHEN list_contains(tokens, k) THEN 0.15 ELSE 0 END))
  + 0.2 * len(list_intersect(list_distinct(string_split(norm, ' ')), kws)) / len(list_distinct(string_split(norm, ' '))), 1), 6) AS score
  FROM cand c JOIN prep ON prep.item_id = c.item_id JOIN note ON note.chapter = CAST(left(c.code, 2) AS INT)),
ht AS (SELECT item_id, cards.code, round(least(sum(CASE WHEN substring THEN 0.1 ELSE 0.05 END), 1), 6) AS heading_term FROM khits JOIN cards ON khits.keyword = cards.keyword GROUP BY item_id, cards.code),
ga AS (SELECT c.item_id, c.code, coalesce(CASE WHEN kind = 'include' THEN score END, 0) AS include_support, coalesce(CASE WHEN kind = 'exclude' THEN -score END, 0) AS exclude_conflict, coalesce(CASE WHEN kind = 'redirect' THEN -score END, 0) AS redirect_penalty,
  CASE WHEN kind = 'redirect' AND score > 0 THEN '0100' END AS redirect_to, coalesce(heading_term, 0) AS heading_term FROM cand c LEFT JOIN ns ON c.item_id = ns.item_id AND c.code = ns.code LEFT JOIN ht ON ht.item_id = c.item_id AND ht.code = c.code),
gs AS (SELECT *, round(heading_term + include_support + exclude_conflict + redirect_penalty, 6) AS total, NOT (exclude_conflict < -0.7 OR (redirect_to IS NOT NULL AND redirect_penalty < -0.8)) AS passed FROM ga)"""


def risks(s, d):
    pred = predictions(s, d)
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    rows = pred.groupBy("item_id").agg(at(1).alias("p1"), at(2).alias("p2"))
    i = F.col("item_id")
    return gate.risk(rows.withColumns({"essence_applied": i % 3 == 0, "missing_axes": (i % 4).cast("int"), "case_conflict": i % 5 == 0, "divergent_rules": i % 2 == 0}))


RISK = PRED + """, p AS (SELECT a.item_id, a.score AS p1, b.score AS p2 FROM pred a JOIN pred b ON a.item_id = b.item_id AND a.rank = 1 AND b.rank = 2),
rs AS (SELECT item_id, CASE WHEN p1 - p2 < 0.15 THEN 3.0 WHEN p1 - p2 < 0.3 THEN 1.5 ELSE 0 END + CASE WHEN item_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN item_id % 4 >= 2 THEN 1.5 * (item_id % 4) ELSE 0 END + CASE WHEN item_id % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS risk_score FROM p),
rl AS (SELECT *, CASE WHEN risk_score >= 5 THEN 'HIGH' WHEN risk_score >= 2.5 THEN 'MED' ELSE 'LOW' END AS risk_level FROM rs)"""


def bucketed(s, d):
    pred = predictions(s, d)
    truth = pred.filter("rank = 1").select("item_id", "true_code", F.concat(F.lit("item "), F.repeat(F.lit("x"), (F.col("item_id") % 30).cast("int"))).alias("text"))
    counts = truth.filter("item_id % 8 = 0").groupBy(F.col("true_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    facts = truth.select("item_id", (F.col("item_id") % 6 != 0).alias("sufficient"))
    return diagnostics.buckets(truth, pred.select("item_id", "code", "score", "rank"), counts, facts)


BUCKETS = PRED + """, tr AS (SELECT true_code, count(*) AS n FROM pred WHERE rank = 1 AND item_id % 8 = 0 GROUP BY true_code),
it AS (SELECT item_id, any_value(true_code) AS true_code, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS gap, min(CASE WHEN code = true_code THEN rank END) AS hit FROM pred GROUP BY item_id),
bk AS (SELECT 'short_text' AS bucket, hit FROM it WHERE 5 + item_id % 30 < 20 UNION ALL SELECT 'rare_class', hit FROM it LEFT JOIN tr ON it.true_code = tr.true_code WHERE coalesce(n, 0) < 5
  UNION ALL SELECT 'ambiguous', hit FROM it WHERE gap < 0.1 UNION ALL SELECT 'fact_insufficient', hit FROM it WHERE item_id % 6 = 0)
SELECT bucket, count(*) AS n, """ + ", ".join(f"sum(CAST(coalesce(hit <= {k}, FALSE) AS INT)) AS top{k}" for k in (1, 3, 5)) + " FROM bk GROUP BY bucket"

FEATURE_NAMES = ["f_ml", "f_lexical", "f_card_hits", "f_rule_inc_hits", "f_rule_exc_hits", "f_note_support_sum"]


def evidence(s, d):
    ev = table(s, d, "events")
    return ev.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("kind"))


def vector_items(s, d):
    name = F.concat(F.lpad((F.floor(F.col("label") / 3) + 1).cast("string"), 2, "0"), F.lpad(F.col("label").cast("string"), 2, "0"))
    return table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), name.alias("code"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def vector_model(s, d):
    rows = vector_items(s, d)
    guess = models.predict(models.fit_vectors(rows.filter("item_id % 5 <> 0")), rows.filter("item_id % 5 = 0").select("item_id", "v"))
    return metrics.top_k_accuracy(guess.join(rows.select("item_id", F.col("code").alias("true_code")), "item_id"))


def tfidf_model(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("code"))
    guess = models.predict(models.fit_tfidf(rows.filter("item_id % 5 <> 0")), rows.filter("item_id % 5 = 0").select("item_id", "text"), 3)
    return metrics.top_k_accuracy(guess.join(rows.select("item_id", F.col("code").alias("true_code")), "item_id"), (1, 2, 3))


def ranker(s, d):
    pred = predictions(s, d)
    rows = pred.select(F.col("item_id").alias("query_id"), F.col("code").alias("doc_id"), (F.col("true_code") == F.col("code")).cast("int").alias("label"), F.col("score").alias("f_score"), F.col("rank").cast("double").alias("f_rank"))
    parts = split.group_split(rows)
    fitted = models.fit_ranker(parts.filter("split = 'train'"), ["f_score", "f_rank"])
    return metrics.ndcg(models.rank(fitted, parts.filter("split = 'test'")))


def class_docs(s, d):
    return documents(s, d).select("doc_id", "tokens", F.col("lang").alias("label"))


QUERIES = {
    "j14_bm25": (short_bm25, f"WITH {BM25} SELECT * FROM bm WHERE rank <= 30"),
    "r2_class_bm25": (lambda s, d: retrieval.class_bm25(questions(s, d), class_docs(s, d), 3), f"WITH {BM25}, c AS (SELECT query_id, lang AS label, round(greatest(max(score), 0), 6) AS score FROM sc JOIN dt ON dt.doc_id = sc.doc GROUP BY query_id, lang), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS INT) AS rank FROM c QUALIFY rank <= 3) SELECT query_id, label, score, rank, round(exp(score - max(score) OVER (PARTITION BY query_id)) / sum(exp(score - (SELECT max(r2.score) FROM r r2 WHERE r2.query_id = r.query_id))) OVER (PARTITION BY query_id), 6) AS p FROM r"),
    "j12_dense": (lambda s, d: retrieval.dense(asked(s, d), vectors(s, d), 10), f"WITH {DENSE} SELECT * FROM de WHERE rank <= 10"),
    "j16_fusion": (fused, f"WITH {BM25}, l AS (SELECT query_id, doc, rank FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, doc, rank * 2 FROM bm WHERE rank <= 30 AND doc % 2 = 0), f AS (SELECT query_id, doc, round(sum(1 / (60 + rank)), 6) AS score FROM l GROUP BY query_id, doc) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INT) AS rank FROM f QUALIFY rank <= 20"),
    "j15_expand": (expanded, f"WITH {ITEMS}, a AS (SELECT DISTINCT string_split(lower(p_name), ' ')[1] AS term, string_split(lower(p_name), ' ')[2] AS alias FROM items), ar AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY alias) AS position FROM a), w AS (SELECT item_id, unnest(string_split(lower(p_name), ' ')) AS term, unnest(range(len(string_split(lower(p_name), ' ')))) AS pos FROM items), m AS (SELECT item_id, string_agg(alias, ' ' ORDER BY pos, position) AS more FROM w JOIN ar ON w.term = ar.term WHERE position <= 3 GROUP BY item_id) SELECT items.item_id AS query_id, concat_ws(' ', text, more) AS expanded FROM items LEFT JOIN m ON m.item_id = items.item_id"),
    "g35_context_passages": (passage_contexts, f"WITH {PASSAGES}, b AS (SELECT query_id, rank, text AS block FROM bm JOIN passages ON doc = doc_id WHERE rank <= 30), c AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM b) SELECT query_id, count(*) AS blocks, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM c WHERE total <= 3600 GROUP BY query_id"),
    "x28_note_types": (lambda s, d: table(s, d, "documents").select("doc_id", extract.note_type(F.col("text")).alias("note_type")), f"SELECT doc_id, {NOTE} AS note_type FROM documents"),
    "x31_notes_from_lines": (turns, TURNS),
    "x3_quantities": (lambda s, d: extract.quantities(table(s, d, "documents")).select("doc_id", F.size(F.filter("quantities", lambda x: x["unit"] == "kg")).alias("n_kg"), F.size(F.filter("quantities", lambda x: x["unit"] == "cm")).alias("n_cm")), UNIT_SQL),
    "j9_gate_scores": (gated, f"WITH {GATE} SELECT * FROM gs"),
    "j10_gate": (lambda s, d: gate.apply_gate(gated(s, d)), f"WITH {GATE} SELECT item_id, code, FALSE AS redirected, CAST(NULL AS DOUBLE) AS fixed_score FROM gs WHERE passed UNION ALL SELECT DISTINCT item_id, redirect_to, TRUE, 0.5 FROM gs g WHERE redirect_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gs h WHERE h.item_id = g.item_id AND h.code = g.redirect_to)"),
    "g24_risk": (lambda s, d: risks(s, d).select("item_id", "risk_score", "risk_level"), f"WITH {RISK} SELECT * FROM rl"),
    "g26_decision": (lambda s, d: gate.decision(predictions(s, d), risks(s, d)).select("item_id", "status", "confidence"), f"WITH {RISK} SELECT rl.item_id, CASE WHEN risk_level = 'HIGH' THEN 'REVIEW' ELSE 'AUTO' END AS status, p1 AS confidence FROM rl JOIN p ON rl.item_id = p.item_id"),
    "a29_buckets": (bucketed, f"WITH {BUCKETS}"),
    "a32_usage": (lambda s, d: diagnostics.usage(evidence(s, d)), "WITH p AS (SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT count(DISTINCT user_id) AS items FROM events) SELECT kind, round(count(*) / any_value(items), 6) AS usage_rate, round(sum(n) / any_value(items), 6) AS mean FROM p, t GROUP BY kind"),
    "a33_latency": (lambda s, d: diagnostics.latency(table(s, d, "events"), "value"), "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events"),
    "a4_kb_statistics": (lambda s, d: diagnostics.kb_statistics(cards(s, d)), f"WITH {BASE}, k AS (SELECT code, count(DISTINCT keyword) AS k FROM cards GROUP BY code) SELECT count(*) AS codes, count(DISTINCT left(code, 2)) AS chapters, round(avg(k), 6) AS mean_keywords, (SELECT count(DISTINCT keyword) FROM cards) AS keywords FROM k"),
    "a43_feature_distribution": (lambda s, d: diagnostics.feature_distribution(all_features(s, d), FEATURE_NAMES).select("feature", "mean", "p95", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), "nonzero"), f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 6) AS p95, round(min({c}), 6) AS least, round(max({c}), 6) AS most, round(avg(CAST({c} <> 0 AS INT)), 6) AS nonzero FROM feat" for c in FEATURE_NAMES)),
    "r3_tfidf_classifier": (tfidf_model, None),
    "r4_vector_classifier": (vector_model, None),
    "r8_ranker": (ranker, None),
}
