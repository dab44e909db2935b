"""Queries of the evaluation metrics."""

from __future__ import annotations

from ..operators import metrics as m
from .fixtures import ITEMS, PRED, TOP1, items, predictions, predictions_sql

HITS = PRED + ", hits AS (SELECT item_id, true_code, min(CASE WHEN true_code = code THEN rank END) AS hit FROM pred GROUP BY item_id, true_code)"
CLASSES = TOP1 + """, long AS (SELECT true_code AS code, CAST(correct AS INT) AS tp, 0 AS fp, CAST(NOT correct AS INT) AS fn FROM top1
  UNION ALL SELECT code, 0, CAST(NOT correct AS INT), 0 FROM top1),
sums AS (SELECT code, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM long GROUP BY code),
cls AS (SELECT code, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp + fn AS support, tp, fp, fn FROM sums)"""
CONF = TOP1 + """, conf AS (SELECT *, CASE WHEN score > 1 OR score < 0 THEN 1 / (1 + exp(-score)) ELSE score END AS p, CAST(correct AS INT) AS y FROM top1)"""


def bins(n: int) -> str:
    return CONF + f""", b AS (SELECT CAST(least(floor(p * {n}), {n - 1}) AS INT) AS bin, count(*) AS n, avg(y) AS a, avg(p) AS c FROM conf GROUP BY 1),
every AS (SELECT CAST(range AS INT) AS bin FROM range({n})),
bins AS (SELECT every.bin, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS accuracy, round(coalesce(c, (every.bin + 0.5) / {n}), 6) AS confidence,
  round(coalesce(abs(a - c) * n / (SELECT count(*) FROM conf), 0), 6) AS contribution FROM every LEFT JOIN b ON every.bin = b.bin)"""


ROUTED = PRED + """, r0 AS (SELECT item_id, true_code, max(CASE WHEN rank = 1 THEN score END) AS confidence, coalesce(min(CASE WHEN true_code = code THEN rank END), 999) AS hit FROM pred GROUP BY item_id, true_code),
routed AS (SELECT item_id, confidence, CASE WHEN confidence >= 0.7 THEN 'AUTO' WHEN confidence >= 0.4 THEN 'ASK' ELSE 'REVIEW' END AS route, hit = 1 AS correct, hit <= 3 AS top3 FROM r0)"""
WRONG = TOP1 + """, wrong AS (SELECT *, left(true_code, 2) AS chapter, CASE WHEN left(true_code, 2) <> left(code, 2) THEN 'chapter_error' WHEN left(true_code, 4) <> left(code, 4) THEN 'heading_error' ELSE 'subheading_error' END AS type FROM top1 WHERE NOT correct)"""
GRID = ROUTED + """, g AS (SELECT a, r, round(a * 0.05, 2) AS auto, round(r * 0.05, 2) AS review FROM (SELECT range AS a FROM range(10, 19)), (SELECT range AS r FROM range(4, 18)) WHERE r < a),
met AS (SELECT auto, review, count(*) AS n, sum(CAST(confidence >= auto AS INT)) AS an, sum(CAST(confidence >= auto AND correct AS INT)) AS ay,
  sum(CAST(confidence < auto AND confidence >= review AS INT)) AS kn, sum(CAST(confidence < auto AND confidence >= review AND top3 AS INT)) AS kt,
  sum(CAST(confidence < review AS INT)) AS rn, sum(CAST(confidence < review AND top3 AS INT)) AS rt FROM routed, g GROUP BY auto, review),
grid AS (SELECT auto, review, round(CASE WHEN an > 0 THEN ay / an ELSE 0 END, 6) AS auto_accuracy, round(an / n, 6) AS auto_ratio,
  round(CASE WHEN kn > 0 THEN kt / kn ELSE 0 END, 6) AS ask_top3, round(CASE WHEN rn > 0 THEN rt / rn ELSE 0 END, 6) AS review_top3 FROM met)"""

TOPK = "SELECT count(*) AS n, " + ", ".join(f"round(avg(CAST(coalesce(hit <= {k}, FALSE) AS INT)), 6) AS top{k}" for k in (1, 3, 5)) + " FROM hits"
NDCG = PRED + """, s AS (SELECT item_id AS query_id, code AS doc_id, CAST(true_code = code AS INT) AS label, round(score, 2) AS score FROM pred WHERE rank <= 6),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, doc_id) AS i FROM s),
d AS (SELECT *, """ + ", ".join(f"avg(CASE WHEN r <= {k} THEN 1 / log2(r + 1) ELSE 0 END) OVER (PARTITION BY query_id, score) AS d{k}" for k in (1, 3, 5)) + """ FROM r),
q AS (SELECT query_id, count(*) AS docs, max(label) AS best, min(CASE WHEN label > 0 THEN r END) AS hit, """ + ", ".join(f"sum(label * d{k}) / nullif(sum(label * CASE WHEN i <= {k} THEN 1 / log2(i + 1) ELSE 0 END), 0) AS n{k}" for k in (1, 3, 5)) + """ FROM d GROUP BY query_id)
SELECT count(*) AS queries, """ + ", ".join(f"round(avg(n{k}), 6) AS ndcg{k}, round(avg(CAST(hit <= {k} AS INT)), 6) AS top{k}" for k in (1, 3, 5)) + " FROM q WHERE docs > 1 AND best > 0"


def status(pred):
    return m.routed(pred).select("item_id", m.F.col("route").alias("status"))


def ranking_rows(pred):
    return pred.filter("rank <= 6").selectExpr("item_id AS query_id", "code AS doc_id", "CAST(true_code = code AS INT) AS label", "round(score, 2) AS score")


def of(f, *args, **kw):
    """A metric of the standard predictions."""
    return lambda spark, sf_dir: f(predictions(spark, sf_dir), *args, **kw)


def codes(spark, sf_dir):
    return items(spark, sf_dir).select("code").distinct()


QUERIES = {
    "a6_topk_accuracy": (of(m.top_k_accuracy), f"WITH {HITS} {TOPK}"),
    "a7_candidate_recall": (of(m.top_k_accuracy, (5, 10, 20)), f"WITH {HITS} " + "SELECT count(*) AS n, " + ", ".join(f"round(avg(CAST(coalesce(hit <= {k}, FALSE) AS INT)), 6) AS top{k}" for k in (5, 10, 20)) + " FROM hits"),
    "a8_class_scores": (lambda s, d: m.class_scores(predictions(s, d)).selectExpr("code", "round(precision, 6) AS precision", "round(recall, 6) AS recall", "round(f1, 6) AS f1", "support"), f"WITH {CLASSES} SELECT code, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cls"),
    "a8_f1": (of(m.f1_summary), f"WITH {CLASSES} SELECT count(*) AS classes, " + ", ".join(f"round(avg({c}), 6) AS {c}_macro, round(sum({c} * support) / sum(support), 6) AS {c}_weighted" for c in ("precision", "recall", "f1")) + ", round(sum(tp) / sum(tp + fp), 6) AS f1_micro FROM cls"),
    "a9_coverage": (lambda s, d: m.coverage(predictions(s, d), codes(s, d)), f"WITH {ITEMS}, {TOP1} SELECT count(DISTINCT code) AS predicted, (SELECT count(DISTINCT code) FROM items) AS all_classes, round(count(DISTINCT code) / (SELECT count(DISTINCT code) FROM items), 6) AS coverage FROM top1"),
    "a10_accuracy_by_level": (of(m.accuracy_by_level), f"WITH {TOP1}, t AS (SELECT *, left(true_code, 2) AS chapter FROM top1) SELECT chapter, true_code AS code, sum(CAST(correct AS INT)) AS correct, count(*) AS total, count(DISTINCT true_code) AS codes, round(sum(CAST(correct AS INT)) / count(*), 6) AS accuracy FROM t GROUP BY ROLLUP (chapter, true_code) HAVING chapter IS NOT NULL"),
    "a13_calibration_bins": (of(m.calibration_bins), f"WITH {bins(10)} SELECT * FROM bins"),
    "a14_ece_brier": (of(m.calibration), f"WITH {CONF}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, sum(y) AS y, sum(p) AS p, sum(pow(p - y, 2)) AS b FROM conf GROUP BY 1) SELECT round(sum(abs(y - p)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier, sum(n) AS n FROM b"),
    "a16_reliability_curve": (of(m.reliability_curve), f"WITH {bins(10)} SELECT bin, round((bin + 0.5) / 10, 6) AS center, accuracy, n AS count FROM bins"),
    "a17_confidence_histogram": (of(m.confidence_histogram), f"WITH {CONF}, b AS (SELECT CAST(least(floor(p * 20), 19) AS INT) AS bin, sum(y) AS r, sum(1 - y) AS w FROM conf GROUP BY 1) SELECT CAST(range AS INT) AS bin, coalesce(r, 0) AS \"right\", coalesce(w, 0) AS wrong FROM range(20) LEFT JOIN b ON range = bin"),
    "a18_overconfidence": (of(m.overconfidence, 0.5), f"WITH {CONF} SELECT count(*) AS n_high, sum(y) AS n_right, count(*) - sum(y) AS n_wrong, round((count(*) - sum(y)) / count(*), 6) AS overconfidence_rate, round(sum(y) / count(*), 6) AS high_accuracy FROM conf WHERE score >= 0.5"),
    "a19_confidence_distribution": (of(m.confidence_distribution), f"WITH {TOP1} SELECT correct, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.75), 6) AS p75 FROM top1 GROUP BY correct"),
    "a19_separation": (of(m.separation), f"WITH {TOP1} SELECT round(avg(CASE WHEN correct THEN score END) - avg(CASE WHEN NOT correct THEN score END), 6) AS mean_diff FROM top1"),
    "p9_route": (of(m.routed), f"WITH {ROUTED} SELECT * FROM routed"),
    "a20_routing": (of(m.routing), f"WITH {ROUTED} SELECT route, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(avg(CAST(top3 AS INT)), 6) AS top3_rate, round(count(*) / (SELECT count(*) FROM routed), 6) AS ratio FROM routed GROUP BY route"),
    "a21_status_rates": (lambda s, d: m.status_rates(status(predictions(s, d))), f"WITH {ROUTED} SELECT count(*) AS n, " + ", ".join(f"round(avg(CAST(route = '{x}' AS INT)), 6) AS {x.lower()}_rate" for x in ("AUTO", "ASK", "REVIEW", "ABSTAIN")) + " FROM routed"),
    "a22_threshold_grid": (of(m.threshold_grid, 0.25, 0.1), f"WITH {GRID} SELECT * FROM grid WHERE auto_accuracy >= 0.25 AND auto_ratio >= 0.1"),
    "a22_best_thresholds": (of(m.best_thresholds, 0.25, 0.1), f"WITH {GRID} SELECT * FROM grid WHERE auto_accuracy >= 0.25 AND auto_ratio >= 0.1 ORDER BY auto_ratio DESC, auto, review LIMIT 1"),
    "a25_confusion_pairs": (of(m.confusion_pairs), f"WITH {WRONG} SELECT true_code, code, count(*) AS n, list_slice(list_sort(list(item_id)), 1, 5) AS examples FROM wrong GROUP BY true_code, code ORDER BY n DESC, true_code, code LIMIT 20"),
    "a26_error_summary": (of(m.error_summary), f"WITH {WRONG} SELECT type, chapter, count(*) AS n, sum(CAST(type = 'chapter_error' AS INT)) AS chapter_errors, sum(CAST(score >= 0.7 AS INT)) AS high, sum(CAST(score < 0.4 AS INT)) AS low, round(avg(score), 6) AS mean_confidence FROM (SELECT *, type AS t FROM wrong) GROUP BY GROUPING SETS ((type), (chapter), ())"),
    "a27_chapter_confusions": (of(m.chapter_confusions), f"WITH {WRONG}, c AS (SELECT chapter, left(code, 2) AS predicted, count(*) AS n FROM wrong GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY n DESC, predicted) AS position FROM c QUALIFY position <= 5"),
    "p13_failure_cases": (of(m.failure_cases, 20, "chapter_error"), f"WITH {WRONG} SELECT item_id, true_code, code, score, type FROM wrong WHERE type = 'chapter_error' ORDER BY score DESC, item_id LIMIT 20"),
    "a42_ndcg": (lambda s, d: m.ndcg(ranking_rows(predictions(s, d))), f"WITH {NDCG}"),
    "a12_improvement": (
        lambda s, d: m.improvement(m.as_long(m.top_k_accuracy(predictions(s, d))), m.as_long(m.top_k_accuracy(predictions(s, d, even=True)))),
        f"WITH {PRED}, {predictions_sql('pe', True)}, "
        + ", ".join(f"{x} AS (SELECT {', '.join(f'round(avg(CAST(coalesce(hit <= {k}, FALSE) AS INT)), 6) AS top{k}' for k in (1, 3, 5))} FROM (SELECT item_id, min(CASE WHEN true_code = code THEN rank END) AS hit FROM {p} GROUP BY item_id))" for x, p in (("a", "pred"), ("b", "pe")))
        + ", l AS ("
        + " UNION ALL ".join(f"SELECT 'top{k}' AS metric, a.top{k} AS value, b.top{k} AS base FROM a, b" for k in (1, 3, 5))
        + ") SELECT *, round(value - base, 6) AS absolute, round((value - base) / base, 6) AS relative FROM l",
    ),
}
