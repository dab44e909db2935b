"""Queries of evaluation bundles: two models over vectors, and a whole run over items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation
from ..sources.scratch import kept
from .fixtures import ITEMS, PRED, items, predictions, predictions_sql
from .match_queries import BASE, SPLIT, tokens_of
from .ranking_queries import NB


def two_models(s, d):
    """Guesses of both models with a subcode by rank, and what is true of each vector."""
    one = lambda name, even: predictions(s, d, even=even).select(F.lit(name).alias("model"), "item_id", "code", F.concat("code", (F.col("rank") % 3).cast("string")).alias("subcode"), "score", "rank", "true_code")
    every = one("all", False).unionByName(one("even", True).filter("item_id % 9 <> 0"))
    truth = one("all", False).filter("rank = 1").select("item_id", "true_code", F.concat("true_code", (F.col("item_id") % 3).cast("string")).alias("true_subcode"), F.substring("true_code", 1, 2).alias("bucket"))
    return every.drop("true_code"), truth


def bundle(s, d):
    return evaluation.bundle(evaluation.outcomes(*two_models(s, d)))


def calibration(s, d):
    return evaluation.calibration_of(bundle(s, d))


def run(s, d):
    it = kept(tokens_of(s, d).join(items(s, d).select("item_id", "code", "subcode"), "item_id"), "items")
    found, truth = (kept(x, n) for x, n in zip(evaluation.run(it), ("predictions", "truth")))
    return evaluation.bundle(evaluation.outcomes(found, truth))


def bundle_sql(pred: str, truth: str) -> str:
    """CTEs up to ``bu`` from predictions and truth of the same columns as in Spark."""
    share = lambda c: f"round(avg(CAST(coalesce({c}, FALSE) AS INT)), 6)"
    tops = ", ".join(f"{share(f'hit <= {k}')} AS top{k}" for k in (1, 3, 5)) + ", " + ", ".join(f"{share(f'sub_hit <= {k}')} AS sub{k}" for k in (1, 3, 5))
    return f"""
eo AS (SELECT m.model, t.item_id, t.true_code, t.bucket, min(CASE WHEN p.code = true_code THEN rank END) AS hit, min(CASE WHEN p.subcode = true_subcode THEN rank END) AS sub_hit, max(CASE WHEN rank = 1 THEN score END) AS p1, max(CASE WHEN rank = 2 THEN score END) AS p2, max(CASE WHEN rank = 1 THEN p.code END) AS first
  FROM {truth} t CROSS JOIN (SELECT DISTINCT model FROM {pred}) m LEFT JOIN {pred} p ON p.model = m.model AND p.item_id = t.item_id GROUP BY m.model, t.item_id, t.true_code, t.bucket),
ep AS (SELECT *, least(greatest(coalesce(p1, 0), 0), 1) AS confidence, coalesce(hit = 1, FALSE) AS correct, coalesce(left(first, 2) = left(true_code, 2), FALSE) AS chapter_hit, CASE WHEN p1 IS NULL THEN 'none' WHEN p2 IS NULL THEN '1' WHEN p1 - p2 < 0.15 THEN '3b' ELSE '3a' END AS step FROM eo),
eq AS (SELECT *, CAST(least(floor(confidence * 10), 9) AS INT) AS bin FROM ep),
er AS (SELECT *, 'all' AS tab, 'all' AS value FROM eq UNION ALL SELECT *, 'bucket', bucket FROM eq UNION ALL SELECT *, 'step', step FROM eq UNION ALL SELECT *, 'bin', CAST(bin AS VARCHAR) FROM eq),
bu AS (SELECT model, tab AS "table", value, count(*) AS n, {tops}, {share('chapter_hit')} AS chapter, round(avg(confidence), 4) AS confidence, round(avg(CAST(correct AS INT)) - avg(confidence), 4) AS gap FROM er GROUP BY model, tab, value)"""


MODELS = PRED + ", " + predictions_sql("pe", True) + """,
pm AS (SELECT 'all' AS model, item_id, code, code || CAST(rank % 3 AS VARCHAR) AS subcode, score, rank FROM pred UNION ALL SELECT 'even', item_id, code, code || CAST(rank % 3 AS VARCHAR), score, rank FROM pe WHERE item_id % 9 <> 0),
tm AS (SELECT item_id, true_code, true_code || CAST(item_id % 3 AS VARCHAR) AS true_subcode, left(true_code, 2) AS bucket FROM pred WHERE rank = 1),""" + bundle_sql("pm", "tm")
RUN = BASE + SPLIT[len(ITEMS):]
TRAIN = "items.item_id IN (SELECT item_id FROM split WHERE split = 'train' AND n >= 3)"
RUN += "," + NB.split("\nkbr AS", 1)[0].rstrip(",").replace("items.item_id % 5 <> 0", TRAIN).replace("FROM items WHERE item_id % 5 <> 0", f"FROM items WHERE {TRAIN}") + """,
te AS (SELECT items.* FROM items JOIN split ON split.item_id = items.item_id WHERE split = 'test' AND n >= 3), tn AS (SELECT code, subcode, count(*) AS n FROM items WHERE """ + TRAIN + """ GROUP BY code, subcode),
us AS (SELECT code, arg_min(subcode, -n * 1000000 + CAST(subcode AS BIGINT)) AS subcode, sum(n) AS size FROM tn GROUP BY code),
pm AS (SELECT 'naive_bayes' AS model, item_id, nbp.code, subcode, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, nbp.code) AS rank FROM nbp LEFT JOIN us ON us.code = nbp.code WHERE item_id IN (SELECT item_id FROM te) QUALIFY rank <= 5),
tm AS (SELECT item_id, te.code AS true_code, te.subcode AS true_subcode, CASE WHEN coalesce(size, 0) >= 10 THEN 'frequent' ELSE 'rare' END AS bucket FROM te LEFT JOIN us ON us.code = te.code),""" + bundle_sql("pm", "tm")

QUERIES = {
    "a34_bundle": (bundle, f"WITH {MODELS} SELECT * FROM bu"),
    "a34_calibration": (calibration, f"WITH {MODELS} SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(gap)) / sum(n), 6) AS ece FROM bu WHERE \"table\" = 'bin' GROUP BY model"),
    "a47_evaluation_run": (run, f"WITH {RUN} SELECT * FROM bu"),
}
