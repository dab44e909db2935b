"""Bundles of figures against a count in Python; a whole run."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from taxonaut.functions.text import normalize, tokenize
from taxonaut.operators import evaluation

PRED = "model string, item_id int, code string, subcode string, score double, rank int"
TRUTH = "item_id int, true_code string, true_subcode string, bucket string"


def table(seed=1):
    rng = random.Random(seed)
    truth = [(i, f"0{rng.randrange(4)}0{rng.randrange(3)}", "", rng.choice(["a", "b", None])) for i in range(60)]
    truth = [(i, c, c + str(rng.randrange(2)), b) for i, c, _, b in truth]
    preds = []
    for m in "xy":
        for i, *_ in truth:
            codes = rng.sample([f"0{a}0{b}" for a in range(4) for b in range(3)], rng.choice([0, 1, 2, 6]))
            scores = sorted((round(rng.random() * 1.1, 3) for _ in codes), reverse=True)
            preds += [(m, i, c, c + str(rng.randrange(2)), s, r + 1) for r, (c, s) in enumerate(zip(codes, scores))]
    return preds, truth


def test_bundle(spark):
    preds, truth = table()
    got = {(r.model, r.table, r.value): r for r in evaluation.bundle(evaluation.outcomes(spark.createDataFrame(preds, PRED), spark.createDataFrame(truth, TRUTH))).collect()}
    cells = collections.defaultdict(list)
    for m in "xy":
        for i, c, s, b in truth:
            mine = sorted(p[5:] + p[2:5] for p in preds if p[0] == m and p[1] == i)
            p = [x[3] for x in mine]
            conf = min(max(p[0], 0), 1) if p else 0.0
            step = "none" if not p else "1" if len(p) == 1 else "3b" if p[0] - p[1] < 0.15 else "3a"
            one = ([x[1] for x in mine], [x[2] for x in mine], c, s, conf)
            for t, v in (("all", "all"), ("bucket", b or ""), ("step", step), ("bin", str(min(int(conf * 10), 9)))):
                cells[m, t, v].append(one)
    assert set(got) == set(cells)
    for key, rows in cells.items():
        mean = lambda f: sum(map(f, rows)) / len(rows)  # noqa: B023,E731
        r = got[key]
        assert r.n == len(rows)
        for k in (1, 3, 5):
            assert r[f"top{k}"] == pytest.approx(mean(lambda x: x[2] in x[0][:k]), abs=1e-6) and r[f"sub{k}"] == pytest.approx(mean(lambda x: x[3] in x[1][:k]), abs=1e-6)  # noqa: B023
        assert r.chapter == pytest.approx(mean(lambda x: x[0][:1] != [] and x[0][0][:2] == x[2][:2]), abs=1e-6)
        assert r.gap == pytest.approx(mean(lambda x: x[0][:1] == [x[2]]) - mean(lambda x: x[4]), abs=6e-5)
    ece = {r.model: r.ece for r in evaluation.calibration_of(evaluation.bundle(evaluation.outcomes(spark.createDataFrame(preds, PRED), spark.createDataFrame(truth, TRUTH)))).collect()}
    for m in "xy":
        assert ece[m] == pytest.approx(sum(got[k].n * abs(got[k].gap) for k in got if k[0] == m and k[1] == "bin") / 60, abs=1e-6)


def test_predictions_are_read_once(spark):
    preds, truth = table()
    plan = evaluation.bundle(evaluation.outcomes(spark.createDataFrame(preds, PRED), spark.createDataFrame(truth, TRUTH)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("score#") >= 1


def test_nothing(spark):
    preds, truth = (spark.createDataFrame([], s) for s in (PRED, TRUTH))
    assert evaluation.bundle(evaluation.outcomes(preds, truth)).count() == 0
    some = spark.createDataFrame(table()[1], TRUTH)
    assert evaluation.outcomes(preds, some).count() == 0


def test_run(spark):
    rows = [(i, f"0{i % 3}01", f"0{i % 3}010{i % 2}", f"{['red', 'green', 'blue'][i % 3]} thing {i}") for i in range(120)] + [(200, "0909", "090901", "odd")]
    items = spark.createDataFrame(rows, "item_id int, code string, subcode string, text string").withColumn("tokens", F.array_distinct(tokenize(normalize(F.col("text")))))
    predictions, truth = evaluation.run(items)
    seen = truth.count()
    out = {(r.table, r.value): r for r in evaluation.bundle(evaluation.outcomes(predictions, truth)).collect()}
    assert out["all", "all"].n == seen >= 9 and out["all", "all"].top1 == 1.0 and 0 < out["all", "all"].sub1 < 1 and ("bucket", "frequent") in out
