"""Branches of answering by retrieval; the table of subcodes and their scores."""

import json

import pytest
from pyspark.sql import functions as F

from taxonaut.functions.text import normalize, tokenize
from taxonaut.operators import answering, subheadings


def answer(best, confidence=0.9, candidates=(), **more):
    return json.dumps({"best_code": best, "confidence": confidence, "candidates": [{"code": c, "score": 0.5} for c in candidates], **more})


@pytest.fixture(scope="module")
def result(spark):
    items = [(i, i == 8) for i in range(1, 12)]
    retrieved = [(i, c, 0.05 - r / 100, r) for i in range(1, 12) if i != 2 for r, c in ((1, "0101"), (2, "0202"), (3, "0303"))]
    answers = [
        (1, answer("0202", candidates=["0202", "0404"])), (2, answer("0101")), (3, None), (4, "no json"), (5, answer("0909")), (6, "```json\n" + answer("0101", need_info=True, questions=["a", "b"]) + "\n```"),
        (7, "so " + answer("0202", 0.2, ["0303", ""])), (8, answer("0101", 1.0)), (9, answer("0101")), (10, answer("", 0.5)),
    ]
    gated = [(9, "0101", False), (9, "0202", True), (3, "0101", False), (3, "0202", False), (3, "0303", False)]
    out = answering.run(
        spark.createDataFrame(items, "item_id int, has_signals boolean"), spark.createDataFrame(retrieved, "item_id int, code string, score double, rank int"),
        spark.createDataFrame(answers, "item_id int, raw string"), spark.createDataFrame(gated, "item_id int, code string, passed boolean"), n=2,
    )
    return {r.item_id: r for r in out.collect()}


def test_every_item_has_one_branch(result):
    assert {i: r.branch for i, r in result.items()} == {1: "answer", 2: "nothing", 3: "fallback", 4: "fallback", 5: "outside", 6: "answer", 7: "answer", 8: "answer", 9: "answer", 10: "outside", 11: "fallback"}


def test_candidates(result):
    assert result[1].codes == ["0202", "0404", "0101"]  # its own list, then the first two retrieved
    assert result[5].codes == ["0909", "0101", "0202"] and result[5].best == "0909"
    assert result[7].codes == ["0202", "0303", "0101"]  # the best code is put before a list that lacks it; blanks go
    assert result[4].codes == ["0101", "0202"] and result[10].codes == ["0101", "0202"] and result[11].is_fallback
    assert (result[2].best, result[2].codes, result[2].confidence, result[2].status) == ("", [], 0.0, "ABSTAIN")


def test_gate_and_confidence(result):
    assert result[9].codes == ["0202", "0101"] and result[9].best == "0202"
    weigh = lambda a, g=1.0: 0.5 * a + 0.3 * min(3 * 0.04, 1) + 0.2 * g
    assert result[1].confidence == pytest.approx(weigh(0.9), abs=1e-6) and result[8].confidence == pytest.approx(min(weigh(1.0), 0.9), abs=1e-6)
    assert result[3].confidence == pytest.approx(0.8 * weigh(0, 0.3), abs=1e-6) and result[4].confidence == pytest.approx(0.8 * weigh(0), abs=1e-6)


def test_status(result):
    assert result[6].status == "ASK" and result[6].need_info and result[6].n_questions == 2
    assert (result[1].status, result[3].status, result[8].status) == ("REVIEW", "ABSTAIN", "AUTO")


def test_subcode_table(spark):
    hierarchy = spark.createDataFrame([("010101", "Own", ["a"]), ("010102", " ", None), ("020201", None, ["b"]), ("990101", "", [])], "subcode string, title string, keywords array<string>")
    notes = spark.createDataFrame([("010102", ["n1", "n2"]), ("030301", ["n3"])], "code6 string, contents array<string>")
    cases = spark.createDataFrame([("010101",), ("010101",), ("040401",), ("0404",), (None,)], "subcode string")
    titles = spark.createDataFrame([("0101", "heading"), ("01", "chapter one"), ("02", "chapter two"), ("S1", "section one")], "code string, title string")
    got = {r.subcode: tuple(r)[1:] for r in subheadings.assembled(hierarchy, notes, cases, titles).collect()}
    assert got == {
        "010101": ("0101", "Own", "010101", ["a"], [], 2), "010102": ("0101", "heading", "0101", [], ["n1", "n2"], 0), "020201": ("0202", "chapter two", "02", ["b"], [], 0),
        "990101": ("9901", "", None, [], [], 0), "030301": ("0303", "section one", "S1", [], ["n3"], 0), "040401": ("0404", "section one", "S1", [], [], 1),
    }


def test_subcode_scores(spark):
    table = spark.createDataFrame(
        [("010101", "0101", "Steel pipe", ["Red", "iron rod"], ["red iron only", ""], 30), ("010102", "0101", "", [], [], 4), ("010103", "0101", "Wood", ["zz"], ["no match"], 0)],
        "subcode string, code string, title string, keywords array<string>, notes array<string>, case_count int",
    )
    items = spark.createDataFrame([(1, "A red pipe of iron"), (2, None)], "item_id int, text string").select("item_id", normalize(F.col("text")).alias("norm"), F.array_distinct(tokenize(F.col("text"))).alias("tokens"))
    axes = spark.createDataFrame([(1, "material", ["steel", "Wood"]), (1, "form", ["rod"])], "item_id int, axis string, values array<string>")
    cands = spark.createDataFrame([(1, "0101"), (2, "0101"), (1, "0909")], "item_id int, code string")
    scored = subheadings.subcode_scores(cands, table, items, axes)
    got = {(r.item_id, r.subcode): (r.keyword_score, r.note_score, r.material_score, r.case_score, r.score) for r in scored.collect()}
    assert got[1, "010101"] == (1.3, round(0.5 * 2 / 3, 6), 0.5, 1.0, round(1.3 + 2 * round(1 / 3, 6) + 0.75 + 1, 6))
    assert got[1, "010102"] == (0.0, 0.0, 0.0, 0.2, 0.2) and got[1, "010103"] == (0.0, 0.0, 0.5, 0.0, 0.75) and got[2, "010101"][:4] == (0.0, 0.0, 0.0, 1.0)
    assert [r.subcode for r in subheadings.resolved(scored, 2).filter("item_id = 1").orderBy("position").collect()] == ["010101", "010103"]
    assert subheadings.subcode_scores(cands.limit(0), table, items, axes).count() == 0
