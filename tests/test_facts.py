"""Facts, questions, notes and contexts on small made-up rows."""

from pyspark.sql import functions as F

from taxonaut.operators import facts, retrieval


def test_card_facts_take_the_first_source(spark):
    cards = spark.createDataFrame([("0101", "냉동 기계", ["철 기계", None], ["냉동 고무"]), ("0102", None, None, None)], "code string, title string, includes array<string>, excludes array<string>")
    got = {(r.axis, r.value): (r.operator, r.hardness, r.source) for r in facts.card_facts(cards).collect()}
    assert got[("processing_state", "냉동")] == ("contains", "soft", "title")
    assert got[("material", "철")] == ("contains", "soft", "includes")
    assert got[("material", "고무")] == ("not_contains", "hard", "excludes")


def test_questions_follow_the_chapter_and_the_text(spark):
    rows = spark.createDataFrame([("0201", "용도"), ("9901", None), ("72", "x")], "code string, content string")
    got = {}
    for r in facts.question_templates(rows).orderBy("code", "position").collect():
        got.setdefault(r.code, []).append(r.key)
    assert got == {"0201": ["processing", "form", "use"], "9901": ["use", "material"]}


def test_subheading_notes_need_six_digits(spark):
    rows = spark.createDataFrame([(2, "subheading", None, ["010121", "0101"], "b"), (1, "chapter", "소호주", ["01012190"], "a"), (3, "chapter", None, ["010121"], "c")], "note_no int, level string, note_type string, codes array<string>, content string")
    assert [(r.code6, r.contents) for r in facts.subheading_notes(rows).collect()] == [("010121", ["a", "b"])]


def test_signal_section(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c", "d"], None, None, None, False), (2, None, None, None, None, None)], "item_id int, incomplete array<string>, mixture array<string>, multi_candidate array<string>, containers array<string>, note_like boolean")
    got = {r.item_id: r.section for r in facts.signal_context(rows).collect()}
    assert "(a, b, c)" in got[1] and got[1].startswith(facts.SIGNAL_HEAD) and got[2] == facts.NO_SIGNAL


def test_ranking_rows_leave_out_items_without_their_truth(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "item_id int, code string")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "item_id int, true_code string")
    gated = spark.createDataFrame([(2, "a", False)], "item_id int, code string, passed boolean")
    assert sorted(map(tuple, facts.ranking_rows(rows, labels, gated).collect())) == [(1, "a", 1), (1, "b", 0)]


def test_supplied_axes_replace_found_ones(spark):
    schema = "item_id int, axis string, values array<string>, confidence double"
    found = spark.createDataFrame([(1, "material", ["x"], 0.5), (2, "material", ["y"], 0.5), (2, "use", ["u"], 0.5)], schema)
    given = spark.createDataFrame([(1, "material", [], 0.9), (2, "material", ["z"], 0.9)], schema)
    got = facts.overlaid_axes(found, given).select("item_id", "axis", F.element_at("values", 1), "supplied").collect()
    assert sorted(map(tuple, got)) == [(1, "material", "x", False), (2, "material", "z", True)]


def test_trace_has_a_row_for_each_query_of_any_list(spark):
    one = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (1, 9, 6)], "query_id int, doc int, rank int")
    other = spark.createDataFrame([(2, 5, 1)], "query_id int, doc int, rank int")
    got = {r.query_id: (r.a, r.b) for r in retrieval.traced({"a": one, "b": other}).collect()}
    assert got == {1: ([8, 7], []), 2: ([], [5])}


def test_case_vectors_need_name_code_and_vector(spark):
    rows = spark.createDataFrame([(1, "x", "0101", [1.0]), (2, " ", "0101", [1.0]), (3, "x", "01", [1.0]), (4, "x", "0101", None), (5, None, "0101", [1.0])], "case_id int, name string, code string, vector array<double>")
    assert [r.case_id for r in retrieval.case_vectors(rows).collect()] == [1]
