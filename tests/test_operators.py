"""Literal frames with expected values by hand."""

import math

import pytest
from pyspark.sql import functions as F

from taxonaut.functions import text as t
from taxonaut.operators import cascade, diagnostics, extract, gate, match, metrics, retrieval, split


def one(spark, column, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double'}" for i, v in enumerate(values)))
    return row.select(column.alias("x")).first().x


def test_normalize_and_tokens(spark):
    c = F.col("c0")
    assert one(spark, t.normalize(c), "Café (x) [y] {z} 55인치 TV-set, 10KG!") == "café 55 인치 tv set 10 kg"
    assert one(spark, t.normalize(c), None) == ""
    assert one(spark, t.tokenize(c), "the 냉장고abc parts of iron") == ["냉장고abc", "냉장고", "iron"]
    assert one(spark, t.tokenize(c, False), "a 가나") == ["a", "가나"]
    assert one(spark, t.keywords(c, 2, 2), "iron bolt iron nut") == ["iron", "bolt"]
    assert one(spark, t.hangul_tokens(c), "가 나다 abc라마") == ["나다", "라마"]
    assert one(spark, t.char_grams(c, 2), "abc") == ["ab", "bc"] and one(spark, t.char_grams(c, 4), "abc") == []
    assert one(spark, t.bm25_tokens(c), "ab cde") == ["ab", "cde", "ab", "cd", "de", "cde"]
    assert one(spark, t.padded_grams(c), "ab") == [" ", "a", "b", " ", " a", "ab", "b "]


def test_matching_functions(spark):
    assert one(spark, t.contains(F.col("c0"), F.col("c1")), "Steel Bolt", "bolt") and not one(spark, t.contains(F.col("c0"), F.col("c1")), "a b", "b")
    assert one(spark, t.match_method(F.col("c0"), F.col("c1")), "red steel", "steel pipe") == "token"
    assert one(spark, t.match_method(F.col("c0"), F.col("c1")), "red steel", "wood") is None
    assert one(spark, t.overlap(F.col("c0"), F.col("c1")), "red steel pipe", ["steel rod", "pipe"]) == ["steel", "pipe"]


def test_small_functions(spark):
    assert one(spark, t.truncate(F.col("c0"), 10), "abcdefgh ijkl") == "abcdefgh..." and one(spark, t.truncate(F.col("c0"), 10), "ab cdefghijkl") == "ab cdefghi..."
    assert one(spark, t.section_of(F.col("c0").cast("int")), 84.0) == 16 and one(spark, t.roman(F.col("c0")), "xiv") == 14
    assert one(spark, t.chapter_number(F.col("c0")), "제 84 류") == 84 and one(spark, t.section_number(F.col("c0")), "none") is None
    assert one(spark, t.error_type(F.col("c0"), F.col("c1")), "0101", "0102") == "heading_error"
    for op, want in ((">=", True), ("<=", True), (">", False), ("<", False), ("=", True), ("?", False)):
        assert one(spark, t.quantity_holds(F.col("c0"), F.lit(op), F.col("c1")), 5.0, 5.0) is want
    rows = spark.createDataFrame([("pump", [("steel", 0.6), ("brass", None)], "water", True, False)], "text string, m array<struct<name: string, ratio: double>>, u string, s boolean, e boolean")
    assert rows.select(t.enriched(F.col("text"), F.col("m"), F.col("u"), F.col("s"), F.col("e")).alias("x")).first().x == "pump | 재질: steel 60%, brass | 용도: water | 세트물품"


@pytest.fixture(scope="module")
def pred(spark):
    rows = [(1, "0101", "0101", 0.9, 1), (1, "0101", "0102", 0.1, 2), (2, "0102", "0101", 0.6, 1), (2, "0102", "0102", 0.4, 2), (3, "0201", "0102", 0.3, 1), (3, "0201", "0101", 0.2, 2), (4, "0102", "0102", 0.5, 1)]
    return spark.createDataFrame([(*r[:4], r[4]) for r in rows], "item_id long, true_code string, code string, score double, rank int")


def test_metrics(pred):
    r = metrics.top_k_accuracy(pred, (1, 2)).first()
    assert (r.n, r.top1, r.top2) == (4, 0.5, 0.75)
    f = {x.code: x for x in metrics.class_scores(pred).collect()}
    assert f["0101"].precision == 0.5 and f["0101"].recall == 1.0 and f["0201"].f1 == 0.0 and f["0102"].support == 2
    s = metrics.f1_summary(pred).first()
    assert math.isclose(s.f1_macro, round((2 / 3 + 0.5 + 0) / 3, 6)) and s.f1_micro == 0.5
    c = metrics.calibration(pred).first()
    assert math.isclose(c.ece, (0.1 + 0.6 + 0.3 + 0.5) / 4) and math.isclose(c.brier, (0.01 + 0.36 + 0.09 + 0.25) / 4)
    bins = metrics.calibration_bins(pred).collect()
    assert sum(b.n for b in bins) == 4 and math.isclose(sum(b.contribution for b in bins), c.ece) and bins[0].confidence == 0.05
    assert {x.route: x.n for x in metrics.routing(pred).collect()} == {"AUTO": 1, "ASK": 2, "REVIEW": 1}
    assert [(x.true_code, x.code, x.n, x.examples) for x in metrics.confusion_pairs(pred).collect()] == [("0102", "0101", 1, [2]), ("0201", "0102", 1, [3])]
    best = metrics.best_thresholds(pred, 0.9, 0.1).first()
    assert best.auto_ratio == 0.25 and best.auto == 0.65


def test_metrics_of_nothing(pred):
    none = pred.limit(0)
    assert metrics.top_k_accuracy(none).first().n == 0 and metrics.confusion_pairs(none).count() == 0 and len(metrics.calibration_bins(none).collect()) == 10
    assert metrics.best_thresholds(none).count() == 0 and metrics.overconfidence(none).first().overconfidence_rate == 0.0


def test_ndcg_shares_tied_discounts(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 0, 0.5), (2, "c", 1, 0.1), (3, "d", 0, 0.3), (3, "e", 0, 0.2)], "query_id long, doc_id string, label int, score double")
    r = metrics.ndcg(rows, (1, 3)).first()
    assert (r.queries, r.ndcg1) == (1, 0.5) and math.isclose(r.ndcg3, round((1 + 1 / math.log2(3)) / 2, 6))


def test_splits(spark):
    items = spark.createDataFrame([(i, f"{i % 4:04d}") for i in range(40)] + [(90, "9999"), (91, "9999")], "item_id long, code string")
    out = split.stratified_split(items).toPandas()
    assert len(out) == 40 and all((g.split == "train").sum() == 8 and (g.split == "val").sum() == 1 for _, g in out.groupby("code"))
    again = split.stratified_split(items.repartition(7)).toPandas()
    assert sorted(zip(out.item_id, out.split)) == sorted(zip(again.item_id, again.split))
    assert split.stratified_split(items, drop_rare=False).filter("code = '9999' and split = 'train'").count() == 2
    assert split.frequent_classes(items, 3).count() == 40 and split.sample(items, 5).count() == 5
    groups = split.group_split(items.withColumn("query_id", F.col("item_id") % 5))
    assert groups.groupBy("query_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    ranked = split.top_k(items.withColumn("score", F.lit(1.0)).withColumn("i", F.lit(1)), 3, "i", "code")
    assert [r.code for r in ranked.orderBy("rank").collect()] == ["0000"] * 3


def test_top_k_nests(pred):
    a, b = (set(split.top_k(pred.drop("rank"), k).select("item_id", "code").collect()) for k in (1, 2))
    assert a < b


def test_adaptive_k_and_reorder(spark):
    rows = spark.createDataFrame([(1, f"{i:04d}", float(-i)) for i in range(60)] + [(2, f"{i:04d}", float(-i)) for i in range(60)], "item_id long, code string, score double")
    flags = spark.createDataFrame([(1, True, False, False, 2, False)], "item_id long, incomplete boolean, mixture boolean, has_quantity boolean, n_materials int, is_set boolean")
    got = {r.item_id: r["count"] for r in split.adaptive_top_k(rows, flags).groupBy("item_id").count().collect()}
    assert got == {1: 55, 2: 30}
    ranked = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.88), (1, "c", 3, 0.2)], "item_id long, code string, rank int, score double")
    first = lambda d: d.filter("rank = 1").first().code
    assert first(split.break_ties(ranked)) == "b" and first(split.move_first(ranked, spark.createDataFrame([(1, "c")], "item_id long, target string"))) == "c"
    assert [r.code for r in split.move_last(ranked, F.col("code") == "a", F.lit(True)).orderBy("rank").collect()] == ["b", "c", "a"]


@pytest.fixture(scope="module")
def items(spark):
    return match.prepared(spark.createDataFrame([(1, "Red steel bolt"), (2, "blue wooden chair"), (3, None)], "item_id long, text string"))


def test_matching(spark, items):
    cards = spark.createDataFrame([("0101", "steel"), ("0101", "steel bolt"), ("0102", "chair"), ("0102", "bolt"), ("0103", "x")], "code string, keyword string")
    kb = {(r.item_id, r.code): r.score for r in match.kb_scores(items, cards, spark.createDataFrame([("red", "0103")], "term string, code string")).collect()}
    assert kb == {(1, "0101"): 2 + 1.0, (1, "0102"): 1.5, (1, "0103"): 1.5, (2, "0102"): 1.5}
    c = {(r.item_id, r.code): r for r in match.card_scores(items, cards).collect()}
    assert c[1, "0101"].card_hits == 2 and math.isclose(c[1, "0101"].score_card, math.log(3)) and math.isclose(c[1, "0101"].specificity, 2 * math.log(3))
    rules = spark.createDataFrame([("r1", "0101", "include_rule", "include", "soft", ["steel", "bolt"]), ("r2", "0101", "exclude_rule", "exclude", "hard", ["red"]), ("r3", "0102", "definition", "neutral", "soft", ["chair"])], "rule_id string, code string, chunk_type string, polarity string, strength string, signals array<string>")
    r = {(x.item_id, x.code): x for x in match.rule_scores(items, rules).collect()}
    assert r[1, "0101"].score_rule == 2 - 10 and r[1, "0101"].hard_exclude and r[1, "0101"].note_support == 2 and r[2, "0102"].score_rule == 0.5
    merged = match.merge_candidates(spark.createDataFrame([(1, "a", 2.0)], "item_id long, code string, score double"), spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4)], "item_id long, code string, score double"))
    assert {x.code: x.source for x in merged.collect()} == {"a": "kb+ml", "b": "ml"}
    scored = match.weighted_score(spark.createDataFrame([(1.0, 1.0, 2.0, 1, 1)], "f_ml double, score_card double, score_rule double, f_exclude_conflict int, f_note_hard_exclude int")).first()
    assert math.isclose(scored.score, 1 + 0.3 + 1.0 - 1.0 - 10)


def test_containment_finds_every_term(spark, items):
    terms = spark.createDataFrame([(w,) for w in ("ed", "steel", "d s", "chair", "zz", "r")], "term string")
    got = sorted(map(tuple, match.contained(items, terms).collect()))
    assert got == [(1, "d s"), (1, "ed"), (1, "steel"), (2, "chair")]


def test_bm25(spark):
    docs = spark.createDataFrame([(0, ["a", "b", "b"]), (1, ["a", "c"]), (2, ["d"])], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(7, ["b", "b", "c", "zz"]), (8, [])], "query_id long, tokens array<string>")
    got = {r.doc: r.score for r in retrieval.bm25(asked, docs).collect()}
    idf = math.log(2.5) - math.log(1.5)
    want = {0: 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)), 1: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2))}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_dense_blocks_agree(spark):
    rows = spark.createDataFrame([(i, [math.sin(i), math.cos(3 * i), 0.1]) for i in range(40)], "doc long, v array<double>")
    asked = rows.filter("doc < 7").withColumnRenamed("doc", "query_id")
    assert sorted(retrieval.dense(asked, rows, 5, block=6).collect()) == sorted(retrieval.dense(asked, rows, 5).collect())


def test_cascade(spark):
    first = spark.createDataFrame([(i, ["a", "b", "c"], [0.45, 0.4, 0.1], "ASK", 0.45) for i in range(6)] + [(9, ["a"], [0.95], "AUTO", 0.95)], "item_id long, codes array<string>, scores array<double>, status string, confidence double")
    second = spark.createDataFrame([(0, "a", 0.5, False), (1, "b", 0.5, False), (2, "z", 0.9, False), (3, "z", 0.5, False), (4, "b", 0.1, False), (5, "b", 0.9, True), (9, "b", 0.9, False)], "item_id long, answer string, answer_confidence double, is_fallback boolean")
    got = {r.item_id: r for r in cascade.run(first, second).collect()}
    assert [got[i].merge_reason for i in (0, 1, 2, 3, 4, 5, 9)] == ["same", "reorder", "novel_high", "novel_low", "low_confidence", "fallback", "direct"]
    assert got[0].confidence == 0.6 and got[1].codes == ["b", "a", "c"] and got[2].codes == ["z", "a", "b", "c"] and got[3].status == "REVIEW" and not got[9].escalate
    conf = cascade.answer_confidence(spark.createDataFrame([(0.8, 0.1, True, False, False), (1.0, 1.0, True, True, False), (1.0, 1.0, True, False, True)], "answer_raw double, best_rrf double, gate_passed boolean, has_signals boolean, is_fallback boolean"))
    assert [r.calibrated for r in conf.collect()] == [0.69, 0.9, 0.5]


def test_extraction(spark):
    cases = spark.createDataFrame([("1", "제5515.12-9000호", None, "통칙 제1호 및 제6호에 따라 분류됨. 제5516호가 아니라 제5515호로 분류함", ["wool"]), ("2", None, "8471", None, [])], "case_id string, decision_code string, heading string, rationale string, materials array<string>")
    a, b = extract.normalized_cases(cases).orderBy("case_id").collect()
    assert (a.code4, a.code6, a.code10) == ("5515", "551512", "5515129000") and a.applied_rules == ["GRI1", "GRI6"] and a.rejected_codes == ["5516"] and a.confidence == 1.0
    assert (b.code4, b.code6, b.confidence) == ("8471", "", 0.2)
    notes = spark.createDataFrame([("제8471호로 분류한다 '기계' ",), ("다음을 제외한다 제84류",), ("is defined as x",)], "note_content string")
    assert [(r.note_type, r.redirect_to) for r in extract.notes(notes).collect()] == [("redirect", "8471"), ("exclude", "8400"), ("definition", None)]
    chunk = extract.chunks(spark.createDataFrame([("0101", "이 호에는 말을 분류한다 말과 노새. 다만 제0102호의 소는 제외한다 정말로. 일반적인 문장입니다 아무 내용")], "code string, content string")).orderBy("position").collect()
    assert [(c.chunk_type, c.target_code, c.strength) for c in chunk] == [("definition", None, "soft"), ("exclude_rule", "0102", "hard")]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["제1류", "주:", "1. 첫째 항목은 다음과 같다", "이어지는 줄", "2. 둘째 항목의 내용이다", "제2류", "표"])], "doc string, line_no int, text string")
    heading = F.when(F.col("text").rlike("^제\\d+류$"), F.col("text"))
    got = extract.notes_from_lines(lines, F.col("text") == "주:", heading, F.col("text").rlike(r"^\d+\.")).orderBy("note_number").collect()
    assert [(r.heading, r.note_content) for r in got] == [("제1류", "1. 첫째 항목은 다음과 같다 이어지는 줄"), ("제1류", "2. 둘째 항목의 내용이다")]
    sig = extract.signals(spark.createDataFrame([("CKD kit 60 % cotton",), (None,)], "text string")).collect()
    assert sig[0].incomplete and sig[0].mixtures_n == 1 and not sig[1].incomplete
    sub = extract.subcodes(spark.createDataFrame([("8471.30-0000", "휴대용 computer", 1), ("847130", "other name", 2)], "code string, name string, position int"), spark.createDataFrame([("8471300000",), ("850110",)], "code string")).orderBy("subcode").collect()
    assert (sub[0].title, sub[0].keywords, sub[0].case_count) == ("휴대용 computer", ["computer", "name", "other", "휴대용"], 1) and sub[1].case_count == 1


def test_answers(spark):
    rows = spark.createDataFrame([('{"code": "1"}',), ('x ```json\n{"code": "2"}\n``` y',), ('so {"code": "3"} ok',), ("no",), (None,)], "a string")
    got = [r.x.code if r.x else None for r in rows.select(extract.parsed_answer(F.col("a"), "code string").alias("x")).collect()]
    assert got == ["1", "2", "3", None, None]


def test_gate_and_facts(spark, items):
    cand = spark.createDataFrame([(1, "0101"), (1, "0201"), (1, "0301")], "item_id long, code string")
    notes = spark.createDataFrame([("n1", "exclude", "red steel bolt", ["red", "steel", "bolt"], None, None, 1, 1), ("n2", "include", "chair", ["chair"], None, None, 2, 2), ("n3", "redirect", "red steel bolt", ["red", "steel", "bolt"], "0901", None, 3, 3)], "note_id string, note_type string, note_content string, keywords array<string>, redirect_to string, section_num int, chapter_num int, position int")
    scored = gate.gate_scores(gate.note_scores(cand, items, notes), cand)
    got = {r.code: r for r in scored.collect()}
    assert got["0101"].exclude_conflict == -1.0 and not got["0101"].passed and got["0201"].passed and not got["0301"].passed and got["0301"].redirect_to == "0901"
    assert sorted((r.code, r.redirected) for r in gate.apply_gate(scored).collect()) == [("0201", False), ("0901", True)]
    facts = spark.createDataFrame([("0101", "material", "contains", "steel", "soft"), ("0101", "use", "eq", "x", "hard"), ("0101", "form", "not_contains", "liquid", "hard")], "code string, axis string, operator string, value string, hardness string")
    axes = spark.createDataFrame([(1, "material", ["Steel"], 0.9), (1, "form", ["liquid"], 0.1)], "item_id long, axis string, values array<string>, confidence double")
    r = gate.fact_check(cand, facts, axes).first()
    assert (r.satisfied, r.missing_hard, r.missing_soft, r.sufficient) == (1, 1, 1, False)
    assert [x.axis for x in gate.missing_fact_questions(cand, facts, axes).orderBy("position").collect()] == ["material", "use"]
    assert gate.uncertainty(axes, items).filter("item_id = 1").first().uncertainty_penalty == 0.4


def test_risk_and_decision(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.45, True, 0, False, False), (2, 0.9, 0.1, False, 3, False, True), (3, 0.9, None, False, 0, False, False)], "item_id long, p1 double, p2 double, essence_applied boolean, missing_axes int, case_conflict boolean, divergent_rules boolean")
    got = {r.item_id: r for r in gate.risk(rows).collect()}
    assert [(got[i].risk_score, got[i].risk_level) for i in (1, 2, 3)] == [(5.0, "HIGH"), (5.5, "HIGH"), (0.0, "LOW")] and got[1].risk_reasons == ["very_small_gap", "essential_character"]
    ranked = spark.createDataFrame([(1, "a", 1, 0.5), (3, "b", 1, 0.9)], "item_id long, code string, rank int, score double")
    assert {r.item_id: r.status for r in gate.decision(ranked, gate.risk(rows)).collect()} == {1: "REVIEW", 2: "ASK", 3: "AUTO"}


def test_permuted_feature_keeps_its_values(spark):
    rows = spark.createDataFrame([(i, float(i), 1) for i in range(500)], "row_id long, f double, label int")
    out = diagnostics.shuffled_feature(rows, "f", 3)
    assert sorted(r.f for r in out.collect()) == [float(i) for i in range(500)] and out.filter("f <> row_id").count() > 100
