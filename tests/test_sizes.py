"""What keeps work and memory in proportion to the input: which rows meet, and how often a value is computed."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from taxonaut.functions.text import matched, once
from taxonaut.operators import attributes, axes, gate, models, profiles, ranking, requirements, retrieval_index, steps, subheadings
from taxonaut.plans import computed_queries


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_codes_meet_each_fact_of_a_scope_once(spark):
    rows = [(f"n{i}", "chapter_01", "material", "contains", "pvc", None, "soft", 0.8) for i in range(50)]
    facts = spark.createDataFrame(rows, "note_id string, scope string, axis string, operator string, value string, basis string, hardness string, confidence double")
    out = requirements.inherited_facts(spark.createDataFrame([("0101",), ("0102",)], "code string"), facts)
    assert [tuple(r) for r in out.select("code", "nearest", "note_id").orderBy("code").collect()] == [("0101", "chapter", "n0"), ("0102", "chapter", "n0")]
    assert re.search(r"Aggregate \[scope#", plan(out))


def test_subcodes_meet_items_without_their_notes(spark):
    subcodes = spark.createDataFrame([("010101", "0101", "", None, [], ["red gear", "red gear", "blue", ""], 0), ("010102", "0101", "", None, [], [], 40)], "subcode string, code string, title string, title_from string, keywords array<string>, notes array<string>, case_count long")
    items = spark.createDataFrame([(1, "red gear big", ["red", "gear", "big"]), (2, "red", ["red"])], "item_id long, norm string, tokens array<string>")
    out = subheadings.subcode_scores(items.selectExpr("item_id", "'0101' AS code"), subcodes, items, spark.createDataFrame([], "item_id long, axis string, values array<string>"))
    assert [tuple(r) for r in out.select("item_id", "subcode", "note_score", "case_score").orderBy("item_id", "subcode").collect()] == [(1, "010101", 1.0, 0.0), (1, "010102", 0.0, 1.0), (2, "010101", 0.5, 0.0), (2, "010102", 0.0, 1.0)]
    assert [tuple(r) for r in subheadings.note_weights(subcodes).collect()] == [("010101", {"red": 0.5, "gear": 0.5, "blue": 0.5})]
    assert "notes" not in plan(out)


def test_only_candidates_meet_materials(spark):
    candidates = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "a")], "item_id long, code string")
    flags = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, False)], "item_id long, incomplete boolean, mixture boolean")
    own = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "x")], "item_id long, material string")
    of = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "code string, material string")
    out = steps.flagged(candidates, flags, spark.createDataFrame([("a",)], "code string"), of, own)
    assert sorted(map(tuple, out.select("item_id", "code", "parts_penalty", "material_match").collect())) == [(1, "a", True, True), (1, "b", False, False), (2, "b", False, False), (3, "a", True, False)]
    joins = [j for j in re.findall(r"Join .*", plan(out)) if "material#" in j]
    assert joins and all("code#" in j for j in joins)


def test_a_value_used_twice_is_computed_once(spark):
    same = once(F.rand(), lambda v: F.array(v, v))
    assert all(r[0][0] == r[0][1] for r in spark.range(20).select(same).collect())


def test_items_with_the_same_tokens_are_scored_once(spark):
    items = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["y", "z"]), (3, "a", ["y", "x"]), (4, "b", ["q"])], "item_id long, code string, tokens array<string>")
    out = ranking.naive_bayes_top(ranking.naive_bayes(items.filter("item_id < 4")), items)
    rows = {i: [(r.code, r.score, r.rank) for r in sorted(out.collect(), key=lambda r: r.rank) if r.item_id == i] for i in (1, 2, 3, 4)}
    assert rows[1] == rows[3] and [c for c, *_ in rows[1]] == ["a", "b"] and [c for c, *_ in rows[2]] == ["b", "a"] and not rows[4]
    assert any("taxonaut-likeliest" in f for f in out.inputFiles())


def test_notes_that_hold_a_query_are_what_is_broadcast(spark):
    notes = spark.createDataFrame([("n1", "red gear", ["red", "gear"]), ("n2", "blue", ["blue"])], "note_id string, note_content string, keywords array<string>")
    queries = spark.createDataFrame([(1, "red gear"), (2, "big red"), (3, "blue"), (4, "none")], "item_id long, norm string")
    out = profiles.search_notes(queries, notes)
    assert sorted(map(tuple, out.select("item_id", "note_id", "score", "rank").collect())) == [(1, "n1", 2.5, 1), (2, "n1", 1.0, 1), (3, "n2", 1.5, 1)]
    assert re.search(r"Join Inner, \(norm#\d+ = norm#\d+\), rightHint=\(strategy=broadcast\)", plan(out))


def joins(df) -> list[str]:
    return re.findall(r"Join .*", plan(df))


def test_facts_meet_candidates_with_their_axes(spark):
    cand = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "item_id long, code string")
    facts = spark.createDataFrame([("a", "material", "eq", "x", "hard"), ("a", "use", "not_contains", "y", "hard"), ("b", "material", "eq", "x", "soft")], "code string, axis string, operator string, value string, hardness string")
    own = spark.createDataFrame([(1, "material", ["x"], 0.9), (1, "use", ["y"], 0.2), (2, "use", ["y"], 0.5)], "item_id long, axis string, values array<string>, confidence double")
    out = gate.fact_check(cand, facts, own)
    assert sorted(map(tuple, out.select("item_id", "code", "satisfied", "missing_hard", "missing_soft").collect())) == [(1, "a", 1, 0, 1), (1, "b", 1, 0, 0), (2, "a", 0, 2, 0), (3, "b", 0, 0, 1)]
    asked = gate.missing_fact_questions(cand, facts, own)
    assert sorted(map(tuple, asked.select("item_id", "axis", "value", "codes", "position").collect())) == [(2, "material", "x", 1, 1), (3, "material", "x", 1, 1)]
    for df in (out, asked):  # facts come last, and nothing is joined by axis
        assert any("taxonaut-with-axes" in f for f in df.inputFiles()) and not any("axis#" in j for j in joins(df))


def test_only_tables_of_codes_are_broadcast(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "item_id long, code string, rank int")
    index = spark.createDataFrame([("a", "completeness", ["parts"]), ("b", "completeness", ["complete"])], "code string, axis string, values array<string>")
    items, codes = spark.createDataFrame([(1, False), (2, False)], "item_id long, has_quant boolean"), spark.createDataFrame([("a",)], "code string")
    out = axes.conflicts(ranked, index, items, codes)
    assert sorted(map(tuple, out.collect())) == [(1, "completeness", 5.0), (1, "quantitative_rules", 1.0)]
    tags = spark.createDataFrame([(1, "completeness", ["parts"])], "item_id long, axis string, values array<string>")
    wide = axes.attributes(items, tags, spark.createDataFrame([(2, [1.0])], "item_id long, quantities array<double>"))
    assert sorted(map(tuple, wide.select("item_id", "completeness", "has_quant").collect())) == [(1, ["parts"], False), (2, [], True)]
    parts = attributes.parts_mismatch(ranked, spark.createDataFrame([(1, True)], "item_id long, is_parts boolean"), codes)
    assert sorted(map(tuple, parts.collect())) == [(1, "a", 0), (1, "b", 0), (2, "a", 1)]
    for df in (out, wide, parts):
        for j in joins(df):
            assert ("strategy=broadcast" if "code#" in j else "strategy=merge") in j


def test_true_codes_are_met_without_a_broadcast_of_items(spark):
    out = computed_queries.true_code_facts(spark, "/root/testdata/sf0.001")
    met = [j for j in joins(out) if "item_id#" in j]
    assert met and all("rightHint=(strategy=merge)" in j for j in met)
    assert out.count() == out.select("item_id").distinct().count() > 0


def test_questions_of_missing_axes_are_not_joined_by_axis(spark):
    items, texts = spark.createDataFrame([(1,), (2,)], "item_id long"), spark.createDataFrame([("material", "m?"), ("completeness", "c?"), ("use", "u?")], "axis string, question string")
    own = spark.createDataFrame([(1, "completeness", ["parts"], 0.9), (1, "material", ["x"], 0.2)], "item_id long, axis string, values array<string>, confidence double")
    out = axes.missing_axis_questions(items, own, texts)
    assert sorted(map(tuple, out.collect())) == [(1, 1, "material", "m?"), (1, 2, "use", "u?"), (2, 1, "completeness", "c?"), (2, 2, "material", "m?")]
    assert not any(re.search(r"axis#\d+ = axis#", j) for j in joins(out))


def test_few_cases_of_a_material_meet_items(spark):
    cases = [(c, f"c{(c * c + c // 7) % 5}", ["Red"] if c % 3 else ["blue", "RED"]) for c in range(300)] + [(300, None, ["red"])]
    texts = [(1, "red gear", "c0"), (2, "blue red", "c1"), (3, "blue", "c2"), (4, "none", "c3"), (5, "red", "c9")]
    given = spark.createDataFrame(cases, "case_id long, code string, materials array<string>")
    out = profiles.case_conflicts(spark.createDataFrame(texts, "item_id long, norm string, code string"), given)
    want = []
    for i, norm, code in texts:
        met = [(c, k) for c, k, ms in cases if k and k != code and any(m.lower() in norm for m in ms)]
        want += [(i, c, k, p + 1) for p, (c, k) in enumerate(sorted(met)[:5])]
    assert sorted(map(tuple, out.select("item_id", "case_id", "case_code", "position").collect())) == want
    kept = [f for f in out.inputFiles() if "taxonaut-first-cases" in f]
    assert spark.read.parquet(*kept).groupBy("term").count().filter("count > 10").isEmpty()


def test_only_needed_matches_get_their_surroundings(spark):
    codes = [f"{(i * 7) % 11 + 100:04d}" for i in range(400)]
    content = " ".join(f"{i} 제{c}호로 분류" for i, c in enumerate(codes))
    df = spark.createDataFrame([("0100", content), ("0101", None), ("0102", "제0105호\x01분류")], "code string, content string")
    first = lambda bodies: F.filter(F.array(F.lit(1), F.lit(3)), lambda i: i < F.size(bodies))
    some, every = (df.select(matched(F.col("content"), profiles.REFERENCES[0], 1, 20, p)).first()[0] for p in (first, None))
    assert some == [every[1], every[3]] and len(every) == 400
    got = [[(x.code, x.reason) for x in r[0]] for r in df.select(profiles.excludes(F.col("content"), F.col("code"))).collect()]
    at = [next(m for m in re.finditer(r"제(\d{4})호[로에]?\s*분류", content) if m[1] == c) for c in dict.fromkeys(c for c in codes if c != "0100")][:5]
    assert got == [[(m[1], content[max(0, m.start() - 50):m.end() + 50].strip()[:100]) for m in at], [], [("0105", "제0105호 분류")]]


def test_code_documents_take_few_rule_texts(spark):
    cards = spark.createDataFrame([("0101", "red gear", ["x1"], None, None, None)], "code string, title string, scope array<string>, includes array<string>, excludes array<struct<code:string,reason:string>>, key_attributes array<struct<name:string,values:array<string>>>")
    chunks = spark.createDataFrame([("0101", p, f"word{p} " * 40) for p in range(50)], "code string, position int, text string")
    out = retrieval_index.code_corpus(cards, chunks, cut=12)
    assert out.first().text == "red gear x1 word0 word0  word1 word1  word2 word2 "
    assert "WindowGroupLimit" in plan(out)


def test_grams_are_not_shuffled(spark):
    rows = [(i, ("red gear", "blau und rot", "vert et bleu")[i % 3] + " " + "abcdefgh"[i % 8], ("en", "de", "fr")[i % 3]) for i in range(60)] + [(99, "red", None)]
    items = spark.createDataFrame(rows, "item_id long, text string, code string")
    assert any("strategy=broadcast" in j for j in joins(models.balanced(items)) if "code#" in j)
    model = models.fit_tfidf(items)
    assert [type(s).__name__ for s in model.stages] == ["StringIndexerModel", "CountVectorizerModel", "IDFModel", "Normalizer", "LogisticRegressionModel"]
    best = {r.item_id: r.code for r in models.predict(model, items, 1).collect()}
    assert all(best[i] == c for i, _, c in rows if c)


def test_scores_of_a_row_are_shuffled_as_one_array(spark):
    rows = spark.createDataFrame([(q, c, int(c == "a"), float(q), 1.0) for q in range(4) for c in "abc"], "query_id int, code string, label int, x double, y double")
    out = ranking.importance(rows, lambda df: df.withColumn("score", F.col("x") + F.col("y")), ["x", "y"])
    text = out._jdf.queryExecution().executedPlan().toString()
    dealt = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*?), \d+\)", text)]
    assert "cell" in dealt and "query_id" in dealt and not any("i, r" in x or "cell, query_id" in x for x in dealt), dealt
