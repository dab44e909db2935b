"""Axes, composed scorers and profiles on literal frames."""

from pyspark.sql import functions as F

from taxonaut.operators import axes, match, profiles, scorers
from taxonaut.sources import scratch


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_contained_in_words_and_phrases(spark):
    items = spark.createDataFrame([(1, "red steel pipe"), (2, "redsteel"), (3, ""), (4, "a b")], "item_id int, norm string")
    terms = spark.createDataFrame([("steel",), ("red steel",), ("d s",), ("teel pi",), ("x",), ("e",), ("a b",), (" pipe",)], "term string")
    want = sorted((i, t) for i, n in ((1, "red steel pipe"), (2, "redsteel"), (3, ""), (4, "a b")) for t in ("steel", "red steel", "d s", "teel pi", "a b", " pipe") if t in n)
    assert rows(match.contained(items, terms), "item_id", "term") == want
    assert match.contained(items.limit(0), terms).count() == 0 and match.contained(items, terms.limit(0)).count() == 0


def test_contained_never_broadcasts_items(spark, tmp_path):
    """F1 to F20: files of items that compress well look small; the words that hold terms are broadcast, or nothing."""
    spark.range(3000).select(F.col("id").alias("item_id"), F.lit("red steel pipe").alias("norm")).write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    terms = spark.createDataFrame([("steel",), ("pip",), ("red st",)], "term string")
    for some, n in ((terms, 9000), (terms.filter("term <> 'red st'"), 6000)):
        out = match.contained(items, some)
        assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == n


def test_spread_bounds_the_rows_of_a_task(spark):
    sizes = [len(p) for p in scratch.spread(spark.range(2000).coalesce(1), "id", 100).rdd.glom().collect()]
    assert sum(sizes) == 2000 and len(sizes) == 20 and max(sizes) < 200
    assert scratch.spread(spark.range(0), "id").count() == 0


def test_axes(spark):
    tags = spark.createDataFrame([(1, "completeness", ["kit", "parts"], 0.8), (1, "material", ["steel"], 0.5), (2, "material", ["wood"], 0.2)], "item_id int, axis string, values array<string>, confidence double")
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    quantities = spark.createDataFrame([(2, [1.0])], "item_id int, quantities array<double>")
    out = axes.flags(axes.attributes(items, tags, quantities))
    assert rows(out, "item_id", "is_parts", "is_set", "is_ckd_skd", "has_quant") == [(1, True, True, False, False), (2, False, False, False, True), (3, False, False, False, False)]
    assert rows(axes.policy(items, tags), "item_id", "hard_axes", "ask") == [(1, ["completeness"], False), (2, [], True), (3, [], True)]
    asked = axes.missing_axis_questions(items, tags, spark.createDataFrame([(a, a + "?") for a in axes.PRIORITY], "axis string, question string"))
    assert rows(asked.filter("item_id = 1"), "number", "axis") == [(1, "quantitative_rules"), (2, "processing_state")]
    ranked = spark.createDataFrame([(1, "0101", 1), (1, "0102", 2)], "item_id int, code string, rank int")
    index = spark.createDataFrame([("0101", "completeness", ["parts"]), ("0102", "completeness", ["complete"]), ("0102", "material", ["steel"])], "code string, axis string, values array<string>")
    plain = spark.createDataFrame([(1, False)], "item_id int, has_quant boolean")
    clash = axes.conflicts(ranked, index, plain, spark.createDataFrame([("0102",)], "code string"))
    assert rows(clash, "axis", "score") == [("completeness", 5.0), ("quantitative_rules", 1.0)]


def test_scorers(spark):
    cand = spark.createDataFrame([(1, "0101", 2.0), (1, "0102", 3.0), (1, "0103", 0.1)], "item_id int, code string, score double")
    gated = spark.createDataFrame([(1, "0101", True, None), (1, "0102", False, "0200"), (1, "0103", True, None)], "item_id int, code string, passed boolean, redirect_to string")
    assert rows(scorers.kb_only(cand, gated), "rank", "code", "score") == [(1, "0101", 2.0), (2, "0200", 0.5), (3, "0103", 0.1)]
    ranked = cand.select("item_id", "code", F.element_at(F.array(F.lit(2), F.lit(1), F.lit(3)), F.substring("code", 4, 1).cast("int")).alias("rank"))
    answers = spark.createDataFrame([(1, 0.8, 0.2, False, False)], "item_id int, answer_raw double, best_rrf double, has_signals boolean, is_fallback boolean")
    out = scorers.post_processed(ranked, gated, answers).first()
    assert (out.best, out.codes, out.confidence) == ("0101", ["0101", "0103", "0102"], 0.78)
    assert scorers.conflict_rate(ranked, gated).first() == (1, 1, 1.0)


def test_profiles(spark):
    text = "이 호에는 사과, 배 를 분류한다. 다만 제0202호로 분류하는 것. 예: 포도, 감자. 재질이 철으로 된 냉동"
    one = spark.createDataFrame([("0101", "과일, 견과", text, None)], "code string, title string, content string, chapter string")
    card = profiles.cards(one).first()
    assert card.chapter == "01" and card.scope == ["사과"] and card.includes == ["과일", "견과", "포도", "감자"] and [x.code for x in card.excludes] == ["0202"]
    assert {a.name: a["values"] for a in card.key_attributes} == {"재질": ["철"], "가공상태": ["냉동"]}
    empty = spark.createDataFrame([("0101", None, None, None)], one.schema)
    assert profiles.cards(empty).first().scope == [] and profiles.cards(one.limit(0)).count() == 0
