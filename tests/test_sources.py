import json

from taxonaut.operators import models
from taxonaut.sources import tables
from taxonaut.streaming import scoring


def lines(path, rows):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    return str(path)


def test_cases(spark, tmp_path):
    rows = [{"hs_code": "8471.30-0000", "hs_heading": "8471", "product_name": "pc"}, {"hs_code": "0101", "hs_heading": "1", "product_name": "horse"}, {"hs_code": "", "product_name": "none"}, {"hs_code": "0102", "product_name": "x"}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    got = tables.labelled_items(spark, str(tmp_path / "c.json")).orderBy("code").collect()
    assert [(r.code, r.subcode, r.code10) for r in got] == [("0101", None, None), ("8471", "847130", "8471300000")] and all(len(r.item_id) == 12 for r in got)


def test_reference_tables(spark, tmp_path):
    cards = lines(tmp_path / "cards", [{"hs4": "0101", "title_ko": "live horses", "includes": ["Mule (x)"], "scope": None}, "broken {"])
    assert sorted(map(tuple, tables.card_keywords(spark, cards).collect())) == [("0101", "horses"), ("0101", "live"), ("0101", "mule")]
    rules = lines(tmp_path / "rules", [{"hs4": "0101", "chunk_type": "exclude_rule", "text": "소는 제외한다 red cow", "signals": []}])
    r = tables.rules(spark, rules).first()
    assert (r.polarity, r.strength) == ("exclude", "hard") and "cow" in r.signals and r.rule_id.startswith("0101_exclude_rule_")
    words = lines(tmp_path / "t", [{"term": "pc", "aliases": ["computer"], "hs4_candidates": ["8471"]}, {"term": "cow", "hs4": "0102"}])
    assert sorted(map(tuple, tables.thesaurus_codes(spark, words).collect())) == [("computer", "8471"), ("cow", "0102"), ("pc", "8471")]
    assert sorted(map(tuple, tables.synonyms(spark, words).collect())) == [("computer", "pc", 1), ("pc", "computer", 1)]
    facts = lines(tmp_path / "f", [{"scope": "chapter_01", "required_facts": [{"axis": "material", "operator": "eq", "value": "x", "hardness": "hard"}]}])
    codes = spark.createDataFrame([("0101",), ("0201",)], "code string")
    assert [r.code for r in tables.required_facts(spark, facts, codes).collect()] == ["0101"]
    (tmp_path / "n.csv").write_text("No,HS code,Title\n1,8471.30,laptop\n2,84,short\n")
    assert [tuple(r) for r in tables.nomenclature(spark, str(tmp_path / "n.csv"), name="Title").collect()] == [("847130", "laptop")]


def test_sinks(spark, tmp_path):
    df = spark.range(7).withColumnRenamed("id", "a")
    assert tables.write_checked(df, str(tmp_path / "out")) == 7 and spark.read.parquet(str(tmp_path / "out")).count() == 7
    tables.write_report(df, str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("part-*"))) == 1


def test_stream(spark, tmp_path):
    spark.range(5).withColumnRenamed("id", "item_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id long").parquet(str(tmp_path / "in"))
    query = scoring.score_stream(stream, lambda rows: rows.selectExpr("item_id", "item_id * 2 AS score"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted((r.item_id, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(i, 2 * i) for i in range(5)]


def test_models(spark):
    rows = spark.createDataFrame([(i, f"{'red apple' if i % 2 else 'blue metal'} {i % 5}", "01" if i % 2 else "02") for i in range(40)], "item_id long, text string, code string")
    fitted = models.fit_tfidf(rows)
    got = {r.item_id: r.code for r in models.predict(fitted, rows, 1).collect()}
    assert all(got[i] == ("01" if i % 2 else "02") for i in range(40)) and models.classes(fitted, spark).count() == 2
    ranked = spark.createDataFrame([(i % 7, i, int(i % 3 == 0), float(i % 3 == 0), float(i % 5)) for i in range(80)], "query_id long, doc_id long, label int, f_a double, f_b double")
    ranker = models.fit_ranker(ranked, ["f_a", "f_b"])
    assert models.rank(ranker, ranked).filter("(score > 0.5) <> (label = 1)").count() == 0
    assert models.importances(ranker, ["f_a", "f_b"], spark).orderBy("gain", ascending=False).first().feature == "f_a"


def test_malformed_lines_are_counted(spark, tmp_path):
    good = [{"hs6": "010101", "hs4": "0101", "title_ko": "t", "keywords": ["a"], "subheading_notes": ["n"], "case_count": 3}, {"hs6": "010202"}, {"hs6": ""}]
    (tmp_path / "s").write_text("\n".join([*map(json.dumps, good), "{broken", '{"hs6": "030303", "case_count": "many"}', "", "[1"]) + "\n")
    rows, counts = tables.subheadings(spark, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in rows.collect()) == [("010101", "0101", "t", ["a"], ["n"], 3), ("010202", "0102", "", [], [], 0)]
    assert tuple(counts.first()) == (6, 3, 3)


def test_saved_predictions_keep_evidence(spark, tmp_path):
    top = [{"hs4": "0101", "score_ml": 0.5, "score_total": 0.9, "evidence": [{"kind": "card", "source_id": "c", "text": "x", "weight": 1.0}]}, {"hs4": "0202", "hs6": "020201", "score_ml": 0.4}]
    lines = [{"sample_id": "a", "true_hs4": "0101", "topk": top, "decision": {"status": "AUTO", "confidence": 0.9}}, {"sample_id": "b", "topk": []}]
    (tmp_path / "p").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    rows, counts = tables.saved_predictions(spark, str(tmp_path / "p"))
    got = {(r.item_id, r["rank"]): r for r in rows.collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", None)} and got["a", 1].score == 0.9 and got["a", 2].score == 0.4 and got["a", 2].subcode == "020201"
    assert got["a", 1].evidence[0].kind == "card" and got["a", 1].status == "AUTO" and tuple(counts.first()) == (3, 2, 1)
