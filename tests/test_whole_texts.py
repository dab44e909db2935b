"""Queries over long documents: what lies far from the start of a text counts."""

import duckdb

from taxonaut.plans import text_queries


def test_classifier_sees_whole_texts(spark, tmp_path):
    """The classes differ after a common start of over 400 characters only."""
    start, tail = "same common start " * 30, {"en": "zebra quiz " * 40, "de": "hymn plow " * 40}
    rows = [(i, start + tail["en" if i // 5 % 2 else "de"], "en" if i // 5 % 2 else "de") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = text_queries.tfidf_model(spark, str(tmp_path)).first()
    assert (got.n, got.top1) == (12, 1.0)


def test_context_holds_late_passages(spark, tmp_path):
    """The matching passage lies 3000 characters into its document; the SQL agrees."""
    lines = [f"filler line number {'abcdefghij'[i % 10]} of many others" for i in range(80)]
    docs = [(i, "\n".join([*lines, "", f"the {w} passage is here", "after all"]), "en") for i, w in enumerate(["violet", "amber", "crimson"])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "violet passage"), (2, "crimson")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    query, sql = text_queries.QUERIES["g35_context_passages"]
    got = sorted(map(tuple, query(spark, str(tmp_path)).select("query_id", "blocks", "context").collect()))
    assert [c.split("\n\n")[0] for _, _, c in got] == ["the violet passage is here", "the crimson passage is here"]
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(sql).fetchall()) == got
