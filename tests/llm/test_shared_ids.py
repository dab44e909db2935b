"""Null and repeated ids, and labels that say nothing: each has a defined result, and none makes a large group."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from taxonaut.llm import packing, quality_classifier, queries, vector_search


@pytest.mark.parametrize("rows", [[(None, "a good text here"), (1, ""), (2, "x y"), (3, "other words")], [(1, None), (2, "x y")], [(1, " \n\t"), (1, "")]])
def test_classifier_of_blank_labels(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, F.lit(True))
    out = quality_classifier.classify(docs, model).collect()
    assert [r.score for r in out if r.doc_id == 2] == [1.0] * sum(i == 2 for i, _ in rows)
    assert len(out) == len(rows) and all(r.score == 0 for r in out if r.doc_id == 1)
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.op10_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(isinstance(r.held_out, bool) for r in got)


def test_classifier_takes_one_row_an_id(spark):
    rng = random.Random(2)
    text = lambda good: " ".join(rng.choice(["the", "then", "other"] if good else ["XX!", "QQ!", "ZZ!"]) for _ in range(30))
    rows = [(i, text(i % 2)) for i in range(60)] + [(61, text(1)) for _ in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, F.lit(True), dims=8)
    assert len(model.vectors) == 61 and len(model.labels) == 61
    assert {r.predicted for r in quality_classifier.classify(docs.filter("doc_id = 61"), model).collect()} == {1}


@pytest.mark.parametrize("same_size", [True, False])
def test_packing_deals_null_and_repeated_ids(spark, same_size):
    rows = [(i, None if i % 2 else 7, 40 if same_size else 1 + i % 83) for i in range(10_000)]
    table = spark.createDataFrame(rows, "n long, doc_id long, tokens int").repartition(5)
    out = packing.pack(table, F.col("tokens"), capacities=(64, 128, 512), group_tokens=16_000, text="n").toPandas()
    assert sorted(out.length) == sorted(r[2] for r in rows) and out.doc_id.isna().sum() == 5000
    groups = collections.Counter(out.bin_id // (1 << 32))
    assert len(groups) > 15 and max(groups.values()) <= 2 * len(rows) / len(groups)
    inside = out.groupby("bin_id").agg(n=("length", "sum"), c=("capacity", "first"), k=("capacity", "nunique"))
    assert (inside.n <= inside.c).all() and (inside.k == 1).all()
    for _, g in out.sort_values("offset").groupby("bin_id"):
        assert (g.offset.iloc[1:].to_numpy() >= (g.offset + g.length).iloc[:-1].to_numpy()).all()


def test_search_lists_each_query_row(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-5, 6) for _ in range(6)]) for i in [*range(40), 20, 20, 7]]
    rows.append(rows[20])  # a full copy of a query row
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<int>, rank int").repartition(3)
    got = collections.defaultdict(list)
    for r in vector_search.top_k(table, F.col("vec_id") % 20 == 0, 9, query_block=2, row_block=7).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = collections.defaultdict(list)
    for k, (i, v) in enumerate(rows):
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(rows) if m != k)[:9]
            want[i] += [(r + 1, j, -s) for r, (s, j) in enumerate(found)]
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
