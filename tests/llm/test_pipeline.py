import corpus_pipeline as p
from taxonaut.llm import jaccard_join, mixing, packing, quality_classifier

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scan", "source mixing", "best-fit packing"]
    stage = docs
    for name, f in p.STAGES[:-1]:
        after = f(spark, stage, SF).cache()
        assert after.schema.names == docs.schema.names, name
        if name == "quality classifier":
            model = quality_classifier.fit(stage, spark.read.parquet(f"{SF}/labels.parquet"), p.F.lit(True))
            want = {r.doc_id for r in quality_classifier.classify(stage, model).filter("predicted = 1").collect()}
            assert {r.doc_id for r in after.collect()} == want
        if name == "n-gram Jaccard join":
            want = {r.doc_id for r in jaccard_join.jaccard_components(stage).collect() if r.doc_id == r.component_id}
            assert sorted(r.doc_id for r in after.collect()) == sorted(want)
        stage = after
    packed = p.STAGES[-1][1](spark, stage, SF).collect()
    assert sum(r.length for r in packed) == packing.pack(stage).agg(p.F.sum("length")).first()[0] > 0


def test_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in p.STAGES[:-1]:
        docs = f(spark, docs, SF)
    assert docs.count() == 0 and p.STAGES[-1][1](spark, docs, SF).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows without an id, or that share one but have different texts, are documents of their own in every stage."""
    import collections
    import random

    rng = random.Random(8)
    good = lambda n=60: " ".join(rng.choice(["the", "there", "then", "other", "and", "hand", "with", "land"]) for _ in range(n))
    bad = lambda: " ".join(rng.choice(["XX!!", "YY!!", "ZZ!!", "QQ!!"]) for _ in range(60))
    known = [(i, good() if i < 40 else bad()) for i in range(80)]
    spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, good()), (None, good()), (None, bad()), (200, good()), (200, good()), (200, bad())]
    copy = odd[3][1] + " more"  # a near copy of a text whose id is less, without an id
    rows = [(i, t, "en", "s", len(t)) for i, t in [*known, *odd, (None, copy), odd[0], odd[4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    pairs = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    want = collections.Counter((r[0], r[1]) for r in rows if "!!" not in r[1])
    assert pairs(p.classify(spark, docs, str(tmp_path))) == want
    kept = p.deduplicate(spark, docs, str(tmp_path)).cache()
    assert pairs(kept) == collections.Counter({(r[0], r[1]) for r in rows if r[1] != copy})
    sized = mixing.mix(kept.withColumn("doc_id", p.row_key(*(p.F.col(c) for c in kept.columns)))).collect()
    mixed = pairs(p.mix(spark, kept, str(tmp_path)))
    assert sum(mixed.values()) == sum(int(r.taken / max(r.size, 1) + 0.5) for r in sized)
    assert {k for k in odd} <= set(mixed)
    doubled = pairs(p.mix(spark, kept.union(kept), str(tmp_path)))
    assert max(doubled.values()) <= 2 * 3 and set(odd) <= set(doubled)
