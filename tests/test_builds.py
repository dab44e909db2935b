"""A knowledge base that is built again only where its inputs have changed."""

import pytest
from pyspark.sql import functions as F

from taxonaut.operators import builds, extract, profiles

TEXT = "이 호에는 {} 고기를 분류한다. 다만 제0203호로 분류하는 {} 가공품은 제외한다"


def sources(spark, changed=(), extra=()):
    rows = [(f"{c:02d}0{k}", "고기", TEXT.format(c, k) + (". 새로운 문장을 모두 포함한다" if f"{c:02d}0{k}" in changed else ""), f"{c:02d}") for c in (1, 2, 3) for k in (1, 2)] + list(extra)
    cases = [(1, "0101"), (2, "0201"), (3, "0201")]
    return {"commentary": (spark.createDataFrame(rows, "code string, title string, content string, chapter string").repartition(3), "chapter"), "cases": (spark.createDataFrame(cases, "case_id int, code string"), None)}


def tables():
    cut = lambda df: df.withColumn("chapter", F.substring("code", 1, 2))
    return [
        builds.Table("statistics", ["cards", "counts"], lambda t: t["cards"].join(t["counts"], "code", "left").agg(F.count(F.lit(1)).alias("cards"), F.sum("n").alias("cases"))),
        builds.Table("rules", ["commentary"], lambda t: cut(extract.chunks(t["commentary"])), "chapter"),
        builds.Table("cards", ["commentary"], lambda t: profiles.cards(t["commentary"]), "chapter"),
        builds.Table("counts", ["cases"], lambda t: t["cases"].groupBy("code").agg(F.count(F.lit(1)).alias("n"))),
    ]


def test_only_what_changed_is_built(spark, tmp_path):
    folder = str(tmp_path / "kb")
    first = builds.build(spark, sources(spark), tables(), folder)
    assert first == {"rules": ["01", "02", "03"], "cards": ["01", "02", "03"], "counts": ["all"], "statistics": ["all"]}
    assert builds.build(spark, sources(spark), tables(), folder) == {} and len(builds.manifests(spark, folder)) == 1
    before = builds.current(spark, folder)
    changed = builds.build(spark, sources(spark, ["0201"]), tables(), folder)
    assert changed.pop("statistics", ["all"]) == ["all"] and changed == {"rules": ["02"], "cards": ["02"]}
    after = builds.current(spark, folder)
    assert {k for k in before if before[k] != after[k]} <= {("rules", "02"), ("cards", "02"), ("statistics", "all")} and before["cards", "01"] == after["cards", "01"]
    whole = profiles.cards(sources(spark, ["0201"])["commentary"][0])
    same = ["code", "title", "scope", "includes", "excludes", "key_attributes"]
    assert sorted(map(str, builds.read(spark, folder, "cards").select(same).collect())) == sorted(map(str, whole.select(same).collect()))
    assert builds.read(spark, folder, "rules").filter("code = '0201'").count() == 3 and builds.read(spark, folder, "rules").count() == 13


def test_gone_new_and_versions(spark, tmp_path):
    folder = str(tmp_path / "kb")
    builds.build(spark, sources(spark), tables(), folder)
    more = builds.build(spark, sources(spark, extra=[("0901", "t", TEXT.format(9, 9), "09"), ("9999", "t", None, "")]), tables()[:1] + tables()[2:], folder)
    assert more["cards"] == ["", "09"] and builds.read(spark, folder, "cards").count() == 8 and builds.read(spark, folder, "statistics").first().cards == 8
    with pytest.raises(Exception, match="rules has rows of a part"):
        builds.build(spark, sources(spark, extra=[("9999", "t", TEXT, "")]), tables()[1:2], folder)
    assert "cards" not in builds.build(spark, sources(spark), tables()[:1] + tables()[2:], folder) and builds.read(spark, folder, "cards").count() == 6
    newer = tables()[:1] + tables()[2:]
    newer[2].version = "2"
    assert builds.build(spark, sources(spark), newer, folder)["counts"] == ["all"]


def test_a_failed_build_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "kb")
    builds.build(spark, sources(spark), tables(), folder)
    broken = tables()
    broken[0].make, broken[0].version = (lambda t: t["cards"].select(F.raise_error(F.lit("broken")).alias("x"))), "2"
    before = builds.current(spark, folder)
    with pytest.raises(Exception, match="broken"):
        builds.build(spark, sources(spark, ["0101"]), broken, folder)
    assert builds.current(spark, folder) == before and builds.read(spark, folder, "cards").count() == 6
    with pytest.raises(ValueError, match="statistics"):
        builds.build(spark, {k: v for k, v in sources(spark).items() if k != "cases"}, tables(), folder)


def test_fingerprints_ignore_order_and_see_copies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    assert builds.fingerprints(df, None) == builds.fingerprints(df.repartition(4).orderBy("x"), None)
    assert builds.fingerprints(df, None) != builds.fingerprints(df.union(df.filter("x = 1")), None)
    assert set(builds.fingerprints(df, "y")) == {"a", ""}
