"""Items that match alike are scored once, with the results of scoring each."""

from pyspark.sql import functions as F

from taxonaut.operators import diagnostics, facts, gate, match, scorers
from taxonaut.plans import ranking_queries, registry

KEYS = ["item_id", "code"]
CARDS = [("0101", "red"), ("0101", "steel bar"), ("0102", "bar"), ("0103", "blue"), ("0103", "x")]
TEXTS = ["red steel bar", "red  steel bar!", "blue barn 7", "blue barn 8", "nothing here", "", None, "bar bar blue", "red steel bar and more words"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(spark):
    items = match.prepared(spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, text string"))
    return items, spark.createDataFrame(CARDS, "code string, keyword string")


def test_profiles_give_the_scores_of_items(spark):
    items, cards = made(spark)
    terms = cards.select(F.col("keyword").alias("term"))
    found, x = match.found_terms(items, terms), match.profiles(items, terms)
    assert x.items.count() < x.of.count() == 6  # items without a match have no profile
    assert rows(x.of_items(match.kb_scores(x.items, cards, None, x.found))) == rows(match.kb_scores(items, cards, None, found))
    assert rows(x.of_items(match.card_scores(x.items, cards, x.found))) == rows(match.card_scores(items, cards, found))


def test_candidates_of_profiles_meet_those_of_the_model(spark):
    items, cards = made(spark)
    x = match.profiles(items, cards.select(F.col("keyword").alias("term")))
    ml = spark.createDataFrame([(0, "0101", 0.5), (0, "0999", 0.4), (4, "0101", 0.3), (99, "0102", 0.2)], "item_id long, code string, score double")
    kb = match.kb_scores(x.items, cards, None, x.found)
    assert rows(match.merge_over_profiles(x, kb, ml).drop("profile")) == rows(match.merge_candidates(x.of_items(kb), ml))


def test_profiles_of_notes_tell_shares_of_words_apart(spark):
    items, cards = made(spark)
    notes = spark.createDataFrame([("n1", "include", "red things", ["red"], None, None, 1, 1)], "note_id string, note_type string, note_content string, keywords array<string>, redirect_to string, section_num int, chapter_num int, position int")
    terms = cards.select(F.col("keyword").alias("term"))
    x = match.profiles(items, terms, spark.createDataFrame([("red",), ("things",)], "word string"))
    of = lambda it, found: match.kb_scores(it, cards, None, found).select(*KEYS)
    mine = x.of_items(gate.note_scores(of(x.items, x.found), x.items, notes).select(*KEYS, "note_id", "score"))
    want = gate.note_scores(of(items, match.found_terms(items, terms)), items, notes).select(*KEYS, "note_id", "score")
    assert rows(mine) == rows(want) and len({r.score for r in want.filter("item_id in (0, 8)").collect()}) == 2


def test_distribution_counts_rows_that_are_alike(spark):
    got = diagnostics.feature_distribution(spark.createDataFrame([(0.0,)] * 3 + [(4.0,), (None,)], "f double"), ["f"]).first()
    assert (got["mean"], got["p95"], got["least"], got["most"], got["nonzero"]) == (1.0, 3.4, 0.0, 4.0, 0.25)


def gate_over(found, keywords):
    gated = gate.heading_terms(match.keyword_hits(None, keywords, found))
    return gated.withColumn("passed", ~((F.col("code") == "0102") & (F.col("heading_term") > 0)))


def test_training_rows_of_profiles(spark):
    items, cards = made(spark)
    terms = cards.select(F.col("keyword").alias("term"))
    found, x = match.found_terms(items, terms), match.profiles(items, terms)
    labels = spark.createDataFrame([(0, "0101"), (1, "0101"), (2, "0103"), (3, "0101"), (7, "0102"), (8, "0101")], "item_id long, true_code string")
    want = facts.ranking_rows(match.kb_scores(items, cards, None, found).select(*KEYS), labels, gate_over(found, cards))
    got = facts.ranking_rows_over_profiles(x, match.kb_scores(x.items, cards, None, x.found).select(*KEYS), labels, gate_over(x.found, cards))
    assert rows(got) == rows(want) != [] and got.columns == want.columns
    assert all("taxonaut-used" in f or "taxonaut-left" in f for f in got.inputFiles())  # rows of items are neither shuffled nor written


def test_hybrid_of_profiles(spark):
    items, cards = made(spark)
    terms = cards.select(F.col("keyword").alias("term"))
    found, x = match.found_terms(items, terms), match.profiles(items, terms)
    rules = spark.createDataFrame([("r1", "0101", "include_rule", "include", "soft", ["red"]), ("r2", "0103", "exclude_rule", "exclude", "soft", ["blue"])], "rule_id string, code string, chunk_type string, polarity string, strength string, signals array<string>")
    ml = spark.createDataFrame([(i, f"010{(i + j) % 5}", 0.1 * j + 0.05) for i in range(9) for j in range(3)], "item_id long, code string, score double")
    known = spark.createDataFrame([("0101",)], "code string")

    def sides(it, found):
        return match.kb_scores(it, cards, None, found), gate_over(found, cards), match.card_scores(it, cards, found), match.rule_scores(it, rules, found), known

    for k, most in ((5, 50), (2, 1)):
        want, got = scorers.hybrid(ml, *sides(items, found), k, most), scorers.hybrid_over_profiles(x, ml, *sides(x.items, x.found), k, most)
        assert rows(got) == rows(want) and got.dtypes == want.dtypes and len(rows(want)) > 9


def test_scores_come_from_profiles(spark):
    queries = registry.QUERIES
    for name in ("j1_kb_topk", "u3_inject_truth"):
        assert any("taxonaut-profile-of" in f for f in queries[name][0](spark, "/root/testdata/sf0.001").inputFiles()), name


def test_copies_of_parts_are_of_one_kind(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").filter("p_partkey < 40")
    n = part.count()
    part.union(part.withColumn("p_partkey", F.col("p_partkey") + 1000)).write.parquet(f"{tmp_path}/part.parquet")
    x = ranking_queries.Inputs(spark, str(tmp_path))
    assert x.of.count() == 2 * n and x.items.count() == x.it.count() <= n and x.of.groupBy("kind").count().filter("count < 2").isEmpty()
    gated, mine = x.gate_of(x.candidates)  # asked of profiles, met by candidates of kinds, and those by items
    assert gated.count() == x.candidates.select("profile", "code").distinct().count() and mine.count() == x.candidates.count()
    assert x.of_items(x.candidates).count() >= 2 * x.candidates.count() > gated.count()
