"""Readers with explicit schemas, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import row_id

CASES = "hs_code string, hs_heading string, product_name string, product_description string, case_number string, decision_date string, reference_number string, decision_hs_code string, rationale string"
CARDS = "hs4 string, title_ko string, chapter string, scope array<string>, includes array<string>, excludes array<struct<hs4: string, reason: string>>, key_attributes array<struct<name: string, values: array<string>>>"
RULES = "hs4 string, chunk_type string, text string, signals array<string>, target_hs4 string, polarity string, strength string, rule_id string"
THESAURUS = "term string, aliases array<string>, hs4_candidates array<string>, hs4 string, confidence double, frequency long"
NOTES = "level string, section_num int, chapter_num int, note_number string, note_content string"
FACTS = "hs4 string, scope string, required_facts array<struct<axis: string, operator: string, value: string, hardness: string>>"
QUESTIONS = "hs4 string, chapter string, disambiguation_questions array<struct<q: string, key: string>>"


def labelled_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of cases: a 4-character heading, else the code's first four; no code or a name below 2 characters: dropped."""
    rows = spark.read.schema(CASES).json(path, multiLine=True)
    digits = F.regexp_replace(F.coalesce("hs_code", F.lit("")), r"\D", "")
    code = F.when(F.length("hs_heading") == 4, F.col("hs_heading")).otherwise(F.substring(digits, 1, 4))
    rows = rows.withColumn("code", code).filter((F.length("code") == 4) & (F.length(F.trim("product_name")) >= 2))
    at = F.coalesce("case_number", "reference_number", F.lit(""))
    return rows.select(
        row_id(F.col("product_name"), F.col("code"), at).alias("item_id"), F.col("product_name").alias("text"), "code", F.when(F.length(digits) >= 6, F.substring(digits, 1, 6)).alias("subcode"),
        F.when(F.length(digits) >= 10, F.substring(digits, 1, 10)).alias("code10"), F.col("product_description").alias("description"), F.struct("case_number", "decision_date").alias("meta"),
    )


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def card_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(code, keyword) from class profiles: normalised scope and includes of two characters or more, and title keywords."""
    from ..functions.text import keywords, normalize

    rows = jsonl(spark, path, CARDS)
    none = F.array().cast("array<string>")
    words = F.filter(F.transform(F.concat(F.coalesce("includes", none), F.coalesce("scope", none)), normalize), lambda w: F.length(w) >= 2)
    return rows.select(F.col("hs4").alias("code"), F.explode(F.array_distinct(F.concat(words, keywords(F.col("title_ko"))))).alias("keyword"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule chunks: missing signals are the first five keywords of the text; polarity and strength inferred."""
    from ..functions.text import keywords, rule_key
    from ..operators.extract import strength

    rows = jsonl(spark, path, RULES)
    polarity = F.coalesce("polarity", F.when(F.contains("chunk_type", F.lit("exclude")), "exclude").when(F.contains("chunk_type", F.lit("include")), "include").otherwise("neutral"))
    signals = F.when(F.size("signals") > 0, F.col("signals")).otherwise(keywords(F.col("text"), 2, 5))
    return rows.select(
        F.coalesce("rule_id", rule_key(F.col("hs4"), F.col("chunk_type"), F.col("text"))).alias("rule_id"), F.col("hs4").alias("code"), "chunk_type", "text", signals.alias("signals"),
        F.col("target_hs4").alias("target_code"), polarity.alias("polarity"), F.coalesce("strength", strength(F.col("text"), F.col("chunk_type"))).alias("strength"),
    )


def thesaurus_codes(spark: SparkSession, path: str) -> DataFrame:
    """(term, code), aliases included; a single code where there is no list."""
    rows = jsonl(spark, path, THESAURUS)
    terms = F.explode(F.array_distinct(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("term")
    codes = F.when(F.size("hs4_candidates") > 0, F.col("hs4_candidates")).otherwise(F.array_compact(F.array("hs4")))
    return rows.select(terms, codes.alias("codes")).select("term", F.explode("codes").alias("code")).distinct()


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(term, alias, position) in both directions."""
    rows = jsonl(spark, path, THESAURUS).select("term", F.posexplode("aliases").alias("p", "alias"))
    back = rows.select(F.col("alias").alias("term"), F.col("term").alias("alias"), F.lit(0).alias("p"))
    return rows.select("term", "alias", "p").unionByName(back.select("term", "alias", "p")).select("term", "alias", (F.col("p") + 1).alias("position"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a JSON array with type, keywords and redirect target."""
    from ..operators import extract

    rows = spark.read.schema(NOTES).json(path, multiLine=True)
    key = F.concat_ws("_", "level", F.coalesce(F.col("chapter_num").cast("string"), F.lit("0")), "note_number")
    return extract.notes(rows.withColumn("note_id", key))


def required_facts(spark: SparkSession, path: str, chapters: DataFrame) -> DataFrame:
    """(code, axis, operator, value, hardness): facts of codes, and of chapter_NN scopes for all codes of the chapter."""
    rows = jsonl(spark, path, FACTS).select(F.coalesce("hs4", "scope").alias("scope"), F.explode("required_facts").alias("f")).select("scope", "f.*")
    own = rows.filter(F.length("scope") == 4).withColumnRenamed("scope", "code")
    wide = chapters.select("code", F.concat(F.lit("chapter_"), F.substring("code", 1, 2)).alias("scope")).join(rows, "scope").select(own.columns)
    return own.unionByName(wide).distinct()


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(code, position, question, key)."""
    rows = jsonl(spark, path, QUESTIONS).select(F.col("hs4").alias("code"), F.posexplode("disambiguation_questions").alias("position", "x"))
    return rows.select("code", "position", F.col("x.q").alias("question"), F.col("x.key").alias("key"))


def nomenclature(spark: SparkSession, path: str, code: str | None = None, name: str | None = None) -> DataFrame:
    """A CSV table with a code and a name column, found by their headers where not given; six digits at least."""
    rows = spark.read.csv(path, header=True)
    pick = lambda words, default: next((c for c in rows.columns if any(w in c.lower() for w in words)), rows.columns[default])
    code, name = code or pick(("code", "hs", "번호", "코드"), 0), name or pick(("name", "title", "품명", "명"), -1)
    digits = F.regexp_replace(F.col(code), r"\D", "")
    return rows.select(digits.alias("code"), F.col(name).alias("name")).filter(F.length("code") >= 6)


def rank_features(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of ranking features: query_id, doc_id, label and f_* as doubles; the header fixes the schema, nothing is inferred."""
    header = spark.read.csv(path, header=True)
    return header.select(*(F.col(c).cast("double").alias(c) if c.startswith("f_") else F.col(c).cast("int").alias(c) if c == "label" else F.col(c) for c in header.columns))


def write_checked(df: DataFrame, path: str, kind: str = "parquet", partition: str | None = None) -> int:
    """Writes and returns the number of rows that the sink then holds."""
    out = df.write.mode("overwrite").format(kind)
    (out.partitionBy(partition) if partition else out).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).load(path).count()


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small aggregate as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).format(kind).save(path)


def write_postings(docs: DataFrame, path: str) -> None:
    """A retrieval index: postings sorted by token, and term weights."""
    from ..operators.retrieval import bm25_index

    postings, idf = bm25_index(docs)
    postings.repartition("token").sortWithinPartitions("token", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    idf.write.mode("overwrite").parquet(f"{path}/idf")


SUBHEADINGS = "hs6 string, hs4 string, title_ko string, keywords array<string>, subheading_notes array<string>, case_count int"
PREDICTIONS = (
    "sample_id string, text string, true_hs4 string, topk array<struct<hs4: string, hs6: string, score_ml: double, score_card: double, score_rule: double, score_total: double, "
    "evidence: array<struct<kind: string, source_id: string, text: string, weight: double>>>>, decision struct<status: string, reason: string, confidence: double>, questions array<string>"
)


def counted_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines by an explicit schema, and one row (lines, kept, dropped) of how many could be read.

    A line that isn't JSON, or whose fields don't fit the schema, is dropped
    and counted; blank lines don't count.
    """
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("a"))
    good = F.col("a").isNotNull() & F.col("a._bad").isNull()
    counts = rows.agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(good, 1)).alias("kept"), F.count(F.when(~good, 1)).alias("dropped"))
    return rows.filter(good).select("a.*").drop("_bad"), counts


def subheadings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Subcodes (subcode, code, title, keywords, notes, case_count) of a JSON-lines table, and what was dropped; rows without a subcode go.

    A missing code is the subcode's first four characters.
    """
    rows, counts = counted_lines(spark, path, SUBHEADINGS)
    none = F.array().cast("array<string>")
    rows = rows.filter("hs6 <> ''").select(
        F.col("hs6").alias("subcode"), F.coalesce("hs4", F.substring("hs6", 1, 4)).alias("code"), F.coalesce("title_ko", F.lit("")).alias("title"),
        F.coalesce("keywords", none).alias("keywords"), F.coalesce("subheading_notes", none).alias("notes"), F.coalesce("case_count", F.lit(0)).alias("case_count"),
    )
    return rows, counts


def saved_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Saved predictions as long rows (item_id, true_code, code, subcode, score, rank, evidence, status, confidence), and what was dropped.

    ``score`` is the total score, or else the model's; evidence stays an array
    of structs. Items without candidates keep one row without a code.
    """
    rows, counts = counted_lines(spark, path, PREDICTIONS)
    long = rows.select(F.col("sample_id").alias("item_id"), F.col("true_hs4").alias("true_code"), F.posexplode_outer("topk").alias("p", "k"), "decision.status", "decision.confidence")
    out = long.select("item_id", "true_code", F.col("k.hs4").alias("code"), F.col("k.hs6").alias("subcode"), F.coalesce("k.score_total", "k.score_ml").alias("score"), (F.col("p") + 1).alias("rank"), F.col("k.evidence").alias("evidence"), "status", "confidence")
    return out, counts
