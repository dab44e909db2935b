"""From raw documents to packed training sequences: five operators, each on all that its predecessor kept.

Rows are told apart by id and text, not by id alone: a null id is an id like
others, and rows that share one but have different texts are judged each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxonaut.llm import jaccard_join, mixing, packing, quality_classifier, secret_scan
from taxonaut.llm.common import row_key, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours call good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels, F.lit(True))
    keyed = docs.withColumn("_key", row_key(F.col("doc_id"), F.col("text")))
    good = quality_classifier.classify(keyed, model, doc_id="_key").filter("predicted = 1").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(good, "_key", "left_semi").select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_first(docs).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    formats = secret_scan.learn(secret_scan.labelled(docs))
    out = secret_scan.redact(docs, formats)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes its words, to the nearest whole copy."""
    keyed = docs.withColumn("_key", row_key(*(F.col(c) for c in docs.columns)))
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    taken = mixing.mix(keyed, doc_id="_key").groupBy(F.col("doc_id").alias("_key")).agg(F.sum(copies).cast("int").alias("_copies"))
    out = keyed.dropDuplicates(["_key"]).join(taken, "_key").filter("_copies > 0")  # rows equal in all columns share their copies
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("secret scan", redact),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: SQL can't express the learned stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
