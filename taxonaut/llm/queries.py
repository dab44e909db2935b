"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard_join, language_model, mixing, packing, quality_classifier, quality_rules, secret_scan, sharding, token_alignment, url_filters, vector_codes, vector_search
from .oracles import ORACLES

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def held_out_row(modulus: int):
    """Rows whose crc32(doc_id as text) leaves 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), held_out_row(7))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", vector_search.quantised(F.col("embedding")).alias("embedding"))
    return vector_search.top_k(vectors, F.col("vec_id") % 20 == 0)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("by_shard")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.judge(docs, quality_rules.likelihood_ratios(docs, trusted))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.learn(secret_scan.labelled(docs)))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels, ~held_out_row(4))
    out = quality_classifier.classify(docs, model)
    return out.select("doc_id", F.coalesce(held_out_row(4), F.lit(False)).alias("held_out"), "score", "predicted")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items", "spans")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.cross_tokenizer_alignment(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_interleave, op2_ppm, op3_url_filter, op4_pack, op5_topk,
        op6_jaccard, op7_mix, op8_quality_rules, op9_secrets, op10_classifier,
        op11_decontaminate, op12_align, op13_codes,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
