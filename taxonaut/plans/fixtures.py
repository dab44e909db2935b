"""Inputs derived from the given tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, text, code (4), subcode (6) from the parts; chapter = brand number, then the type's index."""
    part = table(spark, sf_dir, "part")
    types = part.select("p_type").distinct().withColumn("ti", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("p_type")) - 1)  # some ten types
    out = part.join(F.broadcast(types), "p_type")
    chapter = F.lpad(F.regexp_extract("p_brand", "([0-9]+)", 1), 2, "0")
    code = F.concat(chapter, F.lpad(F.col("ti").cast("string"), 2, "0"))
    text = F.concat_ws(" ", "p_name", "p_type", F.lit("size"), F.col("p_size").cast("string"))
    return out.select(F.col("p_partkey").alias("item_id"), text.alias("text"), "p_name", "p_type", "p_size", code.alias("code"), F.concat(code, F.lpad(F.floor(F.col("p_size") / 10).cast("string"), 2, "0")).alias("subcode"))


ITEMS = """
types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS ti FROM (SELECT DISTINCT p_type FROM part)),
items0 AS (SELECT p_partkey AS item_id, p_name, part.p_type, p_size, p_name || ' ' || part.p_type || ' size ' || CAST(p_size AS VARCHAR) AS text,
  lpad(regexp_extract(p_brand, '([0-9]+)', 1), 2, '0') || lpad(CAST(ti AS VARCHAR), 2, '0') AS code FROM part JOIN types ON part.p_type = types.p_type),
items AS (SELECT *, code || lpad(CAST(p_size // 10 AS VARCHAR), 2, '0') AS subcode FROM items0)"""


def predictions(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """Ranked guesses for every vector: softmax of 20 x cosine to the label centroids (of even ids only, if asked)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    long = vectors.filter("vec_id % 2 = 0" if even else "true").select("label", F.posexplode("v").alias("d", "x"))
    center = long.groupBy("label", "d").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c"))
    center = center.select(F.col("label").alias("guess"), F.transform("c", lambda s: s["x"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = vectors.join(F.broadcast(center))  # one centroid a label: some ten rows
    met = met.withColumn("e", F.exp(20 * dot("v", "c") / F.sqrt(dot("v", "v") * dot("c", "c"))))
    met = met.withColumn("score", F.round(F.col("e") / F.sum("e").over(W.partitionBy("vec_id")), 6))
    name = lambda c: F.concat(F.lpad((F.floor(F.col(c) / 3) + 1).cast("string"), 2, "0"), F.lpad(F.col(c).cast("string"), 2, "0"))
    met = met.select(F.col("vec_id").alias("item_id"), name("label").alias("true_code"), name("guess").alias("code"), "score")
    return met.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "code")))


def predictions_sql(name: str = "pred", even: bool = False) -> str:
    where = "WHERE vec_id % 2 = 0" if even else ""
    code = lambda c: f"lpad(CAST({c} // 3 + 1 AS VARCHAR), 2, '0') || lpad(CAST({c} AS VARCHAR), 2, '0')"
    return f"""
{name}_l AS (SELECT vec_id, label, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
{name}_c AS (SELECT label AS guess, d, avg(x) AS x FROM {name}_l {where} GROUP BY label, d),
{name}_n AS (SELECT guess, sqrt(sum(x * x)) AS n FROM {name}_c GROUP BY guess),
{name}_s AS (SELECT l.vec_id, any_value(l.label) AS label, c.guess, sum(l.x * c.x) / (sqrt(sum(l.x * l.x)) * any_value(n.n)) AS cosine
  FROM {name}_l l JOIN {name}_c c ON l.d = c.d JOIN {name}_n n ON n.guess = c.guess GROUP BY l.vec_id, c.guess),
{name}_e AS (SELECT *, exp(20 * cosine) AS e FROM {name}_s),
{name}_p AS (SELECT vec_id AS item_id, {code("label")} AS true_code, {code("guess")} AS code, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS score FROM {name}_e),
{name} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, code) AS rank FROM {name}_p)"""


PRED = predictions_sql()
TOP1 = PRED + ", top1 AS (SELECT item_id, true_code, code, score, true_code = code AS correct FROM pred WHERE rank = 1)"
