"""Classifiers and rankers on Spark ML: TF-IDF and vector regression, boosted pointwise ranker."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded_grams
from ..sources.scratch import kept
from .split import frequent_classes, top_k


def balanced(rows: DataFrame, label: str = "code") -> DataFrame:
    """Adds weight = rows / (classes x rows of the class). Counts are broadcast, one row a class: a fitted model has many numbers a class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return rows.join(F.broadcast(counts), label).join(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def fit_tfidf(items: DataFrame, features: int = 10_000, least: int = 2) -> PipelineModel:
    """Character 1- and 2-grams inside words, TF-IDF, multinomial regression with balanced weights."""
    rows = items.filter("code is not null").select("code", padded_grams(F.col("text")).alias("grams"))
    counts = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=features, minDF=least).fit(rows)
    rows = kept(counts.transform(rows).select("code", "tf"), "gram-counts")  # of what follows nothing looks at the texts again
    stages = [
        StringIndexer(inputCol="code", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features"), LogisticRegression(weightCol="weight", maxIter=20, regParam=0.01),
    ]
    fitted = Pipeline(stages=stages).fit(balanced(rows)).stages
    return PipelineModel([fitted[0], counts, *fitted[1:]])


def fit_vectors(items: DataFrame, least: int = 3) -> PipelineModel:
    """Regression on a vector column ``v``; classes with fewer than ``least`` rows are left out."""
    rows = balanced(frequent_classes(items, least)).withColumn("features", array_to_vector("v"))
    return Pipeline(stages=[StringIndexer(inputCol="code", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"), LogisticRegression(weightCol="weight", maxIter=20, regParam=0.01)]).fit(rows)


def classes(model: PipelineModel, spark) -> DataFrame:
    """The codes that a model knows."""
    return spark.createDataFrame([(c,) for c in model.stages[0].labels], "code string")


def predict(model: PipelineModel, items: DataFrame, k: int = 5) -> DataFrame:
    """The k likeliest codes of each item: item_id, code, score, rank. Items of unknown codes are scored too."""
    rows = items.withColumn("grams", padded_grams(F.col("text"))) if "text" in items.columns else items.withColumn("features", array_to_vector("v"))
    for stage in model.stages[1:]:
        rows = stage.transform(rows)
    labels = F.array(*map(F.lit, model.stages[0].labels))
    long = rows.select("item_id", F.posexplode(vector_to_array("probability")).alias("i", "score"))
    return top_k(long.select("item_id", F.get(labels, F.col("i")).alias("code"), F.round("score", 6).alias("score")), k)


def fit_ranker(rows: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    """Pointwise boosted trees on feature columns; not the listwise objective of a ranking library."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(labelCol=label, maxIter=20, maxDepth=4, seed=42)]).fit(rows)


def rank(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds score: the probability of label 1."""
    return model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6))


def importances(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """(feature, gain, share) of a ranker."""
    gains = model.stages[1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, gains)), "feature string, gain double").withColumn("share", F.round("gain", 6))


__all__ = ["balanced", "classes", "fit_ranker", "fit_tfidf", "fit_vectors", "importances", "predict", "rank"]
