"""Quality classifier: similarity-weighted votes of the nearest labelled documents in latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn

#: Hashed byte trigrams, then the counts below.
TERMS = 4096
SHAPES = 2
WIDTH = TERMS + SHAPES


def features(text: str | None) -> np.ndarray:
    """Counts of a text's hashed byte trigrams, of words like the one before, and of words in capitals."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, dtype=np.float32)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) >= 3:
        keys = (b[:-2] * np.uint32(65599 * 65599 % 2**32) + b[1:-1] * np.uint32(65599) + b[2:]) * np.uint32(2654435769)
        out[:TERMS] = np.bincount((keys >> np.uint32(20)).astype(np.int64), minlength=TERMS)
    words = raw.split()
    out[TERMS] = sum(map(bytes.__eq__, words, words[1:]))
    out[TERMS + 1] = sum(map(bytes.isupper, words))
    return out


@dataclass
class Model:
    """Labelled vectors in latent space with what leads there: sizes are bounded by parameters."""

    weight: np.ndarray  # of each term
    axes: np.ndarray  # terms by dimensions
    vectors: np.ndarray  # labelled documents by dimensions, of length 1
    labels: np.ndarray
    prior: float
    neighbours: int

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.weight) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, by positive cosine; the prior where none is."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        x = self.embed(counts)
        near = x @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        votes = np.where(near >= edge[:, None], np.maximum(near, 0), 0).astype(np.float64)  # ties at the edge all vote
        total = votes.sum(axis=1)
        out = np.where(total > 1e-6, votes @ self.labels / np.maximum(total, 1e-6), self.prior)
        return np.clip(out, 0.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies times the weights: long and short texts are alike, and so compare."""
    out = counts / np.maximum(counts[:, :TERMS].sum(axis=1, keepdims=True), 1)
    np.sqrt(out, out=out)
    out *= weight
    return out


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = 1500, dims: int = 64, neighbours: int = 25, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns from the rows of ``labels`` (doc_id, quality) for which ``usable`` holds.

    At most ``per_label`` documents of each label, drawn by a seeded hash, get
    vectors: a bounded sample of labelled rows. Term weights are inverse
    document frequencies over all documents. Labels other than 0 and 1, null
    ids and ids without a document are ignored; of a repeated id the larger
    label and the least text count, one row an id. If the sample's texts are
    all blank there are no vectors, and the share of label 1 is the score.
    """

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(WIDTH, dtype=np.int64), 0
        for batch in batches:
            for t in batch.text:
                df += features(t) > 0
            n += len(batch)
        yield pd.DataFrame({"term": [*range(WIDTH), -1], "n": [*df, n]})

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = docs.select("text").mapInPandas(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    table = {r.term: r.n for r in found}
    n = table.pop(-1, 0)
    df = np.array([table.get(t, 0) for t in range(WIDTH)], dtype=float)
    weight = np.log((n + 1) / (df + 1)).astype(np.float32) + 1
    weight[TERMS:] = weight[:TERMS].max() * 4  # shapes are one term each where trigrams are many

    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(usable).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    sample = drawn(known, "quality", "doc_id", per_label, seed).select("doc_id", "quality")

    def vectorise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "quality": batch.quality, "v": [features(t).astype(np.float32).tobytes() for t in batch.text]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # of the texts of one id the least counts: 2 * per_label rows at most
    vectors = texts.mapInPandas(vectorise, f"doc_id {kind}, quality int, v binary")

    def decompose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        x = np.empty((len(rows), WIDTH), dtype=np.float32)
        for i, v in enumerate(rows.v):
            x[i] = np.frombuffer(v, dtype=np.float32)
        x = weighted(x, weight)
        values, left = np.linalg.eigh(x @ x.T)
        top = np.argsort(values)[::-1][:dims]
        top = top[values[top] > max(1e-6 * values.max(), 1e-9)]
        if not len(top):  # blank texts span nothing: no neighbours, so the prior counts
            return pd.DataFrame([("none", None, b"")], columns=["kind", "quality", "data"])
        axes = (x.T @ left[:, top] / np.sqrt(values[top])).astype(np.float32)
        vectors = unit(x @ axes).astype(np.float32)
        out = [("axis", None, axes[:, i].tobytes()) for i in range(axes.shape[1])]
        out += [("vector", float(q), v.tobytes()) for q, v in zip(rows.quality, vectors)]
        return pd.DataFrame(out, columns=["kind", "quality", "data"])

    # the bounded sample meets in one task; the driver gets its latent vectors only
    made = vectors.groupBy(F.lit(0).alias("all")).applyInPandas(decompose, "kind string, quality double, data binary").collect()
    prior = 1.0 if share is None else float(share)
    of = lambda kind: [np.frombuffer(r.data, dtype=np.float32) for r in made if r.kind == kind]
    if not any(r.kind == "axis" for r in made):
        return Model(weight, np.zeros((WIDTH, 1), np.float32), np.empty((0, 1)), np.empty(0), prior, neighbours)
    quality = np.array([r.quality for r in made if r.kind == "vector"])
    return Model(weight, np.array(of("axis")).T.copy(), np.array(of("vector")), quality, prior, neighbours)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7, block: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score (0 to 1, higher: label 1 likelier) and prediction of every document: doc_id, score, predicted.

    Cosines with all labelled vectors are exact, computed for blocks of
    documents; the nearest vote by their positive cosine. Null, empty and blank
    texts have nothing that could be good and score 0. Without labelled
    vectors all others score the share of label 1 (1 if there are no labels).
    Repeated rows score alike, null ids are ids like others, no rows give
    none, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = [shared.value.score(np.array([features(t) for t in batch.text.iloc[i : i + block]])) for i in range(0, len(batch), block)]
            got = np.round(np.concatenate(scores), 6) if scores else np.empty(0)
            got[[not isinstance(t, str) or not t.strip() for t in batch.text]] = 0.0
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": got, "predicted": (got >= threshold).astype(np.int32)})

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(judge, f"doc_id {kind}, score double, predicted int")
