"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import buckets_for


#: Rows whose scores are accumulated together, so that they stay in a core's cache.
TILE = 256


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null if any is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(F.exists(vector, bad), None).otherwise(F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def postings(rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Term -> (row numbers, weights) of the components that aren't 0."""
    lengths = np.array([len(r) for r in rows])
    term = np.concatenate([np.arange(n) for n in lengths]) if len(rows) else np.empty(0, int)
    row, weight = np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows) if len(rows) else np.empty(0)
    order = np.flatnonzero(weight != 0)
    order = order[np.argsort(term[order], kind="stable")]
    term, row, weight = term[order], row[order], weight[order]
    edges = np.flatnonzero(np.diff(term, prepend=-1))
    return {int(term[a]): (row[a:b], weight[a:b]) for a, b in zip(edges, [*edges[1:], len(term)])}


def scores(queries: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Inner products, queries by rows: each query term scatters its weighted posting into the dense array.

    Sums are exact: 32-bit where the largest possible sum fits, then 64-bit,
    then Python integers, cut to the range of a long.
    """
    top = lambda vs: max((max(abs(int(v.max())), abs(int(v.min()))) for v in vs if len(v)), default=0)
    bound = top(queries) * top(rows) * max((len(v) for v in rows), default=0)
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    acc = np.zeros((len(rows), len(queries)), dtype=kind)
    asked = postings(queries)
    for start in range(0, len(rows), TILE):
        tile = acc[start : start + TILE]
        for term, (r, wr) in postings(rows[start : start + TILE]).items():
            if term in asked:
                q, wq = asked[term]
                if 2 * len(q) > len(queries):
                    dense = np.zeros(len(queries), dtype=kind)
                    dense[q] = wq.astype(kind)
                    tile[r] += wr.astype(kind)[:, None] * dense[None, :]
                else:
                    tile[np.ix_(r, q)] += wr.astype(kind)[:, None] * wq.astype(kind)[None, :]
    if kind is object:
        acc = np.clip(acc, -(2**63), 2**63 - 1).astype(np.int64)
    return acc.T


def best(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ``ids`` ascends."""
    if len(row) > k:
        edge = np.partition(row, len(row) - k)[len(row) - k]
        over = np.flatnonzero(row > edge)
        picked = np.concatenate([over, np.flatnonzero(row == edge)[: k - len(over)]])
    else:
        picked = np.arange(len(row))
    return picked[np.lexsort((ids[picked], -row[picked].astype(object) if row.dtype == np.int64 and len(row) and row.min() == -(2**63) else -row[picked].astype(np.int64)))]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, query_block: int = 1024, row_block: int = 8192, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest inner products of every query row with all other rows: query_id, rank, vec_id, score.

    ``queries`` says which rows are queries. Vectors hold integers, or null for
    rows that take no part; they may differ in length. Each query row has a
    list of its own, also where rows share an id: then ``query_id`` has
    several lists. All rows but the query's own are candidates, those of its id
    included; repeated rows count each. Ties go to the smaller id. Rows with a
    null id take no part. No queries or no candidates give no rows. Other
    columns are ignored.

    Queries and candidates are cut into blocks by a hash of id and vector and
    each pair of blocks is one group: memory per group is bounded by the two
    block sizes unless rows are full copies, and each cell passes on ``k``
    rows a query to the merge. Copies of a query row are scored once.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), queries.alias("q")).filter("vec_id is not null and v is not null")
    rows = rows.withColumn("key", F.xxhash64("vec_id", "v"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    nq, nr = buckets_for(counts.q, query_block), buckets_for(counts.n, row_block)
    block = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.filter("q").select("vec_id", "key", "v", block(nq, 1).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("b"))
    right = rows.select("vec_id", "key", "v", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("a"), block(nr, 2).alias("b"))

    def cell(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["vec_id", "key"], kind="stable")
        asked = asked.assign(copies=asked.groupby("key").key.transform("size")).drop_duplicates("key")
        ids, keys = held.vec_id.to_numpy(), held.key.to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        if len(ids) and len(asked):
            got = scores([np.asarray(v) for v in asked.v], [np.asarray(v) for v in held.v])
            for i, key, n, row in zip(asked.vec_id, asked.key, asked.copies, got):
                a, b = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
                own = a + np.flatnonzero(keys[a:b] == key)[:1]
                others, row = (np.delete(ids, own), np.delete(row, own)) if len(own) else (ids, row)
                pick = best(row, others, k)
                out.append((np.full(len(pick), i), np.full(len(pick), key), np.full(len(pick), n), others[pick], row[pick].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 5
        return pd.DataFrame(dict(zip(("query_id", "key", "copies", "vec_id", "score"), cols)))

    kind = dict(vectors.dtypes)[vec_id]
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(cell, f"query_id {kind}, key long, copies long, vec_id {kind}, score long")
    return merged(found, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query row over all blocks, as often as the row is there."""
    order = W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("query_id", "rank", "vec_id", "score")
