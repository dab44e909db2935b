"""Vector code compression: product codes by k-means whose assignments use Drake and Hamerly's adaptive bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS = 16


def limit_of(width: int) -> int:
    """The largest component kept as it is, so that a squared distance of ``PARTS`` parts of this width fits a long."""
    return int(2**28 / math.sqrt(max(width, 1)))


def integers(vector: np.ndarray, scale: int, limit: int) -> np.ndarray:
    return np.clip(np.floor(np.asarray(vector, dtype=np.float64) * scale), -limit, limit).astype(np.int64)


def below(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are surely not above ``x``."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of n rows to k entries: n by k."""
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def listed(distances: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From all squared distances: the b closest entries in order (ties to the lower index), their lower bounds, and one for all others."""
    near = np.argsort(distances, axis=1, kind="stable")[:, : b + 1]
    low = below(np.sqrt(np.take_along_axis(distances, near, axis=1).astype(np.float64)))
    outer = low[:, b] if near.shape[1] > b else np.full(len(low), np.inf, np.float32)
    return near[:, :b].astype(np.uint8), low[:, :b], outer


def first_lists(x: np.ndarray, entries: np.ndarray, b: int):
    """near, low, outer and depth of one part's rows, all entries measured."""
    near, low, outer = listed(squares(x, entries), b)
    return near, low, outer, np.full(len(x), b + 1, np.uint8)


def next_lists(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, b: int):
    """The same after the entries moved, by as much as ``moved`` says at most.

    Every bound falls by its entry's move, the outer one by the largest. A row
    looks at its listed entries in order, each measured in integers, until
    the best is surely closer than the bounds of all that follow; only if none
    of the list settles it are all entries measured. ``depth`` says how many
    were looked at. Lists are then put in order again and cut to ``b``.
    """
    n, held = near.shape
    rows = np.arange(n)
    low = low.astype(np.float64) - moved[near]
    outer = outer.astype(np.float64) - moved.max()
    rest = np.minimum.accumulate(np.concatenate([low[:, 1:], outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]  # of all after each place
    settled = lambda best, bound: (bound > 0) & (best < bound * bound * (1 - 1e-12))
    at = near[:, 0].astype(np.int64)
    best = ((x - entries[at]) ** 2).sum(axis=1)
    low[:, 0] = np.sqrt(best)
    depth = np.ones(n, np.uint8)
    open_rows = rows[~settled(best, rest[:, 0])]
    for j in range(1, held):
        if not len(open_rows):
            break
        i = near[open_rows, j].astype(np.int64)
        d = ((x[open_rows] - entries[i]) ** 2).sum(axis=1)
        low[open_rows, j] = np.sqrt(d)
        depth[open_rows] = j + 1
        closer = (d < best[open_rows]) | (d == best[open_rows]) & (i < at[open_rows])
        at[open_rows[closer]], best[open_rows[closer]] = i[closer], d[closer]
        open_rows = open_rows[~settled(best[open_rows], rest[open_rows, j])]
    key = np.where(near == at[:, None], -1.0, np.where(np.arange(held) < depth[:, None], low, np.maximum(low, 0)))
    order = np.argsort(key, axis=1, kind="stable")
    near, low = np.take_along_axis(near, order, axis=1), below(np.maximum(np.take_along_axis(low, order, axis=1), 0))
    outer = below(np.maximum(outer, 0))
    if held > b:
        outer = np.minimum(outer, low[:, b:].min(axis=1))
    near, low = near[:, :b].copy(), low[:, :b].copy()
    if len(open_rows):
        near[open_rows], low[open_rows], outer[open_rows] = listed(squares(x[open_rows], entries), b)
        depth[open_rows] = held + 1
    return near, low, outer, depth


STATE = "label {label}, x binary, near binary, low binary, outer binary, depth binary"


def packed(batch: pd.DataFrame, x: np.ndarray, lists: list) -> pd.DataFrame:
    """Rows of the state table: per row its parts' lists one after another."""
    near, low, outer, depth = (np.stack([p[i] for p in lists], axis=1) for i in range(4))
    each = lambda a: [r.tobytes() for r in np.ascontiguousarray(a)]
    return pd.DataFrame({"vec_id": batch.vec_id, "label": batch.label, "x": each(x.astype(np.int32)), "near": each(near), "low": each(low), "outer": each(outer), "depth": each(depth)})


def unpacked(batch: pd.DataFrame, width: int, b: int):
    n = len(batch)
    read = lambda c, t: np.frombuffer(b"".join(batch[c]), dtype=t)
    return read("x", np.int32).reshape(n, PARTS, width).astype(np.int64), read("near", np.uint8).reshape(n, PARTS, b), read("low", np.float32).reshape(n, PARTS, b), read("outer", np.float32).reshape(n, PARTS)


def sums_of(state: DataFrame, width: int, b: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer sums and counts of the vectors' parts at each entry, and how many parts were settled at each depth; a few thousand rows reach the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count, deep = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64), np.zeros(256, np.int64)
        for batch in batches:
            if len(batch):
                x, near = unpacked(batch, width, b)[:2]
                for p in range(PARTS):
                    np.add.at(total[p], near[:, p, 0], x[:, p])
                    count[p] += np.bincount(near[:, p, 0], minlength=k)
                deep += np.bincount(np.frombuffer(b"".join(batch.depth), np.uint8), minlength=256)
        values = np.concatenate([total.ravel(), count.ravel(), deep])
        yield pd.DataFrame({"at": np.flatnonzero(values), "n": values[values != 0]})

    rows = state.mapInPandas(partial, "at int, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    flat = np.zeros(PARTS * k * (width + 1) + 256, dtype=object)
    for r in rows:
        flat[r["at"]] = int(r.n)
    cut = PARTS * k * width
    return flat[:cut].reshape(PARTS, k, width), flat[cut : cut + PARTS * k].reshape(PARTS, k), flat[cut + PARTS * k :]


def compress(vectors: DataFrame, entries: int = 64, rounds: int = 2, scale: int = 256, first_b: int | None = None, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Codes of all vectors: vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x); a vector is cut into 16 equal parts,
    each with a codebook of ``entries`` entries (256 at most). They start as
    the parts of the smallest ids. A round assigns every part to its nearest
    entry (squared distance, ties to the lower index) and replaces entries by
    floor(sum / count) of their parts; after the last round parts are assigned
    once more. All sums and the decisions are in integers.

    Each assignment is a pass over a written table that holds, for each part,
    its b closest entries with lower bounds and one bound for all others. b
    starts at a quarter of the entries and falls to what 99 % of the parts
    needed in the pass before, an eighth at least; whatever the list can't
    settle is measured against all entries.

    Rows whose vector is null or holds a null or non-finite component are
    dropped. Vectors whose length isn't that of the smallest id's vector, or
    no multiple of 16, can't be cut alike: their code and error are null. Of
    rows that share one of the smallest ids the least vector starts an entry;
    null ids start none, and without any id codes are null. Repeated rows count each.
    Fewer rows than ``entries`` make smaller codebooks; no rows give none.
    Components are held at +-2^28 / sqrt(part length), a million times the
    usual, so that no distance overflows. ``label_error`` sums errors of equal
    labels, nulls together. Other columns are ignored.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", bad))
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    first = [r.vec_id for r in rows.select("vec_id").filter("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    starts = rows.filter(F.col("vec_id").isin(first)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()  # a row for each of the first ids
    size = len(starts[0].v) if starts else 0
    width = size // PARTS
    fits = F.size("v") == size if size % PARTS == 0 else F.lit(False)
    limit = limit_of(width)
    start = [integers(r.v, scale, limit).reshape(PARTS, width) for r in starts if len(r.v) == size and size % PARTS == 0]
    books = np.stack(start, axis=1) if start else np.zeros((PARTS, 0, 0), np.int64)  # parts, entries, places
    k = books.shape[1]
    odd = rows.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not k:
        coded = odd
    else:
        b = min(k, max(1, k // 4) if first_b is None else first_b)
        state = written(rows.filter(fits).mapInPandas(_first(books, b, scale, limit, width), f"vec_id {id_kind}, {STATE.format(label=label_kind)}"), "codes-1")
        for done in range(1, rounds + 1):
            total, count, deep = sums_of(state, width, b, k)
            old, books = books, books.copy()
            for p in range(PARTS):
                for e in range(k):
                    if count[p, e]:
                        books[p, e] = [t // count[p, e] for t in total[p, e]]
            moved = np.nextafter(np.sqrt(((books - old) ** 2).sum(axis=2).astype(np.float64)), np.inf)
            b, held = next_b(deep, b, k) if done > 1 else b, b
            work = _next(books, moved, held, b, width)
            state = written(state.mapInPandas(work, f"vec_id {id_kind}, {STATE.format(label=label_kind)}"), f"codes-{done + 1}")
        coded = state.mapInPandas(_code(books, b, width), f"vec_id {id_kind}, label {label_kind}, code string, error long").unionByName(odd)
    coded = written(coded, "codes")
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def next_b(deep: np.ndarray, b: int, k: int, share: float = 0.99) -> int:
    """The least list length within which ``share`` of the parts that a list settled were settled; an eighth of the entries at least."""
    within = np.cumsum(deep[: b + 1].astype(np.float64))
    needed = int(np.searchsorted(within, share * within[-1])) if within[-1] else b
    return min(b, max(1, k // 8, needed))


def _first(books: np.ndarray, b: int, scale: int, limit: int, width: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = integers(np.stack(batch.v.to_list()), scale, limit).reshape(len(batch), PARTS, width)
                yield packed(batch, x, [first_lists(x[:, p], books[p], b) for p in range(PARTS)])

    return work


def _next(books: np.ndarray, moved: np.ndarray, held: int, b: int, width: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, near, low, outer = unpacked(batch, width, held)
                yield packed(batch, x, [next_lists(x[:, p], books[p], moved[p], near[:, p], low[:, p], outer[:, p], b) for p in range(PARTS)])

    return work


def _code(books: np.ndarray, b: int, width: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, near = unpacked(batch, width, b)[:2]
                at = near[:, :, 0]
                error = sum(((x[:, p] - books[p][at[:, p]]) ** 2).sum(axis=1) for p in range(PARTS))
                yield pd.DataFrame({"vec_id": batch.vec_id, "label": batch.label, "code": [r.tobytes().hex() for r in np.ascontiguousarray(at)], "error": error})

    return work
