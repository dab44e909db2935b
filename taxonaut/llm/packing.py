"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import n_words


def best_fit(sizes: list[int], capacities: tuple[int, ...], overhead: float) -> tuple[list[int], list[int]]:
    """(bin of each item, capacity of each bin), for sizes in falling order.

    An item goes to the open bin with the least room that holds it. If there
    is none, a bin opens: of the capacities that hold the item, the one with
    the least cost for each token that it will likely hold. It costs its
    length plus ``overhead``; beside the item it will hold as much of the
    tokens yet to come as its room's share of all open room. At the end every
    bin shrinks to the least capacity that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    at, filled, room = [0] * len(sizes), [], []
    free: dict[int, list[int]] = {}  # room -> bins
    rooms: list[int] = []  # those of free, in order
    left, open_room = sum(sizes), 0
    for i, size in enumerate(sizes):
        left -= size
        k = bisect_left(rooms, size)
        if k < len(rooms):
            old = rooms[k]
            b = free[old].pop()
            if not free[old]:
                del free[old], rooms[k]
            open_room -= size
        else:
            fits = capacities[bisect_left(capacities, size) :]
            likely = lambda c: size + (c - size) * min(1.0, left / max(1, open_room + c - size))
            best = min(fits, key=lambda c: ((c + overhead) / likely(c) if likely(c) else c, c))
            b, old = len(filled), best
            filled.append(0)
            room.append(0)
            open_room += best - size
        at[i], filled[b], room[b] = b, filled[b] + size, old - size
        if room[b]:
            if room[b] not in free:
                free[room[b]] = []
                insort(rooms, room[b])
            free[room[b]].append(b)
    return at, [capacities[bisect_left(capacities, f)] for f in filled]


def pack(docs: DataFrame, size: Column | None = None, capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192), overhead: float = 64.0, group_tokens: int = 1 << 21, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where each piece of each document lies: doc_id, piece, start, length, bin_id, capacity, offset, n_tokens.

    ``size`` is the number of tokens of a row (default: its words and one end
    mark; null counts as none). A document longer than the largest capacity
    is cut into pieces of that length and a rest, so no token is lost. Pieces
    are dealt by a hash of id, size and piece into groups of about
    ``group_tokens`` tokens, and each group is packed by best fit in falling
    order, ties by id and piece. Rows of equal id and size are counted first
    and dealt over all groups in turn, so neither a null id nor a repeated one
    makes a large group; null ids are ids like others.

    A bin id holds the group and the bin's number in it; ``offset`` is where a
    piece starts in its bin. A document of no tokens has one piece of length 0
    in a bin of the least capacity, shared with others where there is one.
    Repeated rows are packed each. No rows give no rows; other columns are
    ignored. One document of any length spreads over many groups.
    """
    size = n_words(text) + 1 if size is None else F.coalesce(size, F.lit(0))
    most = max(capacities)
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.cast("long").alias("n_tokens"))
    total = rows.agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(1, -(-(total.n or 0) // group_tokens), -(-total.rows // (group_tokens // 16)))
    rows = rows.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))  # rows alike in these are alike in the result
    last = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / most)
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("start", F.col("piece") * most).withColumn("length", F.least(F.col("n_tokens") - F.col("start"), F.lit(most)))
    dealt = F.least("copies", F.lit(groups).cast("long"))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), dealt - 1)))
    each = F.floor(F.col("copies") / dealt) + (F.col("share") < F.col("copies") % dealt).cast("long")
    rows = rows.withColumn("group", F.pmod(F.pmod(F.xxhash64("doc_id", "n_tokens", "piece"), F.lit(groups)) + F.col("share"), F.lit(groups)).cast("long")).withColumn("copies", each)

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.loc[part.index.repeat(part.copies)]
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        at, capacity = best_fit(part.length.tolist(), capacities, overhead)
        part["bin_id"] = part["group"] * (1 << 32) + np.array(at, dtype=np.int64)
        part["capacity"] = np.array([capacity[b] for b in at], dtype=np.int32)
        part["offset"] = part.groupby("bin_id").length.cumsum() - part.length
        return part[["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset", "n_tokens"]]

    kind = dict(docs.dtypes)[doc_id]
    return rows.groupBy("group").applyInPandas(work, f"doc_id {kind}, piece long, start long, length long, bin_id long, capacity int, offset long, n_tokens long")
