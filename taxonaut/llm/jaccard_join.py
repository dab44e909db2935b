"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Every document is a set of hashed word shingles. To overlap enough with any
partner, a document must share one of its ``n - T + 1`` rarest shingles with
it (its short lists), where T is the least overlap that can suffice. Those
route documents into groups; inside a group the short inverted lists are
heap-merged, the T - 1 long ones binary-probed, and documents that reach the
required overlap are linked.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, row_key, written
from .components import components

#: Bytes of text that are hashed together; a longer text goes alone.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes.

    A word's hash is a polynomial in its bytes, taken from running sums over
    all bytes of a piece, so no Python code runs for a single word.
    """

    def __init__(self, size: int):
        self.size, self.power, self.inverse = size, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word."""
        if len(data) > len(self.power):
            n = max(PIECE + 4096, len(data))
            self.power = np.cumprod(np.full(n, BASE, dtype=np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64))
        blank = BLANK[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[data] + np.uint64(1)) * self.power[: len(data)])])
        return start, mixed((sums[end] - sums[start]) * self.inverse[start])

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        run: list[bytes] = []
        total = 0
        for text in texts:
            run.append((text or "").encode("utf-8", "surrogatepass"))
            total += len(run[-1]) + 1
            if total >= PIECE:
                yield from self.piece(run)
                run, total = [], 0
        yield from self.piece(run)

    def piece(self, run: list[bytes]) -> Iterator[np.ndarray]:
        start, word = self.words(np.frombuffer(b"\n".join(run), dtype=np.uint8))
        first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in run]))
        for a, b in zip(first, first[1:]):
            n = min(self.size, b - a)
            if not n:
                yield np.empty(0, np.uint64)
                continue
            out = np.full(b - a - n + 1, n, dtype=np.uint64)
            for i in range(n):
                out = mixed(out * MIX + word[a + i : b - n + 1 + i])
            yield np.unique(out)


def least_overlap(n: int, percent: int) -> int:
    """The least overlap that a set of n can have with any partner."""
    return -(-percent * n // 100)


def required(n: int, m: int, percent: int) -> int:
    """The overlap at which 100 * common >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


class Forest:
    """Union-find."""

    def __init__(self, labels: list):
        self.up = list(range(len(labels)))
        first: dict = {}
        for i, x in enumerate(labels):
            self.up[i] = first.setdefault(x, i)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def search(sets: list[np.ndarray], labels: list, asked: list[int], percent: int, earlier: bool) -> Iterator[tuple[int, int]]:
    """Links (i, j) of the asked documents that join two components, each found by DivideSkip.

    Documents with equal labels are in one component already. A candidate of
    the document's own component isn't probed: its link changes nothing.
    ``earlier``: all documents are asked, and look at those before them.
    """
    lists: dict[int, list[int]] = {}
    rows = [s.tolist() for s in sets]
    for i, row in enumerate(rows):
        for s in row:
            lists.setdefault(s, []).append(i)
    forest = Forest(labels)
    for i in asked:
        n = len(rows[i])
        own = sorted((lists[s] for s in rows[i]), key=len)
        short = n - least_overlap(n, percent) + 1
        last, count = -1, 0
        long = own[short:]
        for j in [*heapq.merge(*(x for x in own[:short] if len(x) > 1)), -1]:
            if j == last:
                count += 1
                continue
            if last >= 0 and last != i and not (earlier and last > i) and forest.find(last) != forest.find(i):
                need = required(n, len(rows[last]), percent)
                left = len(long)
                for x in long:
                    if count >= need or count + left < need:
                        break
                    left -= 1
                    at = bisect_left(x, last)
                    count += at < len(x) and x[at] == last
                if count >= need:
                    forest.join(forest.find(last), forest.find(i))
                    yield i, last
            last, count = j, 1


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else b""


def profiled(docs: DataFrame, size: int, counters: int) -> DataFrame:
    """A row (doc_id, sig, n) for each document, and rows (part, counts) of a count-min table of shingles."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, table, held = Shingler(size), np.zeros(counters, dtype=np.uint32), []
        for batch in batches:
            found = list(shingler(batch.text))
            yield pd.DataFrame({"doc_id": batch.doc_id, "sig": [digest(s) for s in found], "n": [len(s) for s in found], "part": -1, "counts": None})
            held += found
            if sum(map(len, held)) > 1_000_000:
                table += np.bincount((np.concatenate(held) & np.uint64(counters - 1)).astype(np.int64), minlength=counters).astype(np.uint32)
                held = []
        if held:
            table += np.bincount((np.concatenate(held) & np.uint64(counters - 1)).astype(np.int64), minlength=counters).astype(np.uint32)
        table = np.minimum(table, 65535).astype(np.uint16)
        step = 1 << 15
        yield pd.DataFrame([(None, None, 0, i // step, table[i : i + step].tobytes()) for i in range(0, counters, step) if table[i : i + step].any()], columns=["doc_id", "sig", "n", "part", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(profile, f"doc_id {kind}, sig binary, n long, part int, counts binary")


def merged_counts(parts: DataFrame, counters: int) -> np.ndarray:
    """The count-min table of all documents: at most ``counters`` numbers, whatever the input."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.uint16).astype(np.uint64) for c in rows["counts"])
        return pd.DataFrame({"part": [rows.part.iloc[0]], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    out = np.zeros(counters, dtype=np.uint32)
    for row in parts.groupBy("part").applyInPandas(add, "part int, counts binary").toLocalIterator():
        got = np.frombuffer(row.counts, dtype=np.uint32)
        out[row.part << 15 : (row.part << 15) + len(got)] = got
    return out


def spare(n: int) -> int:
    """How many short lists more than one a document of n shingles has: then two must share as many more."""
    return n // 50


def short_lists(docs: DataFrame, size: int, percent: int, counts: np.ndarray, heavy: int, parts: int) -> DataFrame:
    """The rarest shingles of each document with half of its digest and its size, packed by part; long lists as rows.

    Shingles are ordered by their count-min count, then hash: any fixed order
    finds every link, this one keeps lists short. Up to 65535 the counts are
    upper bounds, so a packed shingle is in at most ``heavy`` documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, held, total = Shingler(size), [], 0
        for batch in batches:
            for s in shingler(batch.text):
                n = len(s)
                if n:
                    c = shared.value[(s & np.uint64(len(shared.value) - 1)).astype(np.int64)]
                    k = min(n, n - least_overlap(n, percent) + 1 + spare(n))
                    first = np.argsort(c, kind="stable")[:k]
                    held.append((s[first], c[first], np.full(k, int.from_bytes(digest(s)[:8], "little"), dtype=np.uint64), np.full(k, n, dtype=np.uint32)))
                    total += k
                if total > 2_000_000:
                    yield packed(held)
                    held, total = [], 0
        if held:
            yield packed(held)

    def packed(held: list) -> pd.DataFrame:
        s, c, d, n = (np.concatenate(x) for x in zip(*held))
        rows = pd.DataFrame({"s": s, "d": d, "n": n, "hot": c >= heavy}).drop_duplicates()
        hot, rows = rows[rows.hot], rows[~rows.hot]
        part = (rows.s.to_numpy() >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        s, d, n, part = rows.s.to_numpy()[order], rows.d.to_numpy()[order], rows.n.to_numpy()[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
        spans = [slice(a, b) for a, b in zip(edges, [*edges[1:], len(part)])]
        light = pd.DataFrame({"part": part[edges].astype(np.int64), "shingles": [s[x].tobytes() for x in spans], "ids": [d[x].tobytes() for x in spans], "sizes": [n[x].tobytes() for x in spans]})
        light["shingle"], light["id"], light["n"] = 0, 0, 0
        hot = pd.DataFrame({"part": -1, "shingles": None, "ids": None, "sizes": None, "shingle": hot.s.to_numpy().view(np.int64), "id": hot.d.to_numpy().view(np.int64), "n": hot.n.to_numpy().astype(np.int64)})
        return pd.concat([light, hot], ignore_index=True)

    return docs.select("text").mapInPandas(route, "part long, shingles binary, ids binary, sizes binary, shingle long, id long, n long")


def hubs(lists: DataFrame, percent: int) -> DataFrame:
    """(id, hub): a document's digest with the least digest of each of its short lists that holds another document.

    A list holds the documents of two neighbouring size classes: sizes of
    linked documents differ by less than a class. Documents with too few such
    lists to share with any one partner are left out.
    """
    ratio = np.log(100 / percent)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        s, d, n = (np.concatenate([np.frombuffer(x, kind) for x in rows[c]]) for c, kind in (("shingles", np.uint64), ("ids", np.uint64), ("sizes", np.uint32)))
        d, level = d.view(np.int64), np.floor(np.log(n) / ratio + 1e-9).astype(np.int64)
        s, d, n, level = np.tile(s, 2), np.tile(d, 2), np.tile(n, 2), np.concatenate([level, level + 1])
        order = np.lexsort((d, level, s))
        s, d, n, level = s[order], d[order], n[order], level[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (level[1:] != level[:-1])])
        starts = np.flatnonzero(new)
        run = np.repeat(np.arange(len(starts)), np.diff([*starts, len(s)]))
        more = (d[starts] != d[np.append(starts[1:], len(s)) - 1])[run]
        out = pd.DataFrame({"id": d[more], "hub": d[starts][run][more], "n": n[more].astype(np.int64), "s": s[more]})
        lists = out.drop_duplicates(["id", "s"]).groupby("id").size().rename("lists")
        out = out[["id", "hub", "n"]].drop_duplicates().join(lists, on="id")
        return out.assign(lists=out.lists.where(~out.id.duplicated(), 0))  # once a document

    light = lists.filter("part >= 0").groupBy("part").applyInPandas(join, "id long, hub long, n long, lists long")
    hot = lists.filter("part < 0").select("shingle", "id", "n").distinct()
    level = F.floor(F.log("n") / float(ratio) + 1e-9)
    hot = hot.withColumn("level", F.explode(F.array(level, level + 1)))
    least = hot.groupBy("shingle", "level").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub < top")
    hot = hot.join(least, ["shingle", "level"])
    hot = hot.groupBy("id", "hub", "n").agg(F.count(F.lit(1)).alias("lists"))
    found = written(light.unionByName(hot), "routes")
    enough = found.groupBy("id", "n").agg(F.sum("lists").alias("lists"))  # a hot list counts for both its levels: too many at most
    least_n = F.ceil(F.col("n") * percent / 100)
    enough = enough.filter(F.col("lists") >= 1 + F.floor(least_n / 50)).select("id").distinct()
    return found.select("id", "hub").distinct().join(enough, "id", "left_semi")


def linked(rows: DataFrame, percent: int, asked: bool, parts: int) -> DataFrame:
    """Links (a, b) inside each group (hub, salt) of rows (hub, salt, sig, shingles, label, asks).

    Only links between documents with different labels, as few as connect them.
    """

    def work(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in part.groupby(["hub", "salt"], sort=False):
            group = group.sort_values(["asks", "sig"]).drop_duplicates("sig", keep="last")
            if len(group) > 1:
                sets = [np.frombuffer(x, np.uint64) for x in group.shingles]
                who = np.flatnonzero(group.asks).tolist() if asked else list(range(len(sets)))
                sig = group.sig.tolist()
                out += [(sig[i], sig[j]) for i, j in search(sets, group.label.tolist(), who, percent, not asked)]
        return pd.DataFrame(out, columns=["a", "b"])

    rows = rows.withColumn("part", F.pmod(F.xxhash64("hub", "salt"), F.lit(parts)).cast("int"))
    return rows.groupBy("part").applyInPandas(work, "a binary, b binary")


def with_sets(docs: DataFrame, reps: DataFrame, routes: DataFrame, size: int, broadcast_rows: int) -> DataFrame:
    """The routes (sig, hub, salt, label, asks), each with the shingles of its document.

    ``reps`` (sig, doc_id) says where a set is found. A document's routes
    travel to its text, so that sets are made there and shuffled once.
    """
    to = routes.groupBy("sig").agg(F.collect_list(F.struct("hub", "salt", "label", "asks")).alias("routes"))
    to = written(reps.select("sig", "doc_id").join(to, "sig"), "routed")
    same = docs["doc_id"].eqNullSafe(to["doc_id"])
    texts = docs.join(F.broadcast(to) if routes.count() <= broadcast_rows else to, same).select("sig", "routes", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(size)
        for batch in batches:
            out, total = [], 0
            for sig, routes, s in zip(batch.sig, batch.routes, shingler(batch.text)):
                if digest(s) == sig:  # not another text of the same id
                    data = s.tobytes()
                    out += [(r["hub"], r["salt"], sig, data, r["label"], r["asks"]) for r in routes]
                    total += len(data) * len(routes)
                if total > 16_000_000:
                    yield pd.DataFrame(out, columns=columns)
                    out, total = [], 0
            yield pd.DataFrame(out, columns=columns)

    columns = ["hub", "salt", "sig", "shingles", "label", "asks"]
    return texts.mapInPandas(sets, "hub long, salt long, sig binary, shingles binary, label binary, asks boolean")


def half_of(sig: Column) -> Column:
    """The first 8 bytes of a digest as a little-endian long."""
    byte = lambda i: F.conv(F.hex(F.substring(sig, i + 1, 1)), 16, 10).cast("long")
    out = byte(0)
    for i in range(1, 8):
        out = out.bitwiseOR(F.shiftleft(byte(i), 8 * i))
    return out


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, block: int = 256, block_shingles: int = 200_000, broadcast_rows: int = 500_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The component of every document under links of Jaccard similarity >= percent / 100.

    A document's set: its distinct shingles of ``size`` words (runs of
    anything but ASCII white space, A-Z in lower case); a shorter one is a
    single shingle; one without words, or null, is linked with nothing.
    Returns a row per input row: doc_id, n_shingles, component_id (the least
    id in its component, itself included). Repeated rows are copies; rows with
    one id but different texts are judged each. A null id is linked like
    others, but is no component's least id unless all its ids are null. No
    rows give no rows; other columns are ignored.

    Equal sets are one node from the start, so copies never form pairs. A
    group of more than ``block`` documents, or of more than
    ``block_shingles`` shingles, is cut into blocks that all hold
    its pivot; documents whose block doesn't tie them to the pivot's component
    are then searched for in every block of the group. So each link is found or
    known to lie inside one component, and no group is held whole. Up to
    ``broadcast_rows`` routes are broadcast to the texts, else both shuffled.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    expected = (total.b or 0) // 6
    counters = 1 << max(16, min(24, (expected // 128).bit_length()))
    profile = written(profiled(docs, size, counters), "profile")
    counts = merged_counts(profile.filter("part >= 0").select("part", "counts"), counters)
    heavy = min(65_535, 4 * expected // counters + 1000)
    nodes = profile.filter("part < 0").select("doc_id", "sig", "n")
    lists = written(short_lists(docs, size, percent, counts, heavy, buckets_for(expected // 6, 1_000_000)), "short-lists")
    member = written(hubs(lists, percent), "hubs")

    rep = nodes.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).withColumn("id", half_of(F.col("sig")))
    rep = written(rep.join(member.select("id").distinct(), "id", "left_semi"), "reps")
    sized = member.join(rep.groupBy("id").agg(F.max("n").alias("n")), "id")
    groups = sized.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.min("id").alias("pivot")).filter("m > 1")
    groups = groups.withColumn("blocks", F.greatest(F.ceil(F.col("m") / block), F.least(F.ceil(F.col("n") / block_shingles), F.col("m"))).cast("long")).drop("n")
    inside = rep.join(member, "id").join(groups, "hub").select("sig", "hub", "blocks", (F.col("id") == F.col("pivot")).alias("pivot"))
    salt = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    salts = F.when(F.col("pivot") & (F.col("blocks") > 1), everywhere).otherwise(F.array(salt))
    routes = inside.select("sig", "hub", F.explode(salts).alias("salt"), F.col("sig").alias("label"), F.lit(False).alias("asks"))
    parts = buckets_for(member.count(), 1024)
    edges = written(linked(with_sets(docs, rep, routes, size, broadcast_rows), percent, False, parts), "links")
    roots = components(edges)

    large = written(inside.filter("blocks > 1"), "large-groups")
    if large.count():
        known = large.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("label", F.coalesce("root", "sig"))
        main = known.filter("pivot").groupBy("hub").agg(F.min("label").alias("main"))
        known = written(known.join(main, "hub").select("hub", "sig", "blocks", "label", (F.col("label") != F.col("main")).alias("asks")), "inside")
        runs = written(known.filter("asks").groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("runs")), "runs")
        if runs.count():
            known = known.join(runs, "hub")
            each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run")
            here = known.select("sig", "hub", salt.alias("block"), "label", F.lit(False).alias("asks"), each)
            there = known.filter("asks").select("sig", "hub", F.explode(everywhere).alias("block"), "label", "asks", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("runs")).alias("run"))
            routes = here.unionByName(there).select("sig", "hub", F.xxhash64("block", "run").alias("salt"), "label", "asks")
            more = written(linked(with_sets(docs, rep, routes, size, broadcast_rows), percent, True, parts), "links")
            roots = components(edges.union(more))

    named = nodes.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = named.filter("n > 0").join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return named.union(nodes.filter("n = 0").select("doc_id", "n", "doc_id"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which one of each component stays: that with the least id. Columns as given.

    A null id comes after all others. Rows with one id (or none) but different
    texts are documents of their own; of one component the least text hash
    decides between equal ids. Of rows equal in id and text one stays.
    Documents without words stay all.
    """
    keyed = docs.withColumn("_key", row_key(F.col(doc_id), F.col(text))).withColumn("_row", row_key(*(F.col(f"`{c}`") for c in docs.columns)))
    found = jaccard_components(keyed, size, percent, doc_id="_key", text=text).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), "_key", "_row")
    first = keyed.select("_key", order.alias("_o")).join(found, "_key").groupBy("component_id").agg(F.min("_o").alias("_o"))
    return keyed.join(first.select("_o._row"), "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)
