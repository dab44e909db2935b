"""Alignment of two tokenizers' tokens over whole texts, and how often each pair of their ids is linked."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

TOKENIZERS = "/opt/tokenizers"

#: Characters on whose classes (letter, number, space) all versions of Unicode in use agree; texts with others take the slower library.
PLAIN = re.compile("[^\x00-ɏͰ-ͳΆ-ϿЀ-ҁҐ-ӿ‐-‧‰-⁞₠-₵ぁ-ゔァ-ヺ一-龥가-힣！-～]")

#: How the byte-level vocabulary cuts texts before its merges; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: id pairs are one int: A * RIGHT + B.
RIGHT = 32_768

#: No id of A or B; parts them in a window's key.
MARK = 0xFFFF


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the rest from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Left:
    """The byte-level tokenizer A, read from its JSON file."""

    def __init__(self, raw: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(raw)
        self.slow.encode_special_tokens = True
        table, found = byte_of(), json.loads(raw)
        special = {t["id"] for t in found.get("added_tokens", [])}
        ranks = {bytes(table[c] for c in t): i for t, i in found["model"]["vocab"].items() if i not in special}
        self.bytes = [b""] * (max(found["model"]["vocab"].values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        self.fast = tiktoken.Encoding("left", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. The fast library's merges are the same; it is used where its classes of characters are, too."""
        if PLAIN.search(text) is None:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint16)


class Right:
    """The piece tokenizer B, which puts a space before each text itself."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        piece = self.model.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(array("H", self.model.encode(text, num_threads=1)), np.uint16)


class Spelling:
    """The bytes of ids, by a table of all entries' bytes."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(t) for t in entries], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """``ends``: running sums of the ids' sizes."""
        n = self.size[ids]
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + n, n)].tobytes()


class Windows:
    """Alignments of windows that lie one after another; both sides of a window cover the same bytes.

    ``at_left`` and ``at_right`` say where the windows' ids begin, and end with
    the numbers of ids.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, size_left: np.ndarray, size_right: np.ndarray, at_left: np.ndarray, at_right: np.ndarray, names: list[str], most: int = 4096):
        left, right = left.astype(np.int64), right.astype(np.int64)
        ends_left, ends_right = np.cumsum(size_left[left]), np.cumsum(size_right[right])
        closes_left, closes_right = (ends_in(x, y) for x, y in ((ends_left, ends_right), (ends_right, ends_left)))
        last_left, last_right = np.flatnonzero(closes_left), np.flatnonzero(closes_right)  # ids that end a group
        n, m = np.diff(last_left, prepend=-1), np.diff(last_right, prepend=-1)
        first_left, first_right = last_left - n + 1, last_right - m + 1
        groups = np.arange(len(n))
        # a group's ids of A, then those of B, each with what follows it
        order = np.empty(len(left) + len(right), np.int64)
        order[np.arange(len(left)) + np.repeat(first_right, n)] = 2 * left + closes_left
        order[np.arange(len(right)) + np.repeat(last_left + 1, m)] = 2 * (right + len(size_left)) + closes_right
        parts = list(map(names.__getitem__, order.tolist()))
        cut = (at_left + at_right).tolist()
        self.texts = ["".join(parts[x:y])[:-1] for x, y in zip(cut, cut[1:])]
        upto = np.searchsorted(last_left, at_left)  # groups before each window
        self.groups = np.diff(upto).tolist()
        links = n * m
        heavy = np.flatnonzero(links > most)  # groups that aren't multiplied out
        links[heavy] = 0
        of, k = np.repeat(groups, links), np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        pairs = left[first_left[of] + k // m[of]] * RIGHT + right[first_right[of] + k % m[of]]
        raw, ends = pairs.astype(np.int32).tobytes(), np.concatenate([[0], np.cumsum(links)])[upto].tolist()
        self.pairs = [raw[4 * x : 4 * y] for x, y in zip(ends, ends[1:])]
        self.weighted = [weighted(left[first_left[g] : last_left[g] + 1], right[first_right[g] : last_right[g] + 1]) for g in heavy]
        self.heavy_in = np.searchsorted(upto, heavy, side="right") - 1  # their windows


def ends_in(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the ends are among the others."""
    marks = np.zeros(int(ends[-1]) + 1, bool)
    marks[others] = True
    return marks[ends]


def weighted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of one group and how often each is linked."""
    (u, n), (v, m) = np.unique(left, return_counts=True), np.unique(right, return_counts=True)
    return (u[:, None] * RIGHT + v).ravel().astype(np.int32), np.outer(n, m).ravel().astype(np.int64)


#: A text without tokens.
NOTHING = (0, 0, 0, 0, "", np.empty(0, np.int32), np.empty(0, np.int64))

#: Aligners of this worker process by their vocabularies, so that tasks find what earlier ones have loaded and aligned.
_aligners: dict[int, Aligner] = {}


def aligner(left: str, right: bytes) -> Aligner:
    key = hash((left, right))
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(Left(left), Right(right))
    return _aligners[key]


class Aligner:
    """Aligns texts; windows between anchors are aligned once for each pair of id tuples."""

    def __init__(self, left: Left, right: Right, memo: int = 300_000, longest: int = 64, chunk: int = 1 << 18):
        self.left, self.right = left, right
        self.spelling = [Spelling(x.bytes) for x in (left, right)]
        self.size = [x.size for x in self.spelling]
        self.names = [f"{i}{c}" for x, end in ((left, "|"), (right, ";")) for i in range(len(x.bytes)) for c in (",", end)]
        self.marked = [np.array([t[:1] == b" " for t in x.bytes]) for x in (left, right)]
        self.memo: dict[bytes, tuple[str, int, bytes]] = {}
        self.most, self.longest, self.chunk = memo, longest, chunk

    def keys(self, text: str | None) -> tuple[int, int, list[bytes]] | None:
        """Numbers of tokens and one key a window: its ids of A, a mark, its ids of B. None for texts without tokens."""
        if not text:
            return None
        whole = " " + text
        a, b, raw = self.left.encode(whole), self.right.encode(text), whole.encode()
        ends_a, ends_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        if self.spelling[0].of(a, ends_a) != raw or self.spelling[1].of(b, ends_b) != raw:
            return None
        # anchors: bytes at which both sides start a token that is marked with a space
        at = np.full(len(raw), -1, dtype=np.int32)
        i = np.flatnonzero(self.marked[0][a])
        at[ends_a[i] - self.size[0][a[i]]] = i
        j = np.flatnonzero(self.marked[1][b])
        i = at[ends_b[j] - self.size[1][b[j]]]
        i, j = i[i >= 0], j[i >= 0]
        skip = int(len(i) > 0 and i[0] == j[0] == 0)  # the first window starts at 0 in any case
        i, j = (np.concatenate([[0], x[skip:], [n]]) for x, n in ((i, len(a)), (j, len(b))))
        n, m, w = i[1:] - i[:-1], j[1:] - j[:-1], np.arange(len(i) - 1)
        both = np.full(len(a) + len(b) + len(w), MARK, np.uint16)
        both[np.arange(len(a)) + np.repeat(j[:-1] + w, n)] = a
        both[np.arange(len(b)) + np.repeat(i[1:] + w + 1, m)] = b
        packed, cut = both.tobytes(), (2 * (i + j + np.arange(len(i)))).tolist()
        return len(a), len(b), [packed[x:y] for x, y in zip(cut, cut[1:])]

    def many(self, texts: list[str | None]) -> list[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, groups_sha256, linked id pairs ascending, how often each is linked.

        Windows that the memo doesn't know are aligned for some texts at once.
        """
        out: list[tuple] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= self.chunk):
                size, end = size + len(texts[end] or ""), end + 1
            out += self.some(texts[at:end])
            at = end
        return out

    def some(self, texts: list[str | None]) -> list[tuple]:
        if len(self.memo) > self.most:
            self.memo.clear()
        cut = [self.keys(t) for t in texts]
        found = [list(map(self.memo.get, x[2])) if x else [] for x in cut]
        new = list({key: None for x, f in zip(cut, found) if None in f for key, y in zip(x[2], f) if y is None})  # each window once
        made, heavy = self.windows(new) if new else ({}, {})
        return [self.summed(x, [made[k] if y is None else y for k, y in zip(x[2], f)] if None in f else f, heavy) if x else NOTHING for x, f in zip(cut, found)]

    def summed(self, cut: tuple[int, int, list[bytes]], found: list[tuple[str, int, bytes]], heavy: dict) -> tuple:
        n_a, n_b, keys = cut
        texts, numbers, pairs = zip(*found)
        ids, times = np.unique(np.frombuffer(b"".join(pairs), dtype=np.int32), return_counts=True)
        if heavy:  # windows with long groups, as often as they occur
            more = [(heavy[k][0], heavy[k][1] * n) for k, n in Counter(k for k in keys if k in heavy).items()]
            ids, times = np.concatenate([ids, *(p for p, _ in more)]), np.concatenate([times, *(t for _, t in more)])
            ids, of = np.unique(ids, return_inverse=True)
            times = np.bincount(of, times).astype(np.int64)
        return n_a, n_b, sum(numbers), int(times.sum()), hashlib.sha256(";".join(texts).encode()).hexdigest(), ids, times

    def windows(self, keys: list[bytes]) -> tuple[dict, dict]:
        """Alignments of different windows (text, groups, pairs) by their ids, kept for later texts; and distinct pairs of those with long groups."""
        both = np.frombuffer(b"".join(keys), np.uint16)
        ends = np.cumsum([len(k) // 2 for k in keys])
        marks = np.flatnonzero(both == MARK)
        left = np.arange(len(both)) < np.repeat(marks, np.diff(ends, prepend=0))
        right = ~left
        right[marks] = False
        n, m = (np.concatenate([[0], np.cumsum(x)[ends - 1]]) for x in (left, right))
        w = Windows(both[left], both[right], *self.size, n, m, self.names)
        made = dict(zip(keys, zip(w.texts, w.groups, w.pairs)))
        heavy: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for k, (p, t) in zip(w.heavy_in.tolist(), w.weighted):
            old = heavy.get(keys[k])
            heavy[keys[k]] = (p, t) if old is None else (np.concatenate([old[0], p]), np.concatenate([old[1], t]))
        self.memo.update((k, x) for k, x in made.items() if len(k) <= 2 * self.longest and k not in heavy)
        return made, heavy


def linked(docs: DataFrame, left: str, right: bytes, doc_id: str = "doc_id", text: str = "text", rows: int = 500) -> DataFrame:
    """Each document with its alignment and its distinct linked id pairs (``pairs`` ascending, ``times`` each)."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((left, right))  # two vocabulary files of a few MB
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, n = aligner(*files.value).many, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = many(part.column("text").to_pylist())
                offsets = pa.array(np.cumsum([0, *(len(g[5]) for g in got)]), pa.int32())
                flat = lambda i, t: pa.array(np.concatenate([g[i] for g in got]).astype(t))
                ints = [pa.array([g[i] for g in got], pa.int64()) for i in range(4)]
                lists = [pa.ListArray.from_arrays(offsets, flat(5, np.int32)), pa.ListArray.from_arrays(offsets, flat(6, np.int64))]
                ids = pa.array(range(n, n + len(got)), pa.int64())
                n += len(got)
                yield pa.RecordBatch.from_arrays([ids, part.column("doc_id"), *ints, pa.array([g[4] for g in got], pa.string()), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.mapInArrow(work, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, docs (rows that hold it), best (no pair of its A id is in more): each task sums what it has read first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, held = np.empty(0, np.int32), np.empty(0, np.int64), 0
        parts: list[np.ndarray] = []

        def merged():
            new, times = np.unique(np.concatenate(parts), return_counts=True) if parts else (ids, n)
            both, of = np.unique(np.concatenate([ids, new]), return_inverse=True)
            return both, np.bincount(of, np.concatenate([n, times]), len(both)).astype(np.int64)

        emit = lambda: pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["pair", "docs"])
        for batch in batches:
            parts.append(batch.column("pairs").flatten().to_numpy(zero_copy_only=False))
            held += len(parts[-1])
            if held > 1 << 23:
                (ids, n), parts, held = merged(), [], 0
            if len(ids) > 1 << 22:  # memory stays bounded: what was summed so far goes on
                yield emit()
                ids, n = np.empty(0, np.int32), np.empty(0, np.int64)
        if parts:
            ids, n = merged()
        yield emit()

    counts = rows.select("pairs").mapInArrow(partial, "pair int, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = written(counts.withColumn("a", F.floor(F.col("pair") / RIGHT).cast("int")), "pair-counts")
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))  # as many rows as A has entries: bounded by its vocabulary
    return counts.join(F.broadcast(best), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least number of documents such that at most ``most`` pairs are in that many; 1 if all fit."""
    bits = F.floor(F.log2(F.col("docs").cast("double"))).cast("int")
    by_bits = {r.b: r.n for r in counts.groupBy(bits.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    total, least = 0, 64
    for b in sorted(by_bits, reverse=True):
        total += by_bits[b]
        if total > most:
            return 1 << (b + 1)
    return 1


def cross_tokenizer_alignment(docs: DataFrame, left: str | None = None, right: bytes | None = None, tokenizers: str = TOKENIZERS, table_pairs: int = 4_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Aligns the tokens of each text under two tokenizers and weighs their links by the whole corpus.

    A encodes a space and the text, B the text, to which it adds the space.
    Shared ends before tokens that both sides mark with a space are anchors;
    they cut a text into windows of token ids, and a window is aligned once
    for each pair of id tuples. Inside, every byte end that both sides share
    closes a group; all pairs of a group are links.

    Returns doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links of
    pairs that are in as many documents as any pair of their A id), count_sum
    (documents that hold the pair, summed over links) and groups_sha256.

    Null and empty texts, and those whose tokens don't spell them exactly, have
    no tokens: zeros and an empty digest. Repeated rows count each, null ids
    are ids like others, no rows give none; other columns are ignored. A text
    of any length is one row; a group of any length passes on distinct ids.

    The ``table_pairs`` most frequent pairs (16 bytes each) are looked up in
    memory; rarer ones, each in few documents, are joined by a shuffle.
    """
    left = Path(tokenizers, "byte_bpe_50k.json").read_text() if left is None else left
    right = Path(tokenizers, "piece_bpe_32k.model").read_bytes() if right is None else right
    rows = written(linked(docs, left, right, doc_id, text), "linked-pairs")
    counts = written(pair_counts(rows), "pair-table")
    least = frequent_from(counts, table_pairs)
    table = counts.filter(F.col("docs") >= least).toArrow()
    keys = table.column("pair").to_numpy()
    order = np.argsort(keys)
    shared = rows.sparkSession.sparkContext.broadcast((keys[order], table.column("docs").to_numpy()[order], table.column("best").to_numpy()[order]))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs_of, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            ids, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(keys, ids), max(len(keys) - 1, 0))
            known = keys[at] == ids if len(keys) else np.zeros(len(ids), bool)
            at = at[known]
            n, t = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            n[known], t[known] = docs_of[at] * times[known], best[at] * times[known]
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[ends] - c[ends - sizes]
            rare = np.concatenate([[0], np.cumsum(~known)])
            offsets = pa.array(np.concatenate([[0], rare[ends]]), pa.int32())
            more = [pa.ListArray.from_arrays(offsets, pa.array(x[~known])) for x in (ids, times)]
            columns = {k: batch.column(k) for k in names if k not in ("n_best", "count_sum")} | {"n_best": pa.array(total(t)), "count_sum": pa.array(total(n))}
            yield pa.RecordBatch.from_arrays([*(columns[k] for k in names), *more], [*names, "rare", "rare_times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(weigh, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<int>, rare_times array<long>")
    if least > 1:
        out = with_rare(written(out, "weighed"), counts.filter(F.col("docs") < least))
    return out.select(names[1:])


def with_rare(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds what the links of rare pairs weigh; a rare pair is in few documents, so no key is hot."""
    long = rows.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("t"))
    more = long.join(counts, "pair").groupBy("row").agg(F.sum(F.col("t") * F.col("docs")).alias("_n"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_t"))
    out = rows.join(more, "row", "left")
    return out.withColumn("count_sum", F.col("count_sum") + F.coalesce("_n", F.lit(0))).withColumn("n_best", F.col("n_best") + F.coalesce("_t", F.lit(0)))
