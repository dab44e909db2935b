"""Language-model scoring by prediction by partial matching over bytes.

The model is the trie of all byte contexts up to ``order`` in the training
texts, with symbol exclusion and escapes as likely as what a context has seen
once. It is kept as tables of strings, not on any one machine. The log
probability of each different string of the corpus is found once, by joins
from the longest context down; a block of documents then gets just those of
its own strings, so what a task holds is bounded by its own text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

#: Bytes that UTF-8 never holds: padding before a text, and the end of one.
PAD, END = b"\xfe", b"\xff"
PIECE = 1 << 18


def prepared(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; a null text is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def strings(texts: list[bytes], order: int) -> np.ndarray:
    """The (order + 1)-byte string that ends in each byte and in the end of each text, as integers."""
    whole = np.frombuffer(b"".join(PAD * order + t + END for t in texts), dtype=np.uint8)
    keys = np.zeros(max(0, len(whole) - order), dtype=np.int64)
    for i in range(order + 1):
        keys = (keys << 8) | whole[i : len(whole) - order + i]
    return keys[whole[order:] != PAD[0]]


def pieces(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about PIECE bytes."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) + 1
        if size >= PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of ascending runs of (keys, counts), with their sums."""
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first)


def counted(docs: DataFrame, order: int) -> DataFrame:
    """(word, key, n): how often the training texts hold each word and each string of order + 1 bytes of any text.

    A word has key 0, a string the word ''. What only held-out texts hold has n 0.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter = Counter()
        for batch in batches:
            for trains in (True, False):
                for run in pieces(prepared(t) for t, out in zip(batch.text, batch.held_out) if out != trains):
                    keys, n = np.unique(strings(run, order), return_counts=True)
                    held.append((keys, n * trains))
                    for t in run:
                        words.update(t.split() if trains else dict.fromkeys(t.split(), 0))
                    if sum(len(k) for k, _ in held[1:]) > 300_000 + len(held[0][0]) // 2:
                        held = [summed(held)]
                    if len(words) > 100_000:
                        yield of_words(words)
                        words = Counter()
        yield of_words(words)
        if held:
            keys, n = summed(held)
            for i in range(0, len(keys), 100_000):
                some = slice(i, i + 100_000)
                yield pd.DataFrame({"word": np.full(len(keys[some]), "", dtype=object), "key": keys[some], "n": n[some]})

    def of_words(words: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": np.array([w.decode("utf-8", "surrogatepass") for w in words], dtype=object), "key": np.zeros(len(words), dtype=np.int64), "n": np.fromiter(words.values(), np.int64, len(words))})

    return docs.select("text", "held_out").mapInPandas(count, "word string, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


def ending(key: Column, n: int) -> Column:
    """The last n bytes of a string."""
    return key.bitwiseAND(F.lit((1 << 8 * n) - 1))


def before(key: Column, n: int) -> Column:
    """The n bytes before the last one."""
    return ending(F.shiftright(key, 8), n)


def trie(grams: DataFrame, order: int) -> dict[int, DataFrame]:
    """The levels of the model: for each length up to order + 1 its strings (key, n, below).

    The longest strings (key, n) are given with their counts. A shorter one counts the different
    strings that are longer by a byte in front and end in it: a symbol is new
    to a context only where the longer context hadn't seen it. ``below`` is
    the count of the string without its first byte; at most 256 strings share
    one, so no window is large.
    """
    out, level = {}, grams
    for n in range(order + 1, 0, -1):
        tail = ending(F.col("key"), n - 1)
        rows = level.withColumn("below", F.count(F.lit(1)).over(W.partitionBy(tail))) if n > 1 else level.withColumn("below", F.lit(0).cast("long"))
        out[n] = written(rows, f"ppm-level-{n}")
        level = out[n].groupBy(tail.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return out


def contexts(level: DataFrame, n: int) -> DataFrame:
    """What each context of n bytes has seen: t (counts), d (different symbols), s (those seen once), and as the next shorter one counts them x and y."""
    one = lambda c: F.sum((F.col(c) == 1).cast("long"))
    return level.groupBy(before(F.col("key"), n).alias("context")).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"), one("n").alias("s"), F.sum("below").alias("x"), one("below").alias("y"))


def log_probabilities(grams: DataFrame, levels: dict[int, DataFrame], order: int) -> DataFrame:
    """(key, value): log10 P(last byte | the bytes before it) of each string (key, n) of order + 1 bytes.

    An escape from a context has the share (s + 1) / (t + s + 2), its symbols
    share the rest by their counts. What a longer context has seen is
    excluded from the shorter ones, by differences of sums. Strings seen in
    training end at the longest context; only the others go down. Contexts of
    a byte and less are few by construction and broadcast.
    """
    zero = F.lit(0).cast("long")
    rows = grams.select("key", F.lit(0.0).alias("value"), F.lit(True).alias("open"), zero.alias("d0"), zero.alias("x0"), zero.alias("y0"), F.col("n").alias("c"))
    done = None
    for n in range(order, -1, -1):
        seen = contexts(levels[n + 1], n)
        rows = rows.withColumn("context", before(F.col("key"), n)).join(F.broadcast(seen) if n < 2 else seen, "context", "left")
        if n < order:
            own = levels[n + 1].select(F.col("key").alias("own"), F.col("n").alias("c"))
            rows = rows.withColumn("own", ending(F.col("key"), n + 1)).join(F.broadcast(own) if n < 2 else own, "own", "left")
        t, s = F.coalesce("t", zero) - F.col("x0"), F.coalesce("s", zero) - F.col("y0")
        some = F.col("open") & (F.coalesce("d", zero) > F.col("d0"))
        hit = some & (F.coalesce("c", zero) > 0)
        escape = (s + 1) / (t + s + 2)
        value = F.col("value") + F.when(hit, F.log10((1 - escape) * F.col("c") / t)).when(some, F.log10(escape)).otherwise(0.0)
        rows = rows.select("key", value.alias("value"), (F.col("open") & ~hit).alias("open"), *(F.coalesce(a, zero).alias(f"{a}0") for a in "dxy"))
        if n == order:
            top = written(rows, "ppm-top")
            done, rows = top.filter("not open").select("key", "value"), top.filter("open")
    rest = F.when(F.col("open"), F.log10(F.greatest(256 - F.col("d0"), F.lit(1)))).otherwise(0.0)
    return done.union(rows.select("key", F.col("value") - rest))


def score(docs: DataFrame, held_out: Column, order: int = 4, block_bytes: int = 10_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """log10 probability of every text, with the words' smoothed unigram score beside it.

    Learns from rows where ``held_out`` isn't true and scores all rows, whole.
    Returns doc_id, held_out, n_tokens (words and one end), n_known, the
    training corpus's train_tokens, base_score (add-one unigrams) and score
    (bytes of the lower-cased text and its end). ``order`` is 6 at most.

    A null text is empty and still has its end; a null id is an id like
    others. Repeated rows count each in training and get equal scores. With
    nothing to learn from, every byte has probability 1/256. No rows give no
    rows; other columns are ignored.

    The corpus is read once for the counts and once, dealt into blocks by a
    hash of id and text, for what each block needs and its scores. A frequent
    string has one row a block where it is joined with its one value, which
    splits as a skewed join does.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = written(counted(docs, order), "ppm-counts")
    grams = counts.filter("word = ''").select("key", "n")
    value = log_probabilities(grams, trie(grams.filter("n > 0"), order), order)
    words = counts.filter("word <> ''")
    values = value.select(F.lit("").alias("word"), "key", "value").union(words.select("word", "key", F.col("n").cast("double")))
    total = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")).first()
    blocks, ends = max(1, -(-(size.bytes or 0) // block_bytes)), size.ends
    n, v = (total.n or 0) + ends, total.v + (ends > 0)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def wanted(rows: pd.DataFrame) -> pd.DataFrame:
        words: set[bytes] = set()
        parts = []
        for run in pieces(map(prepared, rows.text)):
            parts.append(np.unique(strings(run, order)))
            words.update(*map(bytes.split, run))
        grams = np.unique(np.concatenate(parts))
        word = np.array([w.decode("utf-8", "surrogatepass") for w in words] + [""] * len(grams), dtype=object)
        return pd.DataFrame({"block": rows.block.iloc[0], "word": word, "key": np.concatenate([np.zeros(len(words), dtype=np.int64), grams])})

    def judge(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        own = known[known.word != ""]
        logs = dict(zip((w.encode("utf-8", "surrogatepass") for w in own.word), np.log10(own.value.to_numpy() + 1.0).tolist()))
        rest = known[known.word == ""].sort_values("key")
        grams, log_p = rest.key.to_numpy(), rest.value.to_numpy()
        del known, own, rest  # a worker's memory is small
        out = []
        for run in pieces(map(prepared, rows.text)):
            keys = strings(run, order)
            at = np.argsort(keys)
            found = np.empty(len(keys))
            found[at] = log_p[np.searchsorted(grams, keys[at])]
            sums = np.add.reduceat(found, np.cumsum([0] + [len(t) + 1 for t in run[:-1]]))
            for t, total in zip(run, sums):
                values = np.array([logs[w] for w in t.split()])
                base = values.sum() + np.log10(ends + 1.0) - (len(values) + 1) * np.log10(n + v + 1.0)
                out.append((len(values) + 1, int(np.count_nonzero(values)) + (ends > 0), n, base, total))
        out = pd.DataFrame(out, columns=["n_tokens", "n_known", "train_tokens", "base_score", "score"])
        out.insert(0, "held_out", rows.held_out.to_numpy())
        out.insert(0, "doc_id", rows.doc_id.to_numpy())
        return out

    asked = dealt.groupBy("block").applyInPandas(wanted, "block int, word string, key long")
    slices = asked.join(values, ["word", "key"]).select(F.col("block").alias("to"), "word", "key", "value")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(slices.groupBy("to")).applyInPandas(judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
