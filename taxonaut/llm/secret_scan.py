"""Secret scans: base patterns, and formats learned by grammar inference.

Credentials that carry a label (what the base patterns call them) train one
probabilistic automaton a kind: their prefix tree, whose statistically
compatible states are merged. Candidates are scored by how much likelier a
format makes them than the background automaton, whose states are symbols: it
holds what followed each symbol in all tokens without a label.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, written

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: What may be a credential: by the alphabet and the least length of the widest base pattern; and the parts of such a run.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
PART = re.compile(r"[A-Za-z0-9+_.-]{6,}")
TOKEN = re.compile(r"\S{12,}")
CUE = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)
END = ""


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), by start, then kind."""
    out = []
    if CUE.search(text):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def gaps(text: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """What the spans taken (by start) leave of a text."""
    out, at = [], 0
    for start, _, end, _ in [*taken, (len(text), 0, 0, 0)]:
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return out


def parts(value: str) -> list[tuple[int, int]]:
    """Spans of the parts between / and = of a candidate that has such marks."""
    return [m.span() for m in PART.finditer(value)] if "/" in value or "=" in value else []


class Automaton:
    """A probabilistic automaton: for each state, how often each symbol (or the end) followed, and where it leads.

    A symbol that never followed a state has a share by how often all states
    saw it, and leads where most symbols of the state lead; an end that never
    came has a small fixed share.
    """

    #: Counts that a state lends to symbols it hasn't seen, and to an end it hasn't seen.
    LENT, LENT_END = 3.0, 0.001
    #: Symbols in all, for what no state has seen.
    SYMBOLS = 66

    def __init__(self):
        self.counts: list[dict[str, int]] = [{}]
        self.next: list[dict[str, int]] = [{}]

    def state(self) -> int:
        self.counts.append({})
        self.next.append({})
        return len(self.next) - 1

    def add(self, string: str, deep: int = 256) -> None:
        """Counts a string in the prefix tree; symbols after the first ``deep`` ones share one state of their branch."""
        at = 0
        for i, c in enumerate(string):
            self.counts[at][c] = self.counts[at].get(c, 0) + 1
            if c not in self.next[at]:
                self.next[at][c] = at if i > deep else self.state()
            at = self.next[at][c]
        self.counts[at][END] = self.counts[at].get(END, 0) + 1

    def differ(self, a: int, b: int, alpha: float) -> bool:
        """Whether the followers of two states differ by more than chance (Hoeffding)."""
        n, m = sum(self.counts[a].values()), sum(self.counts[b].values())
        if not n or not m:
            return False
        bound = math.sqrt(math.log(2 / alpha) / 2) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(self.counts[a].get(c, 0) / n - self.counts[b].get(c, 0) / m) > bound for c in self.counts[a].keys() | self.counts[b].keys())

    def alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states, and all states that the same symbols lead to from both, differ by chance only."""
        todo, seen = [(a, b)], {(a, b)}
        while todo:
            a, b = todo.pop()
            if self.differ(a, b, alpha):
                return False
            pairs = {(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()}
            pairs = {(x, y) for x, y in pairs - seen if x != y}
            seen |= pairs
            todo += pairs
        return True

    def joined(self, a: int, b: int) -> Automaton:
        """The automaton in which b is a, and so are the states that the same symbols lead to."""
        up = list(range(len(self.next)))

        def find(i: int) -> int:
            while up[i] != i:
                i = up[i]
            return i

        out = Automaton()
        out.counts, out.next = [dict(x) for x in self.counts], [dict(x) for x in self.next]
        todo = [(a, b)]
        while todo:
            a, b = sorted(map(find, todo.pop()))
            if a == b:
                continue
            up[b] = a
            for c, n in out.counts[b].items():
                out.counts[a][c] = out.counts[a].get(c, 0) + n
            for c, to in out.next[b].items():
                if c in out.next[a]:
                    todo.append((out.next[a][c], to))
                else:
                    out.next[a][c] = to
            out.counts[b], out.next[b] = {}, {}
        out.next = [{c: find(to) for c, to in x.items()} for x in out.next]
        return out

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to the tree below a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.counts[b].items():
                self.counts[a][c] = self.counts[a].get(c, 0) + n
            below, self.counts[b], self.next[b] = self.next[b], {}, {}
            for c, to in below.items():
                if to == b:
                    self.next[a].setdefault(c, a)
                elif c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def merge(self, alpha: float, least: int = 30) -> Automaton:
        """Merges compatible states: first those of one depth, then those of different depths.

        States after equally many symbols are one unless their strings show
        that they differ. Across depths that takes evidence: both have
        ``least`` strings at least, and all that follows them agrees, the
        ends included. So few random strings still keep their length and
        fixed parts, where small states would else be merged into one.
        """
        layer, order = [0], [0]
        while layer:
            kept: list[int] = []
            for up in layer:
                for c, q in sorted(self.next[up].items()):
                    if q == up:
                        continue
                    same = next((r for r in kept if r == q or self.alike(r, q, alpha)), None)
                    if same is None:
                        kept.append(q)
                    elif same != q:
                        self.fold(same, q)
                        self.next[up][c] = same
            layer = kept
            order += kept
        out, kept = self, []
        for q in order:
            if q and not out.counts[q]:
                continue  # merged with another by a join
            if sum(out.counts[q].values()) >= least:
                same = next((r for r in kept if out.counts[r] and out.alike(r, q, alpha)), None)
                if same is None:
                    kept.append(q)
                else:
                    out = out.joined(same, q)
        return out

    def states(self) -> list[int]:
        """The states that can be reached, the first one first."""
        seen, todo = {0: None}, [0]
        while todo:
            for to in self.next[todo.pop()].values():
                if to not in seen:
                    seen[to] = None
                    todo.append(to)
        return list(seen)

    def table(self) -> tuple[list[dict[str, tuple[float, int | None]]], list[float], list[int | None], dict[str, float]]:
        """Logs for :func:`likelihood`: of each state's symbols with where they lead, what any other starts from, where it leads, and its own share."""
        total: dict[str, int] = {}
        for counts in self.counts:
            for c, n in counts.items():
                if c != END:
                    total[c] = total.get(c, 0) + n
        seen = sum(total.values()) + 0.1 * self.SYMBOLS
        share = {c: (n + 0.1) / seen for c, n in total.items()}
        share[END] = 0.1 / seen  # of a symbol that no state has seen
        known, rest, most = [], [], []
        for counts, to in zip(self.counts, self.next):
            size = sum(counts.values()) + self.LENT + self.LENT_END
            here = {c: (math.log((n + self.LENT * share[c]) / size), to.get(c)) for c, n in counts.items() if c != END}
            here[END] = (math.log((counts.get(END, 0) + self.LENT_END) / size), None)
            known.append(here)
            rest.append(math.log(self.LENT / size))
            most.append(to[max(to, key=lambda c: (counts.get(c, 0), c))] if to else None)
        return known, rest, most, {c: math.log(x) for c, x in share.items()}

    def log_likelihood(self, string: str) -> float:
        """Natural log of the string's probability."""
        return likelihood(self.table(), string)


def likelihood(table: tuple, string: str, least: float = -math.inf) -> float:
    """Natural log of a string's probability by an automaton's table; symbols beyond all its states are equally likely.

    What falls below ``least`` on the way is -inf.
    """
    known, rest, most, share = table
    at, total = 0, 0.0
    for i, c in enumerate(string):
        step = known[at].get(c)
        if step is None:
            step = rest[at] + share.get(c, share[END]), most[at]
        total += step[0]
        if total < least:
            return -math.inf
        at = step[1]
        if at is None:
            return total - math.log(Automaton.SYMBOLS) * (len(string) - i)
    return total + known[at][END][0]


def infer(strings: list[str], alpha: float) -> Automaton:
    out = Automaton()
    for s in strings:
        out.add(s)
    return out.merge(alpha)


def unlabelled(text: str, spans: list[tuple[int, int, int, int]]) -> list[str]:
    """The candidates, their parts and the long ASCII tokens in what the base spans leave of a whole text."""
    out = []
    for gap in gaps(text, spans):
        found = CANDIDATE.findall(text, *gap)
        out += found
        out += [v[a:b] for v in found for a, b in parts(v)]
        out += [w for w in TOKEN.findall(text, *gap) if w.isascii() and not CANDIDATE.fullmatch(w)]
    return out


class Transitions:
    """How often each ASCII symbol followed each other one, for any number of tokens; a line feed is start and end."""

    def __init__(self):
        self.counts = np.zeros(1 << 14, dtype=np.int64)
        self.held: list[str] = []
        self.size = 0

    def add(self, tokens: list[str]) -> None:
        self.held += tokens
        self.size += sum(map(len, tokens))
        if self.size > 1_000_000:
            self.flush()

    def flush(self) -> None:
        if self.held:
            b = np.frombuffer("\n".join(["", *self.held, ""]).encode("ascii"), dtype=np.uint8).astype(np.int64)
            self.counts += np.bincount(b[:-1] << 7 | b[1:], minlength=1 << 14)
        self.held, self.size = [], 0

    def rows(self) -> list[tuple[str, str, int]]:
        self.flush()
        return [("none", chr(i >> 7) + chr(i & 127), int(self.counts[i])) for i in np.flatnonzero(self.counts)]


def labelled(docs: DataFrame, per_kind: int = 300, seed: int = 11, text: str = "text") -> DataFrame:
    """(kind, value, n): at most ``per_kind`` distinct credentials of each base kind, and all tokens without a label.

    The credentials are drawn by a seeded hash from all documents, each in its
    full length. The tokens of all whole documents come as sums: of kind
    ``none``, value holds two symbols and n says how often the second followed
    the first.
    """

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ground = Transitions()
        for batch in batches:
            out = set()
            for t in batch.text.dropna():
                spans = base_spans(t)
                out |= {(KINDS[k], t[v:e], 1) for _, k, e, v in spans}
                ground.add(unlabelled(t, spans))
            yield pd.DataFrame(sorted(out), columns=["kind", "value", "n"])
        yield pd.DataFrame(ground.rows(), columns=["kind", "value", "n"])

    found = docs.select(F.col(text).alias("text")).mapInPandas(values, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    found = written(found, "secret-examples")
    return drawn(found.filter("kind <> 'none'"), "kind", "value", per_kind, seed).union(found.filter("kind = 'none'"))


def background(transitions: list[tuple[str, int]]) -> Automaton:
    """The automaton of counted pairs of symbols: a state for each symbol, the first one for the start; each leads to all."""
    state = {c: i for i, c in enumerate(["\n", *sorted({c for pair, _ in transitions for c in pair} - {"\n"})])}
    out = Automaton()
    out.counts = [{c: 0 for c in state if c != "\n"} for _ in state]
    out.next = [{c: i for c, i in state.items() if c != "\n"} for _ in state]
    for (a, b), n in transitions:
        out.counts[state[a]][END if b == "\n" else b] = n
    return out


def learn(examples: DataFrame, alpha: float = 0.05) -> dict[str, Automaton]:
    """One automaton a kind, each in its own task: of bounded examples, the background of bounded counts."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        made = background(list(zip(rows.value, rows.n))) if rows.kind.iloc[0] == "none" else infer(sorted(rows.value), alpha)
        number = {state: i for i, state in enumerate(made.states())}
        edges = [(rows.kind.iloc[0], number[i], c, n, number.get(made.next[i].get(c), -1)) for i in number for c, n in made.counts[i].items()]
        return pd.DataFrame(edges, columns=["kind", "state", "symbol", "n", "to"])

    out: dict[str, Automaton] = {}
    for row in examples.groupBy("kind").applyInPandas(work, "kind string, state int, symbol string, n long, to int").collect():
        one = out.setdefault(row.kind, Automaton())
        while len(one.counts) <= max(row.state, row.to):
            one.counts.append({})
            one.next.append({})
        one.counts[row.state][row.symbol] = row.n
        if row.to >= 0:
            one.next[row.state][row.symbol] = row.to
    return out


class Judge:
    """Compares candidates with the formats and the background; remembers a bounded number of short harmless ones."""

    def __init__(self, formats: dict[str, Automaton], margin: float):
        self.margin = margin
        self.known = [a.table() for k, a in formats.items() if k != "none"]
        self.ground = formats["none"].table() if "none" in formats else None
        self.clean: set[str] = set()

    def gain(self, string: str) -> float:
        """By how many nats the best format makes a whole string likelier than the background does.

        It is at most twice the gain over equal shares of all symbols, and
        -inf below ``margin``: what is merely strange to the background is no
        format's string.
        """
        blind = -math.log(Automaton.SYMBOLS) * (len(string) + 1)
        best = max(likelihood(f, string, blind + self.margin * len(string) / 2) for f in self.known)
        return min(best - likelihood(self.ground, string), 2 * (best - blind)) if best > -math.inf else best

    def learned(self, text: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
        """Candidates outside the spans taken that gain ``margin`` nats a character: whole, or those parts that do if they gain more."""
        out = []
        for gap in gaps(text, taken) if self.known and self.ground else ():
            if not self.clean.issuperset(CANDIDATE.findall(text, *gap)):
                for m in CANDIDATE.finditer(text, *gap):
                    out += [(m.start() + i, m.start() + j) for i, j in self.secret(m.group())]
        return out

    def secret(self, value: str) -> list[tuple[int, int]]:
        """The spans of a candidate that :meth:`learned` takes."""
        if value in self.clean:
            return []
        each = [(i, j, self.gain(value[i:j])) for i, j in [(0, len(value)), *parts(value)]]
        each = [(i, j, n) for i, j, n in each if n >= self.margin * (j - i)]
        if each and each[0][:2] == (0, len(value)):
            each = each[:1] if each[0][2] >= sum(n for *_, n in each[1:]) else each[1:]
        if not each and len(value) <= 64 and len(self.clean) < 1 << 17:
            self.clean.add(value)
        return [(i, j) for i, j, _ in each]


def scan(docs: DataFrame, formats: dict[str, Automaton], margin: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned.

    ``spans`` is ``kind:start:end`` by start, then kind (assign, access, hex,
    learned), with code point offsets, end exclusive. A candidate outside all
    base spans, or its part between / and =, is added as ``learned`` if some
    format gives the whole of it at least ``margin`` nats a character more than
    the background does, and half of that more than equal shares of all
    symbols. Null and empty texts have no spans. Rows are judged alone: repeated rows get equal
    results, no rows give none, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value, margin)
        for batch in batches:
            out = []
            for key, t in zip(batch.doc_id, batch.text):
                t = t if isinstance(t, str) else ""
                spans = base_spans(t)
                base = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans]
                more = [(a, 3, b, a) for a, b in judge.learned(t, spans)]
                n = [sum(k == i for _, k, _, _ in spans) for i in range(3)]
                every = [f"{(*KINDS, 'learned')[k]}:{s}:{e}" for s, k, e, _ in sorted(spans + more)]
                out.append((key, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(every), len(more)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(judged, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")


def redact(docs: DataFrame, formats: dict[str, Automaton], mark: str = "[secret]", margin: float = 1.0, text: str = "text") -> DataFrame:
    """The documents with every span of :func:`scan` replaced by ``mark``; columns as given, null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    @F.pandas_udf("string")
    def clean(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(shared.value, margin)
        for column in columns:
            yield pd.Series([without(t, judge) for t in column], dtype=object)

    def without(t: str | None, judge: Judge) -> str | None:
        if not isinstance(t, str):
            return t
        spans = base_spans(t)
        spans += [(a, 3, b, a) for a, b in judge.learned(t, spans)]
        at, kept = 0, []
        for start, _, end, _ in sorted(spans):
            if start >= at:
                kept.append(t[at:start] + mark)
            at = max(at, end)
        return "".join(kept) + t[at:]

    return docs.withColumn(text, clean(F.col(text)))
