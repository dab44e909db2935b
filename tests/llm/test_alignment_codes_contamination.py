"""Decontamination, token alignment and vector codes against brute force: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest

from taxonaut.llm import decontamination, token_alignment, vector_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, key string, part int, win string, row long"
ITEMS = "item_id long, text string, items string, h long"


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def contaminated(docs, items, window=10):
    """Rows of the contract by comparing every window of every document with every window of every item."""
    held = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            held[tuple(w[s : s + n])].add("null" if i is None else str(i))
    lengths = {len(k) for k in held}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n, s in itertools.product(lengths, range(len(w))):
            if s + n <= len(w) and tuple(w[s : s + n]) in held:
                hit |= set(range(s, s + n))
                found |= held[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "한국어", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([10, 12, 25, 40]))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "!?"), (15, "Only THREE words"), (16, "lone"), (None, text(20)), (0, text(15)), (17, items[3][1]), (18, text(9)), (19, "a " * 30)]
    docs = [(i, text(rng.choice([0, 5, 30, 200]))) for i in range(20)]
    for i, (_, t) in enumerate(items):
        w = (t or "").split()
        docs.append((100 + i, f"{text(7)} {(t or '').upper().replace(' ', '-')} {text(3)} {' '.join(w[2:12])} {text(2)} {' '.join(w[:9])}"))
    docs += [(None, None), (None, items[0][1]), (7, ""), (8, "\x00\x7f"), docs[21], docs[21], (9, "a " * 2000), (10, "only three words " * 300 + "z" * 50_000)]
    return docs, items


@pytest.mark.parametrize("most", [(2_000_000, 64 << 20), (0, 0)])
def test_decontamination(spark, benchmark_rows, most):
    docs, items = benchmark_rows
    d = spark.createDataFrame([(*r, "k", 1, "w", 2) for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, "i", 1) for r in items], ITEMS)
    out = decontamination.decontaminate(d, i, broadcast_hashes=most[0], broadcast_bytes=most[1])
    rows = out.collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    assert got == contaminated(docs, items)
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) and len(r["items"]) == r.n_items


def test_decontamination_of_nothing(spark, benchmark_rows):
    docs, items = benchmark_rows
    d, i = spark.createDataFrame([(*r, "k", 1, "w", 2) for r in docs], DOCS), spark.createDataFrame([(*r, "i", 1) for r in items], ITEMS)
    assert decontamination.decontaminate(d.limit(0), i).count() == 0
    clean = decontamination.decontaminate(d, i.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)


def test_least_hashes_miss_no_window(spark):
    """Equal windows have equal fingerprints wherever they lie: shifted copies of one passage are found whole."""
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randrange(40)}" for _ in range(60))
    docs = [(k, " ".join(f"q{rng.randrange(9)}" for _ in range(k)) + " " + passage) for k in range(40)]
    out = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()
    assert all(r.n_hit >= 60 for r in out)


# --- alignment of two tokenizers


@pytest.fixture(scope="module")
def vocabularies():
    if not Path(token_alignment.TOKENIZERS, "byte_bpe_50k.json").exists():
        pytest.skip("vocabulary files are not here")
    return Path(token_alignment.TOKENIZERS, "byte_bpe_50k.json").read_text(), Path(token_alignment.TOKENIZERS, "piece_bpe_32k.model").read_bytes()


def aligned(texts, left, right):
    """Groups and links of each text by the slow library's tokens, one byte end at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(left), SentencePieceProcessor(model_proto=right)
    a.encode_special_tokens = True
    byte = token_alignment.byte_of()
    found = []
    for t in texts:
        groups = []
        if t:
            ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
            tb = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ta) == b"".join(tb) == (" " + t).encode():
                ea, eb = list(itertools.accumulate(map(len, ta))), list(itertools.accumulate(map(len, tb)))
                start = 0
                for end in sorted(set(ea) & set(eb)):
                    groups.append(([i for i, e in zip(ia, ea) if start < e <= end], [i for i, e in zip(ib, eb) if start < e <= end]))
                    start = end
        found.append(groups)
    held = collections.Counter()
    for groups in found:
        held.update({(p, q) for x, y in groups for p in x for q in y})
    most = collections.Counter()
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for groups in found:
        links = [(p, q) for x, y in groups for p in x for q in y]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


TEXTS = [
    None, "", " ", "a", "Hello world, hello World!", "  two  spaces\tand\ttabs\n\n\nlines  ", "naïve café déjà-vu", "한국어 텍스트 그리고 日本語のテキスト 中文", "🙂🙂👍🏽 emoji 👩‍👩‍👧 run",
    "<|endoftext|> <s> </s> <unk> <0x41>", "▁ already marked", "x" * 30_000, " ".join(["word"] * 5000), "1234567890 3.14159 0x1F", "don't I'll we've THEY'RE", "ﬁ ligature Ⅷ ½ ²", "ᏣᎳᎩ ꙮ 𝒳 𐍈", "​zero​width", "\r\n\r\n x \x00 y", "🙂" * 400, " " * 3000, "Hello world, hello World!",
]


@pytest.mark.parametrize("table", [4_000_000, 0, 40])
def test_alignment(spark, vocabularies, table):
    docs = spark.createDataFrame([(i if i % 7 else None, t, "k", 1, "w", 2) for i, t in enumerate(TEXTS)], DOCS).repartition(3)
    out = token_alignment.cross_tokenizer_alignment(docs, *vocabularies, table_pairs=table).collect()
    got = collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out)
    assert got == collections.Counter((i if i % 7 else None, *r) for i, r in enumerate(aligned(TEXTS, *vocabularies)))


def test_alignment_of_real_texts(spark, vocabularies):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    table = rows.toPandas()
    got = {r.doc_id: tuple(r)[1:] for r in token_alignment.cross_tokenizer_alignment(rows, *vocabularies).collect()}
    assert got == dict(zip(table.doc_id, aligned(table.text.tolist(), *vocabularies)))


def test_alignment_of_no_rows(spark, vocabularies):
    none = spark.createDataFrame([], DOCS)
    assert token_alignment.cross_tokenizer_alignment(none, *vocabularies).count() == 0


def test_long_groups_keep_distinct_pairs():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, 300), rng.integers(0, 9, 200)
    ids, times = token_alignment.weighted(x, y)
    want = collections.Counter(p * token_alignment.RIGHT + q for p in x for q in y)
    assert dict(zip(ids.tolist(), times.tolist())) == want


def test_memo_changes_nothing(vocabularies):
    rng = random.Random(4)
    left, right = token_alignment.Left(vocabularies[0]), token_alignment.Right(vocabularies[1])
    texts = [" ".join(rng.choice(["stone", "Über", "river's", "日本", "12%"]) for _ in range(40)) for _ in range(30)]
    with_memo, without = token_alignment.Aligner(left, right), token_alignment.Aligner(left, right, memo=0, longest=0)
    for t in texts:
        (one,), (other,) = with_memo.many([t]), without.many([t])
        assert one[:5] == other[:5] and (one[5] == other[5]).all() and (one[6] == other[6]).all()
    assert with_memo.memo and not without.memo


# --- vector codes


def coded(rows, k=64, rounds=2):
    """The contract in Python integers: rows (vec_id, vector, label) of one length."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = len(kept[0][1]) // 16
    part = lambda v, p: v[p * d : (p + 1) * d]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))
    first = list({r[0]: r for r in reversed(first)}.values())[::-1][:k]
    books = [[part(r[1], p) for r in first] for p in range(16)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(v, books[p][e]), e))
    for _ in range(rounds):
        at = [[near(part(v, p), p) for _, v, _ in kept] for p in range(16)]
        for p in range(16):
            for e in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), a in zip(kept, at[p]) if a == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for i, v, y in kept:
        code = [near(part(v, p), p) for p in range(16)]
        out.append((i, y, bytes(code).hex(), sum(dist(part(v, p), books[p][e]) for p, e in enumerate(code))))
    total = collections.Counter()
    for _, y, _, e in out:
        total[y] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return collections.Counter((i, c, e, total[y], digest) for i, y, c, e in out)


VECTORS = "vec_id long, embedding array<float>, label int, x int, near string, code string"


def vectors(n, dims, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, spread, (max(n // 9, 1), dims))
    return [(int(i), [float(np.float32(x)) for x in at[rng.integers(len(at))] + rng.normal(0, 0.05, dims)], [0, 1, None][i % 3]) for i in rng.permutation(n)]


@pytest.mark.parametrize("n,dims,spread", [(500, 64, 0.3), (40, 32, 1.0), (700, 16, 0.002), (300, 48, 0.0)])
def test_codes(spark, n, dims, spread):
    rows = vectors(n, dims, n, spread)
    rows += [rows[3], rows[3], (None, rows[4][1], 5), (n + 1, None, 0), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] + [0.0] * (dims - 1), None), (n + 4, rows[5][1], 0)]
    got = vector_codes.compress(spark.createDataFrame([(*r, 1, "n", "c") for r in rows], VECTORS).repartition(3)).collect()
    assert collections.Counter(tuple(r) for r in got) == coded(rows)


@pytest.mark.parametrize("b", [1, 2, 64])
def test_codes_dont_depend_on_the_list_length(spark, b):
    rows = vectors(400, 32, 7)
    got = vector_codes.compress(spark.createDataFrame([(*r, 1, "n", "c") for r in rows], VECTORS), first_b=b).collect()
    assert collections.Counter(tuple(r) for r in got) == coded(rows)


def test_codes_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 1, "n", "c") for r in rows], VECTORS)
    assert vector_codes.compress(frame([])).count() == 0
    assert vector_codes.compress(frame([(1, None, 1)])).count() == 0
    odd = {r.vec_id: (r.code, r.error) for r in vector_codes.compress(frame([(1, [0.5] * 32, 1), (2, [0.5] * 7, 1), (3, [], None)])).collect()}
    assert odd == {1: ("00" * 16, 0), 2: (None, None), 3: (None, None)}
    assert {r.code for r in vector_codes.compress(frame([(1, [0.5] * 7, 1), (2, [0.5] * 32, 1)])).collect()} == {None}
    assert [r.code for r in vector_codes.compress(frame([(None, [0.5] * 32, 1)] * 2)).collect()] == [None] * 2


def test_bounds_settle_most_parts():
    """After small moves few parts are measured against all entries, and b shrinks to what was needed."""
    rng = np.random.default_rng(3)
    entries = rng.integers(-200, 200, (64, 4))
    x = entries[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 4))
    near, low, outer, _ = vector_codes.first_lists(x, entries, 16)
    moved_to = entries + rng.integers(-4, 5, entries.shape)
    moved = np.nextafter(np.sqrt(((moved_to - entries) ** 2).sum(axis=1).astype(float)), np.inf)
    near2, low2, outer2, depth = vector_codes.next_lists(x, moved_to, moved, near, low, outer, 16)
    d = vector_codes.squares(x, moved_to)
    assert (near2[:, 0] == d.argmin(axis=1)).all() and (depth > 16).mean() < 0.01 and (depth == 1).mean() > 0.3
    assert (low2.astype(float) ** 2 <= np.take_along_axis(d, near2.astype(int), axis=1) * (1 + 1e-9)).all()
    rest = np.ones_like(d, bool)
    np.put_along_axis(rest, near2.astype(int), False, axis=1)
    assert (outer2.astype(float)[:, None] ** 2 <= np.where(rest, d, np.inf) * (1 + 1e-9)).all()
    assert vector_codes.next_b(np.bincount(depth, minlength=256), 16, 64) == 8
