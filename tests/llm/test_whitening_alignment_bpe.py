"""Whitening, token alignment and prefix BPE against brute force and the tokenizers' own libraries."""

import base64
import hashlib
import math
import random
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest

from articleflow.llm import alignment, prefix_bpe, whitening
from articleflow.llm.queries import tokenizer_path

RANKS, A_FILE, B_FILE = (tokenizer_path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
RNG = random.Random(11)
PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", ".", "é", "ß", "你", "😀", "12", "՘", "Ⱟ", "\x85", "the", "ing", "ΩΩ", "\t", "▁"]


def made_up(n):
    return "".join(RNG.choice(PARTS) for _ in range(n))


ODD_TEXTS = [None, "", " ", "a", " a", "\n", "don't", "<|endoftext|> x", "<s>", "﻿x", "\0a", "é ﬁ", " " * 5000, "ab" * 4000, "x " * 3000]


# ------------------------------------------------------------------------------------------------- prefix BPE
@pytest.fixture(scope="module")
def bpe():
    return prefix_bpe.vocabulary(RANKS)


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_prefix_encoding_is_the_librarys(bpe, tik):
    texts = [t or "" for t in ODD_TEXTS] + [made_up(RNG.randint(0, 40)) for _ in range(1500)]
    texts += ["".join(chr(RNG.choice([RNG.randint(32, 0x5FF), RNG.randint(0xE000, 0x3FFFF)])) for _ in range(20)) for _ in range(500)]
    for text in texts:
        ids = bpe.encode(text).tolist()
        assert ids == tik.encode_ordinary(text), text
        assert bpe.decode(ids) == text.encode()


def test_every_prefix_has_one_valid_last_token(bpe, tik):
    for piece in (b" understanding", "Grundstücksverkehr".encode(), b"aaaaaaaaaaaa", "日本語日本語".encode()):
        last = bpe.prefixes(piece)
        for n in range(1, len(piece) + 1):
            assert bpe.walk(piece[:n], last[:n + 1]) == tik._encode_single_piece(piece[:n])
            fits = [r for m in range(1, n + 1) if (r := bpe.rank.get(piece[n - m:n])) is not None
                    and (m == n or bpe.may_follow(last[n - m], r))]
            assert fits == [last[n]]


def test_appends_and_edits_equal_a_new_encoding(bpe, tik):
    for _ in range(1500):
        table = bpe.table(made_up(RNG.randint(0, 50)) if RNG.random() < .7 else RNG.choice("abc ") * RNG.randint(0, 300))
        for _ in range(3):
            a = RNG.randint(0, len(table.text))
            table = table.replaced(bpe, a, a + RNG.choice([0, 1, 2, 10]), made_up(RNG.choice([0, 1, 3])))
            assert table == bpe.table(table.text)
            assert table.ids(bpe) == tik.encode_ordinary(table.text)
        assert table.appended(bpe, "ing it").ids(bpe) == tik.encode_ordinary(table.text + "ing it")


def test_an_edit_in_a_long_piece_keeps_the_rest(bpe, monkeypatch):
    piece = b"ab" * 20_000
    old = bpe.prefixes(piece)
    seen = []
    fill = bpe._fill
    monkeypatch.setattr(bpe, "_fill", lambda p, last, done, to: (seen.append(to - done), fill(p, last, done, to)))
    new = piece[:20_000] + b"xyz" + piece[20_002:]
    assert bpe.edited(piece, old, new) == bpe_prefixes_plain(bpe, fill, new)
    assert sum(seen) < 20 * bpe.longest


def bpe_prefixes_plain(bpe, fill, piece):
    last = array("i", [-1] * (len(piece) + 1))
    fill(piece, last, 0, len(piece))
    return last


def test_prefix_bpe_frames(spark, bpe, tik):
    rows = [(i, t, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, "twice", "x"), (3, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, prefix_bpe.digests(docs, RANKS).collect()), key=str)

    def row(i, text):
        ids = np.array(tik.encode_ordinary(text or ""), dtype="<u4")
        return i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got == sorted((row(i, t) for i, t, _ in rows), key=str)
    back = prefix_bpe.decode(prefix_bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    assert prefix_bpe.digests(docs.limit(0), RANKS).count() == 0
    edits = spark.createDataFrame([(i, 1, 2, "ing") for i in range(len(ODD_TEXTS) - 1)] + [(len(ODD_TEXTS) - 1, None, None, "end")],
                                  "doc_id long, start int, stop int, replacement string")
    changed = prefix_bpe.apply_edits(prefix_bpe.prefix_tables(docs.filter("ids = 'x'"), RANKS).join(edits, "doc_id"), RANKS).collect()
    assert len(changed) == len(ODD_TEXTS)
    for r in changed:
        old = ODD_TEXTS[r.doc_id] or ""
        assert r.text == (old + "end" if r.doc_id == len(ODD_TEXTS) - 1 else old[:1] + "ing" + old[2:])
        assert r.ids == tik.encode_ordinary(r.text)


def test_blocks_of_a_long_text(bpe, tik, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "BLOCK", 50)
    for _ in range(200):
        text = made_up(200)
        assert bpe.encode(text).tolist() == tik.encode_ordinary(text)


# ------------------------------------------------------------------------------------------------- alignment
def brute_alignment(texts):
    """(rows without the count columns, links per row) by comparing sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(A_FILE)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    rows, links = [], []
    for text in texts:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        a_raw = [bytes(back[c] for c in a_lib.id_to_token(i)) for i in a]
        b_raw = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()
                 for i in b for p in [b_lib.id_to_piece(i)]]
        whole = (" " + text).encode() if text else b"\0"
        if not text or b"".join(a_raw) != whole or b"".join(b_raw) != whole:
            rows.append((0, 0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(t) for t in raw]).tolist() for raw in (a_raw, b_raw)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es) if start < e <= end) for ids, es in zip((a, b), ends)))
            start = end
        begins = [[0, *es[:-1]] for es in ends]
        over = sum(1 for s, e in zip(begins[0], ends[0]) for s2, e2 in zip(begins[1], ends[1]) if s < e2 and s2 < e) if len(a) < 400 else None
        own = [(i, j) for i, e in zip(a, ends[0]) if e in set(common) for j, e2 in zip(b, ends[1]) if e == e2] if len(a) < 400 else \
            [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in common]
        rows.append((len(a), len(b), len(groups), len(own), over, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    return rows, links


def test_gallop_against_sets():
    for _ in range(500):
        a = sorted(RNG.sample(range(1, 400), RNG.randint(0, 40)))
        b = sorted(RNG.sample(range(1, 400), RNG.randint(0, 200)))
        ranks, held = alignment.gallop(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), RNG.choice([1, 3, 1024]))
        assert ranks.tolist() == [sum(y < x for y in b) for x in a]
        assert held.tolist() == [x in set(b) for x in a]


def test_numbers_of_linked_pairs():
    t = alignment.tokenizers(A_FILE, B_FILE)
    by_bytes = defaultdict(lambda: ([], []))
    for side, tokens in enumerate((t.a_bytes, t.b_bytes)):
        for i, token in enumerate(tokens):
            for k in range(len(token)):
                by_bytes[token[k:]][side].append((i, k))
    pairs = {(a, b) for own, its in by_bytes.values() for a, k in own for b, m in its if not k or not m}
    a, b = np.array(sorted(pairs)).T
    slots = t.slot(a, b)
    assert len(set(slots.tolist())) == len(pairs) and 0 <= slots.min() and slots.max() < t.slots
    assert (t.b_of(slots) == b).all()


def test_alignment_against_brute_force(spark):
    texts = ODD_TEXTS + ["The harbour opened late.", "The harbour opened late.", "Straße über Kanäle – naïve café 東京"]
    texts += [made_up(RNG.randint(1, 60)) for _ in range(150)]
    rows, links = brute_alignment(texts)
    counts = Counter(p for own in links for p in own)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, links string").repartition(4)
    got = {r.doc_id: r for r in alignment.measures(docs, A_FILE, B_FILE).collect()}
    assert len(got) == len(texts)
    for i, (n_a, n_b, n_groups, n_links, over, digest) in enumerate(rows):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_groups, n_links, digest), texts[i]
        assert over is None or r.n_overlaps == over
        assert r.n_best == sum(counts[p] == highest[p[1]] for p in links[i])
        assert r.count_sum == sum(counts[p] for p in links[i])
    assert alignment.measures(docs.limit(0), A_FILE, B_FILE).count() == 0


def test_alignment_in_blocks_and_overlap_ranges(spark, monkeypatch):
    t = alignment.tokenizers(A_FILE, B_FILE)
    for _ in range(100):
        text = made_up(300).replace("▁", "")
        whole = alignment.aligned_blocks(t, text)
        monkeypatch.setattr(alignment, "BLOCK", 40)
        cut = alignment.aligned_blocks(t, text)
        monkeypatch.undo()
        assert b";".join(x.groups(t) for x in cut) == whole[0].groups(t)
    row = alignment.align(spark.createDataFrame([(1, "unbelievable harbourmaster 12")], "doc_id long, text string"), A_FILE, B_FILE).first()
    sizes = {"a": [int(t.a_size[i]) for i in row.a_ids], "b": [int(t.b_size[i]) for i in row.b_ids]}
    mine, other = (sizes["a"], sizes["b"]) if row.driver == "a" else (sizes["b"], sizes["a"])
    ends, other_ends = np.cumsum(mine), np.cumsum(other)
    for k, (first, last) in enumerate(zip(row.first, row.last)):
        over = [j for j in range(len(other)) if other_ends[j] > ends[k] - mine[k] and other_ends[j] - other[j] < ends[k]]
        assert [first, last] == [over[0], over[-1]]


# ------------------------------------------------------------------------------------------------- whitening
@pytest.mark.parametrize("values", [np.arange(1, 41) ** 2.0, 2.0 ** -np.arange(40), [1.0] * 20, [1, 2, 3] + [0] * 20, [5.0],
                                    [1] * 6 + [1 + 1e-9] * 5 + [.5] * 9 + [.5 + 1e-13] * 4, 1 + 1e-10 * np.arange(30)])
def test_refined_eigenvectors(values):
    rng = np.random.default_rng(len(values))
    d = len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = (q * np.array(values, dtype=float)) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.eigenpairs(v)
    top = max(values)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14
    assert np.abs(v @ x - x * e).max() < 1e-14 * top
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], rtol=0, atol=1e-14 * top)


def brute_whitening(vectors, components):
    xs = {i: np.floor(64 * np.array(v, dtype=float)).astype(int) + 1_000_000 for i, v in vectors.items()}
    fit = np.array(sorted({tuple(x) for x in xs.values()}))
    n, s = len(fit), [sum(int(e) for e in col) for col in fit.T]
    centred = (fit * n - np.array(s)) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    out = {}
    for i, x in xs.items():
        deviation = sum((n * int(a) - b) ** 2 for a, b in zip(x, s))
        out[i] = n, deviation, ((x * n - np.array(s)) / n) @ q / np.sqrt(e), e / np.trace(centred.T @ centred / n)
    return out


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(12, 12))
    vectors = {i: (rng.normal(size=12) @ mix).tolist() for i in range(400)}
    vectors |= {1000 + i: vectors[0] for i in range(300)}  # copies count once
    bad = [(2000, None), (2001, [1.0] * 11 + [float("nan")]), (2002, [1.0] * 11 + [None]), (2003, [float("inf")] * 12), (2004, []),
           (2005, [1.0] * 5), (2006, [1e300] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in list(vectors.items()) + bad], "vec_id long, embedding array<double>, component int")
    rows = whitening.whiten(df.repartition(5), components=8).collect()
    expected = brute_whitening(vectors, 8)
    assert len(rows) == 8 * len(vectors) and {r.vec_id for r in rows} == set(vectors)
    sign = {}
    for r in rows:
        n, deviation, white, explained = expected[r.vec_id]
        k = r.component - 1
        assert (r.n, r.deviation) == (n, deviation) == (401 - 1, deviation)
        assert math.isclose(r.explained, explained[k], rel_tol=1e-9) and r.identity_error < 1e-10
        if abs(white[k]) > 1e-3:
            assert sign.setdefault(k, r.whitened * white[k] > 0) == (r.whitened * white[k] > 0)
        assert math.isclose(abs(r.whitened), abs(white[k]), rel_tol=1e-8, abs_tol=1e-9)


def test_whitening_of_few_and_large_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (None, [2.0, 2.0, 5.0]), (2, [2.0, 2.0, 5.0])], kind)).collect()
    assert len(rows) == 3 and {r.component for r in rows} == {1} and rows[0].identity_error < 1e-12
    big = whitening.whiten(spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [5.0, 7.0])], kind)).collect()
    assert {r.deviation for r in big} == {None, sum((3 * x - s) ** 2 for x, s in zip((1_000_320, 1_000_448), (3_000_320, 3_000_512)))}
