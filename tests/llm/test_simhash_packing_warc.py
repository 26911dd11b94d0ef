"""SimHash near-dedup, packing and WARC archives against brute force and round trips."""

import hashlib
import random
import struct
import tempfile
import zlib
from base64 import b32encode
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from articleflow.llm import packing, simhash, warc
from articleflow.llm.components import components
from articleflow.llm.queries import tokenizer_path
from articleflow.operators.graph import star_components

RNG = random.Random(5)
VOCAB = ["wort" + str(i) for i in range(400)]


def brute_fingerprint(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in low.encode().split()]
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, ids, bits=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(i)
    best = {r: min((ids[i] for i in own if ids[i] is not None), default=None) for r, own in groups.items()}
    return [best[find(i)] for i in range(len(fps))], [find(i) for i in range(len(fps))]


def texts_with_copies():
    rows = [None, "", "Ein", "ein", "Ein Wort", "ÄRGER ärger x", "a b c " * 4000]
    for _ in range(40):
        base = [RNG.choice(VOCAB) for _ in range(RNG.randint(3, 400))]
        rows.append(" ".join(base))
        for _ in range(RNG.randint(0, 4)):
            other = list(base)
            for _ in range(RNG.randint(0, 2)):
                other[RNG.randrange(len(other))] = RNG.choice(VOCAB)
            rows.append(" ".join(other).upper() if RNG.random() < .3 else " ".join(other))
    return rows


def test_variants_meet_for_every_difference():
    masked, ball = simhash.masked_variants(3), simhash.ball_variants(3)
    assert len(masked) == 131 and len(ball) == 1 + 64 + 2 * 496
    for _ in range(200):
        a = RNG.getrandbits(64)
        b = a
        for bit in RNG.sample(range(64), RNG.randint(0, 3)):
            b ^= 1 << bit
        near = [{(x & (k % (1 << 64))) ^ (f % (1 << 64)) for k, f in masked} for x in (a, b)]
        assert near[0] & near[1]
        flips = [{x ^ (f % (1 << 64)): n for f, n in ball} for x in (a, b)]
        assert any(min(flips[0][v], flips[1][v]) <= 1 for v in flips[0].keys() & flips[1].keys())


def test_near_duplicates_equal_brute_force(spark):
    texts = texts_with_copies()
    ids = [None if i % 17 == 16 else 1000 - i for i in range(len(texts))]
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    fps = [brute_fingerprint(t) for t in texts]
    comps, _ = brute_components(fps, ids)
    want = sorted((str(i), f, str(c)) for i, f, c in zip(ids, fps, comps))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_other_radii(spark, bits):
    fps = [RNG.getrandbits(64) for _ in range(12)]
    for f in list(fps):
        for _ in range(6):
            for bit in RNG.sample(range(64), RNG.randint(0, 4)):
                f ^= 1 << bit
            fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    meet = simhash.meeting(df, bits)
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(meet, bits).collect()]
    assert all(0 < (a ^ b).bit_count() <= bits for a, b in links)
    at = {f: i for i, f in enumerate(fps)}
    _, roots = brute_components(fps, list(range(len(fps))), bits)
    label = list(range(len(fps)))
    for _ in fps:
        for a, b in links:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
    assert all((roots[i] == roots[j]) == (label[i] == label[j]) for i in range(len(fps)) for j in range(i))


def test_keep_one_leaves_one_of_each_component(spark):
    texts = texts_with_copies()
    ids = [i // 2 if i % 5 == 0 else None if i % 23 == 22 else 500 + i for i in range(len(texts))]
    ids[3], texts[3] = ids[2], texts[2]  # a repeated row
    df = spark.createDataFrame(list(zip(ids, texts, ids)), "doc_id long, text string, __x long")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    fps = [brute_fingerprint(t) for t in texts]
    comps, roots = brute_components(fps, ids)
    kept = out.collect()
    by_text = {t: r for t, r in zip(texts, roots)}
    assert sorted(by_text[r.text] for r in kept) == sorted(set(roots))
    best = {r: c for r, c in zip(roots, comps)}
    assert all(r.doc_id == best[by_text[r.text]] for r in kept)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(300, 299)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 180)) and got[300] == 299
    assert components(df.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------------------- packing
def test_links_of_dense_groups_are_contracted(spark):
    """Links per fingerprint do not grow with a group in which all are near copies, and the components stay."""
    shares = []
    for n in (60, 600):
        centre = RNG.getrandbits(64)
        group = {centre} | {centre ^ (1 << a) ^ (1 << b) for a, b in (RNG.sample(range(64), 2) for _ in range(n))}
        group |= {RNG.getrandbits(64) for _ in range(20)}
        df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in group], "fp long")
        plain, fewer = simhash.links(df, 3), simhash.contracted(simhash.hub_links(df, 3))
        assert {r.node: r.root for r in components(fewer).collect()} == {r.node: r.root for r in components(plain).collect()}
        sizes = []
        star_components(fewer, "a", "b", sizes=sizes).count()
        shares.append((fewer.count() / len(group), sizes[0] / len(group)))
    assert shares[1][0] <= 5 and shares[1][1] <= 1, shares


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    own, other = packing.encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    other.encode_special_tokens = True
    for t in ["", "Hello world", " mehrere  Leerzeichen\n\n\tund Tabs ", "größer été ñandú 北京 😀", "a" * 5000, "x=1;" * 50,
              "don't we'll I'm", "<|endoftext|>", "  x", "1234567 89 ½"]:
        assert own.encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids, t


def test_pieces_have_the_ids_of_the_default_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rows = ["a<|endoftext|>b", "<|endoftext|>", " x  <|endoftext|> \n<|endoftext|>y", "a" + " " * 1_000_000 + "b", "\n" * 1_000_000,
            " \t\n" * 400_000 + "<|endoftext|>", "größer don't 北京 12", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = defaultdict(list)
    for r in packing.pieces(df, tokenizer_path(), with_ids=True).orderBy("doc_id", "piece").collect():
        got[r.doc_id] += r.ids
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
    for i, t in enumerate(rows):
        assert got[i] == [*plain.encode(t, add_special_tokens=False).ids, 0], t[:30]


def test_cut_and_plan():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(1, 4) == [(0, 1)]
    rng = np.random.default_rng(3)
    for histogram in ({7: 1}, {100: 50, 3: 4}, {64: 10}, dict(zip(*np.unique(rng.integers(1, 64, 3000), return_counts=True)))):
        histogram = {int(k): int(v) for k, v in histogram.items()}
        cap = 100 if 100 in histogram else 64
        plan = packing.make_plan(histogram, cap)
        fill, used = defaultdict(list), defaultdict(int)
        runs = sorted(plan.runs)
        for i, (length, first, seq, off) in enumerate(runs):
            until = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else histogram[length]
            for r in range(first, until):
                fill[seq + r - first].append((off, length))
                used[length] += 1
        assert dict(used) == histogram and len(fill) == plan.sequences
        for own in fill.values():
            at = 0
            for off, length in sorted(own):
                assert off == at
                at += length
            assert at <= cap
        least = -(-sum(k * v for k, v in histogram.items()) // cap)
        assert plan.sequences <= max(least + 2, 1.02 * least)


def test_packing_covers_every_document(spark):
    texts = [None, "", "kurz", "wort " * 3000, "ein zwei drei " * 40, "kurz"] + [f"text {i} " * (i % 90) for i in range(150)]
    df = spark.createDataFrame([(None if i == 7 else i % 150, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    enc = packing.encoder(tokenizer_path())
    got = packing.pack_documents(df, tokenizer_path(), capacity=256, with_ids=True).collect()
    want = []
    for i, t in enumerate(texts):
        ids = [*enc.encode_ordinary(t or ""), 0]
        for k, (s, n) in enumerate(packing.cut(len(ids), 256)):
            want.append((str(None if i == 7 else i % 150), k, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s:s + n])), tuple(ids[s:s + n])))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == sorted(want)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for own in fill.values():
        at = 0
        for off, length in sorted(own):
            assert off == at
            at += length
        assert at <= 256
    assert len(fill) <= -(-sum(r.length for r in got) // 256) * 1.05 + 2
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


# ------------------------------------------------------------------------------------------------------- WARC
def test_archives_round_trip(spark):
    pages = [(i, f"http://h/{i}", "<p>" + "zeile ü " * (i % 50) + f"{i % 40}</p>") for i in range(300)]
    pages += [(900, None, None), (901, "http://h/\r\nx", ""), (902, "u", ""), (None, "n", "null id"), (5, "http://h/5", "other text"),
              (903, "big", "x" * 3_000_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, payload_bytes int")
    folder = "file://" + tempfile.mkdtemp(prefix="warc-test-")
    manifest = warc.write_archives(df.repartition(3), folder, max_archive_bytes=1 << 20, sample_bytes=4096)
    assert manifest.agg({"records": "sum"}).first()[0] == len(pages) and manifest.count() >= 2
    records = warc.read_archives(manifest).select("*", warc.id_of("record_id", "long").alias("pid"),
                                                  warc.id_of("refers_to", "long").alias("ref")).collect()
    assert len(records) == len(pages) and not any(r.error for r in records)
    first = {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = first[h or ""] != i
        want.append((str(i), len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
                     str(first[h or ""] if again else None)))
    assert sorted((str(r.pid), r.payload_bytes, r.payload_digest, r.record_type, str(r.ref)) for r in records) == sorted(want)
    by_id = {r.pid: r for r in records if r.record_type == "response"}
    assert by_id[903].payload == b"x" * 3_000_000 and by_id[900].payload == b"" and by_id[900].target_uri is None
    assert warc.archive_paths(spark, folder).count() == manifest.count()
    assert warc.write_archives(df.limit(0), folder + "/none").count() == 0
    least = warc.read_archives(warc.write_archives(df, folder + "/least", min_revisit_bytes=1)).collect()
    assert all(r.record_type == "response" for r in least if r.payload_bytes == 0)


def test_reader_loads_plain_dictionaries_and_reports_damage(spark):
    import zstandard as zstd

    records = [warc.record_bytes("response", str(i), "2024-01-01T00:00:00Z", f"http://x/{i}", b"hello world " * 30, None) for i in range(40)]
    dictionary = zstd.train_dictionary(2048, records)
    codec = zstd.ZstdCompressor(dict_data=dictionary)
    raw = dictionary.as_bytes()
    head = struct.pack("<II", warc.DICT_MAGIC, len(raw)) + raw
    folder = tempfile.mkdtemp(prefix="warc-test-")

    def errors(name, data):
        with open(f"{folder}/{name}.warc.zst", "wb") as f:
            f.write(data)
        paths = spark.createDataFrame([(f"file://{folder}/{name}.warc.zst",)], "archive string")
        return [r.error for r in warc.read_archives(paths).orderBy("position").collect()]

    good = head + b"".join(map(codec.compress, records))
    assert errors("good", good) == [None] * 40
    assert errors("cut", good[:-7])[:-1] == [None] * 39 and "truncated" in errors("cut", good[:-7])[-1]
    bad = [records[0], records[1].replace(b"hello", b"HELLO", 1), records[2].replace(b"WARC-Date", b"WARC-Dote"),
           records[3].replace(b"Content-Length: 4", b"Content-Length: 5"), records[4][:-2], b"nothing"]
    found = errors("bad", head + b"".join(map(codec.compress, bad)))
    assert found[0] is None and all(found[1:]) and "digest" in found[1] and "warc-date" in found[2]
    assert errors("empty", b"") == []


def test_a_failed_read_fails_the_task(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="warc-test-")
    with open(f"{folder}/a.warc.zst", "wb") as f:
        f.write(b"no frame at all")
    paths = spark.createDataFrame([(f"file://{folder}/a.warc.zst",)], "archive string")
    assert [bool(r.error) for r in warc.read_archives(paths).collect()] == [True]
    for lost in (OSError, MemoryError):
        def frames(stream, lost=lost):
            yield 0, b"a record before the failure"
            raise lost("the store went away")

        monkeypatch.setattr(warc, "frames", frames)
        with pytest.raises(Exception, match="the store went away"):
            warc.read_archives(paths).collect()
