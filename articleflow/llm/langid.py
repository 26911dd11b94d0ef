"""Language identification by a linear-chain conditional random field over words.

Every line is a chain of its words. A word's score for a language sums learned weights of its affixes and inner byte
n-grams (hashed; the blanks around a word mark prefixes and suffixes) and of its membership in each language's
lexicon (frequent words of the training sample). Learned transition weights tie neighbours, and forward-backward gives
each word's label distribution, so code-switched text is labelled word by word. A document's language is the one with the
most posterior mass over its words that hold a letter, and its score is that share.

Training: about ``per_language`` documents of each language, chosen by hash (a bounded sample; the bound is that
parameter), are split over ``shards``; in every round each shard takes a pass of stochastic gradient steps on the
chain likelihood from the common weights, and the weights are averaged. As training documents carry one language each, a
share of the chains is spliced from lines of two languages, so that switches are learned too. One task takes the mean of the shards' weights, so
the driver gets one set of them however many shards there are.

Defined results: a null text and one without a letter are ``und`` with score 0; ties go to the language that sorts
first; when there is nothing to learn from, every text is ``und``. Rows are judged each on its own, whole texts always.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import WORD, map_texts, texts
from articleflow.session import materialize

_MIX, _RADIX = np.uint32(2654435761), np.uint64(1099511628211)
CHUNK_BYTES = 1 << 20


@dataclass
class Model:
    labels: list[str]
    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 15
    grams: np.ndarray = None  # (2^bits, labels); row 0 stays zero and stands for no feature
    lexicon: np.ndarray = None  # sorted word hashes
    member: np.ndarray = None  # (lexicon, labels) 0/1
    lex: np.ndarray = None  # (labels, labels) weights of membership
    trans: np.ndarray = None
    start: np.ndarray = None
    sums: dict = field(default_factory=dict)  # AdaGrad's squared gradients

    def blank(self) -> Model:
        n = len(self.labels)
        self.grams = np.zeros((1 << self.bits, n), np.float32)
        self.lex, self.trans, self.start = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n)
        return self


class Chains:
    """Hashed features of a list of lines, each a list of words (lower-case UTF-8)."""

    def __init__(self, lines: list[list[bytes]], model: Model):
        words = [w for line in lines for w in line]
        self.lens = np.array([len(line) for line in lines])
        self.first = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        raw = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1  # with the blank before the word
        self.at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.sizes = sizes
        n = int(sizes.sum())
        end = np.repeat(self.at + sizes, sizes)  # place of the blank after the word
        spot = np.arange(n)
        code = raw[:n].astype(np.uint32)
        self.buckets = []
        for order in range(2, max(model.orders) + 1):
            follow = np.zeros(n, np.uint32)
            follow[:max(0, n - order + 2)] = raw[order - 1:n + 1][:n]
            code = code * np.uint32(257) + follow
            if order in model.orders:
                bucket = ((code + np.uint32(order)) * _MIX) >> np.uint32(32 - model.bits)
                self.buckets.append(np.where(spot + order - 1 <= end, bucket, 0).astype(np.int32))
        self.hash = word_hashes(raw, self.at, sizes)
        if len(model.lexicon):
            near = np.minimum(np.searchsorted(model.lexicon, self.hash), len(model.lexicon) - 1)
            self.member = model.member[near] * (model.lexicon[near] == self.hash)[:, None]
        else:
            self.member = np.zeros((len(words), len(model.labels)))

    def scores(self, model: Model) -> np.ndarray:
        total = model.grams[self.buckets[0]]
        for b in self.buckets[1:]:
            total += model.grams[b]
        return np.add.reduceat(total, self.at, axis=0).astype(np.float64) + self.member @ model.lex


def word_hashes(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    power = np.cumprod(np.full(int(sizes.max()), _RADIX, np.uint64))
    inside = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    return np.add.reduceat(raw[:len(inside)].astype(np.uint64) * power[inside], at)


def forward_backward(scores: np.ndarray, first: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray,
                     pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label distribution of every word, and on demand the expected transition counts. All chains advance together, longest
    first, one word per step."""
    order = np.argsort(-lens, kind="stable")
    head, sorted_lens = first[order], lens[order]
    longest = int(sorted_lens[0])
    active = len(lens) - np.searchsorted(sorted_lens[::-1], np.arange(1, longest + 1))  # chains longer than t
    psi = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, alpha = np.exp(trans - trans.max()), np.empty_like(psi)
    a = psi[head] * np.exp(start - start.max())
    a /= a.sum(axis=1, keepdims=True)
    alpha[head] = a
    for t in range(1, longest):
        spot = head[:active[t]] + t
        a = (a[:active[t]] @ move) * psi[spot] + 1e-300
        a /= a.sum(axis=1, keepdims=True)
        alpha[spot] = a
    gamma, expected = alpha.copy(), np.zeros_like(trans) if pairs else None
    b = np.ones((len(lens), scores.shape[1]))
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        spot = head[:n] + t
        ahead = psi[spot + 1] * b[:n]
        if pairs:
            both = alpha[spot][:, :, None] * move[None] * ahead[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = ahead @ move.T + 1e-300
        b[:n] = back / back.sum(axis=1, keepdims=True)
        g = alpha[spot] * b[:n]
        gamma[spot] = g / g.sum(axis=1, keepdims=True)
    return gamma, expected


def train_pass(model: Model, lines: list[list[bytes]], labels: list[list[int]], batch_words: int = 4000,
               rate: float = 0.2, decay: float = 1e-6) -> None:
    """One pass of AdaGrad steps over the chains, in place."""
    k, done = len(model.labels), 0

    def step(name: str, grad: np.ndarray) -> None:
        total = model.sums.setdefault(name, np.zeros(grad.shape, np.float32))
        total += grad * grad
        weights = getattr(model, name)
        weights -= (rate * grad / (np.sqrt(total) + 1e-4) + decay * weights).astype(weights.dtype)

    while done < len(lines):
        upto, n = done, 0
        while upto < len(lines) and (n < batch_words or upto == done):
            n += len(lines[upto])
            upto += 1
        c = Chains(lines[done:upto], model)
        gold = np.concatenate([np.asarray(x) for x in labels[done:upto]])
        gamma, expected = forward_backward(c.scores(model), c.first, c.lens, model.trans, model.start, pairs=True)
        g = gamma.copy()
        g[np.arange(len(gold)), gold] -= 1
        wide = np.repeat(g, c.sizes, axis=0) / len(gold)
        grad = np.stack([sum(np.bincount(b, weights=wide[:, j], minlength=1 << model.bits) for b in c.buckets)
                         for j in range(k)], axis=1)
        grad[0] = 0
        seen = np.zeros((k, k))
        inner = np.ones(len(gold), bool)
        inner[c.first] = False
        np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
        begin = g[c.first].sum(axis=0)
        step("grams", grad.astype(np.float32))
        step("lex", (c.member.T @ g / len(gold)))
        step("trans", (expected - seen) / len(gold))
        step("start", begin / len(c.lens))
        done = upto


def chains_of(raw: bytes) -> list[list[bytes]]:
    lowered = raw.decode("utf-8", "replace").lower().encode()
    return [w for w in (line.split() for line in lowered.split(b"\n")) if w]


# --------------------------------------------------------------------------------------------------- training
def training_sample(docs: DataFrame, text_col: str, lang_col: str, key: str, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, chosen by a hash of ``key``: (lang, text)."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    lang = F.col(lang_col).cast("string")
    counts = rows.groupBy(lang.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()  # the model has a column per language
    picked = rows.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"),
                         F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(7)), F.lit(1_000_003)).alias("_slot"))
    if not counts:
        return picked.drop("_slot")
    n = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["l"], r["n"])]), F.col("lang"))
    return picked.filter(F.col("_slot") * n < F.lit(1_000_003 * per_language)).drop("_slot")


def learn_lexicon(sample: DataFrame, model: Model, per_language: int) -> None:
    """Sets the lexicon: each language's most frequent words in the sample."""
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"))).alias("w"))
    counts = words.groupBy("lang", "w").count()
    found: dict[str, set[str]] = {}
    for i, lang in enumerate(model.labels):
        for r in counts.filter(F.col("lang") == lang).orderBy(F.desc("count"), "w").limit(per_language).collect():
            found.setdefault(r["w"], set()).add(i)
    listed = [w.encode() for w in found]
    if not listed:
        model.lexicon, model.member = np.zeros(0, np.uint64), np.zeros((0, len(model.labels)))
        return
    raw = np.frombuffer(b" " + b" ".join(listed) + b" ", dtype=np.uint8)
    sizes = np.array([len(w) + 1 for w in listed], dtype=np.int64)
    hashes = word_hashes(raw, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes)
    member = np.zeros((len(listed), len(model.labels)))
    for row, langs in enumerate(found.values()):
        member[row, list(langs)] = 1
    order = np.argsort(hashes)
    model.lexicon, model.member = hashes[order], member[order]


def spliced(lines: list[list[bytes]], tags: list[int], share: float, rng) -> tuple[list, list]:
    """Chains for training: some lines get the end of another line, often of another language."""
    out, labels = [], []
    for i in rng.permutation(len(lines)):
        line, gold = lines[i], [tags[i]] * len(lines[i])
        if rng.random() < share:
            j = int(rng.integers(len(lines)))
            a, b = int(rng.integers(1, len(line) + 1)), int(rng.integers(0, len(lines[j])))
            line, gold = line[:a] + lines[j][b:], gold[:a] + [tags[j]] * (len(lines[j]) - b)
        out.append(line)
        labels.append(gold)
    return out, labels


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id",
          per_language: int = 400, lexicon_words: int = 200, shards: int = 6, rounds: int = 3,
          splice_share: float = 0.3) -> Model:
    sample = materialize(training_sample(docs, text_col, lang_col, key, per_language), "lang-sample")
    labels = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    model = Model(labels).blank()
    learn_lexicon(sample, model, lexicon_words)
    if not labels:
        return model
    spark, names = docs.sparkSession, {n: i for i, n in enumerate(labels)}
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            lines, tags = [], []
            for b in batches:
                for lang, raw in zip(b.column(0).to_pylist(), texts(b.column(1))):
                    found = chains_of(raw)
                    lines += found
                    tags += [names[lang]] * len(found)
            if not lines:
                return
            train_pass(own, *spliced(lines, tags, splice_share, np.random.default_rng(turn)))
            parts = [own.grams, own.lex, own.trans, own.start]
            blob = b"".join(np.ascontiguousarray(p, dtype=np.float32).tobytes() for p in parts)
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, lines))], pa.int64()), pa.array([blob])],
                                             names=["words", "weights"])

        passes = sample.repartition(shards).mapInArrow(run, "words long, weights binary")
        # the weighted mean is taken by one task, a shard at a time, so the driver gets one set of weights
        mean = np.frombuffer(passes.repartition(1).mapInArrow(_mean, "weights binary").first()["weights"], np.float64)
        if mean.size < model.grams.size:  # texts without words taught nothing
            break
        at = 0
        for name in ("grams", "lex", "trans", "start"):
            old = getattr(model, name)
            setattr(model, name, mean[at:at + old.size].reshape(old.shape).astype(old.dtype))
            at += old.size
        model.grams[0] = 0
    return model


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, mean = 0, 0.0
    for b in batches:
        for i in range(b.num_rows):
            n = b.column(0)[i].as_py()
            total += n
            mean = mean + (np.frombuffer(b.column(1)[i].as_buffer(), np.float32) - mean) * (n / total)
    yield pa.RecordBatch.from_arrays([pa.array([np.asarray(mean, np.float64).tobytes()])], names=["weights"])


# --------------------------------------------------------------------------------------------------- prediction
def label_texts(batch: list[bytes], model: Model) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Per text the label distribution of its words and a mask of words with a letter; None where there is none."""
    out: list = [None] * len(batch)
    pending: list[tuple[int, list[list[bytes]]]] = []
    held = 0

    def flush() -> None:
        if pending:
            lines = [line for _, own in pending for line in own]
            c = Chains(lines, model)
            gamma, _ = forward_backward(c.scores(model), c.first, c.lens, model.trans, model.start)
            at = 0
            for i, own in pending:
                n = sum(map(len, own))
                out[i] = (gamma[at:at + n], own)
                at += n
            pending.clear()

    for i, raw in enumerate(batch):
        if not model.labels or not has_letter(raw):
            continue
        pending.append((i, chains_of(raw)))
        held += len(raw)
        if held > CHUNK_BYTES:
            flush()
            held = 0
    flush()
    return out


def has_letter(raw: bytes) -> bool:
    """Whether UTF-8 holds a letter; numbers such as ``½`` and ``③`` are none."""
    return _ASCII_LETTER.search(raw) is not None or (not raw.isascii() and any(map(str.isalpha, raw.decode("utf-8", "replace"))))


def _lettered(lines: list[list[bytes]]) -> np.ndarray:
    """Whether a word holds a letter."""
    return np.array([has_letter(w) for line in lines for w in line], dtype=bool)


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            segments: bool = False) -> DataFrame:
    """(id, lang_pred, score[, segments]) per row of ``docs``. ``segments`` lists runs of words with one label:
    ``first:last:lang`` with word numbers from 0 over the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: list[bytes]) -> list[pa.Array]:
        m, langs, scores, runs = shared.value, [], [], []
        for found in label_texts(batch, m):
            if found is None:
                langs.append("und")
                scores.append(0.0)
                runs.append([])
                continue
            gamma, lines = found
            mask = _lettered(lines)
            mass = gamma[mask].sum(axis=0) if mask.any() else gamma.sum(axis=0)
            best = int(mass.argmax())
            langs.append(m.labels[best])
            scores.append(float(min(1.0, mass[best] / mass.sum())))
            if segments:
                tag = gamma.argmax(axis=1)
                cuts = np.flatnonzero(np.diff(tag)) + 1
                heads, tails = [0, *cuts.tolist()], [*cuts.tolist(), len(tag)]
                runs.append([f"{a}:{b - 1}:{m.labels[tag[a]]}" for a, b in zip(heads, tails)])
        cols = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return [*cols, pa.array(runs, pa.list_(pa.string()))] if segments else cols

    schema = "lang_pred string, score double" + (", segments array<string>" if segments else "")
    return map_texts(docs, [id_col], text_col, run, schema, [dict(docs.select(id_col).dtypes)[id_col]])
