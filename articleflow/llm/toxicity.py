"""Toxicity scores from a counterfactual-regularised linear classifier.

Features of a text are its words (lower case, letters and digits) and their prefixes of ``PREFIXES`` letters, by
log(1 + count). Training uses about ``train_rows`` labelled rows chosen by hash (a bounded sample; the bound is that
parameter): the ``vocabulary`` features with the largest chi-square between label and presence are selected by one distributed
count, and a logistic model is fitted on them together with all identity terms.

Counterfactuals: every sentence of the sample that names an identity term is written again with the other terms of the same
dimension, and the squared change of the score (before the sigmoid) is added to the loss with weight ``fairness``.
A group that is only mentioned next to toxic words in training thus cannot carry the score, which lowers false positives on
neutral mentions.

Defined results: null and empty texts have no features and get the model's base score; a label row without a document, with
a null label or a null id is not learned from; several label rows of an id count as their largest label; repeated
documents are scored each on its own. Without labelled rows every score is 0.5 and nothing is predicted toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import map_texts
from articleflow.session import materialize

TOKEN = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (4, 5)
# Identity terms by dimension; a term is swapped for the others of its dimension.
IDENTITY = {
    "gender": ("woman", "man", "women", "men", "female", "male", "transgender", "nonbinary"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "homosexual", "heterosexual", "queer"),
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist",
                 "christians", "muslims", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists"),
    "origin": ("black", "white", "asian", "african", "european", "american", "mexican", "chinese", "arab", "indian",
               "immigrant", "immigrants", "refugee", "refugees", "native", "foreigner", "foreigners"),
    "age": ("young", "old", "teenage", "elderly"),
    "ability": ("deaf", "blind", "disabled", "paralyzed", "autistic"),
}
DIMENSION = {t: d for d, terms in IDENTITY.items() for t in terms}


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def logit(self, counts: dict[str, int]) -> float:
        total = self.bias
        for f, n in counts.items():
            i = self.index.get(f)
            if i is not None:
                total += self.weights[i] * math.log1p(n)
        return total


def features(text: str) -> Counter:
    """Counts of words and of their prefixes (marked by a closing star). An identity term has no prefixes, so that
    swapping it changes one feature."""
    counts = Counter(TOKEN.findall(text.lower()))
    for w, n in list(counts.items()):
        for k in PREFIXES:
            if len(w) > k and w not in DIMENSION:
                counts[w[:k] + "*"] += n
    return counts


def swapped_sentences(text: str) -> list[tuple[str, str]]:
    """(identity term, other term) for every swap in every sentence that names one."""
    out = []
    lowered = text.lower()
    for sentence in SENTENCE.split(lowered):
        for w in set(TOKEN.findall(sentence)):
            if w in DIMENSION:
                out += [(w, other) for other in IDENTITY[DIMENSION[w]] if other != w]
    return out


def fit(rows: list[tuple[int, bytes, bytes]], swaps: Counter, index: dict[str, int], fairness: float,
        ridge: float, steps: int = 400, rate: float = 0.1) -> Model:
    """A model from rows of (label, feature numbers as int32, values as float32). Logistic loss with both classes weighing the same, plus ``fairness`` times the mean squared score change of the swaps (Adam on the full sample)."""
    y = np.array([r[0] for r in rows], dtype=float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) // 4 for r in rows])
    col = np.frombuffer(b"".join(r[1] for r in rows), np.int32).astype(np.int64)
    val = np.frombuffer(b"".join(r[2] for r in rows), np.float32).astype(float)
    pairs = [(index[a], index[b], n) for (a, b), n in swaps.items()]
    a, b, n = (np.array(x, dtype=float) for x in zip(*pairs)) if pairs else (np.zeros(0),) * 3
    a, b, n = a.astype(int), b.astype(int), n / max(1.0, n.sum())
    w, m, v, k = np.zeros(len(index) + 1), 0.0, 0.0, len(index)
    log2 = math.log1p(1)
    balance = np.where(y > 0, len(y) / max(1.0, 2 * y.sum()), len(y) / max(1.0, 2 * (len(y) - y.sum())))
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col] * val, minlength=len(y)) + w[k]
        g = (1 / (1 + np.exp(-z)) - y) * balance
        grad = np.zeros(k + 1)
        grad[:k] = np.bincount(col, weights=g[row] * val, minlength=k) / len(y) + ridge * w[:k]
        grad[k] = g.mean()
        change = fairness * 2 * n * log2 * log2 * (w[a] - w[b])
        grad[:k] += np.bincount(a, weights=change, minlength=k) - np.bincount(b, weights=change, minlength=k)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Model(index, w[:k], float(w[k]))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    train_rows: int) -> DataFrame:
    """About ``train_rows`` labelled documents: (id, label, text). The chosen labels are bounded, so they are broadcast
    and the texts of other documents are never moved."""
    own = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label")))
    n = max(1, own.count())
    slot = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_003))
    chosen = own.filter(slot * F.lit(n) < F.lit(1_000_003 * train_rows)).orderBy(slot, "_id").limit(2 * train_rows)
    texts_of = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return texts_of.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_label", "_text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          train_rows: int = 12_000, vocabulary: int = 300, min_docs: int = 5, fairness: float = 1.0,
          ridge: float = 2e-5) -> Model:
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, train_rows)

    def prepare(batch: list[bytes]) -> list[pa.Array]:
        seen = [features(t.decode("utf-8", "replace")) for t in batch]
        swaps = [["\t".join(s) for s in swapped_sentences(t.decode("utf-8", "replace"))] for t in batch]
        return [pa.array([list(c) for c in seen], pa.list_(pa.string())),
                pa.array([list(c.values()) for c in seen], pa.list_(pa.int32())),
                pa.array(swaps, pa.list_(pa.string()))]

    stored = materialize(map_texts(sample, ["_id", "_label"], "_text", prepare,
                                   "names array<string>, counts array<int>, swaps array<string>",
                                   [dict(sample.dtypes)["_id"], "int"]), "toxic-features")
    total, positive = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    identity = sorted(DIMENSION)
    if not total:
        return Model({}, np.zeros(0), 0.0)
    # chi-square of presence against the label, from document frequencies by class
    df = stored.select("_label", F.explode("names").alias("f")).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_label").alias("p"))
    n, p, big, pos = F.col("n").cast("double"), F.col("p").cast("double"), float(total), float(positive)
    cross = p * (big - pos) - (n - p) * pos
    chi = F.lit(big) * cross * cross / (F.lit(max(pos * (big - pos), 1.0)) * n * F.greatest(big - n, F.lit(1.0)))
    top = df.filter(F.col("n") >= min_docs).select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").limit(vocabulary)
    names = list(dict.fromkeys([r["f"] for r in top.collect()] + identity))
    index = {f: i for i, f in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def restrict(batches):
        known = shared.value
        for b in batches:
            rows = []
            for label, fs, ns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                hits = sorted((known[f], math.log1p(c)) for f, c in zip(fs, ns) if f in known)
                rows.append((label, np.array([h[0] for h in hits], np.int32).tobytes(),
                             np.array([h[1] for h in hits], np.float32).tobytes()))
            if rows:
                labels_, cols, vals = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(labels_, pa.int32()), pa.array(cols, pa.binary()),
                                                  pa.array(vals, pa.binary())], names=["y", "cols", "vals"])

    slim = stored.select("_label", "names", "counts").mapInArrow(restrict, "y int, cols binary, vals binary")
    # bounded by train_rows and the vocabulary: eight bytes a feature that a document has
    rows = sorted((r["y"], bytes(r["cols"]), bytes(r["vals"])) for r in slim.collect())
    pairs = stored.select(F.explode("swaps").alias("s")).groupBy("s").count().collect()  # bounded by the term list
    swaps = Counter({tuple(r["s"].split("\t")): r["count"] for r in pairs})
    return fit(rows, swaps, index, fairness, ridge)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: list[bytes]) -> list[pa.Array]:
        m = shared.value
        index, weights, cut = m.index, m.weights.tolist(), PREFIXES
        out = []
        for raw in batch:
            hits: Counter = Counter()
            for w, n in Counter(TOKEN.findall(raw.decode("utf-8", "replace").lower())).items():
                if w in index:
                    hits[index[w]] += n
                for k in cut:
                    if len(w) > k and w not in DIMENSION and (f := w[:k] + "*") in index:
                        hits[index[f]] += n
            z = m.bias + sum(weights[i] * math.log1p(n) for i, n in hits.items())
            out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
        return [pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())]

    return map_texts(docs, [id_col], text_col, run, "score double, predicted int",
                     [dict(docs.select(id_col).dtypes)[id_col]])
