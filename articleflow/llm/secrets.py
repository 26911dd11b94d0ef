"""Secret scan: candidates by shape and by assignment, then a random forest that removes false positives.

Candidates are long tokens of key characters that hold a digit, values assigned to a name (``password=...``,
``token: "..."``) and private keys, from the BEGIN line through the matching END line (where that is missing, to
the last base64 line). A candidate's features are its length, its mix of characters, entropy, character
transitions (changes of character class, and the mean log-probability of its letter pairs in ordinary words),
dictionary coverage (share of its letters inside known words), its path (test, example and documentation folders; whether
it is itself part of a path or URL) and the words before and after it.

The forest is trained from labelled findings (``train``): a table with the candidate's text, its neighbours, its path and a label. Where a
corpus has no labelled findings, ``labelled_findings`` takes them from the corpus: candidates in an issuer's published
format and assigned values that look generated are positive; placeholders, plain numbers, identifiers, versions, digests in paths and
everything else are negative. At most about ``train_rows`` different findings, chosen by hash within each label, are used (a
bounded sample; the bound is that parameter) and weighted by what they stand for; copies count once. The letter pairs and
the dictionary come from the words of all documents. Only the forest's nodes reach the driver; tasks apply them to every candidate of every whole text.

Defined results: null and empty texts have no findings and stay as they are; overlapping candidates are one finding, the
private key if there is one, then the assigned value, else the longer; repeated rows are scanned each on its own; without positive or
without negative training findings the rule of ``label_of`` decides on every candidate.
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

from articleflow.llm.common import slices, texts
from articleflow.session import materialize

TOKEN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----")
#: What follows a header whose END line is missing: RFC 1421 headers, base64 lines, and a last line of any length.
PEM_BODY = re.compile(
    r"(?:[ \t]*(?:\r?\n|\\n)[ \t>#*]*(?:Proc-Type|DEK-Info|Key-Info|MIC-Info|Version|Comment):[ \t][^\n\\]*)*"
    r"(?:(?:[ \t\"'>#*]|\\[nr]|\r?\n)+[A-Za-z0-9+/]{16,}={0,2})+"
    r"(?:[ \t\"']*(?:\r?\n|(?:\\r)?\\n)[ \t\"'>#*]*[A-Za-z0-9+/]+={0,2}(?=[ \t\"']*(?:[\r\n\\]|\Z)))?")
DIGIT = re.compile(r"[0-9]")
# Names that announce a secret, words that speak against one, and issuers' published formats.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth",
                "credential", "private_key", "client_secret", "bearer", "passphrase")
#: Only a name that announces a secret takes a value, so a plain ``name: value`` hides no assignment inside it. A quoted
#: value reaches to its closing quote. Names and blanks have any length.
ASSIGNED_NAME = re.compile(r"(?<![A-Za-z0-9_\-])([A-Za-z0-9_\-]++)[\"']?[ \t]*+(?:=|:=|:)[ \t]*+")
ASSIGNED_VALUE = re.compile(
    r"\"(?!//)((?:[^\"\\\n]|\\.){6,})\"|'(?!//)((?:[^'\\\n]|\\.){6,})'|[\"']?(?!//)([^\s\"'<>]{6,})")
LOGIN = re.compile(r"://[^\s/:@\"'<>]+:([^\s/@\"'<>]{6,})@")
ELEMENT = re.compile(r"<([A-Za-z0-9_:.\-]++)(?:\s[^<>]*)?>([^<>\s]{6,})</")
PLAIN_NAMES = ("example", "sample", "dummy", "test", "phone", "tel", "uuid", "commit", "sha", "md5", "hash", "version",
               "isbn", "card", "order", "invoice", "id", "url", "http", "https", "date", "checksum")
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|\*\*\*|1234567|0000000|\$\{|todo")
FORMATS = re.compile(
    r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    r"|AIza[0-9A-Za-z_\-]{35}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}.*|-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*))\Z")
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
                      r"|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{35}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}"
                      r"(?:\.[A-Za-z0-9_\-]+)?)(?![A-Za-z0-9])")
PREFIX_TEXT = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza", "eyJ")
PATH_PLAIN = re.compile(r"(?i)(?:^|[/_.\-])(?:tests?|examples?|fixtures?|mocks?|samples?|docs?)(?:$|[/_.\-])")
N_NEAR = 3
FEATURES = ("length", "digits", "upper", "lower", "symbols", "distinct", "entropy", "hex", "class_changes", "pair_logprob",
            "dictionary", "in_path", "path_plain", "name_secret", "name_plain", "after_plain", "assigned", "quoted", "longest_run")


def private_keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of every private key: header, body and END line."""
    heads = list(PEM.finditer(text))
    out = []
    for m, until in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
        last = f"-----END {m.group(1)}PRIVATE KEY-----"
        at = text.find(last, m.end(), until)
        body = PEM_BODY.match(text, m.end(), until) if at < 0 else None
        out.append((m.start(), at + len(last) if at >= 0 else body.end() if body else m.end()))
    return out


def announces(name: str) -> bool:
    low = name.lower()
    return any(n in low for n in SECRET_NAMES)


def assigned(text: str) -> list[tuple[int, int]]:
    """(start, end) of values given to a name that announces a secret, of passwords in addresses and of secret elements' texts."""
    out, until = [], 0
    if "=" in text or ":" in text:
        for name in ASSIGNED_NAME.finditer(text):
            if name.start() < until or not announces(name.group(1)):
                continue
            m = ASSIGNED_VALUE.match(text, name.end())
            if m:
                until = m.end()
                out.append((m.start(m.lastindex), m.end(3) - len(m.group(3)) + len(m.group(3).rstrip(".,;)")) if m.lastindex == 3
                            else m.end(m.lastindex)))
    if "://" in text:
        out += [m.span(1) for m in LOGIN.finditer(text)]
    if "</" in text:
        out += [m.span(2) for m in ELEMENT.finditer(text) if announces(m.group(1))]
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, detector) of the candidates of a text, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    found += [(a, b, "assigned") for a, b in assigned(text)]
    keys = private_keys(text) if "PRIVATE KEY" in text else []
    if any(p in text for p in PREFIX_TEXT):
        found += [(m.start(), m.end(), "format") for m in PREFIXED.finditer(text)]
    if DIGIT.search(text):
        for m in TOKEN.finditer(text):
            if DIGIT.search(m.group()):
                found.append((m.start(), m.end(), "format" if FORMATS.match(m.group()) else "token"))
    rank = {"assigned": 0, "format": 1, "token": 2}
    kept = [(s, e, "format") for s, e in keys]  # a key is one finding, whatever its lines look like
    for c in sorted(found, key=lambda c: (rank[c[2]], c[0] - c[1], c[0])):
        if c[1] > c[0] and all(c[1] <= k[0] or c[0] >= k[1] for k in kept):
            kept.append(c)
    return sorted(kept)


def near_words(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before = re.findall(r"[A-Za-z_\-]+", text[max(0, start - 60):start].lower())[-N_NEAR:]
    after = re.findall(r"[A-Za-z_\-]+", text[end:end + 60].lower())[:N_NEAR]
    return before, after


def looks_generated(value: str) -> bool:
    letters, digits = sum(c.isalpha() for c in value), sum(c.isdigit() for c in value)
    return len(value) >= 8 and digits >= 2 and letters >= 2 and len(set(value)) >= 6


def whole_key(value: str) -> bool:
    """Whether a private key comes with its body, not as a bare header."""
    return bool((m := PEM.match(value)) and PEM_BODY.match(value, m.end()))


def label_of(value: str, detector: str, path: str) -> int:
    """The label a finding gets where nobody labelled it: published format, or an assigned value that looks generated."""
    # a key's base64 letters can spell a placeholder by chance
    if PATH_PLAIN.search(path) or (not whole_key(value) and PLACEHOLDER.search(value)):
        return 0
    return int(bool(FORMATS.match(value)) or (detector == "assigned" and looks_generated(value)))


@dataclass
class Lexicon:
    words: set[str]
    pairs: np.ndarray  # log-probabilities of letter pairs (27 x 27, the last for anything else)


def _codes(value: str) -> list[int]:
    return [ord(c) - 97 if "a" <= c <= "z" else 26 for c in value.lower()]


def coverage(value: str, words: set[str]) -> float:
    """Share of the letters inside dictionary words of four letters and more, longest first from the left."""
    run, covered, letters, i = value.lower(), 0, 0, 0
    while i < len(run):
        if not run[i].isalpha():
            i += 1
            continue
        size = next((n for n in range(min(12, len(run) - i), 3, -1) if run[i:i + n] in words), 0)
        covered += size
        letters += size or 1
        i += size or 1
    return covered / letters if letters else 0.0


def vector(value: str, detector: str, before: list[str], after: list[str], path: str, quoted: bool, touching: str,
           lexicon: Lexicon) -> list[float]:
    n = max(1, len(value))
    counts = Counter(value)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    codes = _codes(value)
    pairs = [lexicon.pairs[a, b] for a, b in zip(codes, codes[1:])]
    longest = best = 0
    for i, k in enumerate(kind):
        longest = longest + 1 if i and k == kind[i - 1] else 1
        best = max(best, longest)
    return [float(x) for x in (
        len(value), kind.count("d") / n, kind.count("u") / n, kind.count("l") / n, kind.count("s") / n, len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()), all(c in "0123456789abcdefABCDEF" for c in value),
        changes / n, sum(pairs) / max(1, len(pairs)), coverage(value, lexicon.words),
        "/" in value or touching in ("/", "\\", "@"), bool(PATH_PLAIN.search(path)),
        any(s in w for w in before for s in SECRET_NAMES), any(w in PLAIN_NAMES for w in before),
        any(w in PLAIN_NAMES for w in after), detector == "assigned", quoted, best / n)]


def describe(text: str, start: int, end: int) -> tuple[str, list[str], list[str], bool, str]:
    before, after = near_words(text, start, end)
    touching = text[start - 1] if start else " "
    return text[start:end], before, after, touching in "\"'", touching


# --------------------------------------------------------------------------------------------------- training
FINDING = ("value string, detector string, before array<string>, after array<string>, quoted boolean, touching string, "
           "path string, label int")


def _paths(docs: DataFrame, path_col: str | None):
    return F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")


def labelled_findings(docs: DataFrame, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Findings of a corpus with the labels of ``label_of``."""
    def run(batches):
        for b in batches:
            for part in slices([b], 1):
                rows = []
                for path, raw in zip(part.column(0).to_pylist(), texts(part.column(1))):
                    text = raw.decode("utf-8", "replace")
                    for s, e, d in candidates(text):
                        value, before, after, quoted, touching = describe(text, s, e)
                        rows.append((value, d, before, after, quoted, touching, path, label_of(value, d, path)))
                if rows:
                    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(),
                             pa.string(), pa.string(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=[x.split()[0] for x in FINDING.split(", ")])

    return docs.select(_paths(docs, path_col).alias("path"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, FINDING)


def learn_lexicon(docs: DataFrame, text_col: str = "text", words: int = 5000) -> Lexicon:
    """Letter pairs and frequent words of all documents, counted within tasks first."""
    split = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit("([a-z]{3,16})"))
    counted = materialize(docs.select(F.explode(split).alias("w")).groupBy("w").count(), "lexicon")
    listed = [(r["w"], r["count"]) for r in counted.orderBy(F.desc("count"), "w").limit(words).collect()]
    pairs = np.ones((27, 27))
    for w, c in listed:
        codes = _codes(w)
        for a, b in zip(codes, codes[1:]):
            pairs[a, b] += c
    return Lexicon({w for w, _ in listed if len(w) > 3}, np.log(pairs / pairs.sum(axis=1, keepdims=True)))


@dataclass
class Forest:
    """Nodes of all trees: split feature (-1 at a leaf), threshold, children and the leaf's share of secrets."""
    lexicon: Lexicon
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    roots: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                rows, spot = np.flatnonzero(inner), at[inner]
                low = x[rows, self.feature[spot]] <= self.threshold[spot]
                at[rows] = np.where(low, self.left[spot], self.right[spot])
            total += self.share[at]
        return total / len(self.roots)


def train(findings: DataFrame, lexicon: Lexicon, train_rows: int = 20_000, trees: int = 24, depth: int = 7,
          seed: int = 7) -> Forest | None:
    """A forest from labelled findings (columns of ``FINDING``); None where one of the labels is missing. A label with fewer
    than half of ``train_rows`` different findings gives all of them."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark = findings.sparkSession
    different = materialize(findings.distinct(), "different-findings")
    counts = {r["label"]: r["count"] for r in different.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    quota = {k: max(train_rows // 2, train_rows - counts[1 - k]) for k in (0, 1)}
    rate = {k: min(1.0, quota[k] / counts[k]) for k in (0, 1)}
    slot = F.pmod(F.xxhash64(*different.columns, F.lit(seed)), F.lit(1_000_003))
    sample = different.filter(slot < F.when(F.col("label") == 1, rate[1]).otherwise(rate[0]) * 1_000_003)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches):
        for b in batches:
            rows = [vector(r["value"], r["detector"], r["before"], r["after"], r["path"], r["quoted"], r["touching"],
                           shared.value) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("label")], names=["x", "label"])

    data = materialize(sample.mapInArrow(run, "x array<double>, label int"), "findings")
    # weights restore the labels' shares where one was sampled more thinly
    few = data.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"),
                      F.when(F.col("label") == 1, 1 / rate[1]).otherwise(1 / rate[0]).alias("weight"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, minInstancesPerNode=2,
                                   weightCol="weight").fit(few)
    feature, threshold, left, right, share, roots = [], [], [], [], [], []

    def walk(node) -> int:
        at = len(feature)
        for column, blank in zip((feature, threshold, left, right, share), (-1, 0.0, -1, -1, 0.0)):
            column.append(blank)
        if node.subtreeDepth():
            feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
            left[at] = walk(node.leftChild())
            right[at] = walk(node.rightChild())
        else:
            share[at] = leaf_share(node)
        return at

    def leaf_share(node) -> float:
        stats = list(node.impurityStats().stats())
        return stats[1] / max(1e-9, stats[0] + stats[1])

    for tree in model.trees:
        roots.append(walk(tree._call_java("rootNode")))
    return Forest(lexicon, np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share), np.array(roots))


def train_on_corpus(docs: DataFrame, text_col: str = "text", path_col: str | None = None,
                    train_rows: int = 20_000) -> tuple[Lexicon, Forest | None]:
    lexicon = learn_lexicon(docs, text_col)
    found = materialize(labelled_findings(docs, text_col, path_col), "labelled-findings")
    return lexicon, train(found, lexicon, train_rows)


# ---------------------------------------------------------------------------------------------------- the scan
def judge(text: str, path: str, model: tuple[Lexicon, Forest | None]) -> list[tuple[int, int, str, float]]:
    """(start, end, detector, score) of every candidate of a text."""
    found = candidates(text)
    lexicon, forest = model
    if not found:
        return []
    if forest is None:
        return [(s, e, d, float(label_of(text[s:e], d, path))) for s, e, d in found]
    rows = []
    for s, e, d in found:
        value, before, after, quoted, touching = describe(text, s, e)
        rows.append(vector(value, d, before, after, path, quoted, touching, lexicon))
    # a key with its body needs no forest, which may have met none in training
    return [(s, e, d, 1.0 if d == "format" and whole_key(text[s:e]) and label_of(text[s:e], d, path) else float(p))
            for (s, e, d), p in zip(found, forest.scores(np.array(rows)))]


def scan(docs: DataFrame, model: tuple[Lexicon, Forest | None], id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: (id, start, length, detector, score, is_secret); places count code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        for part in slices(batches, 2):
            at, rows = [], []
            paths = part.column(1).to_pylist()
            for i, raw in enumerate(texts(part.column(2))):
                for s, e, d, p in judge(raw.decode("utf-8", "replace"), paths[i], shared.value):
                    at.append(i)
                    rows.append((s, e - s, d, p, p >= threshold))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_())],
                    names=[id_col, "start", "length", "detector", "score", "is_secret"])

    return (docs.select(id_col, _paths(docs, path_col).alias("__path"), F.col(text_col).cast("string").alias("__text"))
            .mapInArrow(run, f"`{id_col}` {kind}, start long, length long, detector string, score double, is_secret boolean"))


def redact(docs: DataFrame, model: tuple[Lexicon, Forest | None], text_col: str = "text", path_col: str | None = None,
           threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; all rows and other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for part in slices(batches, at):
            paths = part.column(len(names)).to_pylist()
            out = []
            for value, path in zip(part.column(at).to_pylist(), paths):
                hits = judge(value, path, shared.value) if value else []
                for s, e, _, p in reversed(hits):
                    if p >= threshold:
                        value = value[:s] + mask + value[e:]
                out.append(value)
            columns = [part.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    typed = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.select(*[F.col(f"`{c}`") for c in names], _paths(docs, path_col).alias("__path")).mapInArrow(run, typed)
