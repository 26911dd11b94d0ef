"""Quality rules, line first: every line is judged by punctuation, navigation and boilerplate rules, failing lines are
removed, and a document that loses too much of its text is rejected.

Words are runs of characters other than ASCII white space. Lines are split at ``\\n``; a line without a word is
neither judged nor counted. A line fails when one of these holds (thresholds are parameters of ``LineRules``):

* punctuation: decorative symbols (``#*$%&|<>``) make up more than a share of its non-blank bytes, or more
  than a share of its words end in a doubled ``!``/``?``, or it has many ASCII capitals and few small letters;
* navigation: at least ``separators`` stand-alone separators (``| > » ·``) making up a share of its words;
* boilerplate: a short line holding one of the phrases, a line of many words with few different ones, or a line
  equal to an earlier line of the document. The share of different words that a long line needs falls with the root of its
  length, as it does in clean prose; up to ``varied_scale`` words it is constant.

Defined results: a null or empty text has zero counts, ``base_failed`` true and ``kept`` false. Repeated rows are judged
each on its own; null ids are carried through. Other columns of the input are ignored by ``judge``.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import map_texts, slices, texts

#: Fixed by the contract: characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = ("|".encode(), ">".encode(), "»".encode(), "·".encode())
PHRASES = (b"all rights reserved", b"cookie policy", b"privacy policy", b"terms of use", b"terms of service",
           b"click here", b"subscribe to our newsletter", b"enable javascript", b"skip to content",
           b"share on facebook", b"sign up now", b"back to top")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_UPPER_SET, _LOWER_SET, _BLANK = bytes(range(65, 91)), bytes(range(97, 123)), b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class LineRules:
    symbol_share: float = 0.12
    doubled_share: float = 0.5
    caps_letters: int = 12
    caps_share: float = 0.75
    separators: int = 3
    separator_share: float = 0.25
    phrase_words: int = 12
    varied_words: int = 10
    distinct_share: float = 0.4
    varied_scale: int = 500
    max_lost: float = 0.5  # rejected when more than this share of the words is in failing lines


def line_fails(line: bytes, words: list[bytes], rules: LineRules) -> str:
    """The first rule the line fails, or an empty string."""
    n = len(words)
    nonblank = sum(map(len, words))
    if nonblank - sum(len(w.translate(None, SYMBOLS)) for w in words) > rules.symbol_share * nonblank:
        separators = sum(w in SEPARATORS for w in words)
        return "navigation" if separators >= rules.separators and separators >= rules.separator_share * n else "symbols"
    if sum(w.endswith((b"!!", b"??", b"!?")) for w in words) > rules.doubled_share * n:
        return "doubled"
    upper = len(line) - len(line.translate(None, _UPPER_SET))
    if upper > rules.caps_letters:
        lower = len(line) - len(line.translate(None, _LOWER_SET))
        if upper > rules.caps_share * (upper + lower):
            return "capitals"
    separators = sum(w in SEPARATORS for w in words)
    if separators >= rules.separators and separators >= rules.separator_share * n:
        return "navigation"
    if n <= rules.phrase_words and any(p in low for low in [line.translate(_LOWER)] for p in PHRASES):
        return "boilerplate"
    if n >= rules.varied_words and len(set(words)) < rules.distinct_share * min(n, math.sqrt(n * rules.varied_scale)):
        return "monotone"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more in the text, first occurrences included."""
    n = len(words) - 4
    if n < 2:
        return 0
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(grams)) == n:
        return 0
    seen, total, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            total += i + 5 - max(i, end)
            end = i + 5
    return total


def judge_text(raw: bytes, rules: LineRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_words, failing lines, cleaned text)"""
    words = raw.split()  # bytes split exactly at the six ASCII white-space characters
    n_dup = kept_words = failing = 0
    seen: set[bytes] = set()
    clean: list[bytes] = []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            clean.append(line)
            continue
        if line in seen:
            n_dup += 1
            failing += 1
            continue
        seen.add(line)
        if line_fails(line, own, rules):
            failing += 1
            continue
        kept_words += len(own)
        clean.append(line)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return (len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), n_dup, repeated_words(words),
            kept_words, failing, b"\n".join(clean) if failing else raw)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None,
          with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_failed``, ``kept`` and, on demand, the cleaned text."""
    rules = rules or LineRules()

    def measure(batch: list[bytes]) -> list[pa.Array]:
        cols = list(zip(*[judge_text(t, rules) for t in batch])) or [[]] * 8
        out = [pa.array(c, pa.int64()) for c in cols[:7]]
        return [*out, pa.array([t.decode("utf-8", "replace") for t in cols[7]], pa.string())] if with_text else out

    schema = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "kept_words long, failed_lines long") + (", clean_text string" if with_text else "")
    id_type = dict(docs.select(id_col).dtypes)[id_col]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lost = (F.col("n_words") - F.col("kept_words")) > F.lit(rules.max_lost) * F.col("n_words")
    return (map_texts(docs, [id_col], text_col, measure, schema, [id_type])
            .withColumn("base_failed", base).withColumn("kept", ~base & ~lost))


def clean_documents(docs: DataFrame, text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """The documents that the rules keep, without their failing lines, in the columns of ``docs``; a column
    ``n_chars`` is set to the length of the cleaned text. One pass; nothing is joined."""
    rules, names = rules or LineRules(), docs.columns
    at = names.index(text_col)

    def run(batches):
        for part in slices(batches, at):
            keep, cleaned = [], []
            for i, raw in enumerate(texts(part.column(at))):
                n_words, _, _, _, repeated, kept_words, _, clean = judge_text(raw, rules)
                if n_words >= 10 and 100 * repeated <= 20 * n_words and n_words - kept_words <= rules.max_lost * n_words:
                    keep.append(i)
                    cleaned.append(clean.decode("utf-8", "replace"))
            if keep:
                columns = [part.column(i).take(pa.array(keep)) for i in range(len(names))]
                columns[at] = pa.array(cleaned, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    typed = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    out = docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, typed)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"])).select(*names)
    return out
