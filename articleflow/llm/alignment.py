"""Alignment of two tokenizers over the same text by galloping intersection of their token ends.

Both tokenizers read a space and the text: ``A`` (a byte-level BPE file) is given it, ``B`` (a piece model with byte fallback) adds
it. A token's bytes are the vocabulary's; running sums give each side's ends.

1. ``gallop``: the shorter end list drives, a block of ends at a time. The search in the longer list starts where the last block
   stopped and doubles its step until it has passed the block's last end; halving inside that window finds every end of the block.
   It gives each end's rank in the longer list and whether the list holds it.
2. Common ends cut both token lists into groups, the slices between their indices. A driving token overlaps the longer list's tokens
   from the rank of its start to the rank of its end: their difference counts them (``overlaps``).
3. Two tokens that end together are linked. One's bytes are then a suffix of the other's, so a pair is one token and a length of its
   suffix (``Tokenizers.slot``): there are no more pairs than the two vocabularies have token bytes, twice for A, as B has a byte
   token beside a piece of one byte. A table with that bound holds the corpus-wide counts, and only it is collected and sent to
   tasks. Links themselves stay with their document.

A text is read in blocks cut before a blank between other characters. No token of either vocabulary reaches over such a place
(checked when the vocabularies are loaded), so a text of any length takes bounded memory but for its ids.

Defined results: a null or empty text, and one whose joined bytes on either side differ from the space and the text, has no tokens:
all numbers 0, the digest ''. Null ids are carried along; repeated rows are aligned and counted once per row; an empty table
gives an empty result. Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import map_texts
from articleflow.llm.packing import encoder, library
from articleflow.session import materialize, scratch_path

BLOCK = 1 << 20
_BORDER = re.compile(r"(?<=\S) (?=[\s\S])")
_LOADED: dict[object, object] = {}


class Tokenizers:
    """Two vocabularies: token bytes, lengths, names, and a numbering of the pairs that can end together."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a_path = a_path
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec.get("added_tokens", [])}
        byte_bpe = encoder(a_path)
        top = max(i for i in spec["model"]["vocab"].values()) + 1
        known = {i for i in spec["model"]["vocab"].values() if i not in special}
        self.a_bytes = [byte_bpe.decode_single_token_bytes(i) if i in known else b"" for i in range(top)]
        self.b_bytes = [self._piece(i) for i in range(self.model.vocab_size())]
        if any(b" " in t.lstrip(b" ") for t in self.b_bytes):
            raise ValueError("a piece reaches over a blank that follows something else")
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.b_is_byte = np.array([self.model.is_byte(i) for i in range(len(self.b_bytes))], dtype=np.int64)
        self.from_b = np.cumsum(self.b_size) - self.b_size
        self.from_a = int(self.b_size.sum()) + 2 * (np.cumsum(self.a_size) - self.a_size)
        self.slots = int(self.b_size.sum() + 2 * self.a_size.sum())
        # decimal ids with what follows them: a comma inside a group, else the sign that ends the side
        self.a_inner, self.a_last = self._names(len(self.a_bytes), b","), self._names(len(self.a_bytes), b"|")
        self.b_inner, self.b_last = self._names(len(self.b_bytes), b","), self._names(len(self.b_bytes), b";")

    @staticmethod
    def _names(n: int, after: bytes) -> np.ndarray:
        """Eight bytes per id, filled up with zero bytes."""
        if n > 9_999_999:
            raise ValueError("ids have at most seven digits")
        return np.array([str(i).encode() + after for i in range(n)], dtype="S8").view(np.uint64)

    def _piece(self, i: int) -> bytes:
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of pairs that end together: a B token and the length of its suffix A, or a longer A token, the length of
        its suffix B and whether B is a byte token."""
        size_a, size_b = self.a_size[a], self.b_size[b]
        return np.where(size_a <= size_b, self.from_b[b] + size_a - 1, self.from_a[a] + 2 * (size_b - 1) + self.b_is_byte[b]).astype(np.int32)

    def b_of(self, slots: np.ndarray) -> np.ndarray:
        """The B tokens of pair numbers."""
        pieces = {t: i for i, t in enumerate(self.b_bytes) if t and not self.b_is_byte[i]}
        raw = {t: i for i, t in enumerate(self.b_bytes) if t and self.b_is_byte[i]}
        out = np.searchsorted(self.from_b, slots, "right") - 1
        while (self.b_size[out] == 0).any():  # tokens without bytes have no numbers
            out = np.where(self.b_size[out] == 0, out - 1, out)
        longer = np.flatnonzero(slots >= self.b_size.sum())
        owners = np.searchsorted(self.from_a, slots[longer], "right") - 1
        for k, a in zip(longer.tolist(), owners.tolist()):
            while not self.a_size[a]:
                a -= 1
            size, is_byte = divmod(int(slots[k] - self.from_a[a]), 2)
            out[k] = (raw if is_byte else pieces)[self.a_bytes[a][-size - 1:]]
        return out

    def ids(self, block: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a space and ``block`` on both sides, or null if joined token bytes differ from it."""
        spaced = " " + block
        try:
            a = encoder(self.a_path).encode_to_numpy(spaced).astype(np.int64)
        except ValueError:  # white space too long for the pattern
            plain = library(self.a_path)[0]
            before, plain.encode_special_tokens = plain.encode_special_tokens, True
            a = np.array(plain.encode(spaced, add_special_tokens=False).ids, dtype=np.int64)
            plain.encode_special_tokens = before
        b = np.array(self.model.encode(block), dtype=np.int64)
        raw = spaced.encode()
        # A cuts the bytes themselves, so equal lengths are equal bytes there
        if self.a_size[a].sum() != len(raw) or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            return None
        return a, b


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """The two vocabularies, loaded once per Python worker."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Tokenizers(a_path, b_path)
    return _LOADED[a_path, b_path]


def gallop(driver: np.ndarray, other: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """For rising arrays: the rank of every ``driver`` value in ``other`` (how many are smaller), and whether ``other`` holds it."""
    ranks = np.empty(len(driver), dtype=np.int64)
    at, n = 0, len(other)
    for i in range(0, len(driver), block):
        part = driver[i:i + block]
        high, step = at, 1
        while high < n and other[high] < part[-1]:
            high += step
            step += step
        found = at + np.searchsorted(other[at:high + 1], part)
        ranks[i:i + block] = found
        at = int(found[-1])
    held = ranks < n
    held[held] = other[ranks[held]] == driver[held]
    return ranks, held


def overlaps(ranks: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last token of the longer list that each driving token overlaps, from the ranks of its start and end."""
    after = ranks + held  # a common end is passed
    return np.concatenate([np.zeros(1, np.int64), after[:-1]])[:len(ranks)], ranks


class Aligned:
    """One text's tokens on both sides and the indices, on each side, of the tokens at common ends."""

    def __init__(self, t: Tokenizers, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        self.driver = "a" if len(a) <= len(b) else "b"
        short, long = (ends_a, ends_b) if self.driver == "a" else (ends_b, ends_a)
        ranks, held = gallop(short, long)
        self.first, self.last = overlaps(ranks, held)
        mine, its = np.flatnonzero(held), ranks[held]
        self.cut_a, self.cut_b = (mine, its) if self.driver == "a" else (its, mine)
        self.ends = short[mine]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return self.a[self.cut_a], self.b[self.cut_b]

    def groups(self, t: Tokenizers) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group. Both sides' tokens are put at their places, group by group."""
        sizes_a, sizes_b = np.diff(self.cut_a, prepend=-1), np.diff(self.cut_b, prepend=-1)
        before = self.cut_b + 1 - sizes_b  # B tokens of the groups before
        at_a = np.arange(len(self.a)) + np.repeat(before, sizes_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.cut_a + 1, sizes_b)
        out = np.empty(len(self.a) + len(self.b), dtype=np.uint64)
        out[at_a], out[at_b] = t.a_inner[self.a], t.b_inner[self.b]
        out[at_a[self.cut_a]], out[at_b[self.cut_b]] = t.a_last[self.a[self.cut_a]], t.b_last[self.b[self.cut_b]]
        characters = out.view(np.uint8)
        return characters[characters != 0].tobytes()[:-1]


def blocks(text: str):
    """The text in blocks, each without the blank before it (both sides put one there)."""
    at = 0
    while len(text) - at > BLOCK:
        border = _BORDER.search(text, at + BLOCK)
        if border is None:
            break
        yield text[at:border.start()]
        at = border.end()
    yield text[at:] if at else text


def aligned_blocks(t: Tokenizers, text: str) -> list[Aligned] | None:
    """The aligned blocks of a text; null if it has no tokens."""
    if not text or "▁" in text:  # the second vocabulary reads that character as a blank
        return None
    out = []
    for block in blocks(text):
        found = t.ids(block)
        if found is None:
            return None
        out.append(Aligned(t, *found))
    return out


def _kind(df: DataFrame, col: str) -> list[str]:
    return [dict(df.select(col).dtypes)[col]]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, a_cuts, b_cuts, ends, driver, first, last) per row: the ids, the indices of the tokens at common ends and
    these ends (bytes of the space and the text), and, for each token of the driving side, the first and last token of the other
    side that it overlaps. Texts without tokens have empty lists."""
    names = ["a_ids", "b_ids", "a_cuts", "b_cuts", "ends", "first", "last"]

    def run(batch: list[bytes]) -> list[pa.Array]:
        t, rows, drivers = tokenizers(a_path, b_path), [], []
        for raw in batch:
            text = raw.decode("utf-8", "replace")
            found = t.ids(text) if text and "▁" not in text else None
            one = None if found is None else Aligned(t, *found)
            drivers.append(one and one.driver)
            rows.append([[]] * 7 if one is None else [one.a, one.b, one.cut_a, one.cut_b, one.ends, one.first, one.last])
        return [*[pa.array(list(c), pa.list_(pa.int64())) for c in zip(*rows)], pa.array(drivers, pa.string())]

    return map_texts(docs, [id_col], text_col, run, ", ".join([f"{n} array<long>" for n in names] + ["driver string"]), _kind(docs, id_col))


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_overlaps, groups_sha256, links) per row; ``links`` holds the pairs' numbers (``slot``)."""
    def run(batch: list[bytes]) -> list[pa.Array]:
        t, rows, links = tokenizers(a_path, b_path), [], []
        for raw in batch:
            found = aligned_blocks(t, raw.decode("utf-8", "replace"))
            if found is None:
                rows.append((0, 0, 0, 0, ""))
                links.append(np.empty(0, np.int32))
                continue
            digest = hashlib.sha256()
            for k, one in enumerate(found):
                digest.update(b";" * bool(k) + one.groups(t))
            rows.append((sum(len(x.a) for x in found), sum(len(x.b) for x in found), sum(len(x.cut_a) for x in found),
                         sum(int((x.last - x.first + 1).sum()) for x in found), digest.hexdigest()))
            links.append(np.concatenate([t.slot(*x.links()) for x in found]))
        cols = list(zip(*rows))
        return [*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4]), pa.array(links, pa.list_(pa.int32()))]

    return map_texts(docs, [id_col], text_col, run, "n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, "
                     "links array<int>", _kind(docs, id_col))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): how many links of all rows hold a pair. At most ``Tokenizers.slots`` rows."""
    return links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def measures(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is, by its count over all rows, the most frequent
    of its B token; ties included), count_sum (the counts of its links), groups_sha256, n_overlaps (overlapping token pairs)."""
    path = scratch_path(docs.sparkSession, "alignment-links")
    # small row groups: a writing task holds one in memory
    linked(docs, a_path, b_path, id_col, text_col).write.option("parquet.block.size", 16 << 20).parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    t = tokenizers(a_path, b_path)
    counts, best = np.zeros(t.slots, dtype=np.int64), np.zeros(t.slots, dtype=bool)
    found = materialize(pair_counts(stored), "alignment-counts").toArrow()  # bounded by the two vocabularies, see above
    pairs, n = found.column("pair").to_numpy(), found.column("n").to_numpy()
    of_b, highest = t.b_of(pairs), np.zeros(len(t.b_bytes), dtype=np.int64)
    np.maximum.at(highest, of_b, n)
    counts[pairs], best[pairs] = n, n == highest[of_b]
    table = docs.sparkSession.sparkContext.broadcast((counts, best))
    names = [id_col, "n_a", "n_b", "n_groups", "groups_sha256", "n_overlaps"]

    def run(batches):
        count, best = table.value
        for batch in batches:
            lists = batch.column(6)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(sizes)

            def total(values: np.ndarray) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                return pa.array(sums[ends] - sums[ends - sizes], pa.int64())

            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sizes, pa.int64()), total(best[flat]), total(count[flat])],
                                             names=[*names, "n_links", "n_best", "count_sum"])

    kinds = [_kind(docs, id_col)[0], "long", "long", "long", "string", "long", "long", "long", "long"]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip([*names, "n_links", "n_best", "count_sum"], kinds))
    return stored.select(*names, "links").mapInArrow(run, schema)
