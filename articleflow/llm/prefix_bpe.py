"""Byte-level BPE by prefix dynamic programming: encoding, decoding, appends and re-encoding near edits.

A rank file names the tokens in the order of their merges. A text is split by the public pattern, and each piece is encoded by itself:

* Of all tokens that end a byte prefix of a piece exactly one is the last token of that prefix's encoding: the one that may follow the
  last token of the prefix before it. ``PrefixBPE.prefixes`` stores it for every prefix, so a piece costs time in proportion to its
  bytes (an automaton lists the tokens ending at each byte), and walking back from any prefix's end gives that prefix's encoding.
* Two tokens may be neighbours when no merge across their border would have come before the merges that made them (``may_follow``).
* Appended bytes only extend the table. After an edit the table is made anew from the edit on, until as many values in a row as
  the longest token has bytes agree with the old table; from there on the old values hold.

A table of a whole text (``Prefixes``) also holds the ends of the pieces: an edit splits anew from a border before it up to the first
old border after it. Tables and ids are plain columns, so edits run on stored tables (``prefix_tables``, ``apply_edits``).

The splitting pattern needs character classes; ``regex`` may know newer characters than the tiktoken library. The classes are
read from that library, and a text with a character that the two judge differently is split by explicit classes.

Defined results: null is the empty text, which has no tokens; bytes that are no UTF-8 become U+FFFD; white space and pieces of
any length are encoded whole; repeated rows get equal results; an empty table gives an empty result. Only the named id and text
columns are read, so further columns cannot clash. Memory: a text is encoded in blocks that end where a piece must end.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import map_texts, slices, texts
from articleflow.llm.packing import PATTERN

#: A piece's encoding depends on at most this many characters after it (a word of "'re" kind; the character after white space).
LOOKAHEAD = 2
#: Characters of one block of a text, and pieces and neighbour pairs that are remembered per Python worker (memory bounds only).
BLOCK, REMEMBERED, LONGEST_REMEMBERED = 1 << 20, 1 << 19, 64
_LOADED: dict[object, object] = {}


class Splitter:
    """The public pattern with the character classes of the tiktoken library."""

    def __init__(self, pattern: str = PATTERN):
        import tiktoken

        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        single = {bytes([b]): b for b in range(256)}
        self.plain, explicit, self.differ = regex.compile(pattern), pattern, set()
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            known = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
            members = bytes(known.encode_ordinary(every)).decode()
            self.differ |= set(members) ^ set(regex.findall(name, every))
            if name != r"\s":
                explicit = explicit.replace(name, self._ranges(members))
        # a class inside a class needs no brackets of its own
        self.explicit = regex.compile(explicit.replace("[^\\s[", "[^\\s").replace("][", "").replace("]]+", "]+"))

    @staticmethod
    def _ranges(members: str) -> str:
        points = np.array([ord(c) for c in members])
        cuts = np.flatnonzero(np.diff(points) != 1)
        starts, ends = points[np.r_[0, cuts + 1]], points[np.r_[cuts, len(points) - 1]]
        return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts.tolist(), ends.tolist())) + "]"

    def of(self, text: str):
        """The pattern for ``text``."""
        return self.plain if text.isascii() or self.differ.isdisjoint(text) else self.explicit

    def blocks(self, text: str) -> Iterator[str]:
        """``text`` in blocks. White space that follows something else always begins a piece."""
        at = 0
        while len(text) - at > BLOCK:
            border = _BORDER.search(text, at + BLOCK)
            if border is None:
                break
            yield text[at:border.start()]
            at = border.start()
        yield text[at:] if at else text


_BORDER = regex.compile(r"(?<=\S)\s")


class PrefixBPE:
    """The vocabulary of one rank file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(r) for token, r in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for r in sorted(self.token):
            whole = self.token[r]
            if len(whole) > 1 and not self._take_apart(r, whole):
                continue  # no merges lead to this token; it only stands for a piece that equals it
            self.automaton.add_word(whole.decode("latin-1"), (r, len(whole)))
        self._known.clear()
        self.automaton.make_automaton()
        self.split = Splitter()
        self.pieces = _Pieces(self)

    def _take_apart(self, r: int, whole: bytes) -> bool:
        """Finds the last merge of a token: the cut into two earlier tokens that stay neighbours under all earlier merges."""
        for cut in range(1, len(whole)):
            left, right = self.rank.get(whole[:cut], r), self.rank.get(whole[cut:], r)
            if left < r and right < r and self._reachable(left) and self._reachable(right) and self._stable(left, right):
                self.parts[r] = left, right
                self.joined[left, right] = r
                return True
        return False

    def _reachable(self, r: int) -> bool:
        return r in self.parts or len(self.token[r]) == 1

    def _edge(self, r: int, side: int) -> list[tuple[float, int]]:
        """(rank of the merge that took it in, token) of the tokens that once stood at the right (1) or left (0) edge of ``r``."""
        out, taken = [], float("inf")
        while True:
            out.append((taken, r))
            if r not in self.parts:
                return out
            taken, r = r, self.parts[r][side]

    def _stable(self, left: int, right: int) -> bool:
        """No merge across the border came before the two edge tokens were taken in. Of equal merges the left one comes first:
        one inside ``left`` comes before one across the border, which comes before one inside ``right``."""
        across, edge = self.joined.get, self._edge(right, 0)
        for taken_left, a in self._edge(left, 1):
            for taken_right, b in edge:
                merge = across((a, b))
                if merge is not None and merge < taken_left and merge <= taken_right:
                    return False
        return True

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._known.get(key)
        if known is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            known = self._known[key] = self._stable(left, right)
        return known

    # ------------------------------------------------------------------------------------------ one piece
    def prefixes(self, piece: bytes, last: array | None = None) -> array:
        """The last token of each prefix of ``piece`` (entry i: of the first i bytes; entry 0 is -1). A table ``last`` of a
        shorter prefix is extended."""
        last = array("i", [-1]) if last is None else last[:]
        done = len(last) - 1
        last.extend([-1] * (len(piece) - done))
        self._fill(piece, last, done, len(piece))
        return last

    def _fill(self, piece: bytes, last: array, done: int, to: int) -> None:
        """Entries after ``done`` up to ``to``, from the entries before."""
        start = max(0, done + 1 - self.longest)
        follow = self.may_follow
        for end, (r, n) in self.automaton.iter(piece[start:to].decode("latin-1")):
            at = start + end + 1
            if at > done and last[at] < 0:
                before = last[at - n]
                if at == n or (before >= 0 and follow(before, r)):
                    last[at] = r

    def edited(self, old: bytes, old_last: array, new: bytes) -> array:
        """The table of ``new`` from the table of ``old``: made anew only between the common beginning and the first place in the
        common end from which the old values hold."""
        head = _common(old, new)
        tail = min(_common(old[::-1], new[::-1]), len(old) - head, len(new) - head)
        last = old_last[:head + 1]
        last.extend([-1] * (len(new) - head))
        shift, border, at = len(old) - len(new), len(new) - tail, head
        while at < len(new):
            to = min(len(new), at + 4 * self.longest)
            self._fill(new, last, at, to)
            at = to
            low = at - self.longest
            if low > max(border, 0, -shift) and last[low:at + 1] == old_last[low + shift:at + shift + 1]:
                last[at:] = old_last[at + shift:]
                break
        return last

    def walk(self, piece: bytes, last: array) -> list[int]:
        """The ids of a piece from its table. A piece that equals a token is that token."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= len(self.token[last[at]])
        return out[::-1]

    # ------------------------------------------------------------------------------------------ texts
    def id_bytes(self, text: str) -> Iterator[bytes]:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers, block by block."""
        pattern = self.split.of(text)
        for block in self.split.blocks(text):
            yield b"".join(map(self.pieces.__getitem__, pattern.findall(block)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.id_bytes(text)), dtype="<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, np.asarray(ids).tolist()))

    def table(self, text: str) -> Prefixes:
        cuts = [m.end() for m in self.split.of(text).finditer(text)]
        empty = Prefixes(text, [0], [0], array("i"))
        for a, b in zip([0, *cuts], cuts):
            empty.add(self, text[a:b].encode())
        return empty


class _Pieces(dict):
    """Encodings of short pieces that were seen, as bytes."""

    def __init__(self, bpe: PrefixBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = array("I", self.bpe.walk(raw, self.bpe.prefixes(raw)))
        out = np.array(ids, dtype="<u4").tobytes()
        if len(raw) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


@dataclass
class Prefixes:
    """A text, the ends of its pieces in characters and bytes (with a leading 0), and the last token of each byte prefix of its
    piece, one per byte."""

    text: str
    ends: list[int]
    byte_ends: list[int]
    last: array

    def add(self, bpe: PrefixBPE, piece: bytes, table: array | None = None) -> None:
        self.last.extend((bpe.prefixes(piece) if table is None else table)[1:])
        self.byte_ends.append(self.byte_ends[-1] + len(piece))
        self.ends.append(self.ends[-1] + len(piece.decode()))

    def piece(self, i: int) -> bytes:
        return self.text[self.ends[i]:self.ends[i + 1]].encode()

    def piece_table(self, i: int) -> array:
        return array("i", [-1]) + self.last[self.byte_ends[i]:self.byte_ends[i + 1]]

    def ids(self, bpe: PrefixBPE) -> list[int]:
        out: list[int] = []
        for i in range(len(self.ends) - 1):
            out += bpe.walk(self.piece(i), self.piece_table(i))
        return out

    def replaced(self, bpe: PrefixBPE, start: int, stop: int, new: str) -> Prefixes:
        """The table after the characters from ``start`` to ``stop`` (cut to the text) give way to ``new``."""
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        text = self.text[:start] + new + self.text[stop:]
        shift = len(text) - size
        if text.isascii() != self.text.isascii() and bpe.split.of(text) is not bpe.split.of(self.text):
            return bpe.table(text)  # other classes: borders before the edit may move
        kept = max(0, bisect_right(self.ends, start - LOOKAHEAD) - 1)
        out = Prefixes(text, self.ends[:kept + 1], self.byte_ends[:kept + 1], self.last[:self.byte_ends[kept]])
        at = kept  # the old piece that begins where the next new one begins, if any
        for found in bpe.split.of(text).finditer(text, out.ends[-1]):
            here = bisect_left(self.ends, out.ends[-1] - (shift if out.ends[-1] >= start + len(new) else 0))
            at = here if here < len(self.ends) - 1 and here >= kept else at
            piece = found.group().encode()
            near = min(at, len(self.ends) - 2)
            table = bpe.edited(self.piece(near), self.piece_table(near), piece) if near >= 0 else None
            out.add(bpe, piece, table)
            end = found.end()
            if end >= start + len(new):
                same = bisect_left(self.ends, end - shift)
                if same < len(self.ends) and self.ends[same] == end - shift:
                    gap = out.byte_ends[-1] - self.byte_ends[same]
                    out.last.extend(self.last[self.byte_ends[same]:])
                    out.byte_ends += [b + gap for b in self.byte_ends[same + 1:]]
                    out.ends += [e + shift for e in self.ends[same + 1:]]
                    break
        return out

    def appended(self, bpe: PrefixBPE, more: str) -> Prefixes:
        return self.replaced(bpe, len(self.text), len(self.text), more)


def vocabulary(path: str) -> PrefixBPE:
    """The vocabulary of a rank file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]


# ------------------------------------------------------------------------------------------------- DataFrames
def _kind(df: DataFrame, col: str) -> list[str]:
    return [dict(df.select(col).dtypes)[col]]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row."""
    def run(batch: list[bytes]) -> list[pa.Array]:
        bpe = vocabulary(ranks)
        return [pa.array([bpe.encode(raw.decode("utf-8", "replace")).astype(np.int32) for raw in batch], pa.list_(pa.int32()))]

    return map_texts(docs, [id_col], text_col, run, "ids array<int>", _kind(docs, id_col))


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) per row; null ids are no bytes."""
    def run(batches):
        bpe = vocabulary(ranks)
        for batch in batches:
            out = [bpe.decode([] if ids is None else ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {_kind(encoded, id_col)[0]}, bytes binary")


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: the ids and the bytes that they decode to, hashed block by block."""
    def run(batch: list[bytes]) -> list[pa.Array]:
        bpe, out = vocabulary(ranks), []
        for raw in batch:
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for block in bpe.id_bytes(raw.decode("utf-8", "replace")):
                n += len(block) // 4
                ids.update(block)
                decoded.update(bpe.decode(np.frombuffer(block, dtype="<u4")))
            out.append((n, ids.hexdigest(), decoded.hexdigest()))
        cols = list(zip(*out))
        return [pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]

    return map_texts(docs, [id_col], text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", _kind(docs, id_col))


TABLE = "text string, ends array<long>, byte_ends array<long>, last array<int>"


def _table_arrays(found: list[Prefixes]) -> list[pa.Array]:
    return [pa.array([p.text for p in found]), pa.array([p.ends for p in found], pa.list_(pa.int64())),
            pa.array([p.byte_ends for p in found], pa.list_(pa.int64())),
            pa.array([np.frombuffer(p.last, dtype=np.int32) for p in found], pa.list_(pa.int32()))]


def prefix_tables(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ends, byte_ends, last) per row: the tables that appends and edits start from."""
    def run(batch: list[bytes]) -> list[pa.Array]:
        bpe = vocabulary(ranks)
        return _table_arrays([bpe.table(raw.decode("utf-8", "replace")) for raw in batch])

    return map_texts(docs, [id_col], text_col, run, TABLE, _kind(docs, id_col))


def apply_edits(tables: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text, ends, byte_ends, last, ids) after one edit per row: the characters from ``start`` to ``stop`` of the row's text give
    way to ``replacement``. A null start or stop is the text's end, a null replacement is empty; an append leaves both null."""
    def run(batches):
        bpe = vocabulary(ranks)
        for batch in batches:
            for part in slices(iter([batch]), 1):
                found = []
                for text, ends, byte_ends, last, start, stop, new in zip(*(part.column(i).to_pylist() for i in range(1, 8))):
                    old = Prefixes(text, ends, byte_ends, array("i", last))
                    begin = len(text) if start is None else start
                    found.append(old.replaced(bpe, begin, len(text) if stop is None else stop, new or ""))
                ids = pa.array([p.ids(bpe) for p in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), *_table_arrays(found), ids],
                                                 names=[id_col, "text", "ends", "byte_ends", "last", "ids"])

    picked = tables.select(id_col, "text", "ends", "byte_ends", "last", F.col("start").cast("long"), F.col("stop").cast("long"),
                           F.col("replacement").cast("string"))
    return picked.mapInArrow(run, f"`{id_col}` {_kind(tables, id_col)[0]}, {TABLE}, ids array<int>")
