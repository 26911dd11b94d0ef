"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by linear grouping.

1. Documents become pieces: token ids, an end id, and only longer ones are cut, the remainder first, then full pieces.
2. A plan is made from the histogram of piece lengths alone (at most ``capacity`` numbers, whatever the data's size):
   large lengths are sorted and cut into ``groups`` groups of equal cardinality, each rounded up to its longest length;
   the configurations of these few sizes are optimised by a linear programme with column generation (the pricing problem is
   an unbounded knapsack); whole multiples of each configuration are kept; actual lengths take the slots of
   their group; and what is left, the small lengths above all, goes by best fit, longest first, into the fullest sequence that still holds it.
3. The plan is a list of runs (length, first rank, first sequence, offset): the pieces of one length are interchangeable, so a
   piece finds its place from its rank among the pieces of its length. Ranks are counted in salted buckets, so that a
   length that a third of all pieces share is spread over tasks.

The plan's size is bounded: best fit makes at most one run per (length, sequence class) step, and classes are created only by
earlier runs, so runs depend on the number of different lengths (<= capacity), not on the documents. It is sent to the
tasks as three arrays.

Defined results: a null text is the empty text, which is one piece holding the end id; null ids are carried through; repeated
rows are packed once per row; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from articleflow.llm.common import texts, slices
from articleflow.session import materialize

#: Fixed value: the public byte-level pattern that splits a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[object, object] = {}
_SHIFT = 40


def encoder(path: str):
    """The byte-level BPE of a tokenizers JSON file as a tiktoken encoding, which is several times as fast; loaded once
    per Python worker. Special tokens' strings are ordinary text; ``token_ids`` gives the library's ids for every text."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec.get("added_tokens", [])}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(to_byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if i not in special}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def library(path: str):
    """The tokenizers JSON file in its own library, and the strings of its added tokens; loaded once per Python worker."""
    if ("library", path) not in _ENCODERS:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        _ENCODERS["library", path] = Tokenizer.from_file(path), added
    return _ENCODERS["library", path]


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids that the tokenizers library gives with ``add_special_tokens=False``: through ``encoder`` where that is the
    same, and from the library where a text holds an added token's string or white space too long for tiktoken's pattern."""
    plain, added = library(path)
    if not any(t in text for t in added):
        try:
            return encoder(path).encode_to_numpy(text)
        except ValueError:  # the pattern's stack is used up by a run of white space
            pass
    return np.array(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the remainder first, then full pieces."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) per piece."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        for part in slices(batches, 1):
            at, rows, ids = [], [], []
            for i, raw in enumerate(texts(part.column(1))):
                tokens = np.append(token_ids(tokenizer, raw.decode("utf-8", "replace")), end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                    own = tokens[start:start + length]
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(own.tobytes())))
                    if with_ids:
                        ids.append(own.astype(np.int32))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), pa.array(cols[0], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in cols[1:]], *([pa.array(ids, pa.list_(pa.int32()))] * with_ids)],
                    names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    schema = f"`{id_col}` {kind}, {PIECE_SCHEMA}" + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


# ------------------------------------------------------------------------------------------------- the plan
def linear_groups(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Equal-cardinality groups of (length, count) pairs, longest first: (rounded size, its pairs)."""
    total = sum(c for _, c in lengths)
    per = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length, count in lengths:
        while count:
            if room == 0:
                out.append((length, []))
                room = per
            m = min(room, count)
            out[-1][1].append((length, m))
            room, count = room - m, count - m
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for size, members in out:  # groups of one common length need no border between them
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(members)
        else:
            merged.append((size, members))
    return merged


def best_knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration of sizes (repeats allowed) within the capacity, one more item per level."""
    before = np.arange(capacity + 1)[None, :] - sizes[:, None]  # room left below an item of each size
    fits = before >= 0
    before = np.maximum(before, 0)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        gain = np.where(fits, best[before] + values[:, None], -1.0)
        pick = gain.argmax(axis=0)
        better = gain[pick, np.arange(capacity + 1)]
        pick = np.where(better > best + 1e-12, pick, -1)
        if pick[capacity] < 0:
            break
        best, _ = np.maximum(best, better), picks.append(pick)
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, max_columns: int = 400
                   ) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of the configurations in an optimal fractional cover of ``demand`` (column generation)."""
    s, k = np.array(sizes), len(sizes)
    per = capacity // s
    basis = [np.where(np.arange(k) == j, per[j], 0) for j in range(k)]
    inverse, x = np.diag(1.0 / per), np.array(demand) / per  # of the matrix whose columns are the basis
    for _ in range(max_columns):
        value, column = best_knapsack(s, inverse.sum(axis=0), capacity)  # every configuration costs one sequence
        step = (inverse * column).sum(axis=1)
        usable = step > 1e-9
        if value <= 1 + 1e-7 or not usable.any():
            break
        out = int(np.where(usable, x / np.where(usable, step, 1.0), np.inf).argmin())
        row, amount = inverse[out] / step[out], x[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
        x = np.maximum(x - step * amount, 0.0)
        x[out] = amount
        basis[out] = column
    return [(pattern, int(n + 1e-6)) for pattern, n in zip(basis, x) if n >= 1 - 1e-6]


class Plan:
    """Runs (length, first rank) -> (first sequence, offset); sequences are numbered from 0."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.next_rank: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = {}  # residual -> [(first sequence, how many)]
        self.residuals: list[int] = []  # sorted keys of room

    def put(self, length: int, count: int, sequence: int, residual: int) -> None:
        self.runs.append((length, self.next_rank[length], sequence, self.capacity - residual))
        self.next_rank[length] += count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def add_room(self, residual: int, sequence: int, count: int) -> None:
        if residual and count:
            if residual not in self.room:
                bisect.insort(self.residuals, residual)
                self.room[residual] = []
            self.room[residual].append((sequence, count))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            i = bisect.bisect_left(self.residuals, length)
            if i == len(self.residuals):
                n = -(-count // (self.capacity // length))
                self.add_room(self.capacity, self.open(n), n)
                continue
            residual = self.residuals[i]
            sequence, n = self.room[residual].pop()
            m = min(n, count)
            if n > m:
                self.room[residual].append((sequence + m, n - m))
            if not self.room[residual]:
                del self.room[residual]
                self.residuals.pop(i)
            self.put(length, m, sequence, residual)
            self.add_room(residual - length, sequence, m)
            count -= m

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length, first rank), first sequences and offsets."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 4)
        return (runs[:, 0] << _SHIFT) + runs[:, 1], runs[:, 2], runs[:, 3]


def make_plan(histogram: dict[int, int], capacity: int, groups: int = 128, large_share: float = 0.34,
              slack_share: float = 0.001) -> Plan:
    """A configuration is used when its rounded sizes leave at most ``slack_share`` of the capacity; the documents of
    others stay for best fit, which fits actual lengths."""
    plan = Plan(capacity)
    left = {n: c for n, c in histogram.items() if c}
    if full := left.pop(capacity, 0):
        plan.put(capacity, full, plan.open(full), capacity)
    large = [(n, left[n]) for n in sorted(left, reverse=True) if n > large_share * capacity]
    if large:
        grouped = linear_groups(large, groups)
        queues = [[list(m) for m in members] for _, members in grouped]
        for pattern, times in configurations([s for s, _ in grouped], [sum(c for _, c in m) for _, m in grouped], capacity):
            if capacity - sum(int(n) * s for n, (s, _) in zip(pattern, grouped)) <= slack_share * capacity:
                _substitute(plan, pattern, times, queues, left)
    for length in sorted(left, reverse=True):
        plan.best_fit(length, left[length])
    return plan


def _substitute(plan: Plan, pattern: np.ndarray, times: int, queues: list, left: dict[int, int]) -> None:
    """Opens ``times`` sequences of one configuration and gives each slot actual pieces of its group."""
    need = [(g, int(n)) for g, n in enumerate(pattern) if n]
    times = min(times, *(sum(c for _, c in queues[g]) // n for g, n in need))
    if not times:
        return
    stretch = [(plan.open(times), times, plan.capacity)]  # (first sequence, how many, residual)
    for g in (g for g, n in need for _ in range(n)):
        out = []
        for sequence, count, residual in stretch:
            while count:
                length, have = queues[g][0]
                m = min(have, count)
                plan.put(length, m, sequence, residual)
                left[length] -= m
                out.append((sequence, m, residual - length))
                sequence, count = sequence + m, count - m
                if have == m:
                    queues[g].pop(0)
                else:
                    queues[g][0][1] = have - m
        stretch = out
    for sequence, count, residual in stretch:
        plan.add_room(residual, sequence, count)


# --------------------------------------------------------------------------------------------- the operator
def pack(piece_rows: DataFrame, capacity: int = 2048, groups: int = 128, large_share: float = 0.34,
         id_col: str = "doc_id", rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``piece_rows`` (id, piece, length, ...) with ``sequence_id`` and ``offset``."""
    rows = materialize(piece_rows, "pieces")
    histogram = {int(n): int(c) for n, c in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    keys, sequences, offsets = make_plan(histogram, capacity, groups, large_share).arrays()
    buckets = max(64, sum(histogram.values()) // rows_per_bucket)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "start"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("length", "_bucket").orderBy(F.asc_nulls_first(id_col), "piece")
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
             .select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")))
    ranked = (rows.withColumn("_in", F.row_number().over(inside) - 1).join(ahead, ["length", "_bucket"])
              .withColumn("_rank", F.col("_in") + F.col("_off")))
    shared = piece_rows.sparkSession.sparkContext.broadcast((keys, sequences, offsets))
    columns = piece_rows.columns

    def place(batches):
        starts, seq, off = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            key = (b.column(len(columns)).to_numpy(zero_copy_only=False).astype(np.int64) << _SHIFT) \
                + b.column(len(columns) + 1).to_numpy(zero_copy_only=False)
            run = np.searchsorted(starts, key, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(columns))], pa.array(seq[run] + key - starts[run]), pa.array(off[run])],
                names=[*columns, "sequence_id", "offset"])

    typed = ", ".join(f"`{c}` {t}" for c, t in piece_rows.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*columns, F.col("length").alias("_l"), F.col("_rank").cast("long")).mapInArrow(place, typed)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col, with_ids=with_ids), capacity,
                id_col=id_col)
