"""Streaming de-duplication that merges (T2): the row of ``dedup.dedup_exact`` for every item, written once when its window closes.

A group opens with the first row of an item id and takes every row of that id that arrives while it is open, in whichever
micro-batch. It closes when the watermark has passed its latest publication day by ``window_days``; then one merged row is written and
the state is removed. A later row of the id opens a new group. Rows published ``delay_days`` or more before the latest publication
day of the batches before are late and dropped. Lateness and closing go by whole days, so that they don't
depend on how rows fall into tasks. A row without a publication time is never late; a group of such rows alone closes
``window_days`` after the watermark of its arrival.

State: items are dealt to a fixed number of buckets by a hash of their id, and a bucket is a key of the stream. A call to the state store
costs far more than what it carries; the calls a key needs besides its values (key, clocks, timer) are made once for a bucket's rows
of a batch, and closing groups are read in pages. A bucket has a map from item to one value (counts, bounds, the primary row with its
content, the first source's part) and a map from every other source of its items to that source's part (urls, last metadata), so that
an item with one source costs one read and one write. A bucket has one timer, at the first end of its groups or before; when it fires, the
groups that ended are written and removed, and the timer moves to the next end. The sources of an item bound its parts, and the rows of
``window_days + delay_days`` the whole state; it lives in the RocksDB state store and is checkpointed with the stream, so a lost
executor restores it.

Hot items: before the shuffle each Arrow batch is reduced to one row per (item, source, day), so that a hot item sends a few rows per
batch of 10,000 to its state task, however many copies it has. Rows whose item has no copy in the batch pass as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from articleflow.operators import dedup as D
from articleflow.schemas import ENTRY_METADATA, RAW_METADATA

_DAY_MS = 86_400_000
_PRIMARY = "source_type string, source_id string, title string, content string, author string, url string, p_published long, meta string"
_PART = "urls array<string>, entry string, entry_seq long"
_STATE = (f"n long, published long, seq long, closes long, others boolean, own_type string, own_id string, {_PART}, pref string, "
          f"{_PRIMARY}")
#: A part: the rows of one item from one source and day, with the best of them. ``pref`` compares as text; times are microseconds and
#: ``day`` the milliseconds of a day's start, so no time zone of a Python worker matters.
PARTS = f"item_id string, day long, n long, published long, seq long, pref string, {_PRIMARY}, {_PART}"
_GROUP = (f"item_id string, n long, published long, seq long, {_PRIMARY}, "
          f"sources array<struct<source_type:string,source_id:string,{_PART.replace(' ', ':').replace(',:', ',')}>>")
_GROUP_ROW = Row("item_id", "n", "published", "seq", *[c.split()[0] for c in _PRIMARY.split(", ")], "sources")
_KEYS = ["item_id", "source_type", "source_id", "day"]


def parts(items: DataFrame) -> DataFrame:
    """Raw items as parts, one per (item, source, day) within each Arrow batch. The metadata travels as JSON text."""
    url_ok = F.when(F.col("url").isNotNull() & (F.col("url") != ""), F.array("url")).otherwise(F.array().cast("array<string>"))
    single = items.select(
        "item_id", F.unix_millis(F.date_trunc("day", "published_at")).alias("day"), F.lit(1).cast("long").alias("n"),
        F.unix_micros("published_at").alias("published"), "seq",
        F.lpad(D.preference().cast("string"), 38, "0").alias("pref"), "source_type", "source_id", "title", "content", "author", "url",
        F.unix_micros("published_at").alias("p_published"), F.to_json("raw_metadata").alias("meta"), url_ok.alias("urls"),
        F.to_json(D.entry_meta()).alias("entry"), F.col("seq").alias("entry_seq"))
    return single.mapInPandas(_reduced, PARTS)


def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        copies = pdf.duplicated(_KEYS, keep=False)
        yield pdf[~copies]
        merged = [_merge_part(rows) for _, rows in pdf[copies].groupby(_KEYS, dropna=False, sort=False)]
        if merged:
            yield pd.DataFrame(merged, columns=pdf.columns)


def _merge_part(rows: pd.DataFrame) -> list:
    best = rows.loc[rows["pref"].idxmax()].copy()
    best["entry"], best["entry_seq"] = _last(zip(rows["entry"], rows["entry_seq"]))
    best["n"] = rows["n"].sum()
    best["published"] = rows["published"].min()
    best["seq"] = rows["seq"].min()
    best["urls"] = sorted({u for urls in rows["urls"] for u in urls})
    return best.tolist()


def _last(entries) -> tuple:
    """The entry with the largest seq; ties and missing numbers go by the text, so the order of arrival decides nothing."""
    return max(entries, key=lambda e: (-1 if e[1] is None or e[1] != e[1] else e[1], e[0] or ""))


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _joined(found: list) -> tuple:
    """One part from the parts of a source."""
    return sorted({u for urls, _, _ in found for u in urls}), *_last((entry, seq) for _, entry, seq in found)


class _Arrived:
    """What a batch brings for one item."""

    __slots__ = ("n", "published", "seq", "end", "best", "by_source")

    def __init__(self):
        self.n, self.published, self.seq, self.end, self.best, self.by_source = 0, None, None, None, None, {}

    def add(self, r, end: int) -> None:
        self.n, self.published, self.seq = self.n + r.n, _least(self.published, r.published), _least(self.seq, r.seq)
        self.end = end if self.end is None else max(self.end, end)
        if self.best is None or r.pref > self.best[0]:
            self.best = (r.pref, r.source_type, r.source_id, r.title, r.content, r.author, r.url, r.p_published, r.meta)
        self.by_source.setdefault((r.source_type, r.source_id), []).append((r.urls, r.entry, r.entry_seq))


class MergeItems(StatefulProcessor):
    """State of the items of one bucket (see the module text)."""

    def __init__(self, window_days: int):
        self.window_ms = int(window_days) * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.groups = handle.getMapState("groups", "item_id string", _STATE)
        self.sources = handle.getMapState("sources", "item_id string, source_type string, source_id string", _PART)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark, arrived = timerValues.getCurrentWatermarkInMs(), {}
        for r in rows:
            if r.day is not None and 0 < watermark and r.day <= watermark:  # Spark's own filter goes by the watermark of the batch before
                continue
            # a day later than the group's last one moves its end
            end = (watermark if r.day is None else r.day + _DAY_MS) + self.window_ms
            arrived.setdefault(r.item_id, _Arrived()).add(r, end)
        closed, known, first_end = [], None, None
        for item, new in arrived.items():
            stored = self.groups.getValue((item,))
            if stored is not None and stored[3] <= watermark:  # timers fire after a batch's rows, which must not join a closed group
                if stored[4] and known is None:
                    known = self._others(arrived)
                closed.append(self._emit(item, stored, known[item] if stored[4] else []))
                stored = None
            first_end = _least(first_end, self._merge(item, stored, new))
        if first_end is not None:
            timer = min(self.handle.listTimers(), default=None)
            if timer is None or first_end < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first_end)
        return iter(closed)

    def _merge(self, item, stored, new: _Arrived) -> int:
        """Stores the group of an item with what arrived for it, and returns its end."""
        n, published, seq, end, others, own, part, best = 0, None, None, new.end, False, None, None, None
        if stored is not None:
            (n, published, seq, end, others), own, part, best = stored[:5], tuple(stored[5:7]), tuple(stored[7:10]), tuple(stored[10:])
        if best is None or new.best[0] > best[0]:
            best = new.best
        for source, found in new.by_source.items():
            own = source if own is None else own
            before = part if source == own else self.sources.getValue((item, *source))
            joined = _joined(found if before is None else [*found, before])
            if source == own:
                part = joined
            else:
                self.sources.updateValue((item, *source), joined)
                others = True
        end = max(end, new.end)
        self.groups.updateValue((item,), (n + new.n, _least(published, new.published), _least(seq, new.seq), end, others, *own, *part, *best))
        return end

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark, ended, several, next_end = timerValues.getCurrentWatermarkInMs(), [], {}, None
        for (item,), stored in self.groups.iterator():
            if stored[3] > watermark:
                next_end = _least(next_end, stored[3])
                continue
            ended.append(item)
            if stored[4]:
                several[item] = stored
            else:
                yield self._row(item, stored, [])
        known = self._others(several) if several else {}
        if next_end is None:
            for item, stored in several.items():
                yield self._row(item, stored, known[item])
            self.groups.clear()
            if several:
                self.sources.clear()
            return
        for item, stored in several.items():
            yield self._emit(item, stored, known[item])
        for item in ended:
            if item not in several:
                self.groups.removeKey((item,))
        self.handle.registerTimer(next_end)

    def _others(self, items) -> dict:
        """The parts of the items' further sources, from one pass over the bucket's."""
        found = {}
        for k, part in self.sources.iterator():
            if k[0] in items:
                found.setdefault(k[0], []).append((k[1:], part))
        return found

    def _emit(self, item, stored, others: list) -> Row:
        """The group's row; its state is removed."""
        for source, _ in others:
            self.sources.removeKey((item, *source))
        self.groups.removeKey((item,))
        return self._row(item, stored, others)

    @staticmethod
    def _row(item, stored, others: list) -> Row:
        found = [(tuple(stored[5:7]), stored[7:10]), *others]
        sources = [Row(source_type=k[0], source_id=k[1], urls=list(v[0]), entry=v[1], entry_seq=v[2]) for k, v in found]
        return _GROUP_ROW(item, *stored[:3], *stored[11:], sources)

    def close(self) -> None:
        pass


def merge_within_window(items: DataFrame, window_days: int, delay_days: int | None = None, buckets: int = 2048) -> DataFrame:
    """A stream of raw items → one merged row per item and window (T2); columns as ``dedup.dedup_exact``. ``delay_days`` (default: the
    window) is how far a row may be behind the latest publication day. Needs the RocksDB state store (``use_rocksdb``) and append mode.
    ``buckets`` is the number of keys of the state and stays the same for a checkpoint."""
    delay = window_days if delay_days is None else delay_days
    timed = items.withColumn("published_at", F.col("published_at").cast("timestamp"))
    grouped = (parts(timed).withColumn("event_day", F.timestamp_millis("day")).withWatermark("event_day", f"{int(delay)} days")
               .withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(int(buckets))).cast("int")).groupBy("bucket"))
    return _finished(grouped.transformWithState(MergeItems(window_days), _GROUP, "append", "eventTime"))


def _finished(groups: DataFrame) -> DataFrame:
    source = lambda f: F.transform("sources", f)  # noqa: E731 - an expression over the group's sources
    as_map = F.map_from_entries(source(lambda s: F.struct(
        F.concat_ws(":", s["source_type"], s["source_id"]).alias("key"), F.from_json(s["entry"], ENTRY_METADATA).alias("value"))))
    present = lambda name: F.array_sort(F.array_distinct(F.array_compact(source(lambda s: s[name]))))
    return D.merged_items(groups.select(
        "n", F.timestamp_micros("published").alias("published_at"), "seq", "source_type", "source_id", "title", "content", "author", F.col("item_id").alias("p_item_id"),
        F.col("url").alias("p_url"), F.timestamp_micros("p_published").alias("p_published_at"), F.from_json("meta", RAW_METADATA).alias("p_meta"),
        F.array_sort(F.array_distinct(F.flatten(source(lambda s: s["urls"])))).alias("all_urls"),
        present("source_type").alias("merged_from_sources"), present("source_id").alias("merged_from_ids"),
        as_map.alias("source_metadata")))


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that ``transformWithState`` needs; must be set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

