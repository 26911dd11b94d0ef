"""The merging streaming dedup (T2) against the batch dedup of the same rows."""

import tempfile

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from articleflow.operators.dedup import dedup_exact
from articleflow.streaming import merge as M
from articleflow.streaming.ingest import run_available
from tests.conftest import RAW_DDL, raw_row, ts


def arrivals(spark, batches):
    folder = tempfile.mkdtemp()
    for rows in batches:
        spark.createDataFrame(rows, RAW_DDL).coalesce(1).write.mode("append").parquet(folder + "/in")
    return spark.readStream.schema(RAW_DDL).option("maxFilesPerTrigger", 1).parquet(folder + "/in")


def flat(df):
    m = "raw_metadata"
    cols = ["item_id", "source_type", "source_id", "title", "content", "author", "published_at", "url", "seq", "n_merged"]
    out = df.select(*cols, f"{m}.feed_name", f"{m}.entry_id", f"{m}.tags", f"{m}.merged_from_sources", f"{m}.merged_from_ids",
                    f"{m}.all_urls", F.to_json(F.array_sort(F.map_entries(f"{m}.source_metadata"))).alias("per_source"))
    return sorted(map(str, out.collect()))


def test_merged_rows_equal_the_batch_over_several_arrivals(spark):
    hot = [raw_row(item_id="h", content="x" * (5 + n % 7), seq=100 + n, source_id=f"http://feed/{n % 2}", url=None,
                   published_at=ts(2024, 12, 20 + n % 3, n % 24)) for n in range(600)]
    first = [raw_row(item_id="a", seq=1), raw_row(item_id="b", seq=2, url=""), raw_row(item_id="t", seq=9, content="same"), *hot[:300]]
    second = [raw_row(item_id="a", seq=3, content="A much longer note.", source_type="gmail", source_id="n@x", url="https://example.com/b",
                      published_at=ts(2024, 12, 22)), raw_row(item_id=None, seq=4, title=None, author=None),
              raw_row(item_id="t", seq=9, content="same"), *hot[300:]]
    ahead = [raw_row(item_id="far", seq=5, published_at=ts(2025, 3, 1))]
    after = [raw_row(item_id="b", seq=6, published_at=ts(2024, 12, 23)),  # late: dropped
             raw_row(item_id="a", seq=7, published_at=ts(2025, 2, 27)),  # a new group, closed by the last arrival
             raw_row(item_id="a", seq=8, published_at=ts(2025, 2, 28), content="Again, and longer.")]
    last = [raw_row(item_id="end", seq=10, published_at=ts(2025, 6, 1))]
    M.use_rocksdb(spark)
    stream = arrivals(spark, [first, second, ahead, after, last])
    got = spark.read.parquet(run_available(M.merge_within_window(stream, 7), "merge-test"))
    want = dedup_exact(spark.createDataFrame(first + second, RAW_DDL)).unionByName(
        dedup_exact(spark.createDataFrame(ahead + after[1:], RAW_DDL)))
    assert flat(got) == flat(want)
    assert sorted(r.n_merged for r in got.filter("item_id IN ('a', 'h')").collect()) == [2, 2, 600]


def test_parts_reduce_copies_before_the_shuffle(spark):
    rows = [raw_row(item_id="h", seq=n, content="y" * (n % 5), url="https://x/1" if n % 2 else None, published_at=ts(2024, 12, 23, n % 24))
            for n in range(1000)] + [raw_row(item_id="single", seq=5000)]
    parts = {r.item_id: r for r in M.parts(spark.createDataFrame(rows, RAW_DDL).coalesce(1)).collect()}
    assert set(parts) == {"h", "single"} and (parts["h"].n, parts["single"].n) == (1000, 1)
    assert (parts["h"].seq, parts["h"].content, parts["h"].urls, parts["h"].entry_seq) == (0, "yyyy", ["https://x/1"], 999)
    assert '"entry_id":"e999"' in parts["h"].entry


def test_row_without_time_and_empty_batch(spark):
    no_time = spark.createDataFrame([raw_row(item_id="u", seq=1)], RAW_DDL).withColumn("published_at", F.lit(None).cast("timestamp"))
    assert M.parts(no_time).collect()[0].day is None
    assert M.parts(no_time.limit(0)).collect() == []
    empty = pd.DataFrame({c.split()[0]: [] for c in M.PARTS.split(", ")})
    assert [len(p) for p in M._reduced(iter([empty]))] == [0]


class _Map(dict):
    def __init__(self, calls):
        self.calls = calls
        self.getValue = lambda k: calls.append("get") or self.get(k)
        self.updateValue = lambda k, v: calls.append("update") or self.__setitem__(k, v)
        self.removeKey = lambda k: calls.append("remove") or self.pop(k, None)
        self.iterator = lambda: calls.append("iterator") or iter(list(self.items()))


class _Handle:
    """A state store of one key that counts the calls made to it."""

    def __init__(self):
        self.calls, self.timers = [], set()
        self.getMapState = lambda *_: _Map(self.calls)
        self.listTimers = lambda: self.calls.append("timers") or iter(sorted(self.timers))
        self.registerTimer = lambda t: self.calls.append("register") or self.timers.add(t)
        self.deleteTimer = lambda t: self.calls.append("delete") or self.timers.remove(t)


class _Clock:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


def _part(item, day, seq, source="s"):
    return Row(item_id=item, day=day * 86_400_000, n=1, published=day, seq=seq, pref=f"{seq:05d}", source_type="rss", source_id=source, title=None,
               content="c", author=None, url=None, p_published=None, meta=None, urls=[f"u{seq}"], entry=None, entry_seq=seq)


def test_a_bucket_pays_two_state_calls_per_item_and_few_besides():
    handle, merge = _Handle(), M.MergeItems(7)
    merge.init(handle)
    first = [_part(f"i{n}", 100 + n, n) for n in range(100)]
    assert list(merge.handleInputRows((0,), iter(first), _Clock(0))) == []
    assert handle.calls.count("get") == handle.calls.count("update") == 100 and len(handle.calls) <= 203
    assert handle.timers == {108 * 86_400_000}  # the first end of the bucket's groups
    # two groups that ended before their timer fired, and a further source that moves an end
    again = [_part("i0", 170, 500), _part("i60", 160, 501, "t"), _part("i60", 170, 502, "t"), _part("i1", 180, 503)]
    closed = list(merge.handleInputRows((0,), iter(again), _Clock(109 * 86_400_000)))
    assert [(r.item_id, r.n, r.seq) for r in closed] == [("i0", 1, 0), ("i1", 1, 1)]
    handle.timers.clear()  # the stream removes a timer that has fired
    ended = {r.item_id: r for r in merge.handleExpiredTimer((0,), _Clock(175 * 86_400_000), None)}
    assert set(ended) == {f"i{n}" for n in range(2, 100) if n <= 67 and n != 60}
    assert handle.timers == {(168 + 8) * 86_400_000} and {k[0] for k in merge.groups} == {"i0", "i1", "i60", *(f"i{n}" for n in range(68, 100))}
    last = {r.item_id: r for r in merge.handleExpiredTimer((0,), _Clock(300 * 86_400_000), None)}
    assert (last["i0"].seq, last["i1"].seq, last["i60"].n, last["i60"].seq) == (500, 503, 3, 60)
    assert [(s.source_id, s.urls) for s in last["i60"].sources] == [("s", ["u60"]), ("t", ["u501", "u502"])]
    assert not merge.groups and not merge.sources and len(last) == 35


def test_items_of_one_bucket_close_apart(spark):
    days = {"a": 2, "b": 3, "c": 9, None: 2}
    first = [raw_row(item_id=i, seq=n, source_id=f"http://feed/{n}", published_at=ts(2024, 12, d)) for i, d in days.items() for n in range(3)]
    between = [raw_row(item_id="far", seq=50, published_at=ts(2024, 12, 12))]  # ends a, b and the one without an id, not c
    second = [raw_row(item_id="c", seq=60, content="A longer one of c.", published_at=ts(2024, 12, 16)),
              raw_row(item_id="a", seq=61, published_at=ts(2024, 12, 17))]
    last = [raw_row(item_id="end", seq=90, published_at=ts(2025, 6, 1))]
    M.use_rocksdb(spark)
    stream = arrivals(spark, [first, between, second, last])
    got = spark.read.parquet(run_available(M.merge_within_window(stream, 7, delay_days=0, buckets=1), "merge-bucket"))
    want = dedup_exact(spark.createDataFrame(first + between + second[:1], RAW_DDL)).unionByName(
        dedup_exact(spark.createDataFrame(second[1:], RAW_DDL)))
    assert flat(got) == flat(want) and got.count() == 6
