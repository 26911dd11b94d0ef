import tempfile
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from articleflow.context import RunContext
from articleflow.operators import publish as P
from articleflow.operators import query as Q
from articleflow.operators import store as S
from articleflow.schemas import NEWS_ITEMS, PIPELINE_RUNS, PROCESSED_ITEMS
from tests.conftest import ts

PROC_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PROCESSED_ITEMS.fields) + ", seq long"


def item(i, topics, sources=("rss",), hour=10, emb=None, article_type="news"):
    return (i, f"title {i}", "summary", ["k1", "k2", "k3"], list(topics), article_type, [f"https://x/{i}"],
            list(sources), ts(2024, 12, 23, hour), ts(2024, 12, 23, 12), emb, hour)


@pytest.fixture
def processed(spark):
    return spark.createDataFrame([item("a", ["LLMs", "Research"], ("rss", "gmail"), 9),
                                  item("b", ["LLMs"], ("gmail",), 11), item("c", [], ("rss",), 10)], PROC_DDL)


def test_topic_source_type_distributions(processed):
    t = {r.topic: r.n for r in P.topic_distribution(processed).collect()}
    assert t == {"LLMs": 2, "Research": 1}
    tv = {r.topic: r.n for r in P.topic_distribution(processed, with_vocabulary=True).collect()}
    assert len(tv) == 10 and tv["NLP"] == 0
    assert {r.source: r.n for r in P.source_distribution(processed).collect()} == {"rss": 2, "gmail": 2}
    assert {r.article_type: r.n for r in P.type_distribution(processed).collect()} == {"news": 3}


def test_stats_long_and_row(processed, spark):
    errs = spark.createDataFrame([("rss", "f", "E", "HTTP 404: Not Found", ts(2024, 1, 1))],
                                 "source_type string, source_id string, error_type string, error_message string, timestamp timestamp")
    long = P.run_stats_long(processed, 2, errs)
    got = {(r.dimension, r.value): r.n for r in long.collect()}
    assert got[("total_items", None)] == 3 and got[("persisted_count", None)] == 2
    assert got[("collection_errors", None)] == 1 and got[("topic", "LLMs")] == 2
    row = P.run_stats_row(long).collect()[0]
    assert row.total_items == 3 and row.topic_distribution["Research"] == 1
    empty = P.run_stats_long(processed.limit(0), 0, None)
    assert {r.dimension: r.n for r in empty.collect()} == {"total_items": 0, "persisted_count": 0, "collection_errors": 0}


def test_by_topic_newest_first_and_uncategorized(processed):
    r = {x.item_id: (x.primary_topic, x.topic_rank) for x in P.by_topic_ranked(processed).collect()}
    assert r == {"b": ("LLMs", 1), "a": ("LLMs", 2), "c": ("Uncategorized", 1)}


def test_api_items_iso_and_no_embedding(processed):
    a = P.api_items(processed)
    assert "embedding" not in a.columns and "id" in a.columns
    assert a.filter(F.col("id") == "a").collect()[0].published_at == "2024-12-23T09:00:00+00:00"


def test_payload_lines_sections(processed, spark):
    ctx = RunContext(run_date=ts(2024, 12, 23), run_id=None, now=ts(2024, 12, 23, 12))
    lines = P.payload_lines(spark, ctx, processed, P.run_stats_long(processed, 3), None)
    counts = {r.section: r["count"] for r in lines.groupBy("section").count().collect()}
    assert counts == {"meta": 1, "stats": 1, "item": 3}
    meta = lines.filter("section = 'meta'").collect()[0].json
    assert '"run_id":"unknown"' in meta and '"version":"1.0"' in meta
    out = tempfile.mkdtemp()
    P.write_payload(lines, out + "/p")
    assert spark.read.json(out + "/p").count() == 5


def news_rows(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NEWS_ITEMS.fields))


def test_upsert_keeps_published_and_created(spark, processed):
    t0, t1 = ts(2024, 12, 20), ts(2024, 12, 24)
    stored = news_rows(spark, [("a", "old", "s", ["x"], ["LLMs"], "news", [], ["rss"], ts(2024, 12, 1), t0, [0.1], t0, t0, None),
                               ("z", "kept", "s", ["x"], ["NLP"], "news", [], ["rss"], ts(2024, 12, 1), t0, None, t0, t0, 0.5)])
    m = {r.item_id: r for r in S.merge_news(stored, processed, t1).collect()}
    assert m["a"].change == "updated" and m["a"].title == "title a"
    assert m["a"].published_at.replace(tzinfo=None) == ts(2024, 12, 1).replace(tzinfo=None)
    assert m["a"].created_at.replace(tzinfo=None) == t0.replace(tzinfo=None)
    assert m["a"].updated_at.replace(tzinfo=None) == t1.replace(tzinfo=None)
    assert m["a"].embedding is None  # a null incoming embedding overwrites (parity)
    assert m["b"].change == "inserted" and m["b"].created_at == m["b"].updated_at
    assert m["z"].change == "kept" and m["z"].title == "kept"
    keep = {r.item_id: r for r in S.merge_news(stored, processed, t1, keep_embedding_if_null=True).collect()}
    assert keep["a"].embedding == [pytest.approx(0.1)]


def test_create_reset_and_rerun_changes_nothing(spark, processed):
    t, now = S.NewsTable(spark, tempfile.mkdtemp() + "/news"), ts(2024, 12, 24)
    t.create()
    assert t.read().count() == 0
    assert t.upsert(processed, now)["inserted"] == 3
    t.create()  # an existing table is left alone
    first = sorted(map(str, t.read().collect()))
    assert t.upsert(processed, now) == {"persisted": 3, "inserted": 0, "updated": 3, "kept_in_rewritten_days": 0}
    assert sorted(map(str, t.read().collect())) == first and len(first) == 3
    assert t.upsert(processed.limit(0), now)["persisted"] == 0
    t.reset()
    assert t.read().count() == 0 and t.upsert(processed, now)["inserted"] == 3


def test_upsert_cut_off_between_stage_and_table_is_finished_by_the_next(spark, processed, monkeypatch):
    t = S.NewsTable(spark, tempfile.mkdtemp() + "/news")
    a, rest = processed.filter("item_id = 'a'"), processed.filter("item_id <> 'a'")

    def lost(*args):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(S, "_overwrite_partitions", lost)
        with pytest.raises(RuntimeError):
            t.upsert(a, ts(2024, 12, 24))
    moved = a.withColumn("published_at", F.lit(ts(2025, 1, 9)))  # stored by the next call first: an update, not a second row
    assert t.upsert(rest.unionByName(moved), ts(2024, 12, 25))["updated"] == 1
    rows = {r.item_id: r for r in t.read().collect()}
    assert len(rows) == t.read().count() == 3
    assert rows["a"].created_at.replace(tzinfo=None) == ts(2024, 12, 24).replace(tzinfo=None)


def test_small_batch_reads_only_its_buckets_and_days(spark, processed):
    t = S.NewsTable(spark, tempfile.mkdtemp() + "/news")
    t.upsert(processed, ts(2024, 12, 24))
    plan = t.touched_days(processed.filter("item_id = 'a'"))._jdf.queryExecution().toString()
    assert "dynamicpruningexpression(bucket" in plan.lower()


def test_reject_rows_two_of_three_persisted(spark, processed):
    bad = processed.withColumn("title", F.when(F.col("item_id") == "b", F.lit(None)).otherwise(F.col("title")))
    good, rejected = S.split_rejects(bad)
    assert good.count() == 2 and [r.reject_reason for r in rejected.collect()] == ["title"]
    wrong_dim = processed.withColumn("embedding", F.array(F.lit(0.1).cast("float")))
    assert S.split_rejects(wrong_dim)[1].count() == 3


def test_run_log(spark):
    runs = spark.createDataFrame([], PIPELINE_RUNS)
    r = S.run_start(runs, "r1", ts(2024, 1, 1), ts(2024, 1, 1, 1))
    r = S.run_start(r, "r1", ts(2024, 1, 1), ts(2024, 1, 1, 2))  # restart resets started_at
    r = S.run_finish(r, "r1", ts(2024, 1, 1, 3), 5, "completed", items_collected=7)
    row = r.collect()[0]
    assert (row.status, row.items_persisted, row.items_collected) == ("completed", 5, 7)
    assert row.started_at.replace(tzinfo=None) == ts(2024, 1, 1, 2).replace(tzinfo=None)
    h = Q.recent_runs(r, 20).collect()[0]
    assert h.duration_seconds == 3600.0
    with pytest.raises(ValueError):
        Q.recent_runs(r, 0)


def test_recent_items_filters(spark, processed):
    news = processed.withColumn("created_at", F.col("processed_at")).withColumn("updated_at", F.col("processed_at"))
    assert [r.item_id for r in Q.recent_items(news, 10).collect()] == ["b", "c", "a"]
    assert [r.item_id for r in Q.recent_items(news, 10, topic="Research").collect()] == ["a"]
    assert Q.recent_items(news, 10, topic="", article_type="").count() == 3
    assert Q.recent_items(news, 10, article_type="tutorial").count() == 0
    assert Q.get_item(news, "nope").count() == 0
    assert Q.items_total(news, topic="LLMs").collect()[0].total == 2


def test_trace_file_sample(spark):
    doc = """{
  "trace_id": "t-1", "messages": [],
  "metadata": {"status": "success", "start_time": "2023-05-04T08:00:00.250000",
    "end_time": "2023-05-04T08:00:03.750000", "duration_ms": 3500,
    "custom_metadata": {"LANGSMITH_PROJECT": "news", "ls_run_depth": 0},
    "token_usage": {"prompt_tokens": 120, "completion_tokens": 30, "total_tokens": 150},
    "costs": {"prompt_cost": "0.001200", "completion_cost": "0.000900", "total_cost": "0.002100"},
    "first_token_time": null, "feedback_stats": {}}, "feedback": []}"""
    d = tempfile.mkdtemp()
    with open(d + "/t.json", "w") as f:
        f.write(doc)
    r = Q.trace_runs(Q.read_traces(spark, d), project="news", limit=10).collect()[0]
    assert (r.name, r.status, r.duration_ms, r.total_tokens) == ("Unnamed", "success", 3500, 150)
    assert str(r.total_cost) == "0.002100"
    assert Q.trace_runs(Q.read_traces(spark, d), project="other").count() == 0
    _ = timedelta


def test_news_table_rewrites_only_touched_days(spark, processed):
    t = S.NewsTable(spark, tempfile.mkdtemp() + "/news")
    older = processed.withColumn("published_at", F.col("published_at") - F.expr("INTERVAL 10 DAYS")) \
        .withColumn("item_id", F.concat(F.lit("old-"), F.col("item_id")))

    def files():
        found = {(r.day, r.f) for r in t.read().select("day", F.input_file_name().alias("f")).collect()}
        return {day: {f for d, f in found if d == day} for day, _ in found}

    assert t.upsert(older.unionByName(processed), ts(2024, 12, 24)) == {
        "persisted": 6, "inserted": 6, "updated": 0, "kept_in_rewritten_days": 0}
    before = files()
    # known under another day than the batch says: the stored day is rewritten, no second row appears
    again = processed.filter(F.col("item_id") == "a").withColumn("title", F.lit("new title")) \
        .withColumn("published_at", F.lit(ts(2025, 2, 1)))
    assert t.upsert(again, ts(2024, 12, 25)) == {"persisted": 1, "inserted": 0, "updated": 1, "kept_in_rewritten_days": 2}
    after = files()
    assert set(after) == {"2024-12-13", "2024-12-23"}
    assert after["2024-12-13"] == before["2024-12-13"] and after["2024-12-23"] != before["2024-12-23"]
    rows = {r.item_id: r for r in t.read().collect()}
    assert len(rows) == 6 and rows["a"].title == "new title" and rows["old-a"].title == "title a"
    assert rows["a"].created_at.replace(tzinfo=None) == ts(2024, 12, 24).replace(tzinfo=None)


def test_run_table_replaces_one_run(spark):
    t = S.RunTable(spark, tempfile.mkdtemp() + "/runs")
    t.create()
    for run_id in ("r1", "20240102"):
        t.put(S.run_start(t.read(run_id), run_id, ts(2024, 1, 1), ts(2024, 1, 1, 1)))
    t.put(S.run_finish(t.read("r1"), "r1", ts(2024, 1, 1, 3), 5))
    assert {r.run_id: r.status for r in t.read().collect()} == {"r1": "completed", "20240102": "running"}
    t.put(S.run_start(t.read("r1"), "r1", ts(2024, 1, 1), ts(2024, 1, 1, 4)))  # a restart
    assert {r.run_id: r.status for r in t.read().collect()} == {"r1": "running", "20240102": "running"}
    t.reset()
    assert t.read().count() == 0


def test_news_folders_do_not_grow_with_the_days(spark, processed):
    one = processed.filter("item_id = 'a'")
    many = one.drop("item_id", "published_at").crossJoin(spark.range(70).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("item_id"),
        F.when(F.col("id") < 69, F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 86_400 * 7)).alias("published_at")))
    t = S.NewsTable(spark, tempfile.mkdtemp() + "/news", slots=8)
    assert t.upsert(many, ts(2024, 12, 24))["inserted"] == 70

    def folders():
        found = t.read().select("item_id", F.regexp_extract(F.input_file_name(), r"slot=(\d+)", 1).alias("slot")).collect()
        return {r.item_id: int(r.slot) for r in found}

    at = folders()
    assert len(at) == 70 and set(at.values()) == set(range(9)) and at["k69"] == 8  # eight slots, and one for rows without a time
    assert t.upsert(many.filter("item_id in ('k3', 'k69')"), ts(2024, 12, 25)) == {
        "persisted": 2, "inserted": 0, "updated": 2, "kept_in_rewritten_days": sum(s == at["k3"] for s in at.values()) - 1}
    assert folders() == at and t.read().filter("day = 'none'").count() == 1


def test_stream_takes_files_by_size(spark):
    from articleflow.streaming.ingest import _run, stream_table

    d = tempfile.mkdtemp()
    spark.range(100).repartition(4).write.parquet(f"{d}/documents.parquet")
    schema = spark.range(1).schema

    def batches(**limit):
        out, progress = _run(stream_table(spark, d, "documents", schema, **limit), "t", "append", None, None)
        assert spark.read.parquet(out).count() == 100
        return sum(p["numInputRows"] > 0 for p in progress)

    assert batches() == 4 and batches(max_bytes=1 << 20) == 1
