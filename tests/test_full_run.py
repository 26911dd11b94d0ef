import tempfile

import pytest
from pyspark.sql import functions as F

from articleflow.context import RunContext
from articleflow.operators import store as S
from articleflow.plans.run import run
from tests.conftest import raw_row, ts

LONG = ("A new open-source agent framework was released. It plans tasks step by step. The authors share a guide. "
        "Early users report good results on benchmarks. The project is on GitHub.")


def collectors(raw_df):
    rss = raw_df([raw_row(item_id=f"i{n}", url=f"https://x/{n}", content=LONG, seq=n,
                          published_at=ts(2024, 12, 20 + n % 3)) for n in range(6)])
    mail = raw_df([raw_row(item_id="i0", url="https://x/0", content=LONG + " More.", seq=100, source_type="gmail",
                           source_id="news@x", published_at=ts(2024, 12, 19))])
    return [rss, mail]


def runs_of(spark, store):
    return {r.run_id: r for r in S.RunTable(spark, f"{store}/pipeline_runs").read().collect()}


def test_full_run_and_rerun(spark, raw_df):
    store = tempfile.mkdtemp()
    ctx = RunContext(run_date=ts(2024, 12, 23), backfill_days=7, run_id="r1", now=ts(2024, 12, 23, 12))
    res = run(spark, ctx, collectors(raw_df), None, store)
    assert (res.status, res.items_collected, res.items_processed, res.items_persisted) == ("completed", 7, 6, 6)
    news = S.NewsTable(spark, f"{store}/news_items").read()
    merged = news.filter(F.col("item_id") == "i0").collect()[0]
    assert merged.source_types == ["gmail", "rss"]
    assert merged.published_at.replace(tzinfo=None) == ts(2024, 12, 19).replace(tzinfo=None)
    payload = spark.read.json(res.payload_path)
    assert payload.filter("section = 'item'").count() == 6 and payload.filter("section = 'meta'").count() == 1
    r1 = runs_of(spark, store)["r1"]
    assert (r1.status, r1.items_collected, r1.items_persisted) == ("completed", 7, 6)
    # the same run again updates the same rows and keeps their creation time
    ctx2 = RunContext(run_date=ts(2024, 12, 23), backfill_days=7, run_id="r2", now=ts(2024, 12, 24))
    res2 = run(spark, ctx2, collectors(raw_df), None, store)
    news2 = S.NewsTable(spark, f"{store}/news_items").read()
    assert news2.count() == 6 and res2.items_persisted == 6
    row = news2.filter(F.col("item_id") == "i1").collect()[0]
    assert row.created_at.replace(tzinfo=None) == ts(2024, 12, 23, 12).replace(tzinfo=None)
    assert row.updated_at.replace(tzinfo=None) == ts(2024, 12, 24).replace(tzinfo=None)


def test_empty_input_still_logs_the_run(spark, raw_df):
    store = tempfile.mkdtemp()
    ctx = RunContext(run_date=ts(2025, 6, 1), backfill_days=0, run_id="empty", now=ts(2025, 6, 1))
    res = run(spark, ctx, collectors(raw_df), None, store)  # every item is older than the window
    assert (res.status, res.items_collected, res.items_persisted) == ("completed", 0, 0)
    assert runs_of(spark, store)["empty"].status == "completed"


def test_errors_of_two_collectors_and_backfill_bound(spark, raw_df):
    ddl = "source_type string, source_id string, error_type string, error_message string, timestamp timestamp"
    errors = [spark.createDataFrame([(k, "s", "E", "m", ts(2024, 12, 1))] * n, ddl) for k, n in (("rss", 2), ("gmail", 1))]
    ctx = RunContext(run_date=ts(2024, 12, 23), backfill_days=7, run_id="e", now=ts(2024, 12, 23))
    assert run(spark, ctx, collectors(raw_df), errors, tempfile.mkdtemp()).collection_errors == 3
    with pytest.raises(ValueError):
        run(spark, RunContext(run_date=ts(2024, 12, 23), backfill_days=31), collectors(raw_df), None, tempfile.mkdtemp())


def test_failed_run_is_recorded(spark, raw_df):
    store = tempfile.mkdtemp()

    def broken(df):
        return df.withColumn("e_title", F.raise_error(F.lit("provider unavailable")))

    ctx = RunContext(run_date=ts(2024, 12, 23), backfill_days=7, run_id="bad", now=ts(2024, 12, 23))
    with pytest.raises(Exception):
        run(spark, ctx, collectors(raw_df), None, store, provider=broken)
    r = runs_of(spark, store)["bad"]
    assert r.status == "failed" and "provider unavailable" in r.error_message
