from articleflow.operators import dedup as D
from articleflow.operators.dedup import dedup_exact, dedup_stats, primary_rows
from articleflow.operators.ordering import global_rank, rank_within
from articleflow.schemas import RAW_METADATA
from articleflow.session import materialize
from pyspark.sql import functions as F
from tests.conftest import raw_row, ts


def by_id(df):
    return {r.item_id: r for r in df.collect()}


def test_all_distinct(raw_df):
    d = dedup_exact(raw_df([raw_row(item_id=f"i{i}", seq=i, url=f"https://x/{i}") for i in range(3)]))
    assert d.count() == 3
    assert all(r.n_merged == 1 and r.raw_metadata.merged_from_sources is None for r in d.collect())


def test_pair_and_single(raw_df):
    rows = [raw_row(item_id="a", seq=0), raw_row(item_id="a", seq=1, source_type="gmail", source_id="x@y"),
            raw_row(item_id="b", seq=2)]
    d = by_id(dedup_exact(raw_df(rows)))
    assert len(d) == 2 and d["a"].n_merged == 2
    assert d["a"].raw_metadata.merged_from_sources == ["gmail", "rss"]
    assert sorted(d["a"].raw_metadata.source_metadata.keys()) == ["gmail:x@y", "rss:http://feed/a"]


def test_all_equal_and_empty(raw_df, spark):
    d = dedup_exact(raw_df([raw_row(item_id="a", seq=i) for i in range(3)]))
    assert d.count() == 1
    assert dedup_exact(raw_df([])).count() == 0


def test_longest_content_and_earliest_date_from_different_rows(raw_df):
    rows = [raw_row(item_id="a", seq=0, content="short", published_at=ts(2024, 12, 20)),
            raw_row(item_id="a", seq=1, content="a much longer text", source_type="gmail", source_id="m@x",
                    published_at=ts(2024, 12, 23), title="Long one")]
    r = by_id(dedup_exact(raw_df(rows)))["a"]
    assert r.content == "a much longer text" and r.title == "Long one" and r.source_type == "gmail"
    assert r.published_at.replace(tzinfo=None) == ts(2024, 12, 20).replace(tzinfo=None)


def test_ties_go_to_first_seen(raw_df):
    rows = [raw_row(item_id="a", seq=5, content="same", title="later"),
            raw_row(item_id="a", seq=1, content="same", title="first", source_id="other")]
    assert by_id(dedup_exact(raw_df(rows)))["a"].title == "first"


def test_urls_collected_null_ignored(raw_df):
    rows = [raw_row(item_id="a", seq=0, url="https://x/1"), raw_row(item_id="a", seq=1, url="https://x/2"),
            raw_row(item_id="a", seq=2, url=None)]
    r = by_id(dedup_exact(raw_df(rows)))["a"]
    assert r.raw_metadata.all_urls == ["https://x/1", "https://x/2"]
    assert r.url == "https://x/1"


def test_metadata_last_seen_wins(raw_df):
    rows = [raw_row(item_id="a", seq=0, feed_name="old"), raw_row(item_id="a", seq=3, feed_name="new"),
            raw_row(item_id="a", seq=1, feed_name="mid", source_id="other")]
    r = by_id(dedup_exact(raw_df(rows)))["a"]
    assert r.raw_metadata.source_metadata["rss:http://feed/a"].feed_name == "new"


def test_stats(raw_df):
    rows = [raw_row(item_id="a", seq=0), raw_row(item_id="a", seq=1), raw_row(item_id="b", seq=2)]
    s = dedup_stats(raw_df(rows)).collect()[0]
    assert (s.input_count, s.output_count, s.duplicates_merged, s.reduction_pct) == (3, 2, 1, 33.3)


def test_primary_rows_window_and_aggregate_agree(raw_df):
    rows = [raw_row(item_id="a", seq=i, content="x" * (i % 3)) for i in range(9)]
    a = {r.item_id: r.seq for r in primary_rows(raw_df(rows)).collect()}
    w = {r.item_id: r.seq for r in primary_rows(raw_df(rows), "window").collect()}
    assert a == w == {"a": 2}


def test_rank_within_hot_group_matches_window(spark):
    # one group holds most rows: ranks must equal a per-group row_number
    from pyspark.sql import Window

    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise((F.col("id") % 10).cast("string"))
                                  .alias("g"), (F.col("id") * 7919 % 5003).alias("v"), "id").repartition(7)
    got = rank_within(df, ["g"], [F.desc("v"), F.asc("id")], "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), F.asc("id"))))
    assert got.select("id", "r").exceptAll(want.select("id", "r")).count() == 0
    assert got.count() == 5000
    g = global_rank(df, [F.asc("v"), F.asc("id")], "r").agg(F.min("r"), F.max("r"), F.count_distinct("r")).collect()[0]
    assert tuple(g) == (1, 5000, 5000)


def test_primary_rows_are_fetched_without_sorting_contents(spark):
    """The join that fetches the primary rows hashes the slim side: contents are not sorted, so they are not spilled."""
    rows = spark.range(40).select(
        F.lit("rss").alias("source_type"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source_id"),
        (F.col("id") % 10).cast("string").alias("item_id"), F.lit("t").alias("title"), F.repeat(F.lit("x"), (F.col("id") + 1).cast("int")).alias("content"),
        F.lit(None).cast("string").alias("author"), F.lit("2024-01-01").cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast(RAW_METADATA).alias("raw_metadata"), F.col("id").alias("seq"))
    slim = D.numbered(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = D.merge_primary(slim, D.dedup_groups(slim))
        plan = merged._jdf.queryExecution().executedPlan().toString()
        found = {r.item_id: (r.n_merged, len(r.content)) for r in merged.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert found == {str(i): (4, 31 + i) for i in range(10)}


def test_scratch_tables_are_compressed_with_zstd(spark):
    """Stored stages hold whole texts; they are written in the smaller codec."""
    stored = materialize(spark.range(10).select(F.repeat(F.lit("text "), 100).alias("t")), "codec")
    assert stored.count() == 10 and all(".zstd." in f for f in stored.inputFiles())
