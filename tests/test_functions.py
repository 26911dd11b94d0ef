import hashlib

import pytest
from pyspark.sql import functions as F

from articleflow.functions import (
    check_limit, iso_format, item_id, longest_text, original_urls, parse_feed_date, primary_topic, source_types,
    strip_html,
)
from articleflow.functions.dates import duration_ms, duration_seconds
from tests.conftest import ts


def one(spark, col, data, ddl):
    return spark.createDataFrame(data, ddl).select(col.alias("x")).collect()


def test_item_id_prefers_url(spark):
    rows = one(spark, item_id("url", "title", "content"), [("https://a/1", "T", "body")],
               "url string, title string, content string")
    assert rows[0].x == hashlib.sha256(b"https://a/1").hexdigest()[:32]


def test_item_id_fallback_title_and_first_500(spark):
    content = "é" * 700
    rows = one(spark, item_id("url", "title", "content"), [(None, "T", content), ("", None, content)],
               "url string, title string, content string")
    assert rows[0].x == hashlib.sha256(("T" + content[:500]).encode()).hexdigest()[:32]
    assert rows[1].x == hashlib.sha256(content[:500].encode()).hexdigest()[:32]


@pytest.mark.parametrize("s,expected", [
    ("Mon, 23 Dec 2024 10:00:00 GMT", ts(2024, 12, 23, 10)),
    ("23 Dec 2024 10:00:00 +0100", ts(2024, 12, 23, 9)),
    ("Mon, 23 Dec 2024 10:00 GMT", ts(2024, 12, 23, 10)),
    ("2024-12-23T10:00:00Z", ts(2024, 12, 23, 10)),
    ("2024-12-23T10:00:00+02:00", ts(2024, 12, 23, 8)),
    ("2024-12-23T10:00:00", ts(2024, 12, 23, 10)),  # no zone → UTC
    ("not a date", None),
])
def test_parse_feed_date(spark, s, expected):
    got = one(spark, parse_feed_date("s"), [(s,)], "s string")[0].x
    assert (got.replace(tzinfo=None) if got else None) == (expected.replace(tzinfo=None) if expected else None)


def test_longest_text_first_wins_ties(spark):
    rows = one(spark, longest_text(F.array("a", "b", "c")), [("xx", "yy", "z"), (None, "", None), ("a", "bbb", "")],
               "a string, b string, c string")
    assert [r.x for r in rows] == ["xx", "", "bbb"]


def test_iso_format_fraction_only_when_nonzero(spark):
    rows = spark.createDataFrame([(ts(2024, 12, 23, 10),), (ts(2024, 12, 23, 10, 0, 0, 120000),)], "t timestamp") \
        .select(iso_format("t").alias("x")).collect()
    assert [r.x for r in rows] == ["2024-12-23T10:00:00+00:00", "2024-12-23T10:00:00.120000+00:00"]


def test_primary_topic(spark):
    rows = one(spark, primary_topic("t"), [(["LLMs", "Research"],), ([],), (None,)], "t array<string>")
    assert [r.x for r in rows] == ["LLMs", "Uncategorized", "Uncategorized"]


def test_source_lists(spark):
    df = spark.createDataFrame(
        [("rss", "https://a", (["gmail", "rss"], ["https://a", "https://b"])), ("gmail", None, (None, None)),
         ("rss", "", (None, None))],
        "source_type string, url string, raw_metadata struct<merged_from_sources:array<string>, all_urls:array<string>>")
    rows = df.select(source_types().alias("s"), original_urls().alias("u")).collect()
    assert [(r.s, r.u) for r in rows] == [(["gmail", "rss"], ["https://a", "https://b"]), (["gmail"], []), (["rss"], [])]


def test_strip_html_drops_scripts_even_with_tags_inside(spark):
    html = '<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><p>Hi  <b>there</b></p></body></html>'
    assert one(spark, strip_html("h"), [(html,)], "h string")[0].x == "T Hi there"


def test_durations(spark):
    df = spark.createDataFrame([(ts(2025, 12, 27, 22, 27, 50, 154062), ts(2025, 12, 27, 22, 28, 59, 519985)),
                                (ts(2025, 1, 1), None)], "a timestamp, b timestamp")
    rows = df.select(duration_ms("a", "b").alias("ms"), duration_seconds("a", "b").alias("s")).collect()
    assert rows[0].ms == 69365 and abs(rows[0].s - 69.365923) < 1e-9
    assert rows[1].ms is None and rows[1].s is None


def test_limit_bounds():
    assert check_limit(20, 100) == 20
    for bad in (0, 101, "5", True):
        with pytest.raises(ValueError):
            check_limit(bad, 100)
