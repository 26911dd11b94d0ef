from __future__ import annotations

import sys
import tempfile
from datetime import UTC, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from articleflow.session import build_session

    s = build_session(master="local[*]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="articleflow-test-ckpt-")})
    yield s
    s.stop()


def ts(*a) -> datetime:
    return datetime(*a, tzinfo=UTC)


RAW_DDL = ("source_type string, source_id string, item_id string, title string, content string, author string, "
           "published_at timestamp, url string, raw_metadata struct<feed_name:string, feed_title:string, "
           "entry_id:string, tags:array<string>, merged_from_sources:array<string>, merged_from_ids:array<string>, "
           "all_urls:array<string>, source_metadata:map<string,struct<feed_name:string,feed_title:string,"
           "entry_id:string,tags:array<string>>>>, seq long")


def raw_row(item_id="k1", title="Harbour", content="A short note.", source_type="rss", source_id="http://feed/a",
            published_at=None, url="https://example.com/a", author="Ann", feed_name="Feed A", seq=0):
    meta = (feed_name, None, f"e{seq}", [], None, None, None, None)
    return (source_type, source_id, item_id, title, content, author, published_at or ts(2024, 12, 23, 10),
            url, meta, seq)


@pytest.fixture
def raw_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, RAW_DDL)
    return make
