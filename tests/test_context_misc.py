import re

import pytest
from pyspark.sql import functions as F

from articleflow.context import RunContext, new_run_id, validate_backfill
from articleflow.functions.text import prompt_text
from articleflow.operators import publish as P
from tests.conftest import ts


def test_cutoff_exact_and_floored():
    c = RunContext(run_date=ts(2024, 12, 23, 15, 30), backfill_days=0)
    assert c.cutoff == ts(2024, 12, 23, 15, 30)  # backfill 0 keeps the exact instant (parity)
    f = RunContext(run_date=ts(2024, 12, 23, 15, 30), backfill_days=2, floor_to_day=True)
    assert f.cutoff == ts(2024, 12, 21)
    assert RunContext(run_date=ts(2024, 1, 1)).effective_run_id == "unknown"


def test_run_id_and_backfill_bounds():
    assert re.fullmatch(r"run_\d{8}_\d{6}_[0-9a-f]{8}", new_run_id(ts(2024, 12, 23, 10)))
    assert validate_backfill(30) == 30
    for bad in (-1, 31, "3"):
        with pytest.raises(ValueError):
            validate_backfill(bad)


def test_prompt_template_slots(spark):
    df = spark.createDataFrame([(None, "x" * 9000, "rss", "https://f", ts(2024, 12, 23, 10))],
                               "title string, content string, source_type string, source_id string, published_at timestamp")
    p = df.select(prompt_text("T={title}|S={source_type}:{source_id}|P={published_at}|C={content}").alias("p")).first().p
    assert p.startswith("T=No title|S=rss:https://f|P=2024-12-23T10:00:00+00:00|C=")
    assert len(p) == len("T=No title|S=rss:https://f|P=2024-12-23T10:00:00+00:00|C=") + 8000


def test_by_topic_nested_top_k(spark):
    rows = [(f"i{n}", ["LLMs"] if n % 2 else ["NLP"], ts(2024, 12, 1 + n), n) for n in range(6)]
    df = spark.createDataFrame(rows, "item_id string, topics array<string>, published_at timestamp, seq long") \
        .withColumn("title", F.col("item_id"))
    nested = {r.primary_topic: [x.item_id for x in r["items"]]
              for r in P.by_topic_nested(P.by_topic_ranked(df), per_topic=2).collect()}
    assert nested == {"LLMs": ["i5", "i3"], "NLP": ["i4", "i2"]}


def test_scratch_scope_removes_what_it_made(spark):
    import os

    from articleflow.session import materialize, scratch_path, scratch_scope

    kept = materialize(spark.range(3), "outside")
    with scratch_scope(spark):
        inside = materialize(spark.range(5), "inside")
        path = inside.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert inside.count() == 5 and os.path.isdir(path)
        scratch_path(spark, "never-written")
    assert not os.path.exists(path) and kept.count() == 3


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from articleflow.session import checkpoint_dir

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda k, d: None))
        session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None))
        with pytest.raises(RuntimeError):
            checkpoint_dir(session)
