import pandas as pd
from pyspark.sql import functions as F

from articleflow.context import RunContext
from articleflow.operators import enrich as E
from articleflow.operators.dedup import dedup_exact
from tests.conftest import raw_row, ts

LONG = ("OpenAI released a new language model today. It is faster than before. The model handles long context. "
        "Benchmarks show large gains on reasoning tasks. Pricing starts low. Developers can try it now.")


def test_extractive_provider_contract(raw_df):
    d = dedup_exact(raw_df([raw_row(item_id="a", content=LONG, title=None), raw_row(item_id="b", content="Too short.", seq=1)]))
    e = {r.item_id: r for r in E.enrich(d).collect()}
    a = e["a"]
    assert a.e_title == "OpenAI released a new language model today."
    assert a.e_summary == "OpenAI released a new language model today. It is faster than before."
    assert 3 <= len(a.e_key_points) <= 5 and a.e_key_points[0] == "Benchmarks show large gains on reasoning tasks."
    assert a.e_topics[:2] == ["LLMs", "Products"] and a.e_article_type == "news"
    valid, quarantine = E.split_valid(E.enrich(d))
    assert [r.item_id for r in valid.collect()] == ["a"]
    q = quarantine.collect()
    assert [(r.item_id, r.reason) for r in q] == [("b", "invalid_output")]


def test_processed_projection_carries_merged_sources(raw_df):
    rows = [raw_row(item_id="a", content=LONG, seq=0), raw_row(item_id="a", content=LONG, seq=1, source_type="gmail",
                                                               source_id="m@x", url="https://other/a")]
    valid, _ = E.split_valid(E.enrich(dedup_exact(raw_df(rows))))
    ctx = RunContext(run_date=ts(2024, 12, 23), now=ts(2024, 12, 23, 12))
    p = E.to_processed(valid, ctx).collect()[0]
    assert p.source_types == ["gmail", "rss"]
    assert p.original_urls == ["https://example.com/a", "https://other/a"]
    assert p.processed_at.replace(tzinfo=None) == ts(2024, 12, 23, 12).replace(tzinfo=None)


class Flaky(E.BatchProvider):
    """Returns too few key points on the first call for ids starting with 'r', raises for ids starting with 'x'."""

    def __init__(self):
        self.calls = {}

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i in batch["item_id"]:
            if i.startswith("x"):
                raise RuntimeError("provider down")
            n = self.calls.get(i, 0)
            self.calls[i] = n + 1
            kp = ["k1"] if (i.startswith("r") and n == 0) or i.startswith("bad") else ["k1", "k2", "k3"]
            out.append({"item_id": i, "title": "t", "summary": "s", "key_points": kp, "topics": ["LLMs"],
                        "article_type": "news"})
        return pd.DataFrame(out)


def test_batch_provider_retries_invalid_only(raw_df):
    rows = [raw_row(item_id=i, seq=n, content=LONG) for n, i in enumerate(["ok1", "retry1", "bad1"])]
    e = {r.item_id: r for r in E.enrich(dedup_exact(raw_df(rows)), Flaky(), max_concurrent=2, pause_seconds=0).collect()}
    assert e["ok1"].attempts == 1 and e["ok1"].enrich_error is None
    assert e["retry1"].attempts == 2 and e["retry1"].enrich_error is None
    assert e["bad1"].attempts == 3 and e["bad1"].enrich_error == "invalid_output"


def test_batch_provider_error_drops_without_retry(raw_df):
    rows = [raw_row(item_id="x1", content=LONG)]
    r = E.enrich(dedup_exact(raw_df(rows)), Flaky(), max_concurrent=1, pause_seconds=0).collect()[0]
    assert r.attempts == 1 and r.enrich_error.startswith("RuntimeError")
    valid, quarantine = E.split_valid(E.enrich(dedup_exact(raw_df(rows)), Flaky(), max_concurrent=1, pause_seconds=0))
    assert valid.count() == 0 and quarantine.count() == 1


def test_embed_hashing_unit_length(raw_df):
    valid, _ = E.split_valid(E.enrich(dedup_exact(raw_df([raw_row(item_id="a", content=LONG)]))))
    r = E.embed_hashing(valid, dim=64).select("embedding").collect()[0]
    assert len(r.embedding) == 64 and abs(sum(x * x for x in r.embedding) - 1) < 1e-5


def test_relevance_options(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.5), ("d", 0.4), ("e", 0.1)], "item_id string, relevance_score double")
    assert [r.item_id for r in E.relevance_filter(df, 0.7).collect()] == ["a", "b"]
    assert tuple(E.relevance_breakdown(df).collect()[0]) == (2, 2, 1)
    assert [r.item_id for r in E.by_relevance(df.unionByName(spark.createDataFrame([("n", None)], df.schema))
                                              .withColumn("published_at", F.lit(0))).collect()] == ["a", "b", "c", "d", "e", "n"]


def test_score_bound_in_the_output_contract(raw_df):
    d = E.enrich(dedup_exact(raw_df([raw_row(item_id=i, content=LONG, seq=n) for n, i in enumerate("abc")])))
    s = d.withColumn("relevance_score", F.when(F.col("item_id") == "a", 0.3).when(F.col("item_id") == "b", 1.3))
    valid, quarantine = E.split_valid(s, relevance_score="relevance_score")
    assert [r.item_id for r in valid.collect()] == ["a"] and sorted(r.item_id for r in quarantine.collect()) == ["b", "c"]
    p = E.to_processed(valid, RunContext(run_date=ts(2024, 12, 23), now=ts(2024, 12, 23))).first()
    assert p.relevance_score == 0.3


def test_one_raising_row_costs_one_row(raw_df):
    rows = [raw_row(item_id=i, seq=n, content=LONG) for n, i in enumerate(["x9", *[f"ok{k}" for k in range(60)], "x8"])]
    e = {r.item_id: r for r in E.enrich(dedup_exact(raw_df(rows)), Flaky(), max_concurrent=1, pause_seconds=0).collect()}
    assert {i for i, r in e.items() if r.enrich_error} == {"x8", "x9"} and e["x8"].enrich_error.startswith("RuntimeError")


class Repeating(Flaky):
    """Names every id twice, and one that nobody asked for."""

    def __call__(self, batch):
        import pandas as pd

        out = super().__call__(batch)
        return pd.concat([out, out, out.head(1).assign(item_id="other")], ignore_index=True)


def test_an_answer_that_repeats_ids_gives_one_row_each(raw_df):
    rows = [raw_row(item_id=i, seq=n, content=LONG) for n, i in enumerate(["ok1", "ok2", "bad1"])]
    got = E.enrich(dedup_exact(raw_df(rows)), Repeating(), max_concurrent=1, pause_seconds=0).collect()
    assert sorted(r.item_id for r in got) == ["bad1", "ok1", "ok2"]


class Recording(Flaky):
    """Tells by the summary how many rows and characters came in the call."""

    def __call__(self, batch):
        size = int(batch["content"].str.len().sum())
        return super().__call__(batch).assign(summary=f"{len(batch)} {size}")


def test_calls_go_in_rounds_and_bounded_batches(spark, raw_df, monkeypatch):
    from articleflow.session import materialize

    rows = [raw_row(item_id=f"ok{n}", seq=n, content=LONG * (1 + n % 3)) for n in range(60)] + [raw_row(item_id="ok0", seq=99, content=LONG)]
    df = materialize(raw_df(rows).repartition(6))
    assert [len(g) for g in E._rounds(df, 1)] == [1] * 6 and len(E._rounds(df, 1 << 30)) == 1
    asked = []
    real = E._rounds
    monkeypatch.setattr(E, "TASK_BYTES", 1)
    monkeypatch.setattr(E, "_rounds", lambda *a: asked.append(real(*a)) or asked[-1])
    got = E.enrich(df, Recording(), max_concurrent=2, pause_seconds=0).collect()
    assert len(asked[0]) > 1
    assert sorted(r.item_id for r in got) == sorted(r[2] for r in rows) and all(r.e_title == "t" for r in got)  # a copy is no further row


def test_batches_for_a_provider_are_cut_by_rows_and_characters():
    big = pd.DataFrame({"item_id": [str(i) for i in range(4100)], "prompt": "p", "title": "t", "content": "c"})
    big.loc[5, "content"] = "x" * (E.CALL_CHARS + 1)
    parts = list(E._call_batches([big, big.head(0)]))
    assert [len(p) for p in parts] == [5, 1, 2000, 2000, 94] and pd.concat(parts).equals(big)
