"""A full run: collect → dedup → enrich → persist → publish.

The enriched rows feed both persistence and publication, so they are written once to the run's staging
folder and read back – the provider is called once per item even though two outputs use the result.
Counts come from ``Observation``s attached to the writes (no extra pass). The news table is stored by
day (``store.NewsTable``): a run rewrites only the days it touches. The run row is written when the run
starts and updated at the end – also for empty input and, with the error text, for a failed run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from articleflow.context import RunContext, validate_backfill
from articleflow.functions.predicates import valid_enrichment
from articleflow.operators import collect as C
from articleflow.operators import dedup as D
from articleflow.operators import enrich as E
from articleflow.operators import publish as P
from articleflow.operators import store as S
from articleflow.session import materialize, scratch_scope


@dataclass
class RunResult:
    run_id: str
    status: str
    items_collected: int
    items_processed: int
    items_persisted: int
    collection_errors: int
    staging: str
    payload_path: str | None
    error_message: str | None = None


def run(spark: SparkSession, ctx: RunContext, collectors: list[DataFrame], errors: DataFrame | list[DataFrame] | None,
        store_dir: str, provider=E.extractive_provider, embed: bool = False) -> RunResult:
    """One run. ``errors`` are the collection errors of one collector or of several, which are appended (U2). The bound on
    backfill days of a run trigger holds here (F9). Scratch tables of the run are removed at its end."""
    validate_backfill(ctx.backfill_days)
    frames = [e for e in (errors if isinstance(errors, list) else [errors]) if e is not None]
    with scratch_scope(spark):
        return _run(spark, ctx, collectors, C.union_collectors(*frames) if frames else None, store_dir, provider, embed)


def _run(spark: SparkSession, ctx: RunContext, collectors: list[DataFrame], errors: DataFrame | None,
         store_dir: str, provider, embed: bool) -> RunResult:
    ctx = ctx.with_run_id()
    store_dir = store_dir.rstrip("/")
    runs = S.RunTable(spark, f"{store_dir}/pipeline_runs")
    news = S.NewsTable(spark, f"{store_dir}/news_items")
    runs.create()
    news.create()
    runs.put(S.run_start(runs.read(ctx.run_id), ctx.run_id, ctx.run_date, ctx.now))
    staging = f"{store_dir}/_staging/{ctx.run_id}"
    collected = processed_n = persisted = err_n = 0
    try:
        if errors is not None:
            err_obs = Observation("errors")
            errors.observe(err_obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{staging}/errors")
            err_n = int(err_obs.get["n"])
        raw = C.collect(collectors, ctx)
        enrich_obs = Observation("enriched")
        enriched = E.enrich(D.dedup_exact(raw), provider)
        # every raw row is in exactly one group, so the sum of group sizes is the collected count
        ok = F.col("enrich_error").isNull() & valid_enrichment("e_title", "e_summary", "e_key_points", "e_topics", "e_article_type")
        (enriched.observe(enrich_obs, F.coalesce(F.sum("n_merged"), F.lit(0)).cast("long").alias("collected"),
                          F.count_if(ok).alias("processed"))
         .write.mode("overwrite").parquet(f"{staging}/enriched"))
        collected, processed_n = (int(enrich_obs.get[k]) for k in ("collected", "processed"))
        enriched = spark.read.parquet(f"{staging}/enriched")
        valid, quarantine = E.split_valid(enriched)
        quarantine.write.mode("overwrite").parquet(f"{staging}/quarantine")
        if embed:
            valid = E.embed_hashing(valid)
        processed = E.to_processed(valid, ctx, "embedding" if embed else None)
        good, rejected = S.split_rejects(processed)
        rejected.write.mode("overwrite").parquet(f"{staging}/rejected")
        good = materialize(good, "storable")  # the batch feeds the upsert's key probe and its merge
        counts = news.upsert(good, ctx.now, unique_keys=True)
        persisted = counts["persisted"]
        payload = f"{staging}/payload"
        # the payload describes this run's processed items (as the publish stage does), read from staging
        run_items = good
        stats = P.run_stats_long(run_items, persisted, errors)
        P.write_payload(P.payload_lines(spark, ctx, run_items, stats, errors, stored=True), payload)
        runs.put(S.run_finish(runs.read(ctx.run_id), ctx.run_id, ctx.now, persisted, "completed", collected,
                                 processed_n, err_n))
        return RunResult(ctx.run_id, "completed", collected, processed_n, persisted, err_n, staging, payload)
    except Exception as e:  # noqa: BLE001 - the run row records the failure, then the error is raised again
        msg = f"{type(e).__name__}: {e}"
        runs.put(S.run_finish(runs.read(ctx.run_id), ctx.run_id, ctx.now, persisted, "failed", collected, processed_n,
                                 err_n, error_message=msg))
        raise
