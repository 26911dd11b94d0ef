"""Enrichment of de-duplicated items into processed items.

Two provider kinds:
* a **column provider** is a function ``DataFrame -> DataFrame`` that adds the enrichment columns with Spark
  expressions (stays inside Catalyst / whole-stage codegen). ``extractive_provider`` is the built-in one.
* a **batch provider** is an object called on pandas batches inside ``mapInPandas`` – the shape of an external
  model call. Invalid outputs are retried (``max_retries`` more calls, only for the invalid rows, with a pause);
  a raised error or an error column drops the row to quarantine without retry.

Enrichment columns: e_title, e_summary, e_key_points, e_topics, e_article_type (+ enrich_error, attempts).
``split_valid`` sends rows that break the output contract (F8) to a quarantine frame with the reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.context import RunContext
from articleflow.functions.arrays import original_urls, source_types
from articleflow.functions.predicates import valid_enrichment
from articleflow.functions.text import embedding_text, prompt_text, sentences
from articleflow.session import compute_once
from articleflow.schemas import (
    EMBEDDING_DIM, KEY_POINTS_MAX, MAX_CONCURRENT, MAX_RETRIES, TOPIC_CATEGORIES, TOPICS_MAX,
)

ENRICH_COLS = ["e_title", "e_summary", "e_key_points", "e_topics", "e_article_type"]

# ---------------------------------------------------------------------------------------------
# Fixed values of the built-in extractive provider (our own rules, not the reference's model):
# keyword patterns per topic, matched as substrings of the lower-cased whole text, in vocabulary order.
TOPIC_KEYWORDS = [
    ("LLMs", "llm|language model|gpt|transformer"),
    ("AI Agents", "agent"),
    ("AI Safety", "safety|alignment|jailbreak"),
    ("MLOps", "mlops|deploy|pipeline|monitoring"),
    ("Computer Vision", "vision|image|video|pixel"),
    ("NLP", "nlp|token|translation|sentiment"),
    ("Open Source", "open source|open-source|github|licen"),
    ("Products", "launch|product|release|pricing"),
    ("Research", "paper|research|study|benchmark|arxiv"),
    ("Industry", "company|market|funding|acquisition|startup"),
]
TUTORIAL_PATTERN = "how to|tutorial|step by step|step-by-step|walkthrough|guide"
SUMMARY_SENTENCES = 2
# ---------------------------------------------------------------------------------------------


def hashed_topic(item_id="item_id") -> F.Column:
    """Fallback topic when no keyword matches: vocabulary entry picked by the first 8 hex digits of the id."""
    idx = F.conv(F.substring(F.col(item_id) if isinstance(item_id, str) else item_id, 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(t) for t in TOPIC_CATEGORIES]), (idx % len(TOPIC_CATEGORIES) + 1).cast("int"))


def _mentions(text: F.Column, words: str) -> F.Column:
    """Whether the text holds one of the ``|``-separated words. Plain substring searches: each is several times as fast as
    trying all words at every place with a regular expression."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words.split("|")])


def extractive_provider(df: DataFrame) -> DataFrame:
    """Built-in column provider (N2). Over the whole content:
    title = given title, else the first sentence; summary = the first two sentences; key points = the five
    longest sentences (ties by position), longest first; topics = keyword hits in vocabulary order (at most 3),
    else one topic derived from the id; article_type = 'tutorial' when a how-to phrase occurs, else 'news'.
    Texts with fewer than three sentences give fewer than three key points and fail validation on purpose."""
    pre = df.withColumn("_sent", sentences(F.col("content"))).withColumn("_low", F.lower(F.col("content")))
    sent, low = F.col("_sent"), F.col("_low")
    # lengths and positions are sorted, not sentences; the five chosen ones are fetched by position
    order = F.slice(F.array_sort(F.transform(sent, lambda s, i: F.struct((-F.length(s)).alias("k"), i.alias("i")))), 1, KEY_POINTS_MAX)
    ranked = F.transform(order, lambda x: F.element_at(sent, x["i"] + 1))
    hits = F.filter(F.array(*[F.when(_mentions(low, p), F.lit(t)) for t, p in TOPIC_KEYWORDS]), lambda x: x.isNotNull())
    out = compute_once(pre, [
        F.coalesce(F.nullif(F.trim(F.col("title")), F.lit("")), F.try_element_at(sent, F.lit(1))).alias("e_title"),
        F.nullif(F.array_join(F.slice(sent, 1, SUMMARY_SENTENCES), " "), F.lit("")).alias("e_summary"),
        ranked.alias("e_key_points"),
        F.when(F.size(hits) > 0, F.slice(hits, 1, TOPICS_MAX)).otherwise(F.array(hashed_topic("item_id"))).alias("e_topics"),
        F.when(_mentions(low, TUTORIAL_PATTERN), F.lit("tutorial")).otherwise(F.lit("news")).alias("e_article_type"),
    ])
    return out.drop("_sent", "_low")


def enrich(df: DataFrame, provider: Callable[[DataFrame], DataFrame] | "BatchProvider" = extractive_provider,
           max_concurrent: int = MAX_CONCURRENT, max_retries: int = MAX_RETRIES, pause_seconds: float = 0.5,
           prompt_template: str | None = None) -> DataFrame:
    """Adds enrichment columns (N1). Column providers run as expressions; batch providers through
    ``enrich_batches``. The frame keeps every input column."""
    if isinstance(provider, BatchProvider):
        return enrich_batches(df, provider, max_concurrent, max_retries, pause_seconds, prompt_template)
    out = provider(df)
    if "enrich_error" not in out.columns:
        out = out.withColumn("enrich_error", F.lit(None).cast("string"))
    if "attempts" not in out.columns:
        out = out.withColumn("attempts", F.lit(1))
    return out


def split_valid(enriched: DataFrame, relevance_score: str | None = None, strict_vocabulary: bool = False):
    """(valid, quarantine) by the output contract (F3, F8, R6). Quarantine rows carry ``reason``."""
    ok = valid_enrichment("e_title", "e_summary", "e_key_points", "e_topics", "e_article_type",
                          relevance_score=relevance_score, strict_vocabulary=strict_vocabulary)
    flagged = enriched.withColumn("_ok", F.col("enrich_error").isNull() & ok)
    valid = flagged.filter("_ok").drop("_ok")
    quarantine = (flagged.filter(~F.col("_ok"))
                  .withColumn("reason", F.coalesce(F.col("enrich_error"), F.lit("invalid_output")))
                  .drop("_ok"))
    return valid, quarantine


def to_processed(valid: DataFrame, ctx: RunContext, embedding: str | None = None) -> DataFrame:
    """Valid enriched rows → processed items (P8–P10). ``processed_at`` is the run's ``now``. A relevance score is carried
    through when the rows have one (R2)."""
    score = [F.col("relevance_score").cast("double").alias("relevance_score")] if "relevance_score" in valid.columns else []
    emb = F.col(embedding) if embedding else F.lit(None).cast("array<float>")
    return valid.select(
        "item_id",
        F.col("e_title").alias("title"),
        F.col("e_summary").alias("summary"),
        F.col("e_key_points").alias("key_points"),
        F.col("e_topics").alias("topics"),
        F.col("e_article_type").alias("article_type"),
        original_urls("raw_metadata", "url").alias("original_urls"),
        source_types("raw_metadata", "source_type").alias("source_types"),
        "published_at",
        F.lit(ctx.now).cast("timestamp").alias("processed_at"),
        emb.alias("embedding"),
        "seq", *score,
    )


def enrichment_counts(enriched: DataFrame, valid_flag: F.Column | None = None) -> DataFrame:
    """input_count, output_count, failed_count in one row."""
    ok = valid_flag if valid_flag is not None else (
        F.col("enrich_error").isNull()
        & valid_enrichment("e_title", "e_summary", "e_key_points", "e_topics", "e_article_type"))
    return enriched.agg(
        F.count(F.lit(1)).alias("input_count"),
        F.count_if(ok).alias("output_count"),
        F.count_if(~ok).alias("failed_count"),
    )


# ------------------------------------------------------------------------ relevance options
def relevance_filter(df: DataFrame, threshold: float, column: str = "relevance_score") -> DataFrame:
    return df.filter(F.col(column) >= F.lit(threshold))


def by_relevance(df: DataFrame, column: str = "relevance_score") -> DataFrame:
    """Best score first, items without a score last, ties newest first, then by id (R3). A global sort: for an output edge."""
    return df.orderBy(F.desc_nulls_last(column), F.desc("published_at"), F.asc("item_id"))


def relevance_breakdown(df: DataFrame, column: str = "relevance_score", high: float = 0.7,
                        medium: float = 0.4) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count_if(c >= high).alias("high"),
                  F.count_if((c >= medium) & (c < high)).alias("medium"),
                  F.count_if(c < medium).alias("low"))


# ------------------------------------------------------------------------------- batch providers
class BatchProvider:
    """Called on pandas batches with columns item_id, prompt, title, content. Returns a frame with item_id and
    title, summary, key_points, topics, article_type, and optionally ``error`` (a message → no retry)."""

    def setup(self) -> None:  # one client per task (connection reuse)
        pass

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:  # pragma: no cover - interface
        raise NotImplementedError


def _valid_rows(out: pd.DataFrame) -> pd.Series:
    """The output contract (F8) on a provider's frame, column by column."""
    def text(col):
        return out[col].map(type).eq(str)

    def strings(col, low, high):
        return out[col].map(lambda x: hasattr(x, "__len__") and not isinstance(x, str) and low <= len(x) <= high
                            and all(isinstance(s, str) for s in x)).astype(bool)

    return text("title") & text("summary") & text("article_type") & strings("key_points", 3, 5) & strings("topics", 1, 3)


BATCH_OUT = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("e_title", T.StringType()),
    T.StructField("e_summary", T.StringType()),
    T.StructField("e_key_points", T.ArrayType(T.StringType())),
    T.StructField("e_topics", T.ArrayType(T.StringType())),
    T.StructField("e_article_type", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("enrich_error", T.StringType()),
])


def _call(provider: BatchProvider, rows: pd.DataFrame) -> pd.DataFrame:
    """One provider call per batch; where it raises, the batch is halved until the failing rows stand alone, so an error
    costs the rows it belongs to and no others."""
    try:
        out = provider(rows).reset_index(drop=True)
    except Exception as e:  # noqa: BLE001 - any provider failure
        if len(rows) > 1:
            half = len(rows) // 2
            return pd.concat([_call(provider, rows.iloc[:half]), _call(provider, rows.iloc[half:])], ignore_index=True)
        out = pd.DataFrame({"item_id": rows["item_id"].values})
        out["error"] = f"{type(e).__name__}: {e}"
    for col in ["title", "summary", "key_points", "topics", "article_type", "error"]:
        if col not in out.columns:
            out[col] = None
    out = out[out["item_id"].isin(rows["item_id"])].drop_duplicates("item_id")  # one answer per row that was asked for
    missing = rows.loc[~rows["item_id"].isin(out["item_id"]), ["item_id"]]  # rows the provider gave no answer for
    return pd.concat([out, missing], ignore_index=True) if len(missing) else out


#: Bytes of an Arrow batch handed to Python, and rows and characters of a batch handed to a provider (a row may have more). Stored
#: bytes that a calling task gets in a round.
ARROW_BYTES, CALL_ROWS, CALL_CHARS, TASK_BYTES = 16 << 20, 2_000, 4 << 20, 64 << 20


def _call_batches(batches):
    """Batches cut to ``CALL_ROWS`` rows and ``CALL_CHARS`` characters, so that what a provider holds stays bounded."""
    for batch in batches:
        size = (batch["prompt"].str.len().fillna(0) + batch["content"].str.len().fillna(0)).to_numpy()
        start = held = 0
        for i, n in enumerate(size):
            if i > start and (i - start == CALL_ROWS or held + n > CALL_CHARS):
                yield batch.iloc[start:i]
                start, held = i, 0
            held += n
        if start < len(batch):
            yield batch.iloc[start:]


def _run_batches(provider: BatchProvider, max_retries: int, pause_seconds: float):
    def run(batches):
        provider.setup()
        for batch in _call_batches(batches):
            pending, done, attempt = batch, [], 0
            while not pending.empty:
                attempt += 1
                out = _call(provider, pending)
                errored = out["error"].notna()
                keep = errored | _valid_rows(out) | (attempt > max_retries)
                res = out[keep].assign(attempts=attempt)
                res.loc[res["error"].isna() & ~_valid_rows(res), "error"] = "invalid_output"
                done.append(res)
                pending = pending[pending["item_id"].isin(out.loc[~keep, "item_id"])]
                if not pending.empty and pause_seconds:
                    time.sleep(pause_seconds)
            if done:
                res = pd.concat(done, ignore_index=True)
                yield pd.DataFrame({
                    "item_id": res["item_id"],
                    "e_title": res["title"], "e_summary": res["summary"],
                    "e_key_points": res["key_points"], "e_topics": res["topics"],
                    "e_article_type": res["article_type"],
                    "attempts": res["attempts"].astype("int32"),
                    "enrich_error": res["error"],
                })

    return run


def _rounds(stored: DataFrame, round_bytes: int) -> list[list[str]]:
    """The files of a stored frame in groups of about ``round_bytes``."""
    jvm, conf = stored.sparkSession.sparkContext._jvm, stored.sparkSession.sparkContext._jsc.hadoopConfiguration()
    groups, held = [[]], 0
    for name in sorted(stored.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        size = path.getFileSystem(conf).getFileStatus(path).getLen()
        if groups[-1] and held + size > round_bytes:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += size
    return groups


def enrich_batches(df: DataFrame, provider: BatchProvider, max_concurrent: int = MAX_CONCURRENT,
                   max_retries: int = MAX_RETRIES, pause_seconds: float = 0.5,
                   prompt_template: str | None = None) -> DataFrame:
    """Batch-provider enrichment (N1, N3, N4). ``max_concurrent`` partitions → at most that many tasks call the
    provider at once. The rows go through in rounds, one after the other, of whole files of the stored input, so that a
    task gets about ``TASK_BYTES`` however long the input is. In a round rows are hash-partitioned by item_id, so a retried task sends
    the same rows again and an idempotent provider gives the same answer. The answers are stored, and the join back to the input
    columns runs on all shuffle partitions: the cap holds for the calls alone."""
    from articleflow.session import materialize, scratch_path, setting

    # the input feeds the calls and the join back: stored once so upstream work (dedup) is not run twice
    df = materialize(df, "enrich-input")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "enrich-output")
    prompt = prompt_text(prompt_template) if prompt_template else prompt_text()
    rounds = _rounds(df, max_concurrent * TASK_BYTES)
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES)):
        for files in rounds:
            rows = spark.read.schema(df.schema).parquet(*files) if len(rounds) > 1 else df
            (rows.select("item_id", prompt.alias("prompt"), "title", "content")
             .repartition(max_concurrent, "item_id")
             .mapInPandas(_run_batches(provider, max_retries, pause_seconds), BATCH_OUT).write.mode("append").parquet(path))
    # rows that share an id may have been asked for in different batches; each gets one answer
    return df.join(spark.read.schema(BATCH_OUT).parquet(path).dropDuplicates(["item_id"]), "item_id", "left")


class ExtractivePandasProvider(BatchProvider):
    """Pandas version of the extractive rules, standing in for an external model in tests and the batch query."""

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        import re

        rx = re.compile(r"[^.!?\n]+[.!?]*")
        rows = []
        for item_id, title, content in zip(batch["item_id"], batch["title"], batch["content"]):
            sent = [s.strip(" ") for s in rx.findall(content or "") if s.strip(" ")]
            ranked = [s for _, _, s in sorted((-len(s), i, s) for i, s in enumerate(sent))][:KEY_POINTS_MAX]
            low = (content or "").lower()
            hits = [t for t, p in TOPIC_KEYWORDS if re.search(p, low)][:TOPICS_MAX]
            topics = hits or [TOPIC_CATEGORIES[int(item_id[:8], 16) % len(TOPIC_CATEGORIES)]]
            rows.append({
                "item_id": item_id,
                "title": (title.strip(" ") if title and title.strip(" ") else (sent[0] if sent else None)),
                "summary": " ".join(sent[:SUMMARY_SENTENCES]) or None,
                "key_points": ranked, "topics": topics,
                "article_type": "tutorial" if re.search(TUTORIAL_PATTERN, low) else "news",
            })
        return pd.DataFrame(rows)


# ------------------------------------------------------------------------------------- embeddings
def embed_hashing(df: DataFrame, text: F.Column | None = None, dim: int = EMBEDDING_DIM,
                  output: str = "embedding") -> DataFrame:
    """Built-in embedding provider: tokens → hashed term frequencies (``dim`` buckets) → L2-normalised
    ARRAY<FLOAT>. Runs in the JVM (Spark ML feature transformers); texts without tokens get a zero vector."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    src = text if text is not None else embedding_text("e_title", "e_summary")
    tmp = df.withColumn("_emb_text", src)
    tokens = RegexTokenizer(inputCol="_emb_text", outputCol="_emb_tok", pattern=r"\W+", minTokenLength=1)
    tf = HashingTF(inputCol="_emb_tok", outputCol="_emb_tf", numFeatures=dim)
    norm = Normalizer(inputCol="_emb_tf", outputCol="_emb_vec", p=2.0)
    out = norm.transform(tf.transform(tokens.transform(tmp)))
    return (out.withColumn(output, vector_to_array("_emb_vec", "float32"))
            .drop("_emb_text", "_emb_tok", "_emb_tf", "_emb_vec"))

