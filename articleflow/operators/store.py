"""Article and run tables: keyed upsert, run log, row rejection, counts.

The upsert itself is a pure DataFrame function (``merge_news``) – the same rule can be handed to ``MERGE INTO`` where a table format
supports it. On plain Parquet, ``NewsTable`` merges the weeks of the publication days that a batch touches and replaces them by Spark's dynamic
partition overwrite; ``RunTable`` replaces the row of one run in the same way.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions.arrays import from_json_text
from articleflow.schemas import EMBEDDING_DIM, NEWS_ITEMS, PIPELINE_RUNS
from articleflow.session import materialize

UPDATED_COLUMNS = ["title", "summary", "key_points", "topics", "article_type", "original_urls", "source_types",
                   "processed_at", "embedding", "relevance_score"]
NEWS_COLUMNS = [f.name for f in NEWS_ITEMS.fields]
RUN_COLUMNS = [f.name for f in PIPELINE_RUNS.fields]


def _ts(now: datetime) -> F.Column:
    return F.lit(now).cast("timestamp")


# -------------------------------------------------------------------------------------------- upsert
def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last by ``order`` (a batch may name a key twice; row-at-a-time upserts let the last
    one win). Aggregate form, so a repeated key is reduced map-side."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("_r")).select("_r.*")


def with_news_columns(df: DataFrame) -> DataFrame:
    """Columns of the news table that ``df`` lacks, as nulls (rows stored before a column existed)."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in NEWS_ITEMS.fields if f.name not in df.columns})


def merge_news(stored: DataFrame, incoming: DataFrame, now: datetime, keep_embedding_if_null: bool = False,
               unique_keys: bool = False) -> DataFrame:
    """Next content of the news table (S6, S7, J1): full outer join on item_id;
    new key → inserted with created_at = updated_at = now; existing key → the nine content columns and
    processed_at/embedding from the incoming row, published_at and created_at kept, updated_at = now;
    untouched rows unchanged. A null incoming embedding overwrites unless ``keep_embedding_if_null``.
    ``unique_keys`` says that the batch names no key twice (a de-duplicated batch), which saves its aggregation."""
    order = [c for c in ("processed_at", "seq") if c in incoming.columns]
    inc = with_news_columns(incoming).select(*[c for c in NEWS_COLUMNS if c not in ("created_at", "updated_at")],
                                             *[c for c in ["seq"] if c in incoming.columns])
    if not unique_keys:
        inc = latest_per_key(inc, "item_id", order)
    s = with_news_columns(stored).select(*NEWS_COLUMNS).withColumn("_s", F.lit(True)).alias("s")
    i = inc.withColumn("_i", F.lit(True)).alias("i")
    j = s.join(i, F.col("s.item_id") == F.col("i.item_id"), "full_outer")
    has_s, has_i = F.col("s._s").isNotNull(), F.col("i._i").isNotNull()
    out = [F.coalesce(F.col("s.item_id"), F.col("i.item_id")).alias("item_id")]
    for c in NEWS_COLUMNS[1:]:
        if c in UPDATED_COLUMNS:
            newv = F.col(f"i.{c}")
            if c == "embedding" and keep_embedding_if_null:
                newv = F.coalesce(newv, F.col(f"s.{c}"))
            out.append(F.when(has_i, newv).otherwise(F.col(f"s.{c}")).alias(c))
        elif c == "published_at":
            out.append(F.when(has_s, F.col("s.published_at")).otherwise(F.col("i.published_at")).alias(c))
        elif c == "created_at":
            out.append(F.when(has_s, F.col("s.created_at")).otherwise(_ts(now)).alias(c))
        elif c == "updated_at":
            out.append(F.when(has_i, _ts(now)).otherwise(F.col("s.updated_at")).alias(c))
    out.append(F.when(has_s & has_i, F.lit("updated")).when(has_i, F.lit("inserted")).otherwise(F.lit("kept"))
               .alias("change"))
    return j.select(*out)


def reject_rules(embedding_dim: int = EMBEDDING_DIM) -> F.Column:
    """Why a processed row cannot be stored (NOT NULL columns, key/type length, vector dimension); null = ok."""
    checks = [
        (F.col("item_id").isNull() | (F.length("item_id") > 64), "item_id"),
        (F.col("title").isNull(), "title"), (F.col("summary").isNull(), "summary"),
        (F.col("key_points").isNull(), "key_points"), (F.col("topics").isNull(), "topics"),
        (F.col("article_type").isNull() | (F.length("article_type") > 20), "article_type"),
        (F.col("original_urls").isNull(), "original_urls"), (F.col("source_types").isNull(), "source_types"),
        (F.col("published_at").isNull(), "published_at"), (F.col("processed_at").isNull(), "processed_at"),
        (F.col("embedding").isNotNull() & (F.size("embedding") != embedding_dim), "embedding_dimension"),
    ]
    reason = F.lit(None).cast("string")
    for cond, name in reversed(checks):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    return reason


def split_rejects(processed: DataFrame, embedding_dim: int = EMBEDDING_DIM):
    """(storable, rejected) – a bad row is counted out, the others are written."""
    tagged = processed.withColumn("reject_reason", reject_rules(embedding_dim))
    return (tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.filter(F.col("reject_reason").isNotNull()))


def upsert_counts(merged: DataFrame) -> DataFrame:
    """persisted (inserted + updated), inserted, updated, kept, total rows of the new version."""
    return merged.agg(
        F.count_if(F.col("change") != "kept").alias("persisted"),
        F.count_if(F.col("change") == "inserted").alias("inserted"),
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.count_if(F.col("change") == "kept").alias("kept"),
        F.count(F.lit(1)).alias("total"),
    )


# ------------------------------------------------------------------------------------------- run log
def run_start(runs: DataFrame, run_id: str, run_date: datetime, now: datetime) -> DataFrame:
    """Insert (run_id, run_date, started_at=now, counters 0, 'running'), or on an existing run_id reset status to
    'running' and started_at to now (S8, J2)."""
    spark = runs.sparkSession
    new = spark.createDataFrame([(run_id, run_date, now, None, 0, 0, 0, 0, "running", None)], PIPELINE_RUNS)
    exists = runs.filter(F.col("run_id") == run_id)
    updated = exists.withColumn("status", F.lit("running")).withColumn("started_at", _ts(now))
    inserted = new.join(runs.select("run_id"), "run_id", "left_anti")
    return runs.filter(F.col("run_id") != run_id).unionByName(updated).unionByName(inserted)


def run_finish(runs: DataFrame, run_id: str, now: datetime, items_persisted: int, status: str = "completed",
               items_collected: int | None = None, items_processed: int | None = None,
               collection_errors: int | None = None, error_message: str | None = None) -> DataFrame:
    """Keyed update of the run row (S9): completed_at, items_persisted, status; also the counters the reference
    declares but never fills, and the error text of a failed run (D5)."""
    hit = F.col("run_id") == run_id
    sets = {"completed_at": _ts(now), "items_persisted": F.lit(int(items_persisted)), "status": F.lit(status)}
    if items_collected is not None:
        sets["items_collected"] = F.lit(int(items_collected))
    if items_processed is not None:
        sets["items_processed"] = F.lit(int(items_processed))
    if collection_errors is not None:
        sets["collection_errors"] = F.lit(int(collection_errors))
    if error_message is not None:
        sets["error_message"] = F.lit(error_message)
    return runs.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).cast(f.dataType).alias(c) if c in sets else F.col(c)
                         for c, f in zip(RUN_COLUMNS, PIPELINE_RUNS.fields)])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one row each."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def from_json_columns(rows: DataFrame) -> DataFrame:
    """The four list columns back from their JSON text."""
    return rows.select("item_id", *[from_json_text(f"{c}_json").alias(c) for c in
                                    ["key_points", "topics", "original_urls", "source_types"]])


def json_columns(news: DataFrame) -> DataFrame:
    """List columns as JSON text, the row-store form of the four list columns."""
    return news.select("item_id", *[F.to_json(c).alias(f"{c}_json") for c in
                                    ["key_points", "topics", "original_urls", "source_types"]])


# ------------------------------------------------------------------------------------- tables by partition
def _overwrite_partitions(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


class RunTable:
    """The run log as Parquet by run id (S8–S11): a write replaces the row of its run and leaves the others alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> None:
        """Makes the empty table unless there is one."""
        self.spark.createDataFrame([], PIPELINE_RUNS).write.mode("ignore").partitionBy("run_id").parquet(self.path)

    def reset(self) -> None:
        """Drops all runs."""
        self.spark.createDataFrame([], PIPELINE_RUNS).write.mode("overwrite").partitionBy("run_id").parquet(self.path)

    def read(self, run_id: str | None = None) -> DataFrame:
        runs = self.spark.read.schema(PIPELINE_RUNS).parquet(self.path).select(*RUN_COLUMNS)
        return runs if run_id is None else runs.filter(F.col("run_id") == run_id)

    def put(self, run: DataFrame) -> None:
        """Stores runs, each in place of the row with its id. The rows may come from this table: they are staged first."""
        _overwrite_partitions(materialize(run, "run"), self.path, "run_id")


class NewsTable:
    """The news table as Parquet in a fixed number of slots, with a key table beside it (S6, S10, S11 at scale). One writer at a time.

    A slot holds whole weeks of publication days: the week's number modulo ``slots``. A table of up to ``slots`` weeks has one week a
    folder, a longer one several, so that folders and files don't grow in number with the days (a folder per day costs a rename, a
    listing and a file of its own, however few rows a day has).

    An upsert
    1. finds the day of every incoming key that is stored: a join with the key table, which is stored by a hash of item_id, so that a
       small batch reads only the parts its keys fall into (dynamic partition pruning) and no news row is read for it;
    2. merges the slots of the touched days – those of known keys and those of new rows – with ``merge_news`` into a staged table;
    3. replaces these slots by dynamic partition overwrite and appends the new keys. A slot never loses its last row, as an upsert
       neither removes rows nor moves them.
    No list of days or keys goes through the driver, only the numbers of the touched slots.

    The overwrite of several slots isn't atomic. The staged table stays until slots and keys are written; if the driver is lost in
    between, the next upsert first writes it again, which has the same result. Reapplying a batch changes nothing either: its rows
    are found and get the same values. Frames read before an upsert must not be used after it."""

    def __init__(self, spark: SparkSession, path: str, key_buckets: int = 64, slots: int = 256):
        self.spark, self.path, self.key_buckets, self.slots = spark, path.rstrip("/"), key_buckets, slots
        self.items, self.keys, self.staged = (f"{self.path}/{name}" for name in ("items", "keys", "staged"))

    _KEY = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("day", T.StringType()),
                         T.StructField("bucket", T.IntegerType())])
    _ITEM = T.StructType(NEWS_ITEMS.fields + [T.StructField("day", T.StringType()), T.StructField("slot", T.IntegerType())])

    def _empty(self, mode: str) -> None:
        for path, schema, column in ((self.items, self._ITEM, "slot"), (self.keys, self._KEY, "bucket")):
            self.spark.createDataFrame([], schema).write.mode(mode).partitionBy(column).parquet(path)

    def create(self) -> None:
        """Makes the empty table unless there is one."""
        self._empty("ignore")

    def reset(self) -> None:
        """Drops all rows."""
        self._drop_staged()
        self._empty("overwrite")

    def read(self) -> DataFrame:
        """The stored rows; ``day`` (yyyy-MM-dd) is stored beside them, for filters that reach the scan."""
        return self._stored().drop("slot")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self._ITEM).parquet(self.items)

    def _day(self) -> F.Column:
        return F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("none"))

    def _slot(self) -> F.Column:
        """The slot of a ``day``; rows without a publication time have one of their own."""
        week = F.floor(F.unix_date(F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date")) / 7)
        return F.coalesce(F.pmod(week, F.lit(self.slots)), F.lit(self.slots)).cast("int").alias("slot")

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("item_id"), F.lit(self.key_buckets)).cast("int").alias("bucket")

    def touched_days(self, incoming: DataFrame) -> DataFrame:
        """(day): where rows of ``incoming`` are stored, or will be."""
        stored = self.spark.read.schema(self._KEY).parquet(self.keys).withColumnRenamed("day", "stored_day")
        batch = materialize(incoming.select("item_id", self._day().alias("day"), self._bucket()), "batch-keys")
        # the lower bound holds for every row; Spark prunes partitions by a join only if the other side has such a filter
        known = batch.filter(F.col("bucket") >= 0).join(stored, ["bucket", "item_id"]).select(F.col("stored_day").alias("day"))
        return known.unionByName(batch.select("day")).distinct()

    def upsert(self, incoming: DataFrame, now: datetime, keep_embedding_if_null: bool = False,
               unique_keys: bool = False) -> dict:
        """Applies one batch; returns {persisted, inserted, updated, kept_in_rewritten_days}."""
        self.create()
        self._finish()
        if incoming.isEmpty():
            return {"persisted": 0, "inserted": 0, "updated": 0, "kept_in_rewritten_days": 0}
        touched = [r.slot for r in self.touched_days(incoming).select(self._slot()).distinct().collect()]  # at most slots + 1 numbers
        base = self._stored().filter(F.col("slot").isin(touched)).drop("slot")
        obs = Observation(f"upsert-{uuid.uuid4().hex[:8]}")
        merged = merge_news(base, incoming, now, keep_embedding_if_null, unique_keys).observe(
            obs,
            F.count_if(F.col("change") != "kept").alias("persisted"),
            F.count_if(F.col("change") == "inserted").alias("inserted"),
            F.count_if(F.col("change") == "updated").alias("updated"),
            F.count_if(F.col("change") == "kept").alias("kept_in_rewritten_days"),
        )
        # by slot, but a slot with many rows is cut into several tasks and files (AQE rebalancing by measured size)
        (merged.withColumn("day", self._day()).withColumn("slot", self._slot()).hint("rebalance", "slot")
         .write.mode("overwrite").parquet(self.staged))
        counts = {k: int(v) for k, v in obs.get.items()}
        self._finish()
        return counts

    def _finish(self) -> None:
        """Writes the staged result, if there is a complete one, into the table and removes it."""
        if not self._exists(f"{self.staged}/_SUCCESS"):
            return
        staged = self.spark.read.schema(T.StructType(self._ITEM.fields + [T.StructField("change", T.StringType())])).parquet(self.staged)
        _overwrite_partitions(staged.drop("change"), self.items, "slot")
        new = staged.filter(F.col("change") == "inserted").select("item_id", "day", self._bucket())
        new.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.keys)
        self._drop_staged()

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _drop_staged(self) -> None:
        p, fs = self._fs(self.staged)
        fs.delete(p, True)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
