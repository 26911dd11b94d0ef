"""Session helpers: configuration the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "articleflow",
                  extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass the session you already have to ``prepare``."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ARTICLEFLOW_DRIVER_MEMORY", "16g"))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator assumes: all timestamps are UTC instants (the reference stores TIMESTAMPTZ in UTC)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session (one JVM, one disk) gets a scratch folder of its own when nothing is configured; on a cluster
    a missing setting is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="articleflow-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written intermediate tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/articleflow/{name}-{uuid.uuid4().hex[:12]}"
    for made in _SCOPES:
        made.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes, at its end, the scratch folders made inside it. Frames read from them must not be used afterwards."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the actions inside; the value of before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df, name: str = "stage"):
    """Writes ``df`` once as Parquet under the shared checkpoint folder and returns the read-back frame.

    Cuts the lineage like ``checkpoint()`` but computes the input only once (a reliable RDD checkpoint of an
    unpersisted Dataset runs its plan a second time to write the files) and stores it columnar/compressed (Zstandard: texts
    take a good deal fewer bytes than with the default codec)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def compute_once(df, cols):
    """Adds named columns through a one-row generator (``inline(array(struct(...)))``).

    A filter on a computed column is normally pushed below the projection that computes it, with the
    expression copied into the filter – expensive expressions (regex passes over whole texts) then run once per
    reference. Columns produced by a generator cannot be pushed through, so each is computed exactly once."""
    from pyspark.sql import functions as F

    return df.select("*", F.inline(F.array(F.struct(*cols))))
