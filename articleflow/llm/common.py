"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (fixed by the query contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to Python in one Arrow batch are split into slices of about this many bytes.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*cols) if cols else df


def as_text(col: str) -> Column:
    """A column as text, null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches at row borders into slices of bounded text bytes, so that Python objects made from one slice
    stay bounded whatever the texts' lengths; a slice has at least one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, keys: list[str], text: str, fn: Callable[[list[bytes]], list[pa.Array]],
              schema: str, key_types: list[str]) -> DataFrame:
    """Runs ``fn`` over slices of the text column. ``fn`` gets UTF-8 texts and returns one Arrow array per column of
    ``schema`` (DDL); ``keys`` are carried along unchanged. Only ``keys`` and ``text`` reach Python."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, len(keys)):
            out = fn(texts(part.column(len(keys))))
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keys))], *out], names=[*keys, *names])

    typed = ", ".join([f"{k} {t}" for k, t in zip(keys, key_types, strict=True)] + [schema])
    picked = df.select(*[F.col(k).cast(t).alias(k) for k, t in zip(keys, key_types, strict=True)],
                       F.col(text).cast("string").alias("__text"))
    return picked.mapInArrow(run, typed)
