"""Date parsing and formatting expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Feed dates arrive as RFC 2822 ("Mon, 23 Dec 2024 10:00:00 GMT") or ISO-8601 strings. Spark's parser rejects
# the weekday letter inside these patterns, so the weekday is removed first. Zone names and numeric offsets are
# both optional; a string without zone is read as UTC (session zone).
RFC822_PATTERNS = [
    "d MMM yyyy HH:mm:ss[ ][xx][z]",
    "d MMM yyyy HH:mm[ ][xx][z]",
    "d MMM yy HH:mm:ss[ ][xx][z]",
    "d MMM yy HH:mm[ ][xx][z]",
]


def parse_feed_date(s) -> Column:
    """Timestamp from one RFC 2822 or ISO-8601 string, null when nothing parses."""
    s = F.trim(_c(s))
    no_weekday = F.regexp_replace(s, r"^[A-Za-z]{3,9},\s*", "")
    parsed = [F.try_to_timestamp(no_weekday, F.lit(p)) for p in RFC822_PATTERNS]
    return F.coalesce(*parsed, F.try_to_timestamp(s))


def published_date(*candidates, now: datetime) -> Column:
    """First usable date of the candidates in order (already parsed timestamps or strings), else ``now``.

    Mirrors the feed rule: published_parsed → updated_parsed → published → updated → now."""
    return F.coalesce(*[_c(c) for c in candidates], F.lit(now).cast("timestamp"))


def iso_format(ts) -> Column:
    """ISO-8601 with the UTC offset; the fraction appears only when the microseconds are non-zero."""
    ts = _c(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(ts.isNull(), F.lit(None)).when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, whole).otherwise(frac)


def plain_ts(ts) -> Column:
    """Timestamp as ``yyyy-MM-dd HH:mm:ss.SSSSSS`` text (a zone-free rendering for comparisons)."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def duration_seconds(start, end) -> Column:
    """Seconds between two instants as DOUBLE; null when either side is null."""
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(1_000_000.0)


def duration_ms(start, end) -> Column:
    """Whole milliseconds between two instants, truncated; null when either side is null."""
    micros = F.unix_micros(_c(end)) - F.unix_micros(_c(start))
    return (micros / 1000).cast("long")


def age_bucket(ts, now: datetime) -> Column:
    """Freshness bucket and count of its unit: minutes under an hour, hours under a day, days under a week,
    else 'older' with whole days (P23)."""
    minutes = F.floor((F.lit(int(now.timestamp() * 1_000_000)) - F.unix_micros(_c(ts))) / F.lit(60_000_000))
    bucket = (F.when(minutes < 60, F.lit("minutes"))
              .when(minutes < 1440, F.lit("hours"))
              .when(minutes < 10080, F.lit("days"))
              .otherwise(F.lit("older")))
    n = (F.when(minutes < 60, minutes)
         .when(minutes < 1440, F.floor(minutes / 60))
         .otherwise(F.floor(minutes / 1440)))
    return F.struct(bucket.alias("bucket"), n.cast("long").alias("n"))


def hours_after(base: datetime, n) -> Column:
    """``base + n hours`` as TIMESTAMP (used for the table bindings)."""
    return F.timestamp_seconds(F.lit(int(base.timestamp())) + _c(n).cast("long") * 3600)
