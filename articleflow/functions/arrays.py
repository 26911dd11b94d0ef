"""Array, map and lookup expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.schemas import UNCATEGORIZED


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def source_types(raw_metadata="raw_metadata", source_type="source_type") -> Column:
    """Merged source list from the metadata, else the item's own source type wrapped in a list."""
    return F.coalesce(_c(raw_metadata).getField("merged_from_sources"), F.array(_c(source_type)))


def original_urls(raw_metadata="raw_metadata", url="url") -> Column:
    """Merged url list from the metadata, else ``[url]`` when the url is non-empty, else ``[]``."""
    url = _c(url)
    own = F.when(url.isNotNull() & (url != ""), F.array(url)).otherwise(empty_strings())
    return F.coalesce(_c(raw_metadata).getField("all_urls"), own)


def primary_topic(topics="topics") -> Column:
    """First topic, or 'Uncategorized' for a missing or empty list."""
    return F.coalesce(F.try_element_at(_c(topics), F.lit(1)), F.lit(UNCATEGORIZED))


def primary_url(urls="urls") -> Column:
    return F.try_element_at(_c(urls), F.lit(1))


def first_key_points(key_points="key_points", n: int = 3) -> Column:
    return F.slice(_c(key_points), 1, n)


def further_sources(urls="urls") -> Column:
    """How many urls beyond the first."""
    return F.greatest(F.size(F.coalesce(_c(urls), empty_strings())) - 1, F.lit(0))


def label_lookup(code, labels: dict[str, str]) -> Column:
    """Code → label with fall-through to the code itself (P25). ``labels`` is a small fixed dictionary."""
    code = _c(code)
    if not labels:
        return code
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, code), code)


def to_json_text(arr) -> Column:
    """ARRAY column → JSON text, as stored in JSON columns of a row store."""
    return F.to_json(_c(arr))


def from_json_text(text, type_ddl: str = "array<string>") -> Column:
    """JSON text → typed column."""
    return F.from_json(_c(text), type_ddl)
