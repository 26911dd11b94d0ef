"""Stable content ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.schemas import FALLBACK_ID_CONTENT_CHARS, ID_HEX_CHARS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def item_id(url="url", title="title", content="content") -> Column:
    """First 32 hex chars of sha256 over the url when it is present and non-empty, else over
    ``title-or-empty || first 500 characters of content``. The url is not normalised."""
    url, title, content = _c(url), _c(title), _c(content)
    key = F.when(url.isNotNull() & (url != ""), url).otherwise(
        F.concat(F.coalesce(title, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, FALLBACK_ID_CONTENT_CHARS))
    )
    return F.substring(F.sha2(key, 256), 1, ID_HEX_CHARS)
