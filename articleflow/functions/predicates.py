"""Predicates and parameter checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.schemas import ARTICLE_TYPES, KEY_POINTS_MAX, KEY_POINTS_MIN, TOPIC_CATEGORIES, TOPICS_MAX, TOPICS_MIN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def given(value) -> bool:
    """An optional filter counts only when it is neither None nor the empty string."""
    return value is not None and value != ""


def all_of(predicates: list[Column | None]) -> Column:
    """AND of the given predicates; TRUE when there is none."""
    preds = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def valid_enrichment(title="title", summary="summary", key_points="key_points", topics="topics",
                     article_type="article_type", relevance_score: str | None = None,
                     strict_vocabulary: bool = False) -> Column:
    """Output contract of an enrichment (F8): strings present, 3..5 key points, 1..3 topics; optionally
    vocabulary membership and a score in [0, 1] (R6). Null-safe: returns FALSE, never NULL."""
    kp, tp = _c(key_points), _c(topics)
    preds = [
        _c(title).isNotNull(), _c(summary).isNotNull(), _c(article_type).isNotNull(),
        kp.isNotNull(), tp.isNotNull(),
        F.size(kp).between(KEY_POINTS_MIN, KEY_POINTS_MAX),
        F.size(tp).between(TOPICS_MIN, TOPICS_MAX),
        ~F.exists(kp, lambda x: x.isNull()), ~F.exists(tp, lambda x: x.isNull()),
    ]
    if strict_vocabulary:
        preds.append(F.forall(tp, lambda x: x.isin(TOPIC_CATEGORIES)))
        preds.append(_c(article_type).isin(ARTICLE_TYPES))
    if relevance_score is not None:
        preds.append(_c(relevance_score).between(0.0, 1.0))
    return F.coalesce(all_of(preds), F.lit(False))


def check_limit(limit: int, upper: int, lower: int = 1) -> int:
    """API bound on a limit parameter (F9); raises before any plan is built."""
    if not isinstance(limit, int) or isinstance(limit, bool) or not lower <= limit <= upper:
        raise ValueError(f"limit must be within {lower}..{upper}, got {limit!r}")
    return limit
