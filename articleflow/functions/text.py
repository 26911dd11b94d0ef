"""Text expressions: content choice, truncation, prompts, html stripping, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.schemas import PROMPT_CONTENT_CHARS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def longest_text(candidates) -> Column:
    """Longest non-empty string of an array column; the first wins ties; '' when none.

    ``candidates`` is an ARRAY<STRING> column in priority order (content values, then summary, then description)."""
    arr = F.filter(_c(candidates), lambda x: x.isNotNull() & (F.length(x) > 0))
    return F.aggregate(arr, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))


def truncate_content(content="content", n: int = PROMPT_CONTENT_CHARS) -> Column:
    """First ``n`` characters (code points) of the content (P5)."""
    return F.substring(_c(content), 1, n)


# Wording and layout are our own; the slots are fixed: title (or "No title"), content (first 8000 chars), source type and
# id, ISO publication time.
DEFAULT_PROMPT_TEMPLATE = (
    "[{published_at}] {source_type}/{source_id} sent: {title}\n"
    "----\n{content}\n----\n"
    "Answer with a headline, two sentences, three to five takeaways, up to three topics and a kind."
)


def prompt_text(template: str = DEFAULT_PROMPT_TEMPLATE, title="title", content="content",
                source_type="source_type", source_id="source_id", published_iso=None) -> Column:
    """Prompt column from a template with the five named slots."""
    from articleflow.functions.dates import iso_format

    values = {
        "title": F.coalesce(F.nullif(_c(title), F.lit("")), F.lit("No title")),
        "content": truncate_content(content),
        "source_type": F.coalesce(_c(source_type), F.lit("")),
        "source_id": F.coalesce(_c(source_id), F.lit("")),
        "published_at": F.coalesce(_c(published_iso) if published_iso is not None else iso_format("published_at"),
                                   F.lit("")),
    }
    import re

    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(title|content|source_type|source_id|published_at)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def embedding_text(title="title", summary="summary") -> Column:
    """Text that is embedded: title, blank line, summary."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit("\n\n"), F.coalesce(_c(summary), F.lit("")))


# Html to text. The three patterns are plain RE2/Java-compatible regexes so the oracle can use the same ones.
HTML_DROP_BLOCKS = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
HTML_TAG = r"<[^>]*>"
SPACES = r"[ \t\r\n]+"
HTML_TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def strip_html(html) -> Column:
    """Visible text of an html document: scripts/styles dropped, tags replaced by a space, runs of white space
    collapsed, trimmed. Entities are left as they are."""
    no_blocks = F.regexp_replace(_c(html), HTML_DROP_BLOCKS, " ")
    no_tags = F.regexp_replace(no_blocks, HTML_TAG, " ")
    return F.trim(F.regexp_replace(no_tags, SPACES, " "))


def html_title(html) -> Column:
    """Text of the first ``<title>`` element, white space collapsed; null when absent or empty."""
    t = F.trim(F.regexp_replace(F.regexp_extract(_c(html), HTML_TITLE, 1), SPACES, " "))
    return F.nullif(t, F.lit(""))


SENTENCE = r"[^.!?\n]+[.!?]*"


def sentences(text) -> Column:
    """Sentences of the whole text: runs up to terminal punctuation or a line end, trimmed, empty ones dropped."""
    parts = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(SENTENCE), 0)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)
