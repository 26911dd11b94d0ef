"""Column → Column expressions used by the operators."""

from articleflow.functions.arrays import (  # noqa: F401
    first_key_points, from_json_text, further_sources, label_lookup, original_urls, primary_topic,
    primary_url, source_types, to_json_text,
)
from articleflow.functions.dates import (  # noqa: F401
    age_bucket, duration_ms, duration_seconds, iso_format, parse_feed_date, plain_ts, published_date,
)
from articleflow.functions.ids import item_id  # noqa: F401
from articleflow.functions.predicates import all_of, check_limit, given, valid_enrichment  # noqa: F401
from articleflow.functions.text import (  # noqa: F401
    embedding_text, html_title, longest_text, prompt_text, sentences, strip_html, truncate_content,
)
