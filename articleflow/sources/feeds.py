"""Feed documents: landing table, RSS 2.0 / Atom parsing, collection errors.

A landed feed document is one row (feed_name, feed_url, status, reason, body, fetch_error, seq). Parsing is lenient (RSS 0.9x, 1.0, 2.0
and Atom, any case and any namespace prefix; see ``markup``) and loses nothing without an error row:

1. the body becomes canonical: a token stream without comments, CDATA as escaped text (so ``</item>`` inside one is text), tags in lower
   case under fixed prefixes;
2. the entries are cut out as complete ``<item>…</item>`` / ``<entry>…</entry>`` fragments; what is opened and not closed loses only
   itself and is counted in an error row;
3. a state machine folded over a fragment's tokens gives its fields. References are decoded in field values, once; the value
   of an ``xhtml`` element is its markup.

Failed fetches (transport errors, statuses outside 2xx, a missing status), bodies that are no feed, incomplete entries and
files that no configured feed names become collection errors. Feeds are independent rows, so one failing feed never
affects another. ``seq`` is (document, position): a body holds fewer than 2^28 entries, as each takes more than 8 bytes of
at most 2^31.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.context import RunContext
from articleflow.functions.arrays import empty_strings
from articleflow.functions.dates import parse_feed_date
from articleflow.functions.text import longest_text
from articleflow.operators.collect import backfill_filter, drop_empty_content, with_item_id
from articleflow.schemas import FEED_DOCUMENTS
from articleflow.session import compute_once
from articleflow.sources import markup as M

FRAGMENT = r"(?s)<(item|entry)(?:\s[^>]*)?(?<!/)>.*?</\1\s*>"
OPENING = r"<(?:item|entry)(?:[\s/][^>]*)?>"
FEED_ROOT = r"<(rss|feed|rdf:rdf|channel)[\s>]"
FEED_TITLE = r"(?s)^.*?<title[^>]*>(.*?)</title>"
# The fields of an entry, by canonical name.
CONTENTS, SUMMARIES = ["content", "content:encoded"], ["summary", "description"]
PUBLISHED, UPDATED = ["pubdate", "published", "issued", "dcterms:issued"], ["updated", "modified", "dc:date", "dcterms:modified"]
FIELDS = ["title", "link", "guid", "id", "author", "dc:creator", "category", "dc:subject", *CONTENTS, *SUMMARIES, *PUBLISHED, *UPDATED]
SEQ_BITS = 28


def feeds_frame(spark: SparkSession, feeds: list[tuple[str, str]]) -> DataFrame:
    """Feed configuration (name, url) (S1); callers pass their list – there is no built-in default list."""
    return spark.createDataFrame(feeds, "name string, url string")


def senders_frame(spark: SparkSession, senders: list[tuple[str, str]]) -> DataFrame:
    """Newsletter sender configuration (name, email)."""
    return spark.createDataFrame(senders, "name string, email string")


def read_landed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents as a table (S3): a Parquet folder with the ``feed_documents`` schema."""
    return spark.read.schema(FEED_DOCUMENTS).parquet(path)


def read_landed_files(spark: SparkSession, path: str, feeds: DataFrame) -> DataFrame:
    """Landed raw files (one feed body per file) joined to the feed list by file name = feed name (S3, J3). A file that no
    feed names stays, as a document with a fetch error. Files have no order of their own: ``seq`` is a hash of the
    path. The join strategy is left to AQE (the feed list is broadcast when its measured size allows)."""
    files = (spark.read.text(path, wholetext=True)
             .select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"),
                     F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("feed_name")))
    known = F.col("_known").isNotNull()
    return (files.join(feeds.withColumnRenamed("name", "feed_name").withColumn("_known", F.lit(True)), "feed_name", "left")
            .select("feed_name", F.col("url").alias("feed_url"), F.lit(200).alias("status"),
                    F.lit("OK").alias("reason"), "body",
                    F.when(~known, F.concat(F.lit("UnknownFeed: no configured feed is named "), F.col("feed_name")))
                    .alias("fetch_error"),
                    F.xxhash64("file").bitwiseAND(F.lit((1 << 34) - 1)).alias("seq")))


# ------------------------------------------------------------------------------------------ lenient parsing
def _canonical(docs: DataFrame, body: F.Column) -> DataFrame:
    """``docs`` with the canonical body as ``_tidy`` (null where ``body`` is null)."""
    named = compute_once(docs, [M.prefixes(body).alias("_names")])
    return compute_once(named, [M.canonical(body, F.col("_names")).alias("_tidy")]).drop("_names")


def _feed_like(docs: DataFrame) -> F.Column:
    return F.col("fetch_error").isNull() & F.coalesce(F.col("status").between(200, 299), F.lit(False))


def collection_errors(docs: DataFrame, now) -> DataFrame:
    """Error rows of landed documents (S15): transport errors under the name that the fetcher recorded
    (``ConnectTimeout: …``), HTTP statuses outside 2xx or missing, bodies that are no feed, incomplete entries."""
    def error(kind, message) -> F.Column:
        return F.struct(F.coalesce(kind, F.lit("RequestError")).alias("error_type"), message.alias("error_message"))

    named = F.nullif(F.regexp_extract("fetch_error", r"^([A-Za-z_][A-Za-z0-9_.]*): ", 1), F.lit(""))
    transport = error(named, F.when(named.isNotNull(), F.regexp_replace("fetch_error", r"^[A-Za-z_][A-Za-z0-9_.]*: ", ""))
                      .otherwise(F.col("fetch_error")))
    http = error(F.lit("HTTPStatusError"), F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("unknown")),
                                                    F.lit(": "), F.coalesce("reason", F.lit(""))))
    fine = _feed_like(docs)
    tidied = _canonical(docs, F.when(fine, F.coalesce(F.col("body"), F.lit(""))))
    rootless = ~F.col("_tidy").rlike(FEED_ROOT)
    counted = compute_once(tidied, [(F.regexp_count("_tidy", F.lit(OPENING)) - F.regexp_count("_tidy", F.lit(FRAGMENT))).alias("_lost")])
    lost = F.col("_lost")
    picked = counted.select("feed_name", "feed_url", F.when(F.col("fetch_error").isNotNull(), transport).when(~fine, http)
                         .when(rootless, error(F.lit("ParseError"), F.lit("the body is no feed")))
                         .when(lost > 0, error(F.lit("ParseError"), F.concat(lost.cast("string"), F.lit(" incomplete entries"))))
                         .alias("e"))
    return picked.filter(F.col("e").isNotNull()).select(
        F.lit("rss").alias("source_type"), F.coalesce("feed_url", "feed_name").alias("source_id"),
        "e.error_type", "e.error_message", F.lit(now).cast("timestamp").alias("timestamp"))


def feed_entries(docs: DataFrame) -> DataFrame:
    """One row per complete entry of every fetched document, with its position and the feed title."""
    tidy = _canonical(docs.filter(_feed_like(docs)), F.col("body"))
    head = compute_once(tidy, [F.regexp_extract("_tidy", r"(?s)^(.*?)<(?:item|entry)[\s>/]", 1).alias("_head")])
    title = F.regexp_extract(F.when(F.col("_head") != "", F.col("_head")).otherwise(F.col("_tidy")), FEED_TITLE, 1)
    # all that is read from the body comes before the entries are spread to rows, which do not carry the body
    found = compute_once(head, [
        M.trimmed(M.decode_entities(title)).alias("feed_title"),
        F.when(F.col("_tidy").rlike(FEED_ROOT), F.regexp_extract_all(F.col("_tidy"), F.lit(FRAGMENT), F.lit(0))).alias("_fragments")])
    return found.select("feed_name", "feed_url", F.col("seq").alias("doc_seq"), "feed_title", F.posexplode("_fragments").alias("pos", "fragment"))


def _value(field: F.Column) -> F.Column:
    """A field's text: characters, or the markup of an xhtml element without the ``div`` around it."""
    xhtml = M.trimmed(F.regexp_replace(field["text"], r"(?s)\A\s*<div(?:\s[^>]*)?>(.*)</div\s*>\s*\z", "$1"))
    return F.when(F.lower(M.attribute(field["tag"], "type")).isin("xhtml", "application/xhtml+xml"), xhtml).otherwise(
        M.trimmed(M.decode_entities(field["text"])))


def entries_to_items(entries: DataFrame, now) -> DataFrame:
    """Entry fragments → raw item columns."""
    # the fold runs once per fragment, and so does the decoding; filters that follow cannot copy them (compute_once)
    folded = compute_once(entries, [M.fields(F.col("fragment"), FIELDS).alias("_raw"), F.regexp_extract("fragment", r"^<[^>]*>", 0).alias("_open")])
    e = compute_once(folded, [F.transform("_raw", lambda f: F.named_struct(
        F.lit("name"), f["name"], F.lit("tag"), f["tag"], F.lit("text"), f["text"], F.lit("value"), _value(f))).alias("_fields")]).drop("_raw")

    def every(*names: str) -> F.Column:
        return F.filter("_fields", lambda f: f["name"].isin(*names))

    def values(*names: str) -> F.Column:
        return F.filter("_fields", lambda f: f["name"].isin(*names) & f["value"].isNotNull()).getField("value")

    def first(*names: str) -> F.Column:
        return F.coalesce(*[F.try_element_at(values(n), F.lit(1)) for n in names])

    linked = F.filter(every("link"), lambda f: M.attribute(f["tag"], "href").isNotNull())
    alternate = F.filter(linked, lambda f: F.coalesce(F.lower(M.attribute(f["tag"], "rel")), F.lit("alternate")) == "alternate")
    href = F.coalesce(*[F.try_element_at(F.transform(found, lambda f: M.attribute(f["tag"], "href")), F.lit(1))
                        for found in (alternate, linked)])
    permanent = F.filter(every("guid"), lambda f: F.coalesce(F.lower(M.attribute(f["tag"], "ispermalink")), F.lit("true")) == "true")
    named = F.transform(every("author"), lambda f: M.trimmed(M.decode_entities(F.regexp_extract(f["text"], r"(?s)<name[^>]*>(.*?)</name", 1))))
    plain = F.filter(every("author"), lambda f: ~F.contains(f["text"], F.lit("<"))).getField("value")
    people = F.filter(F.concat(named, plain), lambda v: v.isNotNull())
    e = compute_once(e, [
        first("title").alias("_title"),
        F.coalesce(first("link"), href, F.try_element_at(permanent.getField("value"), F.lit(1))).alias("_url"),
        F.concat(values(*CONTENTS), values(*SUMMARIES)).alias("_texts"),
        first(*PUBLISHED).alias("_published"),
        first(*UPDATED).alias("_updated"),
        F.coalesce(F.try_element_at(people, F.lit(1)), first("dc:creator")).alias("_author"),
        F.coalesce(first("id", "guid"), M.attribute(F.col("_open"), "[a-z]+:about")).alias("_entry"),
        F.filter(F.transform(every("category", "dc:subject"), lambda f: F.coalesce(M.attribute(f["tag"], "term"), f["value"])),
                 lambda v: v.isNotNull()).alias("_tags"),
    ])
    published = F.coalesce(parse_feed_date("_published"), parse_feed_date("_updated"), F.lit(now).cast("timestamp"))
    e = compute_once(e, [longest_text("_texts").alias("_content"), published.alias("_when")])
    too_many = F.coalesce(F.col("doc_seq"), F.lit(0)) >= F.lit(1 << (63 - SEQ_BITS))
    seq = F.when(too_many, F.raise_error(F.lit("a document's seq must stay below 2^35")).cast("long")).otherwise(
        F.shiftleft(F.coalesce(F.col("doc_seq"), F.lit(0)).cast("long"), SEQ_BITS) + F.col("pos"))
    return e.select(
        F.lit("rss").alias("source_type"),
        F.col("feed_url").alias("source_id"),
        F.col("_title").alias("title"),
        F.col("_content").alias("content"),
        F.col("_author").alias("author"),
        F.col("_when").alias("published_at"),
        F.col("_url").alias("url"),
        F.struct(
            F.col("feed_name").alias("feed_name"), F.col("feed_title").alias("feed_title"),
            F.col("_entry").alias("entry_id"),
            F.coalesce(F.col("_tags"), empty_strings()).alias("tags"),
            F.lit(None).cast("array<string>").alias("merged_from_sources"),
            F.lit(None).cast("array<string>").alias("merged_from_ids"),
            F.lit(None).cast("array<string>").alias("all_urls"),
            F.lit(None).cast("map<string,struct<feed_name:string,feed_title:string,entry_id:string,tags:array<string>>>")
            .alias("source_metadata"),
        ).alias("raw_metadata"),
        seq.alias("seq"),
    )


def collect_feeds(docs: DataFrame, ctx: RunContext):
    """Landed documents → (raw items inside the window with content, collection errors)."""
    items = with_item_id(entries_to_items(feed_entries(docs), ctx.now))
    return drop_empty_content(backfill_filter(items, ctx)), collection_errors(docs, ctx.now)


# --------------------------------------------------------------------------------- documents → landed feeds
def _cdata(col) -> F.Column:
    return F.concat(F.lit("<![CDATA["), F.regexp_replace(col, r"\]\]>", "]]]]><![CDATA[>"), F.lit("]]>"))


def _esc(col) -> F.Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def rss_documents(documents: DataFrame, chunk: int = 1000) -> DataFrame:
    """Newsletter documents published as RSS 2.0 feed documents, one per (source, id range of ``chunk``), so a
    document never holds more than ``chunk`` entries however many rows a source has."""
    from articleflow.functions.dates import hours_after
    from articleflow.sources.tables import BINDING_BASE

    ts = hours_after(BINDING_BASE, F.col("doc_id"))
    item = F.concat(
        F.lit("<item><title>"), _esc(F.concat(F.lit("Note "), F.col("doc_id").cast("string"))), F.lit("</title><link>"),
        F.lit("https://letters.example/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
        F.lit("</link><guid>doc-"), F.col("doc_id").cast("string"), F.lit("</guid><description>"), _cdata(F.col("text")),
        F.lit("</description><pubDate>"), F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><category>"),
        F.col("lang"), F.lit("</category></item>"))
    g = documents.select("source", (F.col("doc_id") / chunk).cast("long").alias("part"), "doc_id", item.alias("item"))
    docs = g.groupBy("source", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), "")
        .alias("items"), F.min("doc_id").alias("seq"))
    body = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>'), F.col("source"),
                    F.lit("</title>"), F.col("items"), F.lit("</channel></rss>"))
    return docs.select(F.col("source").alias("feed_name"),
                       F.concat(F.lit("https://letters.example/"), F.col("source"), F.lit("/feed")).alias("feed_url"),
                       F.lit(200).alias("status"), F.lit("OK").alias("reason"), body.alias("body"),
                       F.lit(None).cast("string").alias("fetch_error"), F.col("seq").cast("long").alias("seq"))
