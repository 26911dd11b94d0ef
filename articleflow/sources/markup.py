"""A tolerant reader of feed markup in column expressions: token stream, canonical names, character references, fields.

``tokens`` cuts a body into comments, CDATA sections, processing instructions, declarations, tags and text. ``canonical`` maps each token:
comments, instructions and declarations go, CDATA becomes escaped text, a ``<`` that opens no tag becomes text, and tag names
become lower case with the prefix that belongs to their namespace (whatever prefix the document binds to it). After that
an entry can be cut out by name. ``fields`` is a state machine folded over an entry's tokens: it collects the direct children,
takes markup inside a child as the child's text, and ends a child without an end tag at the next field.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = (r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<\?.*?(?:\?>|\z)|<![^>]*+>"
         r"|</?[A-Za-z_](?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>|</?[A-Za-z_][^<>]*+>|[^<]++|<")
NAME = r"^</?([^\s/>]+)"
PLAIN = r"^</?[a-z0-9_.-]+[\s/>]"  # a tag whose name is canonical as it is
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# The namespaces that feeds use and the prefix that names get here (empty: none), and usual prefixes of documents
# that do not declare them.
NAMESPACES = {
    "http://www.w3.org/2005/atom": "", "http://purl.org/atom/ns#": "", "http://purl.org/rss/1.0/": "",
    "http://my.netscape.com/rdf/simple/0.9/": "", "http://channel.netscape.com/rdf/simple/0.9/": "",
    "http://backend.userland.com/rss2": "", "http://blogs.law.harvard.edu/tech/rss": "", "http://www.w3.org/1999/xhtml": "",
    "http://purl.org/rss/1.0/modules/content/": "content:", "http://purl.org/dc/elements/1.1/": "dc:",
    "http://purl.org/dc/terms/": "dcterms:", "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf:",
}
UNDECLARED = {"atom": "", "rss": "", "xhtml": "", "content": "content:", "dc": "dc:", "dcterms": "dcterms:", "rdf": "rdf:"}


def _map(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _struct(**columns: Column) -> Column:
    """A struct whose field names also hold inside lambda functions."""
    return F.named_struct(*[x for name, value in columns.items() for x in (F.lit(name), value)])


def _bound(value: Column, function) -> Column:
    """``function`` of a value that is computed once, however often the function names it (lambdas share no common expressions)."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _references() -> dict[str, str]:
    """Every named reference of HTML, and the numeric ones that stand for another character there (code page 1252)."""
    named = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    moved = {f"#{n}": bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    return named | {k: v for k, v in moved.items() if v}


def decode_entities(text: Column) -> Column:
    """Character references as characters, once: what a reference yields is not read as another one. Unknown references stay.
    The different references of a text are found first; those that yield an ampersand are replaced last."""
    known = _map(_references())

    def character(ref: Column) -> Column:
        number = F.when(ref.rlike("^#[xX]"), F.substring(ref, F.lit(3), F.length(ref))).when(
            ref.startswith("#"), F.conv(F.substring(ref, F.lit(2), F.length(ref)), 10, 16))
        code = F.conv(number, 16, 10).cast("long")
        plain = F.when(ref.rlike("^#[xX]"), F.concat(F.lit("#"), code.cast("string"))).otherwise(ref)
        fine = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(F.try_element_at(known, plain), F.when(fine, F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")))

    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))),
                        lambda r: _struct(ref=r, char=character(r)))
    # an unknown reference compares as null and drops out of both lists
    ordered = _bound(found, lambda all_: F.concat(F.filter(all_, lambda x: x["char"] != "&"), F.filter(all_, lambda x: x["char"] == "&")))
    replaced = F.aggregate(ordered, text, lambda acc, x: F.replace(acc, F.concat(F.lit("&"), x["ref"], F.lit(";")), x["char"]))
    return F.when(F.contains(text, F.lit("&")), replaced).otherwise(text)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def tokens(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))


def prefixes(body: Column) -> Column:
    """The prefixes that the document binds to known namespaces, as a map to the prefixes used here (the last binding of one counts)."""
    bound = F.transform(F.regexp_extract_all(body, F.lit(r"xmlns:[A-Za-z_][^\s=<>]*\s*=\s*(?:\"[^\"<]*\"|'[^'<]*')"), F.lit(0)), lambda d: _struct(
        key=F.lower(F.regexp_extract(d, r"^xmlns:([^\s=]+)", 1)),
        value=F.try_element_at(_map(NAMESPACES), F.lower(F.regexp_extract(d, r"[\"'](.*)[\"']$", 1)))))
    # foreign namespaces keep their prefix
    own = F.transform(bound, lambda x: _struct(key=x["key"], value=F.coalesce(x["value"], F.concat(x["key"], F.lit(":")))))
    # both are bound: the body would be searched again for every key of the map
    last = _bound(own, lambda all_: F.map_from_entries(F.aggregate(all_, F.slice(all_, 1, 0), lambda acc, x: F.array_append(
        F.filter(acc, lambda y: y["key"] != x["key"]), x))))
    return _bound(last, lambda found: F.map_concat(F.map_filter(_map(UNDECLARED), lambda k, _: ~F.map_contains_key(found, k)), found))


def _tag(token: Column, names: Column) -> Column:
    def full(name: Column) -> Column:
        prefix = F.regexp_extract(name, r"^([^:]+):", 1)
        local = F.regexp_replace(name, r"^[^:]+:", "")
        return F.when(F.contains(name, F.lit(":")), F.concat(F.coalesce(F.try_element_at(names, prefix), F.concat(prefix, F.lit(":"))),
                                                             local)).otherwise(name)

    changed = F.concat(F.regexp_extract(token, r"^</?", 0), _bound(F.lower(F.regexp_extract(token, NAME, 1)), full),
                       F.regexp_replace(token, NAME, ""))
    return F.when(token.rlike(PLAIN), token).otherwise(changed)


def canonical(body: Column, names: Column) -> Column:
    """The body with canonical tags, CDATA as escaped text and nothing that is no markup or text. ``names`` is ``prefixes`` of the body."""
    def token(t: Column) -> Column:
        return (F.when(~t.startswith("<"), t)
                .when(t.startswith("<![CDATA["), escaped(F.regexp_replace(F.substring(t, 10, 1 << 30), r"\]\]>\z", "")))
                .when(t.startswith("<!") | t.startswith("<?"), "").when(t == "<", F.lit("&lt;")).otherwise(_tag(t, names)))

    return F.regexp_replace(F.array_join(F.transform(tokens(body), token), ""), CONTROL, "")


def fields(fragment: Column, known: list[str]) -> Column:
    """The direct children of a canonical fragment, in order, as structs (name, tag, text); ``tag`` is the whole opening tag and
    ``text`` the markup between the tags. A child whose end tag is missing ends where one of the ``known`` fields begins."""
    inner = F.regexp_replace(fragment, r"\A<[^>]*>|</[^<>]*>\z", "")
    closed = F.array_distinct(F.regexp_extract_all(inner, F.lit(r"</([^\s/>]+)"), F.lit(1)))
    stream = F.transform(tokens(inner), lambda t: _struct(
        kind=F.when(~t.startswith("<"), "text").when(t.startswith("</"), "end").when(t.endswith("/>"), "empty").otherwise("start"),
        name=F.regexp_extract(t, NAME, 1), raw=t))
    child = "struct<name:string,tag:string,text:string>"
    start = _struct(name=F.lit(None).cast("string"), tag=F.lit(""), open=F.lit(0), text=F.lit(""),
                    out=F.from_json(F.lit("[]"), f"array<{child}>"))

    def one(name: Column, tag: Column, text: Column) -> Column:
        return _struct(name=name, tag=tag, text=text)

    def step(s: Column, t: Column) -> Column:
        idle, kind, same = s["name"].isNull(), t["kind"], t["name"] == s["name"]
        # a field that begins inside a child without an end tag ends that child
        cut = ~idle & kind.isin("start", "empty") & ~same & t["name"].isin(*known) & ~F.array_contains(closed, s["name"])
        opens, single = (kind == "start") & (idle | cut), (kind == "empty") & (idle | cut)
        ends = ~idle & (kind == "end") & same & (s["open"] == 1)
        own = F.array(one(s["name"], s["tag"], s["text"]))
        out = F.when(cut | ends, F.concat(s["out"], own)).otherwise(s["out"])
        return _struct(
            name=F.when(opens, t["name"]).when(ends | single, F.lit(None).cast("string")).otherwise(s["name"]),
            tag=F.when(opens, t["raw"]).otherwise(s["tag"]),
            open=F.when(opens, 1).when(~idle & same & (kind == "start"), s["open"] + 1).when(~idle & same & (kind == "end"), s["open"] - 1)
            .otherwise(s["open"]),
            text=F.when(opens | ends | single | idle, F.lit("")).otherwise(F.concat(s["text"], t["raw"])),
            out=F.when(single, F.concat(out, F.array(one(t["name"], t["raw"], F.lit(""))))).otherwise(out))

    def finish(s: Column) -> Column:
        return F.when(s["name"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(one(s["name"], s["tag"], s["text"]))))

    return F.aggregate(stream, start, step, finish)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value; null when absent or empty."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return _bound(F.trim(decode_entities(F.regexp_replace(found, r"^[\"']|[\"']$", ""))), _filled)


def trimmed(text: Column) -> Column:
    return _bound(F.regexp_replace(text, r"\A\s+|\s+\z", ""), _filled)


def _filled(text: Column) -> Column:
    return F.when(text != "", text)
