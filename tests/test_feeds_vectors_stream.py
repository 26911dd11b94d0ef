import tempfile

import pytest
from pyspark.sql import functions as F

from articleflow.context import RunContext
from articleflow.operators import vectors as V
from articleflow.schemas import FEED_DOCUMENTS
from articleflow.sources.feeds import collect_feeds
from tests.conftest import ts

def channel(*items, title="Garden &amp; Kitchen"):
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>{title}</title>{"".join(items)}</channel></rss>'


SOUP = ("<item><title>Leek soup</title><link>https://garden.example/soup</link><guid>g-1</guid><category>food</category>"
        "<description>Cut two leeks and boil them.</description><pubDate>Sat, 02 Nov 2024 06:30:00 GMT</pubDate>"
        "<author>cook@garden.example</author></item>")
COMPOST = ("<item><title>Compost</title><link>https://garden.example/compost?a=1&amp;b=2</link>"
           "<description>Leaves first, then soil.</description><pubDate>Fri, 03 Feb 2023 18:00:00 +0100</pubDate></item>")
RSS = channel(SOUP, COMPOST)
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Harbour log</title>
<entry><title>Low tide</title><link rel="self" href="https://h.example/self"/><link href="https://h.example/tide"/>
<id>tag:h.example,2024:9</id><updated>2024-11-05T04:00:00Z</updated><summary>Mud.</summary>
<content type="html"><![CDATA[<p>The boats lie on the mud until noon.</p></entry>]]></content></entry></feed>"""


def landed(spark, rows):
    return spark.createDataFrame(rows, FEED_DOCUMENTS)


def ctx(day):
    return RunContext(run_date=day, backfill_days=0, now=ts(2025, 1, 2))


def test_rss_cutoff_keeps_one(spark):
    items, errors = collect_feeds(landed(spark, [("Garden", "https://f/rss", 200, "OK", RSS, None, 0)]), ctx(ts(2024, 10, 1)))
    rows = items.collect()
    assert [r.title for r in rows] == ["Leek soup"] and errors.count() == 0
    assert rows[0].raw_metadata.feed_title == "Garden & Kitchen" and rows[0].author == "cook@garden.example"
    none, _ = collect_feeds(landed(spark, [("Garden", "https://f/rss", 200, "OK", RSS, None, 0)]), ctx(ts(2025, 1, 1)))
    assert none.count() == 0


def test_http_error_gives_error_row(spark):
    items, errors = collect_feeds(landed(spark, [("Bad", "https://f/410", 410, "Gone", None, None, 0),
                                                 ("Odd", "https://f/odd", None, None, RSS, None, 0)]), ctx(ts(2020, 1, 1)))
    assert items.count() == 0
    assert sorted((x.error_type, x.error_message) for x in errors.collect()) == [
        ("HTTPStatusError", "HTTP 410: Gone"), ("HTTPStatusError", "HTTP unknown: ")]


def test_atom_prefers_full_content(spark):
    items, errors = collect_feeds(landed(spark, [("Harbour", "https://f/atom", 200, "OK", ATOM, None, 0)]), ctx(ts(2024, 10, 1)))
    r = items.collect()[0]
    assert r.content == "<p>The boats lie on the mud until noon.</p></entry>" and errors.count() == 0
    assert r.url == "https://h.example/tide" and r.raw_metadata.entry_id == "tag:h.example,2024:9"


def test_one_feed_failing_keeps_other_and_truncated_tail(spark):
    truncated = RSS[: RSS.index("<item><title>Compost") + 40]
    docs = landed(spark, [("Good", "https://f/rss", 200, "OK", truncated, None, 0),
                          ("Down", "https://f/down", 503, "Unavailable", None, None, 1),
                          ("Gone", "https://f/gone", 0, None, None, "ReadTimeout: no answer", 2),
                          ("Page", "https://f/page", 200, "OK", "<html><body>moved</body></html>", None, 3),
                          ("None", "https://f/none", 200, "OK", None, None, 4)])
    items, errors = collect_feeds(docs, ctx(ts(2023, 1, 1)))
    assert [r.title for r in items.collect()] == ["Leek soup"]
    assert sorted((r.source_id, r.error_type, r.error_message) for r in errors.collect()) == [
        ("https://f/down", "HTTPStatusError", "HTTP 503: Unavailable"), ("https://f/gone", "ReadTimeout", "no answer"),
        ("https://f/none", "ParseError", "the body is no feed"), ("https://f/page", "ParseError", "the body is no feed"),
        ("https://f/rss", "ParseError", "1 incomplete entries")]


def test_messy_entries_are_all_there(spark):
    link = "<link>https://garden.example/{}</link>"
    body = channel(
        "<item><title>Th&eacute;&nbsp;vert</title>" + link.format("a?x=1&y=2") + "<description>One &hellip; two</description></item>",
        "<item><title>Salt & pepper</title>" + link.format("b") + "<description><![CDATA[a </item> <b>b</b> & c]]></description></item>",
        "<item><title>Broken</title>" + link.format("c") + "<description>first<br>second &lt;3 &#8211; &#x41;</description>"
        "<category>k1</category><category>k &amp; 2</category></item>",
        "<item><title>No end tag" + link.format("d") + "<description>still here</description></item>",
        title="<![CDATA[Salt & Sugar]]>")
    items, errors = collect_feeds(landed(spark, [("M", "https://f/m", 200, "OK", body, None, 7)]), ctx(ts(2020, 1, 1)))
    rows = items.orderBy("seq").collect()
    assert [(r.title, r.content) for r in rows] == [
        ("Thé\u00a0vert", "One … two"), ("Salt & pepper", "a </item> <b>b</b> & c"),
        ("Broken", "first<br>second <3 – A"), ("No end tag", "still here")]
    assert [r.url[-9:] for r in rows] == ["a?x=1&y=2", "example/b", "example/c", "example/d"]
    assert {r.raw_metadata.feed_title for r in rows} == {"Salt & Sugar"} and rows[2].raw_metadata.tags == ["k1", "k & 2"]
    assert errors.count() == 0 and len({r.seq for r in rows}) == 4


def test_case_prefixes_comments_and_references(spark):
    """Upper case, a prefixed feed, a commented-out item, every HTML reference, quoted brackets in attributes."""
    upper = ("<RSS><CHANNEL><TITLE>Up</TITLE><!-- <ITEM><TITLE>no</TITLE></ITEM> --><ITEM><TITLE a='x>y'>&times; &Eacute; &#128512; &amp;lt; &nope;</TITLE>"
             "<LINK>https://u.example/1</LINK><DESCRIPTION>body &lt;b&gt;bold&lt;/b&gt; &#150; &#0;</DESCRIPTION></ITEM><ITEM/></CHANNEL></RSS>")
    atom = ("<atom:feed xmlns:atom='http://www.w3.org/2005/Atom'><atom:title>At</atom:title><atom:entry><atom:title>E</atom:title>"
            "<atom:source><atom:title>other</atom:title></atom:source><atom:content type='xhtml'><div><p>a &amp; <i>b</i></p><p>c</p></div>"
            "</atom:content><atom:category term='t1'/></atom:entry></atom:feed>")
    rdf = ("<rdf:RDF xmlns='http://purl.org/rss/1.0/' xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:x='http://purl.org/dc/elements/1.1/'>"
           "<channel rdf:about='c'><title>R</title><items><rdf:Seq><rdf:li resource='i'/></rdf:Seq></items></channel>"
           "<item rdf:about='https://r.example/i'><title>I</title><link>https://r.example/i</link><description>d</description>"
           "<x:date>2024-03-05T06:07:08Z</x:date><x:subject>s1</x:subject></item></rdf:RDF>")
    docs = landed(spark, [(n, f"https://f/{n}", 200, "OK", body, None, i) for i, (n, body) in enumerate([("u", upper), ("a", atom), ("r", rdf)])])
    items, errors = collect_feeds(docs, ctx(ts(2024, 1, 1)))
    u, a, r = items.orderBy("seq").collect()
    assert (u.title, u.content) == ("× É 😀 &lt; &nope;", "body <b>bold</b> – &#0;")
    assert (a.title, a.content, a.raw_metadata.tags, a.raw_metadata.feed_title) == ("E", "<p>a &amp; <i>b</i></p><p>c</p>", ["t1"], "At")
    assert (r.title, r.raw_metadata.tags, r.published_at.isoformat()[:19]) == ("I", ["s1"], "2024-03-05T06:07:08")
    assert [(e.source_id, e.error_message) for e in errors.collect()] == [("https://f/u", "1 incomplete entries")]


def test_same_link_in_two_feeds_is_one_item(spark):
    from articleflow.operators.dedup import dedup_exact

    docs = landed(spark, [(n, f"https://f/{n}", 200, "OK", RSS, None, 0) for n in ("one", "two", "three")])
    items, _ = collect_feeds(docs, ctx(ts(2020, 1, 1)))
    got = dedup_exact(items).collect()
    assert len(got) == 2 and all(r.n_merged == 3 for r in got)
    assert all(r.raw_metadata.merged_from_ids == ["https://f/one", "https://f/three", "https://f/two"] for r in got)


def test_empty_channel(spark):
    empty = '<?xml version="1.0"?><rss version="2.0"><channel><title>E</title></channel></rss>'
    items, errors = collect_feeds(landed(spark, [("E", "https://f/e", 200, "OK", empty, None, 0)]), ctx(ts(2024, 1, 1)))
    assert items.count() == 0 and errors.count() == 0


@pytest.fixture(scope="module")
def vecs(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    return emb


@pytest.mark.parametrize("threshold", [0.4, 0.85])
def test_pairs_equal_brute_force(vecs, threshold):
    exact = {(r.id_a, r.id_b) for r in V.similar_pairs_exact(vecs, threshold).collect()}
    got = [(r.id_a, r.id_b) for r in V.similar_pairs(vecs, threshold, pivots=16, block=50).collect()]
    assert len(got) == len(set(got)) and set(got) == exact


def test_hashed_pairs_reach_their_recall(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 32))
    rows = [(f"v{i:04d}", base[i % 150].tolist() if i < 150 else (base[i % 150] + .45 * rng.normal(size=32)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows + [("zz", [0.0] * 32), ("copy", base[0].tolist()), ("null", None)], "vec_id string, embedding array<double>")
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.85, 1))
    name = lambda k: "copy" if k == 0 else rows[k][0]
    exact = {tuple(sorted((name(a), name(b)))) for a, b in zip(i, j)}
    got = [(r.id_a, r.id_b) for r in V.hashed_pairs(df, 0.85).collect()]
    assert len(got) == len(set(got)) and set(got) <= exact and len(got) >= 0.95 * len(exact) and len(exact) > 300
    assert V.hashed_pairs(df.limit(0), 0.85).count() == 0
    for n in (10, 1 << 20, 1 << 30):
        bits, bands = V.hash_plan(n, 0.85, 0.97)
        assert 1 - (1 - V.band_hit_rate(0.85, bits)) ** bands >= 0.97 and bands * (bits + 1) < 3000


def test_copies_give_all_pairs_and_links_a_star(spark):
    near = [0.9, 0.3, 0.0]
    df = spark.createDataFrame([(f"v{i}", [1.0, 0.0, 0.0], 0) for i in range(6)] + [("w", [0.0, 1.0, 0.0], 1), ("x", near, 1),
                                ("z", [0.0, 0.0, 0.0], 1)], "vec_id string, embedding array<float>, label int")
    pairs = {(r.id_a, r.id_b) for r in V.similar_pairs(df, 0.9).collect()}
    assert pairs == {(r.id_a, r.id_b) for r in V.similar_pairs_exact(df, 0.9).collect()} and len(pairs) == 15 + 6
    links = V.similar_links(df, 0.9)
    assert links.count() == 6 and links.columns == ["id_a", "id_b"]
    comp = {r.id: r.component for r in V.connected_components(links, df.select("vec_id")).collect()}
    assert comp["v5"] == comp["x"] == "v0" and comp["w"] == "w" and comp["z"] == "z"
    merged = {r.component: r for r in V.merge_components(V.connected_components(links, df.select("vec_id")), df).collect()}
    assert (merged["v0"].n_members, merged["v0"].last_member, merged["v0"].n_labels) == (7, "x", 2) and merged["w"].n_members == 1


def test_unit_binds_the_length_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r.u for r in df.select(V.unit("v").alias("u")).collect()] == [[0.6, 0.8], None, None]


def test_hashing_embedding_values(spark):
    """Against an own 32-bit murmur hash of the tokens (seed 42), modulo the dimension, scaled to length 1."""
    from collections import Counter

    from articleflow.operators.enrich import embed_hashing

    def murmur(data: bytes, h: int = 42) -> int:
        def mix(k):
            k = k * 0xCC9E2D51 & 0xFFFFFFFF
            return ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF

        whole = len(data) // 4 * 4
        for i in range(0, whole, 4):
            h ^= mix(int.from_bytes(data[i:i + 4], "little"))
            h = (((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64) & 0xFFFFFFFF
        if whole < len(data):
            h ^= mix(int.from_bytes(data[whole:], "little"))
        h ^= len(data)
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    text = "Leek soup leek garden kitchen harbour a bb ccc"
    got = embed_hashing(spark.createDataFrame([(text,)], "t string"), F.col("t"), dim=97).first().embedding
    want = [0.0] * 97
    for w, n in Counter(text.lower().split()).items():
        h = murmur(w.encode())
        want[(h - (1 << 32) if h >> 31 else h) % 97] += n
    size = sum(x * x for x in want) ** 0.5
    assert [round(x, 5) for x in got] == [round(x / size, 5) for x in want]


def test_components_on_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "id_a long, id_b long")
    comp = V.connected_components(edges)
    assert comp.select("component").distinct().collect()[0].component == 0 and comp.count() == 41


def _plain_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_star_contraction_against_union_find(spark):
    import random

    from articleflow.operators.graph import star_components

    rng = random.Random(4)
    chain = list(range(300))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(350)]
    edges += [(2000, 2000 + i) for i in range(200)] + [(3000, 3000), (2600, 2500), (2600, 2500)]
    want = _plain_components(edges)
    df = spark.createDataFrame(edges, "id_a long, id_b long")
    sizes = []
    got = {r.node: r.root for r in star_components(df, sizes=sizes).collect()}
    assert got == {x: r for x, r in want.items() if x != r}
    assert sizes == sorted(sizes, reverse=True) and len(sizes) < 20
    every = {r.id: r.component for r in V.connected_components(df).collect()}
    assert every == want
    names = df.selectExpr("concat('n', id_a) id_a", "concat('n', id_b) id_b")
    assert {r.node for r in star_components(names).collect()} >= {"n2001"}
    assert star_components(df.limit(0)).count() == 0 and V.connected_components(df.limit(0)).count() == 0


def test_links_of_a_dense_group_stay_in_proportion(spark):
    import numpy as np

    from articleflow.operators.graph import star_components

    rng = np.random.default_rng(2)
    shares = []
    for n in (200, 1600):
        centre = rng.normal(size=16)
        rows = [(i, (centre + .01 * rng.normal(size=16)).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        links = V.similar_links(df, 0.85, pivots=4, block=400)
        sizes = []
        assert {r.root for r in star_components(links, sizes=sizes).collect()} == {0}
        shares.append((links.count() / n, sizes[0] / n))
    assert all(later <= 30 for later, _ in shares) and all(first <= 1.0 for _, first in shares)


def test_topk_and_ivf(vecs):
    q = [float(x) for x in vecs.orderBy("vec_id").first().embedding]
    top = V.cosine_topk(vecs, q, 5).collect()
    assert top[0].vec_id == 0 and abs(top[0].similarity - 1) < 1e-9
    cent, assigned = V.ivf_index(vecs, lists=10)
    approx = V.ivf_search(cent, assigned, q, 5, probes=10).collect()
    assert [r.vec_id for r in approx] == [r.vec_id for r in top]  # probing every list is exact


def test_streaming_dedup_across_batches(spark):
    from articleflow.streaming.ingest import dedup_within_window, run_available

    d = tempfile.mkdtemp()
    schema = "item_id string, published_at timestamp"
    spark.createDataFrame([("a", ts(2024, 1, 10)), ("b", ts(2024, 1, 10))], schema).write.parquet(d + "/in/1")
    spark.createDataFrame([("a", ts(2024, 1, 11)), ("c", ts(2024, 1, 11)), ("old", ts(2023, 1, 1))], schema) \
        .write.parquet(d + "/in/2")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d + "/in/*")
    out = run_available(dedup_within_window(s, 7), "test-dedup")
    ids = sorted(r.item_id for r in spark.read.parquet(out).collect())
    assert ids.count("a") == 1 and "c" in ids and "b" in ids
    _ = F


def test_sender_list_with_counts(spark):
    from articleflow.operators.collect import feed_coverage
    from articleflow.sources.feeds import senders_frame

    senders = senders_frame(spark, [("Weekly", "w@x.example"), ("Daily", "d@x.example")])
    items = spark.createDataFrame([("w@x.example",), ("w@x.example",), ("other",)], "source_id string")
    got = {r.name: r["items"] for r in feed_coverage(senders, items, feed_key="email").collect()}
    assert got == {"Weekly": 2, "Daily": 0}


def test_topk_many_in_blocks_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(150, 6))
    v[40:90] = v[40]  # a third are copies
    rows = [(i, [float(x) for x in v[i]]) for i in range(150)] + [(900, None), (901, [0.0] * 6), (902, [None] + [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("block", F.lit(1))
    asked = df.filter("vec_id % 20 = 0 OR vec_id IS NULL")
    got = {}
    for r in V.topk_many(df, asked, 5, block_rows=13, query_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.einsum("ij,kj->ik", u, u)
    want = {q: sorted((i for i in range(150) if i != q), key=lambda i, q=q: (-scores[q, i], i))[:5] for q in range(0, 150, 20)}
    assert got == want
    assert V.topk_many(df, asked.limit(0), 5).count() == 0 and V.topk_many(df.limit(0), asked, 5).count() == 0
    assert V.topk_many(df.filter("vec_id < 3"), asked.filter("vec_id = 0"), 5).count() == 2


def test_list_index_recall(vecs):
    cent, assigned = V.ivf_index(vecs, lists=10)
    hits = total = 0
    for r in vecs.filter("vec_id % 60 = 0").collect():
        q = [float(x) for x in r.embedding]
        want = {x.vec_id for x in V.cosine_topk(vecs, q, 10).collect()}
        hits += len(want & {x.vec_id for x in V.ivf_search(cent, assigned, q, 10, probes=7).collect()})
        total += len(want)
    assert hits >= 0.8 * total


def test_landed_files_joined_to_feed_list(spark):
    import os

    from articleflow.operators.collect import feed_coverage, feeds_without_items
    from articleflow.sources.feeds import feeds_frame, read_landed_files

    d = tempfile.mkdtemp()
    for name, body in (("feedA", RSS), ("feedB", ATOM), ("stray", RSS)):
        with open(os.path.join(d, f"{name}.xml"), "w") as f:
            f.write(body)
    feeds = feeds_frame(spark, [("feedA", "https://a/rss"), ("feedB", "https://b/atom"), ("feedC", "https://c/rss")])
    landed_docs = read_landed_files(spark, d, feeds)
    assert sorted(str(r.feed_url) for r in landed_docs.collect()) == ["None", "https://a/rss", "https://b/atom"]
    assert landed_docs.select("seq").distinct().count() == 3
    items, errors = collect_feeds(landed_docs, ctx(ts(2023, 1, 1)))
    assert items.count() == 3  # the stray file is no item but an error
    assert [(e.source_id, e.error_type) for e in errors.collect()] == [("stray", "UnknownFeed")]
    cov = {r.url: r["items"] for r in feed_coverage(feeds, items, feed_key="url").collect()}
    assert cov == {"https://a/rss": 2, "https://b/atom": 1, "https://c/rss": 0}
    assert [r.name for r in feeds_without_items(feeds, items, feed_key="url").collect()] == ["feedC"]


@pytest.mark.parametrize("links", [False, True])
def test_a_dense_pair_of_blocks_stays_in_bounded_memory(links):
    import tracemalloc

    import numpy as np
    import pandas as pd

    u = np.random.default_rng(3).normal(size=(1500, 64)) * 0.05 + 1  # every pair is similar
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    left, right = pd.DataFrame({"id": np.arange(1500), "u": list(u)}), pd.DataFrame({"other": np.arange(1500), "w": list(u)})
    tracemalloc.start()
    found = V._compare_blocks(left, right, 0.9, links)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == (2 * 1499 if links else 1500 * 1499 // 2)  # the forest links every row of either block but id 0 to it
    assert links or np.allclose(found["similarity"], (u[found["id_a"]] * u[found["id_b"]]).sum(axis=1))
    assert peak < 200 << 20  # multiplying all pairs out at once takes 3 GB


def test_cells_leave_python_as_one_row_per_vector():
    import numpy as np
    import pandas as pd

    u = np.eye(4)[np.arange(3000) % 4]
    got = pd.concat(V._near_cells([pd.DataFrame({"id": np.arange(3000), "u": list(u)}), pd.DataFrame({"id": [], "u": []})], np.eye(4), 2.0))
    assert got["id"].tolist() == list(range(3000)) and (got["own"] == np.arange(3000) % 4).all()
    assert all(len(x) == 4 for x in got["near"])


def test_markup_values_are_computed_once(spark):
    """The body is searched once for its namespaces and a trimmed text is trimmed once, whatever names them afterwards."""
    from articleflow.sources import markup as M

    df = spark.createDataFrame([("<a:feed xmlns:A='http://www.w3.org/2005/Atom' xmlns:q='urn:x' xmlns:dc='urn:own'>", "  x  "), (None, "  ")], "b string, t string")
    out = df.select(M.prefixes(F.col("b")).alias("p"), M.trimmed(F.col("t")).alias("t"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_replace(t") == 1
    rows = out.collect()
    assert [r.t for r in rows] == ["x", None] and rows[1].p is None
    assert (rows[0].p["a"], rows[0].p["q"], rows[0].p["dc"], rows[0].p["content"]) == ("", "q:", "dc:", "content:")


def test_canonical_names_of_plain_and_odd_tags(spark):
    """Tags that are canonical pass as they are; case, prefixes and letters beyond ASCII still go through the full rule."""
    from articleflow.sources import markup as M

    body = "<item a='B'><TITLE x=Y>T</TITLE><a:Link/><dc:Date >d</dc:Date><É>n</É><x1-y.z/></item>"
    df = spark.createDataFrame([(body,)], "b string")
    got = df.select(M.canonical(F.col("b"), M.prefixes(F.col("b"))).alias("c")).first().c
    assert got == "<item a='B'><title x=Y>T</title><a:link/><dc:date >d</dc:date>&lt;É>n&lt;/É><x1-y.z/></item>"


def test_hashing_search_sends_no_buckets_through_the_driver(spark):
    import numpy as np

    v = np.random.default_rng(11).normal(size=(300, 16))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    plan = V.hashed_pairs(df, 0.85)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "band" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)  # the table before it is exploded is small enough to be broadcast


def _clustered(n: int, dim: int = 8, seed: int = 12):
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = np.eye(dim)[rng.integers(0, dim, n)] * np.where(rng.random(n) < .5, 1, -1)[:, None]
    return centres + .1 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("threshold", [0.4, 0.95])
def test_every_pair_of_blocks_is_compared_once(spark, threshold):
    import numpy as np

    v = _clustered(400)
    rows = [(f"n{i:03d}", [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [rows[7], ("nan", [float("nan")] * 8), ("copy", rows[9][1]), ("zero", [0.0] * 8), ("none", None)]  # a row that comes twice, too
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = [(a, b) for a in range(400) for b in range(a + 1, 400) if (u[a] * u[b]).sum() >= threshold]
    want = []
    for a, b in near:
        # the row that comes twice is its vector's smallest row twice over, so its pairs come as often as it meets itself: 4 times
        want += [(f"n{a:03d}", f"n{b:03d}")] * (4 if 7 in (a, b) else 1)
        if 9 in (a, b):
            want += [tuple(sorted(("copy", f"n{(b if a == 9 else a):03d}")))] * (4 if 7 in (a, b) else 1)
    got = [(r.id_a, r.id_b) for r in V.similar_pairs(df, threshold, pivots=8, block=40).collect()]
    assert sorted(got) == sorted([*want, ("copy", "n009")])
    links = [(r.id_a, r.id_b) for r in V.similar_links(df, threshold, pivots=8, block=40).collect()]
    assert _plain_components(links) == _plain_components([*want, ("copy", "n009")])


def test_the_pair_search_shuffles_each_vector_once(spark):
    reps = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(_clustered(100, 4))], "id long, u array<double>")
    found = V._rep_pairs(reps, 0.4, 4, 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in found and "Exchange" not in found and "Generate" not in found  # the blocks themselves are stored


def test_blocks_apart_are_not_compared(spark):
    import numpy as np

    pivots = np.eye(4)
    u = np.repeat(pivots, 5, axis=0)
    reps = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(u)], "id long, u array<double>")
    counts = V._rep_pairs(reps, 0.9, 4, 5, "count").collect()
    assert sum(r.n for r in counts) == 4 * 10
    assert V._rep_pairs(reps.limit(0), 0.9, 4, 5, "links").count() == 0 and V.pair_search_stats(
        reps.limit(0).withColumnsRenamed({"id": "vec_id", "u": "embedding"})).first().asDict() == {
            "vectors": 0, "candidate_pairs": 0, "verified_pairs": 0, "largest_bucket": 0}


def test_a_task_gives_one_forest_for_all_its_blocks():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(13)
    u = rng.normal(size=(600, 8)) * .02 + 1
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    far = V._distances(u, u[:2])
    sides = []
    for k in range(6):
        at = slice(100 * k, 100 * k + 100)
        sides.append([pa.array([k]), pa.array([list(range(at.start, at.stop))]), pa.array([u[at].tobytes()], pa.binary()),
                      pa.array([list(far[at].min(axis=0))]), pa.array([list(far[at].max(axis=0))])])
    batches = [pa.RecordBatch.from_arrays(sides[a] + sides[b], [str(c) for c in range(10)]) for a in range(6) for b in range(a, 6)]
    links = pa.Table.from_batches(V._links_of_blocks(batches, u[:2], 0.9)).to_pylist()
    assert len(links) == 599 and {r["id_a"] for r in links} == {0}  # a forest per pair of blocks has 21 times 99 or 199 links
    pairs = pa.Table.from_batches(V._pairs_of_blocks(batches, u[:2], 0.9, False))
    assert len(pairs) == 600 * 599 // 2
