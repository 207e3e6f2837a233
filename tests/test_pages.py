import pytest
from pyspark.sql import functions as F

from talkgrain.operators.chunking import chunked, chunks, pack, scored, tokens, unit_type
from talkgrain.sources import html as h

U = "https://example.com/help/"


def texts(page):
    return [(b["kind"], b["text"]) for b in h.semantic_blocks(page, U)["blocks"]]


def test_semantic_blocks():
    page = """<html><head><title> T </title></head><body><nav><p>menu</p></nav><main><h1>Head <b>one</b></h1><p>First <a href="x">link</a> text</p>
    <ul><li>Item <p>inner</p></li></ul><blockquote>quoted words</blockquote><script>var p = "<p>";</script>
    <p><a href="/a">A page</a> <a href="/b">B page</a></p><pre>x = 1</pre><p>First [link](https://example.com/help/x) text</p></main></body></html>"""
    assert texts(page) == [
        ("heading", "Head one"), ("paragraph", "First [link](https://example.com/help/x) text"), ("list_item", "Item inner"),
        ("blockquote", "quoted words"), ("list_item", "[A page](https://example.com/a)"), ("list_item", "[B page](https://example.com/b)"), ("code", "x = 1"),
    ]
    assert h.semantic_blocks(page, U)["title"] == "T"


def test_leaf_divisions_and_containment():
    page = "<body><div><div>Some prose that only stands in a division of the page.</div></div></body>"
    assert texts(page) == [("paragraph", "Some prose that only stands in a division of the page.")]
    blocks = [{"kind": "paragraph", "text": t} for t in ("a sentence of some words", "it has a sentence of some words inside", "short", "short")]
    assert [b["text"] for b in h.once(blocks)] == ["it has a sentence of some words inside", "short"]
    assert h.semantic_blocks(None, None)["blocks"] == [] == h.semantic_blocks("", U)["blocks"]


def test_table_rows():
    page = "<main><table><tr><th>Model</th><th>Battery</th></tr><tr><td>Alpha</td><td>Eight hours</td></tr><tr><td>Beta</td></tr></table></main>"
    (b,) = h.semantic_blocks(page, U)["blocks"]
    assert h.table_records(b["text"]) == ["Model: Alpha; Battery: Eight hours", "Model: Beta"]
    assert h.table_records("no table") == []
    got = chunks("Specs", [b], 200, 20, 5)
    assert [c["content"] for c in got] == ["Model: Alpha; Battery: Eight hours", "Model: Beta"]


def test_records_and_merge():
    page = """<main><script type="application/ld+json">{"@graph": [{"@type": "FAQPage", "mainEntity": [{"name": "Is it fast?", "acceptedAnswer": {"text": "Yes, it is quite fast indeed."}},
    {"name": "Is it safe?", "acceptedAnswer": {"text": "It is as safe as anything."}}]}, {"@type": ["HowTo"], "name": "Start", "step": [{"text": "Plug in"}, "Wait"]}]}</script>
    <script type="application/ld+json">broken {</script><details><summary>Where?</summary>In the box you got.</details>
    <button aria-controls="z">When?</button><div id="z">At any time of the day.</div><p>Yes, it is quite fast indeed. It is as safe as anything.</p></main>"""
    r = h.record_blocks(page)
    assert [(b["text"]) for b in r] == ["Is it fast?", "Yes, it is quite fast indeed.", "Is it safe?", "It is as safe as anything.", "Start", "- Plug in\n- Wait", "Where?", "In the box you got.", "When?", "At any time of the day."]
    merged = h.merge(h.semantic_blocks(page, U)["blocks"], r)
    assert "Yes, it is quite fast indeed. It is as safe as anything." not in [b["text"] for b in merged]
    assert h.merge([1, 2], []) == [1, 2]


def test_markdown(spark):
    md = "# One\ntext a\n  text b\r\n\n- item\n* next - one\n## Two\n1. first\n```\ncode, never closed\n\n####### seven\n-none"
    df = spark.createDataFrame([(1, md), (2, None), (3, " \n\t\n")], "i int, t string").orderBy("i")
    got = [[tuple(b) for b in r.b] for r in df.select(h.markdown_blocks(F.col("t")).alias("b")).collect()]
    assert got[0] == [
        ("heading", "One", 1), ("paragraph", "text a\ntext b", None), ("list_item", "item", None), ("list_item", "next - one", None), ("heading", "Two", 2),
        ("paragraph", "1. first\n```\ncode, never closed", None), ("paragraph", "####### seven\n-none", None),
    ]
    assert got[1:] == [[], []]


def test_links(spark):
    page = '<a href="/a#x">1</a><a href="b?q=1">2</a><a href="https://other.com/">3</a><a href="mailto:x">4</a><a href="/blog/[slug]">5</a><a href="/x.png">6</a><a>7</a>'
    assert h.links(page, U) == ["https://example.com/a", "https://example.com/help/b?q=1"]
    df = spark.createDataFrame([("u", ["v", "w"]), ("v", ["x", "u"]), ("w", ["x"]), ("x", ["y"])], "url string, links array<string>")
    got = [(r.url, r.depth) for r in h.crawl(df, spark.createDataFrame([("u",)], "url string"), 2, 10).collect()]
    assert got == [("u", 0), ("v", 1), ("w", 1), ("x", 2)]


def test_sitemap(spark):
    x = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://e.com/a </loc></url><url><loc>https://e.com/b</loc></url></urlset>'
    r = spark.createDataFrame([(x,)], "x string").select(h.sitemap_urls(F.col("x")).alias("u"), h.sitemap_is_index(F.col("x")).alias("i")).first()
    assert r.u == ["https://e.com/a", "https://e.com/b"] and not r.i


def test_pack():
    units = [(f"w{i} " * 10, i) for i in range(6)]
    got = pack([(t.strip(), i) for t, i in units], 32, 10)
    assert [(a, b) for _, a, b in got] == [(0, 2), (2, 4), (4, 5)]
    assert tokens("don't stop, re-use") == 4
    assert pack([], 32, 10) == []


def test_chunks_of_pages(spark):
    page = "<main><h1>How to start</h1><p>" + "First plug in the device and wait. " * 5 + "</p><h2>Fees</h2><p>" + "word " * 300 + "</p></main>"
    df = spark.createDataFrame([(1, U, page), (2, None, None)], "page_id long, url string, html string")
    docs = h.page_documents(df)
    got = chunked(docs).orderBy("page_id", "chunk").collect()
    assert got[0].heading_path == "How to start" and got[0].unit_type == "definition"
    assert got[1].heading_path == "How to start > Fees" and {r.page_id for r in got} == {1} and all(r.tokens <= 440 for r in got)  # a chunk may open with one whole unit of the last
    q = scored(docs).orderBy("page_id").collect()
    assert q[0].quality > 0.9 and q[1].quality < 0.9
    assert [(b.page_id, b.ord) for b in h.blocks_of(docs).orderBy("ord").collect()] == [(1, i) for i in range(4)]
    assert h.page_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize(("title", "text", "kind"), [("x", "payment declined", "troubleshooting"), ("How to pay", "", "procedure"), ("x", "the fee", "policy"), ("Why?", "", "faq"), ("x", "battery life", "product_spec"), ("x", "coffee", "definition")])
def test_unit_type(spark, title, text, kind):
    assert spark.createDataFrame([(title, text)], "a string, b string").select(unit_type(F.col("a"), F.col("b"))).first()[0] == kind


def test_to_markdown(spark):
    b = [("heading", "H", 3, "{}"), ("list_item", "i", None, "{}"), ("paragraph", " ", None, "{}"), ("code", "c", None, "{}")]
    df = spark.createDataFrame([(b,)], "b array<struct<kind:string,text:string,level:int,meta:string>>")
    assert df.select(h.to_markdown(F.col("b"))).first()[0] == "### H\n\n- i\n\n```\nc\n```"
