import random
import time

from talkgrain.operators import chunking
from talkgrain.sources import html

PROSE = "This is a sentence about the device and how it is set up, with all that one needs to know. " * 3
LINKS = "".join(f'<a href="/l{i}">link number {i} to some other page</a> ' for i in range(30))
PLAIN = f"""<body><div id="top">{LINKS}</div><div id="wrap"><div id="side"><p>{LINKS}</p></div>
<div id="content"><h1>Setup</h1><p>{PROSE}</p><p>Second. {PROSE.replace("device", "printer")}</p><ul><li>Item one of the list</li></ul></div></div><div>Imprint</div></body>"""


def ids(page):
    return html.densest_root(html.tree(page)).attrs.get("id")


def test_densest_element():
    assert ids(PLAIN) == "content"
    assert ids(f'<body><div id="a">{PROSE}</div><nav>{PROSE * 9}</nav></body>') == "a"
    assert ids(f'<table><tr><td id="x">{LINKS}</td><td id="y"><p>{PROSE}</p><p>{PROSE}</p></td></tr></table>') == "y"
    assert html.densest_root(html.tree("")).tag == "" and html.densest_root(html.tree("<p>only</p>")).tag == ""
    assert html.densest_root(html.tree("<div>" * 3000 + PROSE)).tag == "div"


def test_blocks_of_the_densest_element():
    got = html.semantic_blocks(PLAIN, "http://x.y/", html.densest_root)
    assert [b["kind"] for b in got["blocks"]] == ["heading", "paragraph", "paragraph", "list_item"] and "link number" not in got["visible"]
    assert "link number" in html.semantic_blocks(PLAIN, "http://x.y/")["visible"]


def test_best_extractor(spark):
    good = f"<body><article><h1>One</h1><p>{PROSE}</p></article></body>"
    pages = spark.createDataFrame([(1, "http://x.y/", PLAIN), (2, "http://x.y/", good), (3, "u", None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in chunking.best_documents(pages).collect()}
    assert set(got) == {1, 2, 3}
    assert [b.kind for b in got[2].blocks] == ["heading", "paragraph"] and got[3].blocks == []
    each = {e: {r.page_id: r.quality for r in chunking.scored(html.page_documents(pages, extractor=e)).collect()} for e in html.EXTRACTORS}
    assert all(got[i].quality == max(q[i] for q in each.values()) for i in got)


def plain_once(blocks):
    seen, left = set(), []
    for b in blocks:
        k = (b["kind"], html._key(b["text"]))
        if k[1] and k not in seen:
            seen.add(k)
            left.append((k[1], b))
    bodies = [k for k, b in left if b["kind"] != "heading"]
    return [b for k, b in left if b["kind"] == "heading" or not (len(k) >= 15 and any(k != o and k in o for o in bodies))]


def test_containment_against_trying_all():
    r = random.Random(7)
    for _ in range(200):
        blocks = [{"kind": r.choice(["paragraph", "heading", "list_item"]), "text": " ".join(r.choice(["aaa", "bb", "aaaa aaa", "É c"]) for _ in range(r.randint(0, 12)))} for _ in range(r.randint(0, 14))]
        assert html.once(blocks) == plain_once(blocks)
        texts = [b["text"] for b in blocks]
        some = set(texts[:4])
        assert html.contained(some, texts) == [{p for p in some - {""} if p in t} for t in texts]


def test_containment_on_a_page_of_many_blocks():
    blocks = [{"kind": "paragraph", "text": f"block number {i:05} says something of its own, not said elsewhere"} for i in range(10_000)]
    blocks += [{"kind": "list_item", "text": f"number {i:05} says something"} for i in range(0, 10_000, 2)]
    began = time.process_time()
    assert html.once(blocks) == blocks[:10_000]
    assert time.process_time() - began < 10


def test_quality_of_a_page_of_many_headings(spark):
    """As before its texts were bound once a page."""
    pages = spark.createDataFrame([(1, "https://a.example/x", "<body><main>" + "".join(f"<h2>Part {i} of 1{i}</h2><p>Text {i} with [a](https://b.example/{i}) and `code`.</p>" for i in range(40)) + "</main></body>")], "page_id long, url string, html string")
    scored = chunking.scored(html.page_documents(pages))
    assert [(r.quality, r.warnings) for r in scored.collect()] == [(0.9897, [])]
    assert html.plain("!\\[a\\](b) [x_y](http://c) <https://d.e> https://f#g *h* `i` |\x1cj") == "!\\a\\ x y h i j"


def test_a_page_is_parsed_for_all_extractors_in_one_pass(spark):
    pages = spark.createDataFrame([(1, None, "<body><p>x</p></body>"), (2, "u", None)], "page_id long, url string, html string")
    plan = chunking.best_documents(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
