"""Pages as ordered blocks. Parsing has no built-in, so it runs in Python over Arrow batches, one page at a time; all else is columns.

A block is kind, text, level (headings), meta (JSON). Two candidates are made of a page: what its semantic elements say, and the
question-and-answer records of its JSON-LD, details and controlled elements; merge() puts them together.
"""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from talkgrain.session import settled

#: Elements that are blocks, that are dropped, and that have no end tag.
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table", "pre", "blockquote", "dt", "dd"}
DROPPED = {"script", "style", "noscript", "svg", "canvas", "iframe", "template", "form", "button", "input", "select", "textarea", "nav", "footer", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Markdown's marks, to spaces.
MARKS = str.maketrans(dict.fromkeys("*_`#>|", " "))
#: Endings of links that aren't pages.
NOT_PAGES = re.compile(r"\.(?:jpg|jpeg|png|gif|svg|webp|zip|mp4|mp3|css|js)$", re.I)

BLOCK = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("meta", T.StringType())])


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    inner: list = field(default_factory=list)  # nodes and strings
    up: Node | None = None

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.inner) if isinstance(c, Node)]

    def text(self, sep: str = " ") -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo += reversed(n.inner)
        return sep.join(s for s in (x.strip() for x in out) if s)

    def within(self, tags) -> bool:
        n = self.up
        while n:
            if n.tag in tags:
                return True
            n = n.up
        return False


class _Tree(HTMLParser):
    """Lenient: an end tag closes the nearest open element of its name; unknown end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.inner.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.inner.append(Node(tag, {k: v or "" for k, v in attrs}, [], self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.up and n.tag != tag:
            n = n.up
        if n.up:
            self.at = n.up

    def handle_data(self, data):
        self.at.inner.append(data)


def tree(page: str | None) -> Node:
    t = _Tree()
    t.feed(page or "")
    t.close()
    return t.root


def _space(s: str) -> str:
    return " ".join((s or "").split())


def plain(s: str) -> str:
    s = s or ""
    if "](" in s:  # most texts have no link; looking for one is what takes longest
        s = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)
    if "http" in s:
        s = re.sub(r"<https?://[^>]+>|https?://\S+", " ", s)
    return _space(s.translate(MARKS))


def _key(s: str) -> str:
    return plain(s).casefold()


def _inline(node: Node, base: str) -> str:
    out = []
    for c in node.inner:
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "a":
            label, target = _space(c.text()), c.attrs.get("href", "").strip()
            out.append(f"[{label}]({urljoin(base, target)})" if label and target else label)
        elif c.tag not in DROPPED and c.tag not in ("ul", "ol", "table"):
            out.append(_inline(c, base))
    return _space(" ".join(out))


def _table(node: Node, base: str) -> str:
    rows = [[_inline(c, base) for c in r.inner if isinstance(c, Node) and c.tag in ("th", "td")] for r in node.walk() if r.tag == "tr"]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    wide = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * wide) + " |", *lines[1:]])


def table_records(markdown: str) -> list[str]:
    """`header: value; ...` of each row of a Markdown table; empty for what is none."""
    rows = [[_space(c) for c in x.strip().strip("|").split("|")] for x in markdown.splitlines() if x.strip().startswith("|")]
    rows = [r for r in rows if not all(re.fullmatch(":?-{3,}:?", c) for c in r)]
    if len(rows) < 2:
        return []
    texts = ["; ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=False) if h and v) for r in rows[1:]]
    return [t for t in texts if t]


def contained(patterns: set[str], texts: list[str]) -> list[set[str]]:
    """The patterns that each text contains, itself included: one automaton of all patterns reads each text once, however many patterns there are."""
    machine = ahocorasick.Automaton()
    for p in patterns - {""}:
        machine.add_word(p, p)
    if not len(machine):
        return [set() for _ in texts]
    machine.make_automaton()
    return [{p for _, p in machine.iter(t)} for t in texts]


def once(blocks: list[dict]) -> list[dict]:
    """Without repeats, and without blocks (headings apart) of 15 characters or more that another block contains."""
    seen, left = set(), []
    for b in blocks:
        k = (b["kind"], _key(b["text"]))
        if k[1] and k not in seen:
            seen.add(k)
            left.append((k[1], b))
    bodies = [k for k, b in left if b["kind"] != "heading"]
    inside = {k for o, found in zip(bodies, contained({k for k in bodies if len(k) >= 15}, bodies), strict=True) for k in found if k != o}
    return [b for k, b in left if b["kind"] == "heading" or k not in inside]


def main_root(top: Node) -> Node:
    """The longest main or article element, else the body."""
    roots = [n for n in top.walk() if n.tag in ("main", "article") or n.attrs.get("role") == "main"]
    return max(roots, key=lambda n: len(n.text()), default=None) or next((n for n in top.walk() if n.tag == "body"), top)


#: Elements that may hold a page's content, and those whose text never is.
HOLDERS = {"body", "div", "section", "article", "main", "td", "center"}


def densest_root(top: Node) -> Node:
    """The element whose children hold the densest text: characters outside of links for each element, less for a large share of links.

    One pass from the leaves up; a holder's score is the sum of its own text and its children's densities, so that a column of paragraphs wins over any one of them and over the
    page around it, whose other children add little.
    """
    order, dropped = [], set()
    for n in top.walk():
        if n.tag in DROPPED or id(n.up) in dropped:
            dropped.add(id(n))
        else:
            order.append(n)
    chars, linked, tags, score = {}, {}, {}, {}
    for n in reversed(order):  # children before their parents
        own = sum(len(c.strip()) for c in n.inner if isinstance(c, str))
        inner = [c for c in n.inner if isinstance(c, Node) and id(c) not in dropped]
        chars[id(n)] = own + sum(chars[id(c)] for c in inner)
        linked[id(n)] = chars[id(n)] if n.tag == "a" else sum(linked[id(c)] for c in inner)
        tags[id(n)] = 1 + sum(tags[id(c)] for c in inner)
        density = lambda c: (chars[id(c)] - linked[id(c)]) ** 2 / max(1, chars[id(c)]) / tags[id(c)]
        score[id(n)] = own + sum(map(density, inner))
    best = max((n for n in reversed(order) if n.tag in HOLDERS), key=lambda n: score[id(n)], default=None)  # of equals the innermost
    return best or next((n for n in order if n.tag == "body"), top)


def semantic_blocks(page: str | None, url: str | None, choose=main_root) -> dict:
    """title, visible text, headings and blocks of the page's main content: what is in the element that `choose` finds."""
    top, base = tree(page), url or ""
    meta = {n.attrs.get("property") or n.attrs.get("name"): _space(n.attrs.get("content", "")) for n in top.walk() if n.tag == "meta"}
    title = meta.get("og:title") or meta.get("twitter:title") or next((_space(n.text()) for n in top.walk() if n.tag == "title"), None) or None
    root = choose(top)
    for n in root.walk():
        n.inner = [c for c in n.inner if isinstance(c, str) or c.tag not in DROPPED]
    visible = _space(root.text())
    blocks: list[dict] = []

    def add(kind, text, level=None):
        if text.strip():
            blocks.append({"kind": kind, "text": text.strip(), "level": level, "meta": "{}"})

    for n in root.walk():
        if n is root or n.tag not in BLOCKS or n.within({"table"}) or n.tag == "p" and n.within({"li", "blockquote"}):
            continue
        if n.tag in ("blockquote", "dt", "dd") and any(c is not n and c.tag in BLOCKS - {n.tag} for c in n.walk()):
            continue
        if n.tag == "p":
            links = [c for c in n.inner if isinstance(c, Node) and c.tag == "a"]
            if len(links) > 1 and not re.search(r"\w", "".join(c for c in n.inner if isinstance(c, str))):
                for a in links:  # a list without list markup
                    add("list_item", _inline(Node("", {}, [a]), base))
                continue
        if re.fullmatch("h[1-6]", n.tag):
            add("heading", _space(n.text()), int(n.tag[1]))
        elif n.tag == "table":
            add("table", _table(n, base))
        elif n.tag == "pre":
            add("code", n.text("\n"))
        else:
            add({"li": "list_item", "p": "paragraph"}.get(n.tag, n.tag), _inline(n, base))
    got = plain(" ".join(b["text"] for b in blocks))
    if len(got) < max(80, int(len(visible) * 0.45)):  # prose in plain divisions
        for n in root.walk():
            if n.tag in ("div", "section") and not any(c.tag in BLOCKS for c in n.walk()):
                text = _inline(n, base)
                if len(plain(text)) >= 30 and plain(text) not in got:
                    add("paragraph", text)
    return {"title": title, "visible": visible, "headings": [b["text"] for b in blocks if b["kind"] == "heading"], "blocks": once(blocks)}


def _nodes(value):
    """All objects of a JSON-LD document, graphs opened."""
    for v in value if isinstance(value, list) else [value]:
        if isinstance(v, dict):
            yield v
            if "@graph" in v:
                yield from _nodes(v["@graph"])


def record_blocks(page: str | None) -> list[dict]:
    """Heading and paragraph of each question and answer, or procedure and its steps, that markup states."""
    top, found = tree(page), []
    for n in top.walk():
        if n.tag != "script" or n.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(c for c in n.inner if isinstance(c, str)))
        except ValueError:
            continue
        for x in _nodes(data):
            kinds = x.get("@type") or []
            kinds = {kinds} if isinstance(kinds, str) else set(kinds)
            if "FAQPage" in kinds:
                for e in x.get("mainEntity") or []:
                    answer = e.get("acceptedAnswer") if isinstance(e, dict) else None
                    if isinstance(answer, dict):
                        found.append((str(e.get("name") or ""), str(answer.get("text") or ""), "faq"))
            elif "HowTo" in kinds:
                steps = [_space(str((s.get("text") or s.get("name") or "") if isinstance(s, dict) else s)) for s in x.get("step") or []]
                found.append((str(x.get("name") or ""), "\n".join(f"- {s}" for s in steps if s), "procedure"))
    by_id = {n.attrs["id"]: n for n in top.walk() if n.attrs.get("id")}
    for n in top.walk():
        question = _space(n.text())
        if n.tag == "summary" and n.up and n.up.tag == "details":
            found.append((question, _space(n.up.text()).removeprefix(question), "faq"))
            continue
        target = next((n.attrs[a] for a in ("aria-controls", "data-bs-target", "data-target") if n.attrs.get(a)), "").lstrip("#")
        if target in by_id:
            found.append((question, by_id[target].text(), "faq"))
    out, seen = [], set()
    for q, a, kind in found:
        q, a = _space(q), a.strip() if kind == "procedure" else _space(a)
        k = (_key(q), _key(a))
        if q and a and k[0] != k[1] and k not in seen:
            seen.add(k)
            meta = json.dumps({"structured_type": kind})
            out += [{"kind": "heading", "text": q, "level": 2, "meta": meta}, {"kind": "paragraph", "text": a, "level": None, "meta": meta}]
    return out


def merge(blocks: list[dict], records: list[dict]) -> list[dict]:
    """Records are kept whole; blocks that repeat one answer or contain several give way to them."""
    if not records:
        return blocks
    answers = {k for r in records if r["kind"] != "heading" and len(k := _key(r["text"])) >= 20}
    keys = [_key(b["text"]) for b in blocks]
    covered = [k in answers or len(found) > 1 for k, found in zip(keys, contained(answers, keys), strict=True)]
    return once([*(b for b, c in zip(blocks, covered, strict=True) if b["kind"] == "heading" or not c), *records])


def markdown_blocks(text: Column) -> Column:
    """Column: (kind, text, level) of a Markdown text's headings, list items and paragraphs, in order; none of a null.

    Headings and items are set apart by blank lines first, so that blank lines separate all blocks. A paragraph keeps its line breaks;
    whatever is no heading or item is part of one, fences and tables, too.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)^[ \t]*((?:#{1,6}|[-*+])[ \t]+[^ \t\n].*)$", "\n$1\n")
    bare = lambda x: F.trim(F.regexp_replace(x, r"[ \t]*\n[ \t]*", "\n"), F.lit(" \t\n"))
    parts = F.filter(F.transform(F.split(t, r"\n[ \t]*\n"), bare), lambda x: x != "")

    def block(x: Column) -> Column:
        marks = F.regexp_extract(x, r"^(#{1,6}|[-*+])[ \t]+[^ \t\n]", 1)
        kind = F.when(marks == "", "paragraph").when(marks.startswith("#"), "heading").otherwise("list_item")
        return F.struct(kind.alias("kind"), F.trim(F.substring(x, F.length(marks) + 1, F.length(x)), F.lit(" \t")).alias("text"), F.when(kind == "heading", F.length(marks)).alias("level"))

    return F.transform(parts, block)


def to_markdown(blocks: Column) -> Column:
    """Column: the Markdown of an array of blocks."""
    def one(b):
        return (
            F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(b["level"], F.lit(2))))), F.lit(" "), b["text"]))
            .when(b["kind"] == "list_item", F.concat(F.lit("- "), b["text"]))
            .when(b["kind"] == "code", F.concat(F.lit("```\n"), b["text"], F.lit("\n```")))
            .otherwise(b["text"])
        )

    return F.array_join(F.filter(F.transform(blocks, one), lambda x: F.trim(x) != ""), "\n\n")


#: Rows that are Python objects at once.
SLICE = 64


def slices(batches):
    """Arrow batches as lists of a few rows, so that a task's memory doesn't grow with the rows of a batch: only their columns are held whole."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE).to_pylist()


#: Ways to find a page's content.
EXTRACTORS = {"semantic": main_root, "density": densest_root}


def page_documents(pages: DataFrame, page_id: str = "page_id", extractor: str = "semantic") -> DataFrame:
    """page_id, url, title, visible, headings, blocks. Repeated pages are parsed each; a null page has no blocks."""
    return parsed_pages(pages, page_id, [extractor]).drop("extractor")


def parsed_pages(pages: DataFrame, page_id: str, extractors: list[str]) -> DataFrame:
    """The columns of page_documents and extractor: a row for each page and way of finding its content. What a page's markup states is the same for all."""
    kind = dict(pages.dtypes)[page_id]
    schema = T.StructType([*(T.StructField(n, t) for n, t in ((page_id, T._parse_datatype_string(kind)), ("url", T.StringType()), ("title", T.StringType()), ("visible", T.StringType()), ("headings", T.ArrayType(T.StringType())), ("blocks", T.ArrayType(BLOCK)), ("extractor", T.StringType())))])

    arrow = to_arrow_schema(schema)

    def parse(batches):
        for page in slices(batches):
            rows = []
            for r in page:
                records = record_blocks(r["html"])
                for e in extractors:
                    d = semantic_blocks(r["html"], r["url"], EXTRACTORS[e])
                    d["blocks"] = merge(d["blocks"], records)
                    rows.append({page_id: r[page_id], "url": r["url"], **d, "extractor": e})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select(page_id, "url", "html").mapInArrow(parse, schema)


def blocks_of(documents: DataFrame, page_id: str = "page_id") -> DataFrame:
    return documents.select(page_id, F.posexplode("blocks").alias("ord", "b")).select(page_id, "ord", "b.*")


def links(page: str | None, url: str | None) -> list[str]:
    """Distinct absolute addresses of the page's own host that are pages, sorted; fragments are cut."""
    base, out = url or "", set()
    host = urlsplit(base).hostname
    for n in tree(page).walk():
        target = n.attrs.get("href", "").strip() if n.tag == "a" else ""
        if not target or target.startswith(("mailto:", "tel:", "javascript:")):
            continue
        try:
            full = urljoin(base, target).split("#")[0]
            parts = urlsplit(full)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and parts.hostname == host and not re.search(r"[\[\]{}]|%5[bd]|%7[bd]", parts.path + parts.query, re.I) and not NOT_PAGES.search(parts.path):
            out.add(full)
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def links_udf(page: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([links(p, u) for p, u in zip(page, url, strict=True)])


def crawl(pages: DataFrame, seeds: DataFrame, depth: int, most: int) -> DataFrame:
    """url, depth of the pages that links reach from seeds(url), breadth first; at most `most`, the nearest and then the first by address.

    pages: url, links. Each level is one anti-join against what is known, written to the shared folder; levels are bounded by `depth`.
    """
    known = level = settled(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        found = level.join(pages, "url").select(F.explode("links").alias("url")).distinct()
        level = settled(found.join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        known = known.unionByName(level)
    return known.orderBy("depth", "url").limit(most)


def sitemap_urls(xml: Column) -> Column:
    """Column: the addresses that a sitemap or sitemap index lists, whatever its namespace."""
    return F.transform(F.xpath(xml, F.lit("//*[local-name()='loc']/text()")), lambda u: F.trim(u))


def sitemap_is_index(xml: Column) -> Column:
    return F.xpath_boolean(xml, F.lit("/*[local-name()='sitemapindex']"))


def unescaped(text: str | None) -> str:
    return html.unescape(text or "")
