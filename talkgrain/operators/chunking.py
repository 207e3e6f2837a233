"""Documents to retrieval chunks: heading paths, greedy packing under a token budget with overlap, quality scores, unit types."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from talkgrain.functions import text as tx
from talkgrain.sources.html import plain, slices, table_records

_TOKEN = re.compile(r"\w+(?:[-']\w+)*|[^\w\s]")
CHUNK = T.ArrayType(
    T.StructType([T.StructField("content", T.StringType()), T.StructField("retrieval_text", T.StringType()), T.StructField("heading_path", T.StringType()), T.StructField("tokens", T.IntegerType()), T.StructField("block_start", T.IntegerType()), T.StructField("block_end", T.IntegerType())])
)


def tokens(text: str) -> int:
    return len(_TOKEN.findall(text or ""))


def _clean(text: str) -> str:
    """Line by line, so that records keep their borders."""
    return "\n".join(x for x in (plain(line) for line in text.splitlines()) if x)


def pack(units: list[tuple[str, int]], most: int, overlap: int) -> list[tuple[str, int, int]]:
    """Greedy packing of (text, order) units; each chunk starts with the last units of the one before that fit the overlap, one at least."""
    out, now, size = [], [], 0
    for text, order in units:
        n = tokens(text)
        if now and size + n > most:
            out.append(now)
            tail, size = [], 0
            for u in reversed(now):
                if tail and size + tokens(u[0]) > overlap:
                    break
                tail.insert(0, u)
                size += tokens(u[0])
            now = tail
        now = [*now, (text, order)]
        size += n
    if now:
        out.append(now)
    return [("\n".join(t for t, _ in c), c[0][1], c[-1][1]) for c in out]


def chunks(title: str | None, blocks: list, most: int, overlap: int, least_chars: int) -> list[dict]:
    """The chunks of one document. No chunk crosses a heading; each row of a table is a chunk of its own."""
    most, overlap = max(32, most), max(0, min(overlap, max(32, most) // 3))
    path: dict[int, str] = {}
    sections: list[tuple[list[str], list]] = [([], [])]
    for i, b in enumerate(blocks):
        if b["kind"] == "heading":
            level = int(b["level"] if b["level"] is not None and b["level"] == b["level"] else 2)
            path = {k: v for k, v in path.items() if k < level} | {level: plain(b["text"])}
            sections.append(([path[k] for k in sorted(path) if path[k]], []))
            continue
        rows = table_records(b["text"]) if b["kind"] == "table" else []
        head = sections[-1][0]
        if rows:
            sections += [(head, [(r, i)]) for r in rows] + [(head, [])]
            continue
        text = f"- {b['text']}" if b["kind"] == "list_item" else b["text"]
        words = text.split()
        parts = [text] if tokens(text) <= most else [" ".join(words[k : k + most]) for k in range(0, len(words), most)]
        sections[-1][1].extend((p, i) for p in parts)
    out = []
    for head, units in sections:
        for content, start, end in pack(units, most, overlap):
            text = _clean(content)
            if len(text) < least_chars:
                continue
            names = list(dict.fromkeys([x for x in [title, *head] if x]))
            lead = ([f"Title: {title}"] if title else []) + ([f"Heading: {' > '.join(head)}"] if head else [])
            out.append({"content": text, "retrieval_text": "\n".join([*lead, text]), "heading_path": " > ".join(names) or None, "tokens": tokens(text), "block_start": start, "block_end": end})
    return out


def chunked(documents: DataFrame, page_id: str = "page_id", most: int = 220, overlap: int = 40, least_chars: int = 40) -> DataFrame:
    """page_id, chunk, content, retrieval_text, heading_path, tokens, block_start, block_end, unit_type. documents: page_id, title, blocks.

    Packing carries state through a document, so it is a function of the document's own block array; no grouping, no shuffle.
    """

    schema = T.StructType([documents.schema[page_id], T.StructField("title", T.StringType()), T.StructField("_c", CHUNK)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_pylist([{page_id: r[page_id], "title": r["title"], "_c": chunks(r["title"], r["blocks"] or [], most, overlap, least_chars)} for r in part], schema=arrow)

    rows = documents.select(page_id, "title", "blocks").mapInArrow(run, schema)
    rows = rows.select(page_id, "title", F.posexplode("_c").alias("chunk", "c")).select(page_id, "title", "chunk", "c.*")
    return rows.withColumn("unit_type", unit_type(F.coalesce("title", F.lit("")), F.col("content"))).drop("title")


def unit_type(title: Column, content: Column) -> Column:
    """The first rule that fits, in order."""
    t = F.lower(F.concat(title, F.lit(" "), content))
    word = lambda w: t.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({w})($|[^\p{{L}}\p{{N}}_])")
    # The words that tell a type.
    return (
        F.when(word("error|declined|failed|not working|troubleshoot"), "troubleshooting")
        .when(word("step|how to|setup|install|activate|configure"), "procedure")
        .when(word("fee|charge|policy|terms|refund|settlement"), "policy")
        .when(F.trim(title).endswith("?"), "faq")
        .when(word("specification|dimension|weight|battery|connectivity"), "product_spec")
        .otherwise("definition")
    )


def scored(documents: DataFrame) -> DataFrame:
    """Adds quality (0 to 1) and warnings: how much of a page's text, headings and figures its blocks cover, and how few lines repeat."""
    from talkgrain.sources.html import to_markdown

    # What several parts or each heading is held against is bound once: a lambda would work it out anew for each element.
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    part = lambda n, d, empty: F.when(d > 0, n / d).otherwise(empty)
    numbers = F.array_distinct(F.regexp_extract_all(F.array_join("headings", " "), F.lit(r"\b[0-9][\w./:+-]*\b"), F.lit(0)))
    heads = F.filter("blocks", lambda b: b["kind"] == "heading")

    def parts(x: Column) -> Column:
        inside = lambda xs: F.size(F.filter(xs, lambda h: F.contains(x["flat"], F.lower(tx.plain(h)))))
        cover = {
            "text": part(F.size(F.array_intersect(x["source"], x["got"])), F.size(x["source"]), F.lit(1.0)),
            "heading": part(inside(F.col("headings")), F.size("headings"), F.lit(1.0)),
            "numeric": part(inside(x["numbers"]), F.size(x["numbers"]), F.lit(1.0)),
            "structure": F.when(F.size("headings") > 0, F.least(F.lit(1.0), F.size(heads) / F.size("headings"))).otherwise((F.size("blocks") > 0).cast("double")),
            "unique": part(F.size(F.array_distinct(x["lines"])), F.size(x["lines"]), F.lit(0.0)),
        }
        return F.struct(*[v.alias(k) for k, v in cover.items()])

    lines = lambda md: F.filter(F.transform(F.split(md, "\n"), lambda x: F.lower(tx.plain(x))), lambda x: x != "")
    terms = lambda x: F.struct(x["flat"].alias("flat"), x["lines"].alias("lines"), tx.terms(x["flat"]).alias("got"), tx.terms(F.col("visible")).alias("source"), numbers.alias("numbers"))
    texts = lambda md: F.struct(F.lower(tx.plain(md)).alias("flat"), lines(md).alias("lines"))
    documents = documents.withColumn("_cover", bound(to_markdown(F.col("blocks")), lambda md: bound(texts(md), lambda x: bound(terms(x), parts))))
    # Weights and floors.
    c = F.col("_cover")
    quality = 0.35 * c["text"] + 0.30 * c["heading"] + 0.15 * c["numeric"] + 0.10 * c["structure"] + 0.10 * c["unique"]
    floors = {"heading": 0.8, "numeric": 0.9, "text": 0.55, "unique": 0.7}
    warnings = F.array_compact(F.array(*[F.when(c[k] < f, k) for k, f in floors.items()]))
    return documents.withColumn("quality", F.round(F.least(F.lit(1.0), quality), 4)).withColumn("warnings", warnings).drop("_cover")


def best_documents(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Each page's document by the extractor whose result is best: by quality, then headings, then length, then the name. Pages need distinct page_ids."""
    from talkgrain.sources.html import EXTRACTORS, parsed_pages

    rows = scored(parsed_pages(pages, page_id, sorted(EXTRACTORS)))
    length = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.length(b["text"]))
    order = F.struct("quality", F.size("headings").alias("h"), length.alias("n"), "extractor")
    best = rows.groupBy(page_id).agg(F.max_by(F.struct(*[c for c in rows.columns if c != page_id]), order).alias("d"))
    return best.select(page_id, "d.*")
