"""Queries over pages and over text as it is spoken."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.functions import speech
from talkgrain.functions import text as tx
from talkgrain.operators import chunking
from talkgrain.plans.registry import query
from talkgrain.session import table
from talkgrain.sources import html
from talkgrain.streaming import machines, run


@query()
def page_blocks(spark, d):
    """Held against literal pages in the tests: SQL has no HTML parser."""
    return html.blocks_of(html.page_documents(table(spark, d, "pages"))).select("page_id", "ord", "kind", "text")


@query()
def chunk_documents(spark, d):
    """Held against literal documents in the tests: packing carries state."""
    return chunking.chunked(html.page_documents(table(spark, d, "pages"))).select("page_id", "chunk", "heading_path", "content", "tokens", "unit_type")


@query()
def page_quality(spark, d):
    """Its parts are held against literal pages in the tests."""
    return chunking.scored(html.page_documents(table(spark, d, "pages"))).select("page_id", "quality", F.array_join("warnings", ",").alias("warnings"))


@query(
    r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h FROM pages),
u AS (SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || split_part(replace(replace(h, '&quot;', '"'), '&amp;', '&'), '#', 1) AS url FROM l WHERE starts_with(h, '/') AND NOT starts_with(h, '//'))
SELECT page_id, url FROM u WHERE NOT regexp_matches(regexp_replace(url, '^[a-z]+://[^/]*', ''), '(?i)[\[\]{}]|%5[bd]|%7[bd]') AND NOT regexp_matches(url, '(?i)\.(avif|css|gif|ico|jpe?g|js|json|mp3|mp4|pdf|png|svg|webp|woff2?|xml|zip)$')"""
)
def page_links(spark, d):
    """The SQL knows links from a host's root only, the only ones in the test pages; others are held against literal pages in the tests."""
    return table(spark, d, "pages").select("page_id", F.explode(html.links_udf("html", "url")).alias("url"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace('# ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || '- end', '(?m)^[ \t]*((?:#{1,6}|[-*+])[ \t]+[^ \t\n].*)$', chr(10) || '\1' || chr(10), 'g') AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\n[ \t]*\n'), lambda x: trim(regexp_replace(x, '[ \t]*\n[ \t]*', chr(10), 'g'), chr(32) || chr(9) || chr(10))), lambda x: x <> '') AS p FROM t),
b AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS ord FROM p), m AS (SELECT *, regexp_extract(x, '^(#{1,6}|[-*+])[ \t]+[^ \t\n]', 1) AS m FROM b)
SELECT doc_id, ord, CASE WHEN m = '' THEN 'paragraph' WHEN starts_with(m, '#') THEN 'heading' ELSE 'list_item' END AS kind, trim(substr(x, length(m) + 1), chr(32) || chr(9)) AS text, CASE WHEN starts_with(m, '#') THEN length(m) END AS level FROM m"""
)
def markdown_blocks(spark, d):
    text = F.concat(F.lit("# "), F.col("doc_id"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n- end"))
    blocks = table(spark, d, "documents").select("doc_id", F.posexplode(html.markdown_blocks(text)).alias("ord", "b"))
    return blocks.select("doc_id", "ord", "b.*")


_LINE = r"""trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
'^(?:\s*(?:[•◦▪‣]|(?:#{1,6}|[*+-]|[0-9]{1,3}[.)])\s))+', ''), '\[([^\[\]]+)\]\(\s*(?i:https?://|www\.)[^()]*\)', '\1', 'g'),
'(?i)\b(?:https?://|www\.)[^\s<>]+', 'the provided link', 'g'), '^\s*`{3}[\w+-]*|[*~_]{2}|`', '', 'g'), '&', ' and '), '%', ' percent'), '[\t\r\f\v ]+', ' ', 'g'))"""


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '‘’“”' || chr(8203), chr(39) || chr(39) || '""'), '[–—]', ', ', 'g') AS t FROM documents),
j AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: """
    + _LINE
    + r"""), lambda x: x <> ''), '. ') AS t FROM t)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\s+([,.;:!?])', '\1', 'g'), '\.(?:\s*\.)+\s*', '. ', 'g'), '\s+', ' ', 'g')) AS spoken FROM j"""
)
def spoken_text(spark, d):
    """The SQL leaves compatibility characters as they are; the tests hold those against given pairs."""
    return table(spark, d, "documents").select("doc_id", speech.speakable(F.col("text")).alias("spoken"))


@query()
def turn_stages(spark, d):
    """The batch twin of the streamed state machine; the tests hold both against each other."""
    kinds = ["user_started", "user_stopped", "final", "llm", "audio", "text", "interrupted", "finished"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % len(kinds) + 1).cast("int"))
    ms = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), ms.alias("at"), kind.alias("kind"), F.lit("").alias("text"))
    return run.batch(e, machines.TURNS)


def _machine_events(spark, d, kind):
    ms = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), ms.alias("at"), kind.alias("kind"), F.col("event_type").alias("text"))


@query("""SELECT user_id AS key, event_id, coalesce(count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS accepted FROM events""")
def terminal_rejections(spark, d):
    """The batch twin of a streamed machine."""
    return run.batch(_machine_events(spark, d, F.col("event_type")), machines.terminal(("error",)))


@query("""WITH g AS (SELECT user_id, ts, event_id, event_type, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events)
SELECT user_id AS key, event_id, CASE WHEN count(*) FILTER (WHERE event_type <> 'view') OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) >= 3 THEN 'open' ELSE 'closed' END AS circuit FROM g""")
def circuit_states(spark, d):
    """The batch twin of a streamed machine, without time to half open."""
    return run.batch(_machine_events(spark, d, F.when(F.col("event_type") == "view", "ok").otherwise("failed")), machines.breaker(3, 10**9))


@query("""WITH g AS (SELECT user_id, ts, event_id, event_type, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS pos, bool_or(event_type = 'view') OVER w AS a, bool_or(event_type = 'click') OVER w AS b FROM g WHERE grp > 0 WINDOW w AS (PARTITION BY user_id, grp ORDER BY ts, event_id))
SELECT user_id AS key, event_id, grp AS draft, a AND b AS complete FROM s""")
def form_drafts(spark, d):
    """The batch twin of a streamed machine: each start opens a draft anew, here after a cancellation in the same breath."""
    e = _machine_events(spark, d, F.col("event_type"))
    start = F.col("kind") == "signup"
    kinds = F.when(start, F.array(F.lit("cancel"), F.lit("start"))).otherwise(F.array("kind"))
    e = e.select("key", (F.col("id") * 2).alias("id"), "at", F.posexplode(kinds).alias("i", "kind"), "text").withColumn("id", F.col("id") + F.col("i"))
    out = run.batch(e, machines.drafts(("view", "click"))).filter("draft > 0 and status <> 'cancelled'")
    return out.select("key", F.floor(F.col("event_id") / 2).alias("event_id"), "draft", (F.col("status") == "review").alias("complete"))


_B = r"(^|[^\p{L}\p{N}_])"
_E = r"($|[^\p{L}\p{N}_])"


@query(rf"""WITH t AS (SELECT doc_id, trim(split_part(coalesce(text, ''), chr(10), 1)) AS title, lower(split_part(coalesce(text, ''), chr(10), 1) || ' ' || coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '{_B}(error|declined|failed|not working|troubleshoot){_E}') THEN 'troubleshooting'
WHEN regexp_matches(t, '{_B}(step|how to|setup|install|activate|configure){_E}') THEN 'procedure' WHEN regexp_matches(t, '{_B}(fee|charge|policy|terms|refund|settlement){_E}') THEN 'policy'
WHEN ends_with(title, '?') THEN 'faq' WHEN regexp_matches(t, '{_B}(specification|dimension|weight|battery|connectivity){_E}') THEN 'product_spec' ELSE 'definition' END AS unit_type FROM t""")
def unit_type_classify(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", chunking.unit_type(tx.first_line(t), F.coalesce(t, F.lit(""))).alias("unit_type"))


@query(r"""SELECT doc_id, 'chars=' || length(coalesce(text, '')) || ',words=' || len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+')) || ',sha256=' || left(sha256(coalesce(text, '')), 12) AS meta,
array_to_string(list_slice(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), 1, 6), ' ') AS title FROM documents""")
def safe_metadata(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.safe_metadata(t).alias("meta"), tx.title_of(t).alias("title"))


@query()
def page_extractors(spark, d):
    """Which way of finding a page's content is best, and what it gives. Held against literal pages in the tests: SQL has no HTML parser."""
    return chunking.best_documents(table(spark, d, "pages")).select("page_id", "extractor", "quality", F.size("blocks").cast("long").alias("n_blocks"))
