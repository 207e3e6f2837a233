"""Queries on kept indexes: documents by their words, embeddings by their centroids. An index is built once a session and state of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrain.functions.text import TERM
from talkgrain.operators import retrieval, text_index, vector_index
from talkgrain.plans.registry import query
from talkgrain.session import kept_table, settled, shared_dir, table


def document_index(spark, d) -> text_index.TextIndex:
    def build(path):
        text_index.TextIndex(spark, path).write(table(spark, d, "documents"), 0, "doc_id", F.col("text"))

    return text_index.TextIndex(spark, kept_table(spark, d, "documents", "words", build))


def embedding_index(spark, d) -> vector_index.Index:
    path = kept_table(spark, d, "embeddings", "vectors", lambda path: vector_index.build(table(spark, d, "embeddings"), "vec_id", path, keep=("label",)))
    return vector_index.load(spark, path)


def _probes(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("probe"))


@query()
def ann_topk(spark, d):
    """Near vectors of every vector whose id 20 divides, from the lists of the index; `ann_recall` holds it against the exact search."""
    out = vector_index.search(embedding_index(spark, d), _probes(spark, d), "q")
    return out.select("q", "vec_id", F.round("similarity", 6).alias("sim"), F.col("dense_pos").cast("long").alias("pos"))


@query("""SELECT count(*) AS n_probes, true AS found_nine_of_ten FROM embeddings WHERE vec_id % 20 = 0""")
def ann_recall(spark, d):
    """Whether the index finds nine of ten of the exact search's rows, over all probes."""
    probes = _probes(spark, d)
    exact = retrieval.dense(probes, table(spark, d, "embeddings"), "q", "vec_id").select("q", "vec_id")
    found = vector_index.search(embedding_index(spark, d), probes, "q").select("q", "vec_id", F.lit(1).alias("hit"))
    out = exact.join(found, ["q", "vec_id"], "left").agg(F.count_distinct("q").alias("n_probes"), (F.count("hit") / F.count("*")).alias("recall"))
    return out.select("n_probes", (F.col("recall") >= 0.9).alias("found_nine_of_ten"))


_CLEAR = r"^[\p{L}\p{N}]"
_POS = rf"""pos AS MATERIALIZED (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TERM}') AS w FROM documents)),
it AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '{TERM}'), lambda t: regexp_matches(t, '{_CLEAR}')) AS w FROM benchmark)"""
_BEST = """SELECT item_id, doc_id, round(rank, 9) AS rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rank, 9) DESC, doc_id) AS pos FROM r) WHERE pos <= 30"""


def _searched(spark, d, asked):
    """Benchmark items' web-style queries, made by asked(words), on the documents' index."""
    w = F.filter(text_index.words(F.col("text")), lambda t: t.rlike(_CLEAR))
    items = table(spark, d, "benchmark").select("item_id", asked(w).alias("asked"))
    out = text_index.search(document_index(spark, d), items, "item_id", F.col("asked"))
    return out.select("item_id", F.col("unit").alias("doc_id"), F.round("rank", 9).alias("rank"), F.col("pos").cast("long").alias("pos"))


@query(rf"""WITH {_POS}, q AS (SELECT item_id, list_sort(list_distinct(w))[1] AS a, list_sort(list_distinct(w))[-1] AS b FROM it WHERE len(list_distinct(w)) > 1),
e AS (SELECT item_id, doc_id, p, true AS isa FROM q JOIN pos ON term = a UNION ALL SELECT item_id, doc_id, p, false FROM q JOIN pos ON term = b),
s AS (SELECT *, max(p) FILTER (isa) OVER w AS la, max(p) FILTER (NOT isa) OVER w AS lb FROM e WINDOW w AS (PARTITION BY item_id, doc_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN la < lb THEN la ELSE lb END AS first FROM s WHERE la IS NOT NULL AND lb IS NOT NULL),
c AS (SELECT *, lag(first) OVER (PARTITION BY item_id, doc_id ORDER BY p) AS before FROM b),
r AS (SELECT item_id, doc_id, sum(0.1 / (p - first)) AS rank FROM c WHERE before IS NULL OR first > before GROUP BY ALL) {_BEST}""")
def cover_density_topk(spark, d):
    """Documents with both of two words, by how near they stand."""
    ends = lambda w: F.array_sort(F.array_distinct(w))
    return _searched(spark, d, lambda w: F.when(F.size(F.array_distinct(w)) > 1, F.format_string('"%s" "%s"', F.get(ends(w), F.lit(0)), F.element_at(ends(w), -1))))


@query(rf"""WITH {_POS}, q AS (SELECT item_id, w[2] AS a, w[3] AS b FROM it WHERE len(w) > 2),
n AS (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM pos),
r AS (SELECT item_id, doc_id, 0.1 * count(*) AS rank FROM q JOIN n ON term = a AND after = b GROUP BY ALL) {_BEST}""")
def phrase_topk(spark, d):
    """Documents with two words side by side, by how often."""
    return _searched(spark, d, lambda w: F.when(F.size(w) > 2, F.concat(F.lit('"'), F.get(w, F.lit(1)), F.lit(" "), F.get(w, F.lit(2)), F.lit('"'))))


@query(rf"""WITH {_POS}, q AS (SELECT item_id, w[1] AS a, w[2] AS b, w[-1] AS c FROM it WHERE len(w) > 2),
r AS (SELECT item_id, doc_id, 0.1 * count(*) AS rank FROM (SELECT DISTINCT item_id, doc_id, p FROM (SELECT item_id, a AS t, c FROM q UNION SELECT item_id, b, c FROM q) x JOIN pos ON term = t
      WHERE NOT EXISTS (SELECT 1 FROM pos o WHERE o.doc_id = pos.doc_id AND o.term = x.c)) GROUP BY ALL) {_BEST}""")
def either_without_topk(spark, d):
    """Documents with either of two words and without a third: `a -c or b -c`, each in quotes, as a word may be `or`."""
    return _searched(spark, d, lambda w: F.when(F.size(w) > 2, F.format_string('"%s" -"%s" or "%s" -"%s"', F.get(w, F.lit(0)), F.element_at(w, -1), F.get(w, F.lit(1)), F.element_at(w, -1))))


@query(rf"""SELECT term, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id,
unnest(regexp_extract_all(lower(CASE WHEN doc_id % 4 = 1 THEN 'changed ' || coalesce(text, '') ELSE coalesce(text, '') END), '{TERM}')) AS term FROM documents WHERE doc_id % 7 <> 3) GROUP BY ALL) GROUP BY term""")
def index_after_deltas(spark, d):
    """Terms of an index that was built of some documents, then given the others and changed texts, then deletions: as if built anew."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = text_index.TextIndex(spark, f"{shared_dir(spark)}/deltas-{spark.sparkContext.applicationId}-{abs(hash(d))}")
    index.write(docs.filter("doc_id % 3 <> 0 or doc_id % 7 = 3"), 0, "doc_id", F.col("text"))
    sink = index.sink("doc_id", F.col("text"), F.col("gone"))
    sink(docs.filter("doc_id % 3 = 0 or doc_id % 4 = 1").select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("changed "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"), F.lit(False).alias("gone")), 0)
    sink(docs.filter("doc_id % 7 = 3").select("doc_id", "text", F.lit(True).alias("gone")), 1)
    return settled(index.postings(places=False).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n")))
