"""Document fingerprints: SpotSigs (Theobald, Siddharth, Paepcke 2008). DataFrame functions only.

A spot signature is an anchor, a common word, followed by the chain of the next content words;
common words between them are skipped. The fingerprint of a text is its set of signatures,
written as a string: the first 8 hexadecimal digits of each one's MD5, sorted, without separators.

near_duplicates() splits the sets by length, so that only sets whose lengths allow the threshold are
compared, indexes only the rarest part of each set, and bounds the likeness before it is computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.llm.common import Scratch, components

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that for it on with as by this be are was at he from or an a "
    "der die und das den von zu mit sich des auf ist im dem nicht ein als "
    "le la de et les en un du une que est pour qui dans par sur au des "
    "el y los del se las con no su al lo"
).split()
CHAIN = 2
DIGITS = 8
START, MARK = "\x02", "\x01"


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits, one space around each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def signatures(text: Column, anchors=tuple(ANCHORS), chain: int = CHAIN) -> Column:
    """The distinct signatures of a text, sorted; null text counts as empty.

    Texts in which no anchor starts a chain, as very short or odd ones, have one signature instead, all
    their words; texts without words, the whole text; the empty text has none.
    """
    text = F.coalesce(text, F.lit(""))
    words = _words(text)
    # A mark before each content word cuts the text into parts, each a content word and the common words after it (the first
    # part has none before them). What follows a part's common words are the words that head the next parts.
    content = rf"(?<= )(?=[^ ])(?!(?:{'|'.join(sorted(set(anchors)))}) )"
    marked = F.concat(F.lit(START), F.regexp_replace(words, content, MARK))

    def chains(parts: Column) -> Column:
        def of(part: Column, i: Column) -> Column:
            last = F.get(parts, i + chain)
            heads = F.concat_ws(" ", *[F.substring_index(F.get(parts, i + k), " ", 1) for k in range(1, chain + 1)])
            spots = F.array_distinct(F.filter(F.split(F.substring(part, F.lit(1) + F.instr(part, " "), F.length(part)), " "), lambda w: w != ""))
            return F.when(last.isNull(), F.array().cast("array<string>")).otherwise(F.transform(spots, lambda w: F.concat(w, F.lit(" "), heads)))

        return F.flatten(F.transform(parts, of))

    # An array of one element, so that the parts are computed once and bound to the lambda's variable.
    plain = F.get(F.transform(F.array(F.split(marked, MARK)), chains), F.lit(0))
    whole = F.trim(F.regexp_replace(words, " +", " "))
    one = F.when(text == "", F.array().cast("array<string>")).when(whole == "", F.array(text)).otherwise(F.array(whole))
    found = F.get(F.transform(F.array(plain), lambda p: F.when(F.size(p) > 0, p).otherwise(one)), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: F.substring(F.md5(s), 1, DIGITS))))


def fingerprint(text: Column) -> Column:
    return F.array_join(signatures(text), "")


def as_set(fp: Column) -> Column:
    """The signatures of a fingerprint, as an array."""
    return F.regexp_extract_all(fp, F.lit(f".{{{DIGITS}}}"), F.lit(0))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature arrays, 0 where their lengths alone rule out the least one asked for.

    Two empty sets are alike (1.0).
    """
    la, lb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    exact = both / (la + lb - both)
    return F.when((la == 0) & (lb == 0), F.lit(1.0)).when(F.least(la, lb) < least * F.greatest(la, lb), F.lit(0.0)).when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(exact)


def with_next(docs: DataFrame, key: str, columns: tuple, buckets: int):
    """Rows dealt into buckets of descending key, and the window in which lead() reads the row that follows; the first row follows the last.

    Bucket bounds are approximate percentiles of the key, which occur in the data, so that the rows at a
    bound start its bucket. These rows are dealt to the bucket before, too, where they only end it. One shuffle
    of the rows, no global sort. Rows that tie on the key are ordered by their columns; a null key comes last.
    """
    rank = F.coalesce(F.col(key), F.lit(-(2**63)))
    bounds = docs.agg(F.percentile_approx(rank, [i / buckets for i in range(buckets, 0, -1)], max(10_000, 20 * buckets)).alias("b"), F.max(rank).alias("top")).first()
    bounds = sorted({*(bounds["b"] or []), bounds["top"] or 0}, reverse=True)
    n = len(bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, n.bit_length())))])
    edges = F.array(*map(F.lit, bounds))
    # Bisection: the number of bounds at or above the key; a key above all of them goes to the first bucket.
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.coalesce(F.try_element_at(edges, F.least(at + s, F.lit(n))), F.lit(0)) >= rank), at + s).otherwise(at))
    first = rank == F.element_at(edges, F.greatest(F.lit(1), place))
    rows = docs.withColumn("_rank", rank).withColumn("_b", F.greatest(F.lit(1), place)).withColumn("_first", first)
    ghost = F.when(F.col("_b") == 1, F.lit(n)).otherwise(F.col("_b") - 1)
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_first"), F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("ghost")), F.struct(ghost.alias("b"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("ghost"))))))
    rows = rows.withColumn("_b", F.col("_to.b")).withColumn("_ghost", F.col("_to.ghost")).drop("_to", "_first")
    return rows, W.partitionBy("_b").orderBy(F.col("_ghost"), F.col("_rank").desc(), *[F.col(c) for c in columns])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs: doc_id, text; other columns are ignored. The edited text has the last third of the code points
    replaced by the first as many of the next document's by descending doc_id. A null text is empty. A single row
    follows itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = min(20_000, 6 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, order = with_next(plain, "doc_id", ("text",), buckets)
    rows = rows.repartition("_b").withColumn("fingerprint", fingerprint(F.col("text")))
    rows = rows.withColumn("_next", F.lead("text").over(order)).withColumn("_next_fp", F.lead("fingerprint").over(order)).filter("not _ghost")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("_next", F.lit(1), third)))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    own = as_set(F.col("fingerprint"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(own, as_set(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(own, as_set(F.col("_next_fp"))).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, scratch: Scratch, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id: the smallest doc_id reachable by pairs whose fingerprints are alike to the threshold or more.

    Equal fingerprints are collapsed first, so copies make no pairs. Length classes grow by 1 / threshold, so
    a set is compared with its own class and the next longer only. Within them sets are joined on the signatures of their prefix, the
    first |s| - ceil(threshold |s|) + 1 in ascending order of document frequency: two sets that reach the threshold share one.
    Texts without words are alike only to equal ones. doc_id must not be null; rows without it are dropped.
    """
    fps = scratch.write(docs.filter("doc_id is not null").select("doc_id", fingerprint(F.col("text")).alias("fp")), "fp")
    reps = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("n", (F.length("fp") / DIGITS).cast("int")), "reps")
    members = fps.join(reps, "fp").select("doc_id", "rep")
    sigs = reps.filter("n > 0").select("rep", "n", F.explode(as_set(F.col("fp"))).alias("s"))
    counted = sigs.join(sigs.groupBy("s").agg(F.count("*").alias("df")), "s")
    rarest = counted.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("df", "s")))
    prefix = rarest.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    prefix = prefix.withColumn("k", kind).select("rep", "n", "s", "k")
    left = prefix.withColumn("j", F.explode(F.array(F.col("k"), F.col("k") + 1)))
    a, b = left.alias("a"), prefix.alias("b")
    near = (F.col("a.s") == F.col("b.s")) & (F.col("a.j") == F.col("b.k"))
    bound = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    pairs = a.join(b, near & bound & (F.col("a.rep") != F.col("b.rep"))).select(
        F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")
    ).distinct()
    sets = reps.select("rep", "fp")
    scored = pairs.join(sets.select(F.col("rep").alias("a"), F.col("fp").alias("fa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("fp").alias("fb")), "b")
    links = scored.filter(likeness(as_set(F.col("fa")), as_set(F.col("fb")), threshold) >= threshold - 1e-12).select("a", "b")
    found = components(links, scratch)
    return members.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
