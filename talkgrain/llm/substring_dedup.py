"""Substring dedup by seed and extend, on words.

Seeds are winnowed anchors, hashes of short word grams. Documents are joined on them; around each seed the match is
extended both ways to the whole run of windows that share it, and where two runs with one seed differ, to
each single window. What is covered by a window that an earlier document has as well goes; adjacent
windows make up the maximal repeats.

Only counts and minima of digests are gathered by seed, never the documents that share one, so a passage in a third of
all documents costs no more than other text. Rows are (gram, digest) pairs of 64-bit hashes, 128 bits together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm import winnow
from talkgrain.llm.common import Scratch, slices

WINDOW = 13
GRAM = 4
LAST = 2**63 - 1


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def keyed(docs: DataFrame) -> DataFrame:
    """k orders the documents, a null doc_id last; k and th tell rows that repeat a doc_id apart. Null texts are empty."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.hash("text").alias("th"), text.alias("text"))


def _int64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def run_rows(docs: DataFrame, symbols, least: int, k: int) -> DataFrame:
    """gram, d, k, th, s, w, o: for each run of the documents its anchor's gram, its extent's digest and its place."""

    def rows(batches):
        for b in slices(batches):
            ids, th = b.column("k").to_numpy(), b.column("th").to_numpy()
            texts = [symbols(t) for t in b.column("text").to_pylist()]
            for d, s, w, o, g, joined, at in winnow.all_runs(texts, least, k):
                digest = winnow.digests64(joined, at, w + least - 1)
                yield pa.RecordBatch.from_arrays(
                    [_int64(g), _int64(digest), _int64(ids[d]), pa.array(th[d]), pa.array(s.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(o.astype(np.int32))],
                    names=["gram", "d", "k", "th", "s", "w", "o"],
                )

    return docs.mapInArrow(rows, "gram long, d long, k long, th int, s int, w int, o int")


def with_spans(docs: DataFrame, spans: DataFrame, keep: tuple = (), kinds: tuple = ("spans",)) -> DataFrame:
    """The rows of docs, keyed, with `spans`, an array of (a, b), null where there are none; with an array for each of several kinds (`of`)."""
    cols = [F.col(c).alias(f"_keep_{c}") for c in keep]
    rows = docs.select(*cols, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.hash("text").alias("th"), F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    pair = F.struct("a", "b")
    grouped = spans.groupBy("k", "th").agg(*(F.collect_list(F.when(F.col("of") == c, pair) if len(kinds) > 1 else pair).alias(c) for c in kinds))
    return rows.join(grouped, ["k", "th"], "left")


def repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """k, th, a, b: word ranges [a, b) of documents that an earlier document (smaller doc_id) holds, too.

    Each is a union of windows of at least `window` words; ranges of a document may overlap.
    """
    d = keyed(docs)
    rows = run_rows(d, word_hashes, window, gram)
    seen = scratch.write(rows.groupBy("gram", "d").agg(F.min("k").alias("lo"), F.max("k").alias("hi")), "runs")
    shared = scratch.write(seen.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram", F.lit(True).alias("multi")), "seeds")
    known = seen.join(shared, "gram", "left").filter("lo < hi or multi").select("gram", "d", "lo", F.coalesce("multi", F.lit(False)).alias("multi"))
    known = scratch.write(known, "known")
    scratch.drop(seen, shared)
    found = scratch.write(rows.drop("o").join(known, ["gram", "d"]).filter("k > lo or multi").select("k", "th", "s", "w", (F.col("k") > F.col("lo")).alias("gone")), "found")
    scratch.drop(known)
    whole = found.filter("gone").select("k", "th", F.col("s").alias("a"), (F.col("s") + F.col("w") + window - 1).alias("b"))
    # Runs that are the first of their kind, but not the only ones with their seed: extend by single windows.
    open_ = found.filter("not gone").groupBy("k", "th").agg(F.collect_list(F.struct("s", "w")).alias("runs"))
    single = scratch.write(_windows(d.join(open_, ["k", "th"]), window), "windows")
    scratch.drop()  # the shuffled texts
    first = scratch.write(single.groupBy("d", "e").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("d", "e", "lo"), "first")
    late = single.join(first, ["d", "e"]).filter("k > lo").select("k", "th", F.col("s").alias("a"), (F.col("s") + window).alias("b"))
    late = scratch.write(late, "late")
    scratch.drop(single, first)
    return whole.unionByName(late)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    def rows(batches):
        for b in slices(batches):
            ids, th = b.column("k").to_pylist(), b.column("th").to_pylist()
            for k, h, t, runs in zip(ids, th, b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = word_hashes(t)
                s = np.unique(np.concatenate([np.arange(r["s"], r["s"] + r["w"]) for r in runs]))
                d, e = winnow.digests(words, s, np.full(len(s), window))
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(e), pa.array(np.full(len(s), k)), pa.array(np.full(len(s), h, np.int32)), pa.array(s.astype(np.int32))], names=["d", "e", "k", "th", "s"])

    return docs.mapInArrow(winnow.gathered(rows), "d long, e long, k long, th int, s int")


def dedup(docs: DataFrame, scratch: Scratch, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept (the remaining words joined by a space).

    docs: doc_id, text; other columns are ignored. Null and empty texts have no words. Rows that repeat a doc_id are one
    document in order, none before the other. Null doc_ids come last and don't precede each other. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches):
        for b in slices(batches):
            out = [[], [], [], []]
            for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = t.split()
                keep = np.ones(len(words), bool)
                for x in spans or ():
                    keep[x["a"] : x["b"]] = False
                kept = b" ".join(w for w, y in zip(words, keep.tolist(), strict=True) if y) if spans else b" ".join(words)
                for c, v in zip(out, (len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")), strict=True):
                    c.append(v)
            cols = [b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out[3], pa.string())] * texts, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    joined = with_spans(docs, repeats(docs, scratch, window)).select("doc_id", "text", "spans")
    return joined.mapInArrow(rows, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
