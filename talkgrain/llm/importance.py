"""Target-distribution importance resampling (Xie et al. 2023) by an external sort-count.

Texts become packed streams of uint16 buckets, one stream for a block of documents, with the offset at which each document's
buckets end. Each block's stream is sorted and run-length encoded, and the runs are summed a bucket; this gives the counts of documents and
target. A later pass gathers the gains of the kept streams and sums them a document with np.add.reduceat.
Documents are ranked by range-sorting their scores: a row's place is its place in its range plus the rows of the ranges before.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.llm.common import Scratch, slices

#: A word, once A-Z are lower-cased: a run of digits, a-z and anything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 10_000
#: Bytes of text in a block. A longer text is a block of its own.
BLOCK = 2_000_000


def buckets_of(text: bytes, runs: int, buckets: int) -> tuple[list[int], int]:
    """The buckets of all runs of 1 to `runs` words of a text, and its number of words."""
    words = WORD.findall(text.lower())
    out = [crc32(w) % buckets for w in words]
    for n in range(2, runs + 1):
        out += [crc32(b" ".join(words[i : i + n])) % buckets for i in range(len(words) - n + 1)]
    return out, len(words)


def streams(texts: DataFrame, key: str, runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """A row for each block of texts(key, text): their keys, numbers of words, and ends in the block's stream of buckets."""
    if not 0 < buckets <= 65_536:
        raise ValueError("a bucket must fit into 16 bits")

    def run(batches):
        for b in slices(batches, chars=BLOCK):
            each = [buckets_of((t or "").encode("utf-8", "surrogatepass"), runs, buckets) for t in b.column("text").to_pylist()]
            stream = np.fromiter((x for found, _ in each for x in found), "<u2", sum(len(found) for found, _ in each))
            n = pa.array([b.num_rows])
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), values if kind is None else pa.array(values, kind))
            ends = np.cumsum([len(found) for found, _ in each], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [one(b.column("key"), None), one([w for _, w in each], pa.int64()), one(ends, pa.int64()), pa.array([stream.tobytes()], pa.binary()), n],
                names=["keys", "words", "ends", "stream", "n"],
            )

    kind = dict(texts.dtypes)[key]
    return texts.select(F.col(key).alias("key"), "text").mapInArrow(run, f"keys array<{kind}>, words array<long>, ends array<long>, stream binary, n long")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a stream, ascending, and how often each occurs."""
    s = np.sort(stream, kind="stable")  # a radix sort for 16 bits
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[starts], np.diff(np.append(starts, len(s)))


def counted(blocks: DataFrame) -> DataFrame:
    """(bucket, n): how often each bucket occurs in all streams."""

    def run(batches):
        for b in batches:
            for stream in b.column("stream"):
                bucket, n = run_lengths(np.frombuffer(stream.as_buffer(), "<u2"))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    return blocks.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from two tables (bucket, n): thousandths of the log ratio of the smoothed shares, rounded down."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    all_s, all_t = both.agg(F.sum(s), F.sum(t)).first()
    ratio = (t + 1.0) * (all_s + float(buckets)) / ((s + 1.0) * (all_t + float(buckets)))
    return both.select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("long").alias("gain"))


def weighed(blocks: DataFrame, gain: np.ndarray, key: str, kind: str) -> DataFrame:
    """key, n_features, n_words, weight of each document in the blocks: the sum of its buckets' gains."""

    def run(batches):
        for b in batches:
            for keys, words, ends, stream in zip(*(b.column(c) for c in ("keys", "words", "ends", "stream")), strict=True):
                end = ends.values.to_numpy()
                start = np.concatenate([[0], end[:-1]])
                some = end > start  # reduceat takes an element for an empty range
                weight = np.zeros(len(end), np.int64)
                if some.any():
                    weight[some] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), "<u2")], start[some])
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(end - start), words.values, pa.array(weight)], names=[key, "n_features", "n_words", "weight"])

    return blocks.select("keys", "words", "ends", "stream").mapInArrow(run, f"{key} {kind}, n_features long, n_words long, weight long")


def ranked(scored: DataFrame, order: list, scratch: Scratch) -> DataFrame:
    """scored with rank, 1, 2, 3 and so on in the order given. One range sort; no task and not the driver sees more than a range and the ranges' sizes."""
    at = scratch.write(scored.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = scratch.write(sizes.select("_part", before.alias("_before")), "ranges")
    out = at.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn("rank", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, runs: int = 1, buckets: int = BUCKETS, least: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each row of docs(doc_id, text); rank is null for those not drawn.

    target(text) has the texts to resemble. Other columns of both are ignored, whatever their names. A null text has no words: weight 0. A null doc_id is
    hashed as an empty one and comes last among equal scores. Rows that repeat a doc_id are rows of their own, with the same noise; if
    they tie, too, the greater weight comes first. Without rows or without texts of `least` words nothing is drawn; an empty target gives every bucket the gain of no target words.
    """
    kind = dict(docs.dtypes)["doc_id"]
    blocks = scratch.write(streams(docs, "doc_id", runs, buckets), "streams")
    wanted = scratch.write(streams(target.select("text", F.lit(0).alias("_k")), "_k", runs, buckets), "target")
    raw, wanted = (scratch.write(counted(b), name) for b, name in ((blocks, "counts"), (wanted, "target-counts")))
    table = gains(raw, wanted, buckets).toPandas()  # `buckets` rows
    gain = np.zeros(buckets, np.int64)
    gain[table["bucket"]] = table["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = scratch.write(weighed(blocks, gain, "doc_id", kind).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.filter(F.col("n_words") >= least)
    drawn = percent * able.count() // 100
    rank = ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()], scratch)
    rank = rank.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return rank.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
