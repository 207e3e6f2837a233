"""N-gram Jaccard join with Bayesian candidate pruning (Satuluri and Parthasarathy 2012), verified exactly.

Documents are sets of hashed five-word shingles. Equal sets are collapsed to one representative with a number of its own. MinHash
values band the representatives; within a band's bucket pairs are compared by more and more MinHash values, and
dropped as soon as the posterior probability of a likeness of the threshold or more, given a uniform prior, falls below the
tolerance. Of a bucket's survivors only a forest is passed on. Its components hold all candidate pairs; within
them every pair that the same pruning leaves is verified on the whole sets, in tiles of bounded size.

With 24 bands of 3 values a pair at a likeness of 0.8 shares no bucket with probability 3e-8, and pruning loses it with
probability of about the tolerance; pairs that share a component are compared whether or not they share a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talkgrain.llm import winnow
from talkgrain.llm.common import Scratch, components, slices
from talkgrain.llm.embedding_dedup import forest
from talkgrain.llm.substring_dedup import _int64, word_hashes

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 3
VALUES = BANDS * ROWS
STEP = 12
TOLERANCE = 1e-7
BUCKET_TILE, SET_TILE = 4096, 256
U64 = np.uint64


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes. A shorter text is one shingle of all its words; a text without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(winnow.gram_hashes(words, min(size, len(words))))


def _family() -> tuple[np.ndarray, np.ndarray]:
    x = winnow.mixed(np.arange(1, 2 * VALUES + 1, dtype=U64))
    return x[:VALUES] | U64(1), x[VALUES:]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES 16-bit MinHash values a set; a set without members has zeros."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    mul, add = _family()
    at = 0
    while at < len(full):
        z, n = at, 0
        while z < len(full) and (z == at or n + len(sets[full[z]]) <= 65536):
            n += len(sets[full[z]])
            z += 1
        part = [sets[i] for i in full[at:z]]
        flat = np.concatenate(part)
        starts = np.cumsum([0, *map(len, part[:-1])])
        low = np.empty((z - at, VALUES), U64)
        for v in range(VALUES):
            low[:, v] = np.minimum.reduceat(flat * mul[v] + add[v], starts)
        out[full[at:z]] = winnow.mixed(low) & U64(0xFFFF)
        at = z
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By the number of values compared, the matches below which a pair is dropped.

    After m matches of n the likeness is Beta(m + 1, n - m + 1), so P(likeness >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs of rows of a and b pruning leaves."""
    left, got = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in least.items():
        got = got + (a[left, n - STEP : n] == b[left, n - STEP : n]).sum(axis=1, dtype=np.int32)
        go = got >= m
        left, got = left[go], got[go]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def _clusters(sig: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """For each row the smallest that chains of surviving pairs reach. Rows found already are compared with those not yet found only."""
    label = np.full(len(sig), -1)
    for start in range(len(sig)):
        if label[start] >= 0:
            continue
        label[start], queue = start, [start]
        while queue:
            rest = np.flatnonzero(label < 0)
            if not len(rest):
                break
            v = queue.pop()
            hit = rest[surviving(np.broadcast_to(sig[v], (len(rest), VALUES)), sig[rest], least)]
            label[hit] = start
            queue.extend(hit.tolist())
    return label


def _sketch(docs: DataFrame, words: int) -> DataFrame:
    def rows(batches):
        for b in slices(batches):
            sets = [shingles(t, words) for t in b.column("text").to_pylist()]
            d = winnow.digests(np.concatenate([*sets, np.zeros(1, U64)]), np.cumsum([0, *map(len, sets)])[:-1], np.array([len(s) for s in sets], np.int64))
            sig = [x.tobytes() for x in minhashes(sets)]
            own = [b.column(c) for c in ("doc_id", "t1", "t2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(d[0]), pa.array(d[1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "t1", "t2", "s1", "s2", "n", "sig"])

    return _texts(docs).mapInArrow(rows, "doc_id long, t1 long, t2 long, s1 long, s2 long, n long, sig binary")


def _hashes() -> list[Column]:
    """Two independent hashes of the text: with doc_id they name a row, whatever repeats or is null."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_hashes(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _bands(reps: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(U64)
            key = (np.arange(BANDS, dtype=U64) << U64(48)) | (sig[:, :, 0] << U64(32)) | (sig[:, :, 1] << U64(16)) | sig[:, :, 2]
            yield pa.RecordBatch.from_arrays([_int64(key.ravel()), _int64(np.repeat(b.column("rep").to_numpy(), BANDS))], names=["bucket", "rep"])

    return reps.filter("n > 0").select("rep", "sig").mapInArrow(rows, "bucket long, rep long")


def _tiles(rows: DataFrame, count: str, tile: int, key: str) -> DataFrame:
    """Repeats each row for all pairs (p, q), p <= q, of its group's tiles that its own tile belongs to."""
    tiles = F.ceil(F.col(count) / tile).cast("int")
    rows = rows.withColumn("_n", tiles).withColumn("_t", F.pmod(F.xxhash64(F.lit(5), key), F.col("_n")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda u: F.struct(F.least(u, F.col("_t")).alias("p"), F.greatest(u, F.col("_t")).alias("q")))
    return rows.withColumn("_pair", F.explode(pair)).select("*", F.col("_pair.p").alias("p"), F.col("_pair.q").alias("q")).drop("_n", "_pair")


def _bucket_edges(rows: DataFrame, least: dict[int, int]) -> DataFrame:
    """Edges (a, b) of a forest of each bucket's surviving pairs. rows: bucket, p, q, rep, sig, sorted by them."""

    def edges(t: pa.Table):
        """Whole groups only."""
        rep = t.column("rep").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        key = np.stack([t.column(c).to_numpy() for c in ("bucket", "p", "q")], axis=1)
        new = np.append(True, (key[1:] != key[:-1]).any(axis=1))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        own = np.flatnonzero(~new)
        ok = surviving(sig[own], sig[first[own]], least)
        a, b = [own[ok]], [first[own[ok]]]
        for f in np.unique(first[own[~ok]]):  # buckets that their first member doesn't hold together
            some = np.flatnonzero(first == f) if len(first) < 64 else np.arange(f, np.searchsorted(first, f, side="right"))
            label = _clusters(sig[some], least)
            a.append(some)
            b.append(some[label])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([rep[a], rep[b]])[:, rep[a] != rep[b]], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            last = t.slice(t.num_rows - 1).to_pylist()[0]
            same = np.ones(t.num_rows, bool)
            for c in ("bucket", "p", "q"):
                same &= t.column(c).to_numpy() == last[c]
            cut = t.num_rows - int(same.sum())
            if cut:
                yield edges(t.slice(0, cut).combine_chunks())
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield edges(held.combine_chunks())

    return rows.select("bucket", "p", "q", "rep", "sig").mapInArrow(run, "a long, b long")


def _common(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|a[i] & b[j]| of each pair."""
    if len(i) < 2000:
        out = np.zeros(len(i), np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            s, t = a[x], b[y]
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            out[k] = np.count_nonzero(t[at] == s)
        return out
    # Many pairs: incidence matrices over the members that occur on both sides, some columns at a time.
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    total = np.zeros((len(a), len(b)), np.float32)
    who_a, who_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    for lo in range(0, len(both), 8192):
        cols = both[lo : lo + 8192]
        sides = []
        for flat, who, n in ((flat_a, who_a, len(a)), (flat_b, who_b, len(b))):
            at = np.searchsorted(cols, flat)
            at[at == len(cols)] = 0
            hit = cols[at] == flat
            m = np.zeros((n, len(cols)), np.float32)
            m[who[hit], at[hit]] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total[i, j].astype(np.int64)


def _verify(threshold: float, least: dict[int, int]):
    def task(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        rep = t.column("rep").to_numpy()
        once = np.append(True, rep[1:] != rep[:-1]) if len(rep) else np.zeros(0, bool)
        t = t.filter(pa.array(once))
        rep, n, copies, tile = (t.column(c).to_numpy() for c in ("rep", "n", "copies", "_t"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        sets = [np.frombuffer(x, U64) for x in t.column("shingles").to_pylist()]
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        a, b = np.flatnonzero(tile == p), np.flatnonzero(tile == q)
        i, j = np.divmod(np.arange(len(a) * len(b)), max(1, len(b)))
        x, y = a[i], b[j]
        ok = (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9) & ((x < y) if p == q else True)
        i, j, x, y = i[ok], j[ok], x[ok], y[ok]
        ok = surviving(sig[x], sig[y], least)
        i, j, x, y = i[ok], j[ok], x[ok], y[ok]
        if len(i):
            both = _common([sets[k] for k in a], [sets[k] for k in b], i, j)
            ok = both * (1 + threshold) >= threshold * (n[x] + n[y]) - 1e-9
            x, y = x[ok], y[ok]
        add = np.zeros(len(rep), np.int64)
        np.add.at(add, x, copies[y])
        np.add.at(add, y, copies[x])
        hit = add > 0
        return pa.table({"rep": rep[hit], "add": add[hit], "root": rep[forest(x, y, len(rep))[hit]]})

    return task


def join(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """doc_id, n_links (other documents whose likeness reaches the threshold, copies included), class_id (smallest doc_id that links reach).

    docs: doc_id, text; other columns are ignored. Equal sets have a likeness of 1, so texts without words (null, empty) are one class.
    Rows without doc_id are dropped; rows that repeat a doc_id count each. An empty table gives an empty result.
    """
    sketch, result = _classes(docs.filter("doc_id is not null"), scratch, threshold, words)
    return sketch.select("doc_id", "s1", "s2").join(result, ["s1", "s2"]).select("doc_id", "n_links", "class_id")


def _classes(docs: DataFrame, scratch: Scratch, threshold: float, words: int) -> tuple[DataFrame, DataFrame]:
    """(sketch, result): a row's doc_id, t1, t2, s1, s2; and s1, s2, n_links, class_id (null if all its rows lack a doc_id), group (the class's number) of each set.

    Representatives are numbered when their table is written, so that neither a repeated nor a missing doc_id merges sets.
    """
    least = least_matches(threshold)
    sketch = scratch.write(_sketch(docs, words), "sketch")
    pick = F.xxhash64("doc_id", "t1")
    sets = sketch.groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.min(pick).alias("pick"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = scratch.write(sets.withColumn("rep", F.monotonically_increasing_id()), "reps")
    bands = _bands(reps)
    full = scratch.write(bands.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1"), "full")
    members = _tiles(bands.join(full, "bucket"), "c", BUCKET_TILE, "rep").drop("_t")
    rows = members.join(reps.select("rep", "sig"), "rep").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "rep")
    comp = scratch.write(components(_bucket_edges(rows, least), scratch), "candidates")
    scratch.drop(full)
    sizes = scratch.write(comp.groupBy("component").agg(F.count("*").alias("m")), "sizes")
    wanted = comp.join(sizes, "component").join(reps.select(F.col("rep").alias("node"), "s1", "s2", "pick", "copies", "n", "sig"), "node")
    whole = scratch.write(_with_sets(docs, wanted.withColumnRenamed("node", "rep"), words), "sets")
    linked = _tiles(whole, "m", SET_TILE, "rep").groupBy("component", "p", "q").applyInArrow(_verify(threshold, least), "rep long, add long, root long")
    linked = scratch.write(linked, "linked")
    scratch.drop(whole)
    classes = scratch.write(components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch), "classes")
    lows = classes.join(reps.select(F.col("rep").alias("node"), "low"), "node").groupBy("component").agg(F.min("low").alias("class_low"))
    classes = classes.join(lows, "component")
    counts = linked.groupBy("rep").agg(F.sum("add").alias("add"))
    result = reps.select("s1", "s2", "rep", "copies", "low").join(counts, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    links, low = F.coalesce("add", F.lit(0)) + F.col("copies") - 1, F.coalesce("class_low", "low")
    return sketch, scratch.write(result.select("s1", "s2", links.alias("n_links"), low.alias("class_id"), F.coalesce("component", "rep").alias("group")), "result")


def _with_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The wanted representatives with their sets, made anew from their texts."""

    def rows(batches):
        seen = set()  # rows that repeat doc_id and text meet in one task, as the join's key is theirs
        for b in slices(batches):
            reps = b.column("rep").to_pylist()
            first = [i for i, r in enumerate(reps) if r not in seen]
            first = list({reps[i]: i for i in reversed(first)}.values())
            b = b.take(pa.array(first, pa.int64()))
            if not b.num_rows:
                continue
            sets = [shingles(t, words) for t in b.column("text").to_pylist()]
            d = winnow.digests(np.concatenate([*sets, np.zeros(1, U64)]), np.cumsum([0, *map(len, sets)])[:-1], np.array([len(s) for s in sets], np.int64))
            mine = (d[0] == b.column("s1").to_numpy()) & (d[1] == b.column("s2").to_numpy())  # other rows may have the same key
            seen.update(b.column("rep").filter(pa.array(mine)).to_pylist())
            cols = [b.column(c) for c in ("rep", "component", "m", "copies", "n", "sig")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([s.tobytes() for s in sets], pa.binary())], names=names).filter(pa.array(mine))

    names = ["rep", "component", "m", "copies", "n", "sig", "shingles"]
    text = _texts(docs).select(F.xxhash64("doc_id", "t1").alias("pick"), "text")
    return text.join(wanted, "pick").mapInArrow(rows, "rep long, component long, m long, copies long, n long, sig binary, shingles binary")


def keep_first(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row of each class, all columns as they are: the first by doc_id (nulls last), text and the other columns.

    Rows without doc_id and rows that repeat one take part as all others do.
    """
    sketch, result = _classes(docs, scratch, threshold, words)
    names, key = docs.columns, ["_id", "t1", "t2"]
    lead = sketch.join(result, ["s1", "s2"]).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    lead = scratch.write(lead.select("group", F.coalesce("doc_id", F.lit(0)).alias("_id"), "t1", "t2", F.col("doc_id").isNull().alias("_none")).distinct(), "lead")
    several = scratch.write(lead.groupBy("group").agg(F.count("*").alias("c")).filter("c > 1").select("group"), "several")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), *_hashes(), F.col("doc_id").isNull().alias("_none"), *[F.col(c).alias(f"c_{c}") for c in names])
    if not several.isEmpty():  # texts that share the class's doc_id: the first stays
        texts = rows.join(lead.join(several, "group", "left_semi"), [*key, "_none"]).groupBy("group").agg(F.min_by(F.struct(*key, "_none"), F.coalesce("c_text", F.lit(""))).alias("x"))
        lead = lead.join(several, "group", "left_anti").unionByName(texts.select("group", "x.*"))
    out = rows.join(scratch.write(lead.select(*key, "_none"), "kept"), [*key, "_none"], "left_semi")
    nth = F.row_number().over(W.partitionBy(*key, "_none").orderBy(*[f"c_{c}" for c in ("text", *names) if c in names]))
    return out.withColumn("_nth", nth).filter("_nth = 1").select(*[F.col(f"c_{c}").alias(c) for c in names])
