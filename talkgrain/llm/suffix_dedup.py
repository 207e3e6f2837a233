"""Winnowing with digest refinement: remove every byte that a repeated string of at least `least` bytes covers, and find the
words that repeated strings of at least `words` words cover.

The order of all suffixes is never sorted anew. Each task (a shard of documents) contributes the rows of its own
suffixes that start at a winnowed anchor, keyed by digests of what follows; grouping by digest merges the shards' rows, with
no transform, interleave or common prefixes. A round extends the string that the suffixes of an interval share
(figures for bytes; a string of words goes through the same rounds, a word being one symbol):

  round 0  the gram at the anchor (128 bytes),
  round 1  the extent of a whole run, at least 400 bytes both ways of the anchor,
  round 2  the 385 bytes that 16 windows at equal offsets to the anchor share, then the block of all they cover,
  round 3  single windows of exactly 400 bytes.

After each round an interval is settled as unique (one suffix: dropped), or as repeated (two or more with equal extents
of 400 bytes or more: a repeated interval), or it is refined further, each distinct extent by one suffix that stands for its
copies. So copies cost nothing beyond round 1, and only the edges of passages reach round 3. Documents are winnowed once; the
shards' rows are a table that all parts of round 1 read.

bwt.py holds the byte-level merge of Burrows-Wheeler transforms that these rounds stand for; it refines once a byte,
400 times over all text, which no limit here allows (see README). The rounds extend by content-defined strings instead.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm import winnow
from talkgrain.llm.common import Scratch, slices
from talkgrain.llm.substring_dedup import _int64, keyed, with_spans, word_hashes

#: Bytes of a repeated string, of the gram at its anchor, windows of a block.
LEAST, GRAM, BLOCK = 400, 128, 16
#: The same in words: passages of over 50 words.
WORDS, WORD_GRAM, WORD_BLOCK = 51, 16, 8
#: At most so many extents are known to all tasks, 24 bytes each.
HEAVY = 10_000


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


#: Where a suffix starts: its document's two keys and the byte.
PLACE = np.dtype([("k", "<i8"), ("th", "<i4"), ("s", "<i4")])


def _hashed(places: np.ndarray) -> np.ndarray:
    """63-bit hashes of places; the least of an extent's tells which suffix stands for it."""
    rest = winnow.mixed(places["th"].astype(np.int64).view(np.uint64) << np.uint64(32) | places["s"].astype(np.uint64))
    return (winnow.mixed(places["k"].astype(np.int64).view(np.uint64) ^ rest) >> np.uint64(1)).view(np.int64)


def _shard_rows(docs: DataFrame, symbols, least: int, gram: int) -> DataFrame:
    """A shard's own merge: gram, d, n, place (least hash), w, o and places (packed) of each extent in it.

    So an extent that very many documents share is one row a shard, not one a document.
    """

    def rows(batches):
        for b in slices(batches):
            ids, th = b.column("k").to_numpy(), b.column("th").to_numpy()
            parts = []
            for doc, s, w, o, g, joined, at in winnow.all_runs([symbols(t) for t in b.column("text").to_pylist()], least, gram):
                place = np.empty(len(s), PLACE)
                place["k"], place["th"], place["s"] = ids[doc], th[doc], s
                parts.append((g, winnow.digests64(joined, at, w + least - 1), place, w, o))
            if not parts:
                continue
            g, d, place, w, o = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((d, g))
            g, d, place, w, o = (x[order] for x in (g, d, place, w, o))
            first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])) if len(g) else [])
            n = np.diff(np.append(first, len(g)))
            low = np.minimum.reduceat(_hashed(place), first) if len(first) else np.zeros(0, np.int64)
            cols = [_int64(g[first]), _int64(d[first]), pa.array(n), pa.array(low), pa.array(w[first].astype(np.int32)), pa.array(o[first].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, _packed(place, np.append(first, len(g)))], names=["gram", "d", "n", "place", "w", "o", "places"])

    return docs.mapInArrow(rows, "gram long, d long, n long, place long, w int, o int, places binary")


def _packed(place: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Places as one binary value for each stretch between edges."""
    offsets = edges.astype(np.int32) * PLACE.itemsize
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(place.tobytes())])


def _without_heavy(shards: DataFrame, heavy: dict) -> DataFrame:
    """The shards' rows; those of heavy extents ((gram, d) to place) hold the suffix that stands for them or are left out."""
    if not heavy:
        return shards
    grams = np.unique(np.array([g for g, _ in heavy], np.int64))
    schema = shards.schema

    def rows(batches):
        for b in batches:
            g, d = b.column("gram").to_numpy(), b.column("d").to_numpy()
            stands = {i: heavy[at] for i in np.flatnonzero(np.isin(g, grams)).tolist() if (at := (int(g[i]), int(d[i]))) in heavy}
            if not stands:
                yield b
                continue
            places, keep = b.column("places").to_pylist(), np.ones(b.num_rows, bool)
            for i, low in stands.items():
                place = np.frombuffer(places[i], PLACE)
                place = place[_hashed(place) == low]
                places[i], keep[i] = place.tobytes(), len(place) > 0
            cols = [pa.array(places, pa.binary()) if c == "places" else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep))

    return shards.mapInArrow(rows, schema)


def _heavy_spans(shards: DataFrame, least: int, heavy: dict) -> DataFrame:
    """k, th, a, b: what heavy extents cover, runs next to each other as one range."""
    if not heavy:
        return shards.sparkSession.createDataFrame([], "k long, th int, a int, b int")
    grams = np.unique(np.array([g for g, _ in heavy], np.int64))

    def rows(batches):
        for b in batches:
            g, d = b.column("gram").to_numpy(), b.column("d").to_numpy()
            hit = [i for i in np.flatnonzero(np.isin(g, grams)).tolist() if (int(g[i]), int(d[i])) in heavy]
            if not hit:
                continue
            packed = b.column("places").take(pa.array(hit)).to_pylist()
            place = np.frombuffer(b"".join(packed), PLACE)
            windows = np.repeat(b.column("w").to_numpy()[hit], [len(x) // PLACE.itemsize for x in packed])
            order = np.lexsort((place["s"], place["th"], place["k"]))
            place, end = place[order], place["s"][order].astype(np.int64) + windows[order] + least - 1
            edges = np.flatnonzero(np.concatenate([[True], (place["k"][1:] != place["k"][:-1]) | (place["th"][1:] != place["th"][:-1]), [True]]))
            out = []
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                a, z = winnow.merged(place["s"][x:y].astype(np.int64), end[x:y])
                out.append((np.full(len(a), place["k"][x]), np.full(len(a), place["th"][x]), a.astype(np.int32), z.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["k", "th", "a", "b"])

    return shards.mapInArrow(rows, "k long, th int, a int, b int")


def _first_round(docs: DataFrame, symbols, least: int, gram: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(runs in a repeated interval or in one to be refined: k, th, s, w, o, total, stands; spans of heavy extents).

    An extent is heavy if it holds one in HEAVY of the repeated suffixes, so there are at most HEAVY of them, and tasks know them
    all. What they cover is found where the shards' rows are read, without a join of each of their suffixes.
    """
    shards = scratch.write(_shard_rows(docs, symbols, least, gram), "shards")
    known = _known(shards, ["gram"], scratch, "round1")
    limit = max(100, math.ceil((known.agg(F.sum("total")).first()[0] or 0) / HEAVY))
    heavy = {(r["gram"], r["d"]): r["place"] for r in known.filter(F.col("total") >= limit).select("gram", "d", "place").collect()}
    joined = _without_heavy(shards, heavy).drop("n", "place").join(known, ["gram", "d"])

    def rows(batches):
        for b in slices(batches, "places", 8_000_000):
            place = np.frombuffer(b"".join(b.column("places").to_pylist()), PLACE)
            of = np.repeat(np.arange(b.num_rows), _sizes(b))
            total, multi, low = (b.column(c).to_numpy(zero_copy_only=False)[of] for c in ("total", "multi", "place"))
            stands = multi & ((total == 1) | (_hashed(place) == low))
            cols = [b.column(c).take(pa.array(of)) for c in ("gram", "w", "o")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(place["k"]), pa.array(place["th"]), pa.array(place["s"]), pa.array(total), pa.array(stands)], names=["gram", "w", "o", "k", "th", "s", "total", "stands"])

    out = joined.select("gram", "w", "o", "total", "multi", "place", "places").mapInArrow(rows, "gram long, w int, o int, k long, th int, s int, total long, stands boolean")
    out = scratch.write(out, "round1"), scratch.write(_heavy_spans(shards, least, heavy), "heavy")
    scratch.drop(shards, known)
    return out


def _sizes(b: pa.RecordBatch) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(b.column("places")).to_numpy() // PLACE.itemsize


def _refined(rows: DataFrame, group: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Merges the interleave of rows(group, d, n, k, th, s, w, o), of which n counts the copies that a row stands for.

    Returns those in a repeated interval or in one to be refined, with total (copies of the extent), multi (another
    extent shares the group) and stands (this row stands for its extent in the next round).
    """
    place = F.xxhash64("k", "th", "s")
    known = _known(rows.withColumn("place", place), group, scratch, name)
    out = rows.join(known, [*group, "d"]).withColumn("stands", F.col("multi") & ((F.col("total") == 1) | (F.col("place") == place)))
    return scratch.write(out.drop("d", "place"), name)


def _known(rows: DataFrame, group: list[str], scratch: Scratch, name: str) -> DataFrame:
    """group, d, total, place, multi of the extents that are repeated or share their group."""
    seen = scratch.write(rows.groupBy(*group, "d").agg(F.sum("n").alias("total"), F.min("place").alias("place")), f"{name}-seen")
    shared = scratch.write(seen.groupBy(*group).agg(F.count("*").alias("c")).filter("c > 1").select(*group, F.lit(True).alias("multi")), f"{name}-shared")
    known = seen.join(shared, group, "left").filter("total > 1 or multi").withColumn("multi", F.coalesce("multi", F.lit(False)))
    known = scratch.write(known, f"{name}-known")
    scratch.drop(seen, shared)
    return known


def repeats(docs: DataFrame, scratch: Scratch, least: int = LEAST, gram: int = GRAM, block: int = BLOCK, symbols=_bytes) -> DataFrame:
    """k, th, a, b: ranges [a, b) of documents' symbols that strings of `least` symbols or more cover which start elsewhere, too."""
    gram, block = min(gram, least // 2 + 1), max(1, min(block, least // 2))
    d = keyed(docs)
    one, heavy = _first_round(d, symbols, least, gram, scratch)
    spans = _spans(one.filter("total > 1"), least).unionByName(heavy)
    todo = one.filter("stands").groupBy("k", "th").agg(F.collect_list(F.struct("s", "w", "o", F.least("total", F.lit(2)).alias("n"))).alias("runs"))
    texts = scratch.write(d.join(todo, ["k", "th"]), "texts")
    blocks = scratch.write(_blocks(texts, symbols, least, block), "blocks")
    two = _refined(blocks, ["core", "q"], scratch, "round2")
    scratch.drop(blocks)
    spans = spans.unionByName(_spans(two.filter("n = 1 and total > 1"), least))
    todo = two.filter("stands").groupBy("k", "th").agg(F.collect_list(F.struct("s", "w", F.least("total", F.lit(2)).alias("n"))).alias("runs"))
    single = scratch.write(_windows(texts.drop("runs").join(todo, ["k", "th"]), symbols, least), "windows")
    scratch.drop(texts)
    repeated = scratch.write(single.groupBy("d", "e").agg(F.sum("n").alias("total")).filter("total > 1").select("d", "e"), "repeated")
    three = scratch.write(_spans(single.filter("n = 1").join(repeated, ["d", "e"]).withColumn("w", F.lit(1)), least), "round3")
    scratch.drop(single, repeated)
    return spans.unionByName(three)


def passages(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """k, th, a, b: ranges of documents' words that strings of `words` words or more cover which start elsewhere, too."""
    return repeats(docs, scratch, words, WORD_GRAM, WORD_BLOCK, word_hashes)


def _spans(rows: DataFrame, least: int) -> DataFrame:
    return rows.select("k", "th", F.col("s").alias("a"), (F.col("s") + F.col("w") + (least - 1)).alias("b"))


def _blocks(texts: DataFrame, symbols, least: int, block: int) -> DataFrame:
    """Cuts each run where its windows' offset to the anchor passes a multiple of `block`.

    core is the digest of the bytes that all windows of a whole block share; only blocks with equal cores can have equal windows.
    """

    def rows(batches):
        for b in slices(batches):
            for k, th, t, runs in zip(b.column("k").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                q, s, w, n, c = [], [], [], [], []
                for r in runs:
                    anchor, high = r["s"] + r["o"], r["o"]
                    low = high - r["w"] + 1  # window s + x has offset o - x
                    for j in range(low // block, high // block + 1):
                        top, bottom = min(high, j * block + block - 1), max(low, j * block)
                        q.append(j)
                        s.append(anchor - top)
                        w.append(top - bottom + 1)
                        n.append(r["n"])
                        c.append(anchor - j * block)
                data, s, w = symbols(t), np.array(s), np.array(w)
                core = winnow.digests64(data, np.array(c), np.full(len(c), least - block + 1))
                yield pa.RecordBatch.from_arrays(
                    [_int64(core), pa.array(q, pa.int32()), _int64(winnow.digests64(data, s, w + least - 1)), pa.array(n, pa.int64())]
                    + [pa.array(np.full(len(s), k)), pa.array(np.full(len(s), th, np.int32)), pa.array(s.astype(np.int32)), pa.array(w.astype(np.int32))],
                    names=["core", "q", "d", "n", "k", "th", "s", "w"],
                )

    return texts.mapInArrow(winnow.gathered(rows), "core long, q int, d long, n long, k long, th int, s int, w int")


def _windows(texts: DataFrame, symbols, least: int) -> DataFrame:
    def rows(batches):
        for b in slices(batches):
            for k, th, t, runs in zip(b.column("k").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                s = np.concatenate([np.arange(r["s"], r["s"] + r["w"]) for r in runs])
                n = np.concatenate([np.full(r["w"], r["n"]) for r in runs])
                d, e = winnow.digests(symbols(t), s, np.full(len(s), least))
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(e), pa.array(n), pa.array(np.full(len(s), k)), pa.array(np.full(len(s), th, np.int32)), pa.array(s.astype(np.int32))], names=["d", "e", "n", "k", "th", "s"])

    return texts.mapInArrow(winnow.gathered(rows), "d long, e long, n long, k long, th int, s int")


def _ranges(spans: list | None) -> tuple[np.ndarray, np.ndarray]:
    return winnow.merged(np.array([x["a"] for x in spans or ()], np.int64), np.array([x["b"] for x in spans or ()], np.int64))


def _rest(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))


def _word_edges(text: bytes) -> np.ndarray:
    """Where each word starts, and the text's end."""
    data = _bytes(text)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    return np.append(np.flatnonzero(~space & np.append(True, space[:-1])), len(text))


def remove_repeats(docs: DataFrame, scratch: Scratch, least: int = LEAST, words: int = WORDS, keep: tuple = (), texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, n_passage_words, the columns to keep and, if wanted, kept.

    docs: doc_id, text; other columns are ignored unless kept. Null and empty texts have no bytes. Rows that repeat a doc_id are documents
    of their own, so copies remove each other. An empty table gives an empty result.

    n_removed to kept_sha256 concern repeated strings of `least` bytes; n_passage_words counts the words that strings of `words` words
    cover which start elsewhere, too, however few bytes they have. kept is the text without both, each passage with the white space
    after it, and without code points that lost a part.
    """
    kinds = dict(docs.dtypes)

    def rows(batches):
        for b in slices(batches):
            out = [[], [], [], [], [], []]
            for t, spans, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), b.column("passages").to_pylist(), strict=True):
                s, e = _ranges(spans)
                kept, (a, z) = _rest(t, s, e), _ranges(found)
                rest = kept
                if texts and len(a):
                    at = _word_edges(t)
                    rest = _rest(t, *winnow.merged(np.append(s, at[a]), np.append(e, at[z])))
                row = (len(t), len(t) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), int((z - a).sum()), rest.decode("utf-8", "ignore") if texts else None)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            cols = [b.column("doc_id"), *(pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(out[:5]))]
            cols += [b.column(f"_keep_{c}") for c in keep] + [pa.array(out[5], pa.string())] * texts
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", *(f"_keep_{c}" for c in keep), *["kept"] * texts]
    schema = f"doc_id {kinds['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long" + "".join(f", _keep_{c} {kinds[c]}" for c in keep) + ", kept string" * texts
    both = repeats(docs, scratch, least).withColumn("of", F.lit("spans")).unionByName(passages(docs, scratch, words).withColumn("of", F.lit("passages")))
    joined = with_spans(docs, both, keep, ("spans", "passages")).select("doc_id", *(f"_keep_{c}" for c in keep), "text", "spans", "passages")
    return joined.mapInArrow(rows, schema).withColumnsRenamed({f"_keep_{c}": c for c in keep})
