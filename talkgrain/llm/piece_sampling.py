"""SentencePiece encoding and decoding by forward filtering and backward sampling.

A text is cut before every space that follows another character; no piece of the vocabulary crosses such a cut (checked on
loading), so the lattice of all segmentations is a product of the segments'. For each distinct segment, forward filtering adds
up the weights of all its prefixes' segmentations; backward sampling then draws every occurrence's pieces from its end,
each with its exact posterior probability. The uniform numbers are hashes of row key, occurrence and step: runs agree.

A BPE vocabulary has ranks as scores, not probabilities; a piece weighs (rank + 1) ** -sharpness, after Zipf's law. Characters
without a piece become their UTF-8 bytes, as does a literal U+2581, which else stands for the space. So decoding is lossless.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.winnow import mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581; a lone surrogate occurs in no text.
LITERAL = "\udc81"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CHARS = 2_000_000
CELLS = 3_000_000
#: A longer segment (text without spaces) is filtered in blocks of so many characters; its table never stands whole.
LONG = 1 << 15
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """A vocabulary: the pieces' texts, None for control pieces, and scores; made on the driver, sent to tasks."""

    texts: list
    scores: list
    sharpness: float = 1.0
    bits: int = 18
    longest: int = field(init=False)

    def __post_init__(self):
        self.byte_ids = np.full(256, -1, np.int64)
        self.raw = []
        words = {}
        for i, t in enumerate(self.texts):
            if t is None:
                self.raw.append(b"")
            elif m := re.fullmatch("<0x([0-9A-F]{2})>", t):
                self.byte_ids[int(m[1], 16)] = i
                self.raw.append(bytes([int(m[1], 16)]))
            else:
                words[t] = i
                self.raw.append(t.replace(SPACE, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no piece for every byte")
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in words):
            raise ValueError("a piece crosses the start of a word")
        self.longest = max(map(len, words))
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.sizes = np.array([len(x) for x in self.raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        keys = np.array([self.key(t) for t in words], U64)
        ids = np.fromiter(words.values(), np.int64)
        rank = np.minimum(-np.array([self.scores[i] for i in ids], float), len(self.texts))
        weight = (np.maximum(rank, 0) + 1) ** -self.sharpness
        # Open addressing; keys are 64-bit hashes, told apart here once for all.
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        mask = (1 << self.bits) - 1
        self.table_key, self.table_id, self.table_weight = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32), np.zeros(1 << self.bits)
        self.probes = 1
        for k, i, w in zip(keys.tolist(), ids.tolist(), weight.tolist(), strict=True):
            at, n = (k >> 40) & mask, 1
            while self.table_id[at] >= 0:
                at, n = (at + 1) & mask, n + 1
            self.table_key[at], self.table_id[at], self.table_weight[at] = k, i, w
            self.probes = max(self.probes, n)
        self.least = float(weight.min()) / len(self.texts)

    @staticmethod
    def key(text: str) -> int:
        """The hash that find() builds from the right."""
        h, power = 0, 1
        for c in reversed(text):
            h = (h + (ord(c) + 1) * power) % (1 << 64)
            power = power * int(_BASE) % (1 << 64)
        return int(mixed(np.array([h], U64))[0])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: none) and weight of the pieces with these hashes."""
        h = mixed(h)
        at = (h >> U64(40)).astype(np.int64) & ((1 << self.bits) - 1)
        out = np.full(len(h), -1, np.int32)
        weight = np.zeros(len(h))
        left = np.arange(len(h))
        for _ in range(self.probes):
            hit = (self.table_key[at] == h[left]) & (self.table_id[at] >= 0)
            out[left[hit]], weight[left[hit]] = self.table_id[at[hit]], self.table_weight[at[hit]]
            go = ~hit & (self.table_id[at] >= 0)
            if not go.any():
                break
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out, weight


def load(path: str = MODEL, sharpness: float = 1.0) -> Pieces:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    return Pieces([None if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], sharpness)


def _forward(codes: np.ndarray, lengths: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For segments of one padded matrix: at each end the cumulative probability of the last piece's length, and the ids of these pieces.

    An id below 0 is a character without a piece, as -1 - code.
    """
    n, size = codes.shape
    deep = min(p.longest, size)
    cum = np.ones((n, size, deep), np.float32)
    ids = np.zeros((n, size, deep), np.int32)
    before = np.zeros((n, deep))  # column l - 1: the weight of the prefix that ends l characters before the end
    before[:, 0] = 1
    for end in range(1, size + 1):
        live = np.flatnonzero(lengths >= end)
        h, power, total = np.zeros(len(live), U64), U64(1), np.zeros((len(live), deep))
        for back in range(1, min(deep, end) + 1):
            c = codes[live, end - back]
            h = h + (c.astype(U64) + U64(1)) * power
            power = U64(int(power) * int(_BASE) % (1 << 64))
            found, weight = p.find(h)
            if back == 1:
                none = found < 0
                found = np.where(none, -1 - c.astype(np.int32), found)
                weight = np.where(none, p.least, weight)
            ids[live, end - 1, back - 1] = found
            total[:, back - 1] = weight * before[live, back - 1]
        total = np.cumsum(total, axis=1)
        whole = total[:, -1:]
        cum[live, end - 1] = total / whole
        # Scaled so that the newest is 1: only ratios matter.
        before[live, 1:] = before[live, :-1] / whole
        before[live, 0] = 1
    return cum.reshape(n * size, deep), ids.reshape(n * size, deep)


def _lattice(codes: np.ndarray, lo: int, hi: int, deep: int, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ids of the pieces that end at lo + 1 to hi, by length; as in _forward."""
    ends = np.arange(lo + 1, hi + 1)
    weights, ids = np.zeros((hi - lo, deep)), np.zeros((hi - lo, deep), np.int32)
    h, power = np.zeros(hi - lo, U64), U64(1)
    for back in range(1, deep + 1):
        inside = ends >= back
        c = codes[np.maximum(ends - back, 0)]
        h = h + (c.astype(U64) + U64(1)) * power
        power = U64(int(power) * int(_BASE) % (1 << 64))
        found, weight = p.find(h)
        if back == 1:
            none = found < 0
            found = np.where(none, -1 - c.astype(np.int32), found)
            weight = np.where(none, p.least, weight)
        ids[:, back - 1] = found
        weights[:, back - 1] = np.where(inside, weight, 0)
    return weights, ids


def _filtered(weights: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cumulative probabilities at each end of a block, and what the next block goes on from."""
    cum = np.empty(weights.shape, np.float32)
    before = before.copy()
    for i, w in enumerate(weights):
        total = np.cumsum(w * before)
        whole = total[-1]
        cum[i] = total / whole
        before[1:] = before[:-1] / whole
        before[0] = 1
    return cum, before


def _drawn(seed: np.ndarray, step) -> np.ndarray:
    """The uniform numbers of these steps."""
    n = np.atleast_1d(step).astype(U64) + U64(1)
    return (mixed(seed + n * U64(0x8CB92BA72F3D8DD7)) >> U64(40)).astype(np.float32) * np.float32(2**-24)


def _long(codes: np.ndarray, seeds: np.ndarray, p: Pieces) -> list[np.ndarray]:
    """A long segment's pieces for each seed, from its end. Blocks are filtered once forwards, which keeps what each begins with, and again as they are drawn from."""
    size, deep = len(codes), min(p.longest, len(codes))
    starts, state = [], np.zeros(deep)
    state[0] = 1
    for lo in range(0, size, LONG):
        starts.append(state)
        state = _filtered(_lattice(codes, lo, min(size, lo + LONG), deep, p)[0], state)[1]
    out, end, step = [[] for _ in seeds], [size] * len(seeds), [0] * len(seeds)
    for b in range(len(starts) - 1, -1, -1):
        lo = b * LONG
        weights, ids = _lattice(codes, lo, min(size, lo + LONG), deep, p)
        cum, _ = _filtered(weights, starts[b])
        for k in range(len(seeds)):
            u = _drawn(seeds[k : k + 1], np.arange(step[k], step[k] + max(0, end[k] - lo)))  # a piece a character at most
            drawn = 0
            while end[k] > lo:
                at = end[k] - lo - 1
                back = min(int(np.count_nonzero(cum[at] <= u[drawn])), min(end[k], deep) - 1)
                out[k].append(ids[at, back])
                end[k], drawn = end[k] - back - 1, drawn + 1
            step[k] += drawn
    return [np.array(x, np.int64) for x in out]


def encode(texts: list, keys: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and where each text's end. keys: a 64-bit number for each text, which seeds it."""
    numbers: dict = {}
    occ, per = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = SEGMENT.findall(t.replace(SPACE, LITERAL).replace(" ", SPACE))
        occ.extend([numbers.setdefault(s, len(numbers)) for s in found])
        per[i] = len(found)
    if not occ:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    occ = np.array(occ, np.int64)
    segments = list(numbers)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    order = np.argsort(lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place, size = rank[occ], lengths[occ]
    row = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(occ)) - np.repeat(np.cumsum(per) - per, per)
    seed = mixed(keys.astype(U64)[row] + nth.astype(U64) * U64(0xD1B54A32D192ED03))
    pieces, counts = [], np.zeros(len(occ), np.int64)
    by_place = np.argsort(place, kind="stable")
    first = np.searchsorted(place[by_place], np.arange(len(order) + 1))
    sorted_lengths, a = lengths[order], 0
    short = int(np.searchsorted(sorted_lengths, LONG, side="right"))
    for i in range(short, len(order)):
        codes = np.frombuffer(segments[order[i]].encode("utf-32-le", "surrogatepass"), np.uint32)
        who = by_place[first[i] : first[i + 1]]
        for w, got in zip(who.tolist(), _long(codes, seed[who], p), strict=True):
            pieces.append((np.full(len(got), w), np.arange(len(got)), got))
            counts[w] = len(got)
    while a < short:
        # Segments of like length together, as many as fill the table.
        z = a + 1
        while z < short and (z - a + 1) * sorted_lengths[z] * min(p.longest, sorted_lengths[z]) <= CELLS and sorted_lengths[z] <= sorted_lengths[a] * 1.25 + 1:
            z = min(short, z + max(1, (z - a) // 8))
        some = [segments[i] for i in order[a:z]]
        wide = int(sorted_lengths[z - 1])
        flat = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros((z - a, wide), np.uint32)
        codes[np.arange(wide) < sorted_lengths[a:z, None]] = flat
        cum, ids = _forward(codes, sorted_lengths[a:z], p)
        who = by_place[first[a] : first[z]]
        base, end, step = (place[who] - a) * wide - 1, size[who].copy(), 0
        while len(who):
            u = _drawn(seed[who], step)
            at = base + end
            back = np.minimum((cum[at] <= u[:, None]).sum(axis=1), np.minimum(end, cum.shape[1]) - 1)
            pieces.append((who, np.full(len(who), step, np.int32), ids[at, back]))
            counts[who] += 1
            end = end - back - 1
            go = end > 0
            who, base, end = who[go], base[go], end[go]
            step += 1
        a = z
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), np.int64)
    for who, step, got in pieces:  # drawn from the end
        out[ends[who] - 1 - step] = got
    text_ends = np.concatenate([[0], ends])[np.cumsum(per)]
    return _with_bytes(out, text_ends, p)


def _with_bytes(out: np.ndarray, ends: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    odd = np.flatnonzero(out < 0)
    if not len(odd):
        return out.astype(np.int32), ends
    chars, which = np.unique(-1 - out[odd], return_inverse=True)
    raw = [SPACE.encode() if c == ord(LITERAL) else chr(c).encode("utf-8", "surrogatepass") for c in chars.tolist()]
    size = np.ones(len(out), np.int64)
    size[odd] = np.array([len(r) for r in raw])[which]
    new_ends = np.cumsum(size)
    wide = np.repeat(out, size)
    for i, r in enumerate(raw):
        start = new_ends[odd[which == i]] - len(r)
        for j, byte in enumerate(r):
            wide[start + j] = p.byte_ids[byte]
    return wide.astype(np.int32), np.concatenate([[0], new_ends])[ends]


def decode(ids: np.ndarray, p: Pieces) -> bytes:
    ids = np.asarray(ids, np.int64)
    size = p.sizes[ids]
    at = np.repeat(p.starts[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return p.flat[at].tobytes()


def encoded(docs: DataFrame, pieces: Pieces, digest: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids and, if wanted, decoded_sha256, the digest of what the ids decode to.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no ids. Rows with equal doc_id and text have equal ids, null doc_ids
    count as equal. A text without spaces, however long, takes memory for LONG of its characters at once. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            keys, doc = b.column("key").to_numpy(), b.column("doc_id")
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHARS):
                    size += len(texts[j])
                    j += 1
                ids, ends = encode(texts[i:j], keys[i:j], pieces)
                offsets = np.concatenate([[0], ends])
                cols = [doc.slice(i, j - i), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if digest:
                    cols.append(pa.array([hashlib.sha256(decode(ids[x:y], pieces)).hexdigest() for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids", "decoded_sha256"][: len(cols)])
                i = j

    keyed = docs.select("doc_id", "text", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("key"))
    return keyed.mapInArrow(rows, f"doc_id {kind}, n_pieces long, ids array<int>" + ", decoded_sha256 string" * digest)


def decoded(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""

    def run(batches):
        for b in batches:
            texts = [None if x is None else decode(x, pieces).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
