"""Content-defined anchors of repeated passages; NumPy code that runs inside a task.

A window is `least` consecutive symbols (bytes, or hashes of words) of one document. Its anchor is the
leftmost of those of its grams of k symbols whose hash is smallest (winnowing, Schleimer et al. 2003), so equal
windows have equal anchors at equal offsets. The consecutive windows that share an anchor are a run. Every
window belongs to exactly one run, and the symbols that a run covers, its extent, are determined by its content.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_POS = 22
#: Symbols handled at once; longer documents are cut into overlapping pieces, which changes no window's anchor.
PIECE = 1 << (_POS - 1)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values (van Herk: minima of block prefixes and suffixes)."""
    n = len(a)
    if n < w:
        return a[:0]
    p = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U64)
    p[:n] = a
    q = p.reshape(-1, w)
    suffix = np.minimum.accumulate(q[:, ::-1], axis=1)[:, ::-1].ravel()
    prefix = np.minimum.accumulate(q, axis=1).ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive symbols, by doubling: those of 2n symbols come from those of n."""
    base = 0x9E3779B97F4A7C15 | 1
    power = mixed(symbols.astype(U64) + U64(0x632BE59BD9B4E019))
    out, have, length, rest = None, 0, 1, k
    while True:
        if rest & 1:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - have)
                out = out[: max(0, n)] * U64(pow(base, length, 1 << 64)) + power[have : have + max(0, n)]
            have += length
        rest >>= 1
        if not rest:
            return mixed(out)
        n = max(0, len(power) - length)
        power = power[:n] * U64(pow(base, length, 1 << 64)) + power[length : length + n]
        length *= 2


def runs(symbols: np.ndarray, ends: np.ndarray, least: int, k: int):
    """(start, windows, anchor, gram) arrays of the runs of concatenated documents that end at `ends`."""
    g = gram_hashes(symbols, k)
    key = (g >> U64(_POS) << U64(_POS)) | np.arange(len(g), dtype=U64)
    m = sliding_min(key, least - k + 1)
    n = len(m)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = doc[:n] == doc[least - 1 : least - 1 + n]
    fresh = np.ones(n, bool)
    fresh[1:] = (m[1:] != m[:-1]) | ~inside[:-1]
    start = np.flatnonzero(fresh & inside)
    last = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True))
    anchor = (m[start] & U64((1 << _POS) - 1)).astype(np.int64)
    return start, last - start + 1, anchor, g[anchor]


def all_runs(docs: list[np.ndarray], least: int, k: int):
    """Batches (document index, start in its document, windows, anchor offset, gram, joined symbols, start in them)."""
    i = 0
    while i < len(docs):
        j, size = i, 0
        while j < len(docs) and (j == i or size + len(docs[j]) <= PIECE):
            size += len(docs[j])
            j += 1
        if size > PIECE:  # one document; pieces overlap by least - 1 symbols
            step = PIECE - least + 1
            for at in range(0, size - least + 1, step):
                piece = docs[i][at : at + PIECE]
                s, w, a, g = runs(piece, np.array([len(piece)]), least, k)
                yield np.full(len(s), i), s + at, w, a - s, g, piece, s
        elif size:
            joined = np.concatenate(docs[i:j])
            ends = np.cumsum([len(x) for x in docs[i:j]])
            s, w, a, g = runs(joined, ends, least, k)
            d = np.searchsorted(ends, s, side="right")
            yield d + i, s - np.concatenate([[0], ends])[d], w, a - s, g, joined, s
        i = j


def digests(joined: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of joined[start : start + length], as two arrays."""
    view, unit = memoryview(np.ascontiguousarray(joined)).cast("B"), joined.dtype.itemsize
    of = xxhash.xxh3_128_digest
    raw = b"".join([of(view[a:b]) for a, b in zip((start * unit).tolist(), ((start + length) * unit).tolist(), strict=True)])
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges, as disjoint maximal ones."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


def digests64(joined: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit digests of joined[start : start + length]."""
    view, unit = memoryview(np.ascontiguousarray(joined)).cast("B"), joined.dtype.itemsize
    of = xxhash.xxh3_64_intdigest
    return np.fromiter((of(view[a:b]) for a, b in zip((start * unit).tolist(), ((start + length) * unit).tolist(), strict=True)), U64, len(start))


def gathered(rows, least: int = 50_000):
    """Joins the small record batches that `rows` yields into larger ones."""
    import pyarrow as pa

    def run(batches):
        held, n = [], 0
        for b in rows(batches):
            held.append(b)
            n += b.num_rows
            if n >= least:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run
