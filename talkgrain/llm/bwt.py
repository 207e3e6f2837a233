"""The byte-level merge of multi-string Burrows-Wheeler transforms by interleave refinement (Holt and McMillan 2014), with the
longest common prefixes that it yields on the way (Egidi, Louza, Manzini and Telles 2019).

A shard's transform lists, for all suffixes of its strings in order, the byte before each. To merge two, an interleave says for
each rank of the result which transform its row comes from. It starts as all rows of the first, then all of the second; each
refinement reads it once and writes it bucketed by the byte of the row, after which suffixes are in order of one byte more.
Where two neighbours part for the first time in round h their common prefix is h - 1. Rounds end when nothing parts any more
or, as repeats of `deep` bytes need no more, after `deep` of them.

This is what suffix_dedup refines by content-defined strings instead; here it serves to hold that against, and for texts of some MB.
"""

from __future__ import annotations

import numpy as np

#: Ends each string; below all bytes. Bytes are stored plus one.
END = 0


def build(texts: list[bytes]) -> np.ndarray:
    """The transform of one shard: int16 bytes plus one, END where a string starts. Equal suffixes stand in the order of their strings."""
    rows = []
    for t, s in enumerate(texts):
        rows += [(s[i:], t, s[i - 1] + 1 if i else END) for i in range(len(s) + 1)]
    rows.sort(key=lambda r: (r[0], r[1]))
    return np.array([r[2] for r in rows], np.int16)


def merge(a: np.ndarray, b: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, lcp, interleave) of both shards' strings. lcp[i] is that of rows i - 1 and i, at most `deep`; interleave is True for rows of b.

    Two passes over the rows a round and three bytes a row: the interleave, the prefix lengths and the transforms.
    """
    n = len(a) + len(b)
    z = np.zeros(n, bool)
    z[len(a) :] = True
    first = np.zeros(n, bool)  # a row that opens a block of equal prefixes
    first[0] = True
    strings = int((a == END).sum() + (b == END).sum())
    lcp = np.full(n, deep, np.int32)
    lcp[0] = 0
    for h in range(1, deep + 2):
        here = np.empty(n, np.int16)
        here[~z], here[z] = a, b
        # The suffix one byte longer than row i's starts with here[i]: a stable bucketing by that byte. A row that begins a
        # string leads to its empty suffix; those come first, in the order of the strings, and share nothing.
        order = np.argsort(here, kind="stable")
        block = np.cumsum(first)[order]
        byte = here[order]
        new = np.ones(n, bool)
        new[1:] = (byte[1:] != byte[:-1]) | (block[1:] != block[:-1]) | (byte[1:] == END)
        z_next = z[order]
        z_next[:strings] = np.arange(strings) >= strings - int((b == END).sum())
        fresh = new & ~first
        lcp[fresh] = h - 1
        settled = not fresh.any() and np.array_equal(z, z_next)
        z, first = z_next, first | new
        if settled:
            break
    here = np.empty(n, np.int16)
    here[~z], here[z] = a, b
    return here, np.minimum(lcp, deep), z


def repeated_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges [i, j) of two rows or more whose suffixes share their first `least` bytes."""
    deep = np.flatnonzero(np.diff(np.concatenate([[False], lcp >= least, [False]]).astype(np.int8)))
    return [(int(i) - 1, int(j)) for i, j in deep.reshape(-1, 2)]
