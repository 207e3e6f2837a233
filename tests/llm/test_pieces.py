import itertools
from collections import Counter

import numpy as np
import pytest

from talkgrain.llm import piece_sampling
from talkgrain.llm.piece_sampling import decode, decoded, encode, encoded, load
from talkgrain.llm.winnow import mixed
from tests.llm.fixtures import documents, empty, odd_texts, rows, with_null_id


@pytest.fixture(scope="module")
def pieces():
    return load()


def cut(ids, ends):
    o = np.concatenate([[0], ends])
    return [ids[a:b] for a, b in itertools.pairwise(o)]


def test_round_trip(pieces, monkeypatch):
    texts = [t or "" for t in odd_texts()] + ["▁", " ▁ ", "a\r\n\tb", "\x00\x7f", "  lead", "trail  ", "<s></s><unk>", "<0x0A>"]
    keys = np.arange(len(texts))
    one = cut(*encode(texts, keys, pieces))
    assert [decode(x, pieces).decode() for x in one] == texts
    monkeypatch.setattr(piece_sampling, "CELLS", 500)  # smaller tables, the same draws
    assert all(map(np.array_equal, one, cut(*encode(texts, keys, pieces))))
    assert all(map(np.array_equal, one[::-1], cut(*encode(texts[::-1], keys[::-1], pieces))))


def test_long_segments(pieces, monkeypatch):
    """Text without spaces: drawn in blocks as it is from a whole table, and lossless at any length."""
    texts = ["x" * 900, "inter" * 300 + "é日😀" * 40, "abc def", "x" * 900, "<|im_start|>" * 70]
    keys = np.arange(len(texts)) * 7
    whole = cut(*encode(texts, keys, pieces))
    for block in (64, 100, 899):
        monkeypatch.setattr(piece_sampling, "LONG", block)
        got = cut(*encode(texts, keys, pieces))
        assert all(map(np.array_equal, whole, got))
    monkeypatch.undo()
    long = "longwordwithoutanyspace" * 9000
    (ids,) = cut(*encode([long], np.array([1]), pieces))
    assert decode(ids, pieces).decode() == long


def test_posterior(pieces):
    word = "nights"
    known = {t: i for i, t in enumerate(pieces.texts) if t}

    def ways(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                yield from ((known[s[:n]], *rest) for rest in ways(s[n:]))

    all_ways = list(ways(word))
    p = np.array([np.prod([1 / (min(-pieces.scores[i], len(pieces.texts)) + 1) for i in w]) for w in all_ways])
    p /= p.sum()
    n = 30_000
    seen = Counter(tuple(x.tolist()) for x in cut(*encode([word] * n, mixed(np.arange(n).astype(np.uint64)).view(np.int64), pieces)))
    assert set(seen) <= set(all_ways)
    for w, q in zip(all_ways, p, strict=True):
        assert abs(seen[w] / n - q) < 5 * np.sqrt(q / n) + 1e-3


@pytest.mark.parametrize("table", [documents, with_null_id])
def test_frames(spark, pieces, table):
    import hashlib

    docs = table(spark)
    out = encoded(docs, pieces)
    again = encoded(docs.repartition(3), pieces)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["ids"])
    assert sorted(map(key, rows(out))) == sorted(map(key, rows(again)))
    want = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows(docs))
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in rows(out)) == want
    assert Counter((r["doc_id"], r["text"]) for r in rows(decoded(out, pieces))) == Counter((r["doc_id"], r["text"] or "") for r in rows(docs))
    assert rows(encoded(empty(spark), pieces)) == []
