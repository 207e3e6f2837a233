import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from talkgrain.llm import winnow
from talkgrain.llm.common import Scratch
from talkgrain.llm.substring_dedup import dedup, word_hashes
from talkgrain.llm.suffix_dedup import remove_repeats
from tests.llm.fixtures import documents, empty, rows, with_null_id, words


def brute_bytes(texts, least):
    seen = Counter(b[i : i + least] for b in texts for i in range(len(b) - least + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, window):
    """For each text the number of words that a string of `window` words covers which starts elsewhere, too."""
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    return [len({j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}) for w in split]


def brute_rest(texts, least, window):
    """The texts without repeated strings of `least` bytes and of `window` words, these with the white space after them."""
    seen = Counter(b[i : i + least] for b in texts for i in range(len(b) - least + 1))
    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)] for t in texts]
    grams = Counter(tuple(w[i : i + window]) for w in (t.split() for t in texts) for i in range(len(w) - window + 1))
    out = []
    for t, at in zip(texts, found, strict=True):
        gone, w = bytearray(len(t)), t.split()
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        for i in range(len(w) - window + 1):
            if grams[tuple(w[i : i + window])] > 1:
                a, z = at[i][0], at[i + window - 1][1]
                gone[a:z] = b"\1" * (z - a)
        out.append(bytes(x for x, y in zip(t, gone, strict=True) if not y))
    return out


@pytest.mark.parametrize("window", [51, 7])
@pytest.mark.parametrize("table", [documents, with_null_id])
def test_passages(spark, table, window):
    docs = table(spark)
    data = rows(docs)
    texts = [(r["text"] or "").encode() for r in data]
    want = Counter((r["doc_id"], n, t) for r, n, t in zip(data, brute_passages(texts, window), brute_rest(texts, 400, window), strict=True))
    got = rows(remove_repeats(docs, Scratch(spark, "t"), words=window))
    assert Counter((r["doc_id"], r["n_passage_words"], r["kept"].encode()) for r in got) == want


def test_short_passage_of_many_words(spark):
    """A passage of 60 words and under 400 bytes goes from the text and is counted; n_removed and the digest stay those of 400 bytes."""
    line = " ".join(words(60, 3).split()[:60])
    line = " ".join(w[:5] for w in line.split())
    assert len(line) < 400
    texts = [f"{words(80, 100 + i)}\n{line}\n{words(50, 200 + i)}" for i in range(5)] + [words(300, 9)]
    got = {r["doc_id"]: r for r in rows(remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t")))}
    assert all(got[i]["n_passage_words"] == 60 and got[i]["n_removed"] == 0 and got[i]["kept"] == texts[i].replace(line + "\n", "") for i in range(5))
    assert got[5]["n_passage_words"] == 0 and got[5]["kept"] == texts[5]


@pytest.mark.parametrize("least", [400, 60, 9])
@pytest.mark.parametrize("table", [documents, with_null_id])
def test_suffix_dedup(spark, table, least):
    docs = table(spark)
    data = rows(docs)
    want = Counter((r["doc_id"], *x) for r, x in zip(data, brute_bytes([(r["text"] or "").encode() for r in data], least), strict=True))
    got = remove_repeats(docs, Scratch(spark, "t"), least, keep=("k", "spans"))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(got)) == want
    assert {r["k"] for r in rows(got)} == {7}


def test_suffix_dedup_near_copies(spark):
    base = words(300, 1)
    texts = [base[:i] + "#" + base[i:] for i in range(0, 1500, 60)] + [words(400, 2)[i:] for i in range(0, 300, 37)] + ["ab" * 600, "ba" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(brute_bytes([t.encode() for t in texts], 400)))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(remove_repeats(df, Scratch(spark, "t")))} == want


def brute_words(data, window):
    first = {}
    split = [(r["doc_id"], (r["text"] or "").encode().split()) for r in data]
    for d, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            k = float("inf") if d is None else d
            first[g] = min(first.get(g, k), k)
    out = Counter()
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("inf") if d is None else d):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [13, 5])
@pytest.mark.parametrize("table", [documents, with_null_id])
def test_substring_dedup(spark, table, window):
    docs = table(spark)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(dedup(docs, Scratch(spark, "t"), window)))
    assert got == brute_words(rows(docs), window)


def test_empty(spark):
    assert rows(remove_repeats(empty(spark), Scratch(spark, "t"))) == [] == rows(dedup(empty(spark), Scratch(spark, "t")))


def test_runs_partition_windows(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 3, n).astype(np.uint8) for n in (0, 5, 30, 500, 31, 2000, 29, 100)] + [np.zeros(300, np.uint8)]

    def found():
        out = defaultdict(list)
        for d, s, w, o, *_ in winnow.all_runs(docs, 30, 12):
            for x in zip(d.tolist(), s.tolist(), w.tolist(), o.tolist(), strict=True):
                out[x[0]] += [(x[1] + i, x[1] + x[3]) for i in range(x[2])]
        return {k: sorted(v) for k, v in out.items()}

    whole = found()
    assert {d: [s for s, _ in v] for d, v in whole.items()} == {i: list(range(len(x) - 29)) for i, x in enumerate(docs) if len(x) >= 30}
    # An anchor is determined by the window's content alone.
    at = defaultdict(set)
    for d, v in whole.items():
        for s, a in v:
            at[docs[d][s : s + 30].tobytes()].add(a - s)
    assert all(len(x) == 1 for x in at.values())
    monkeypatch.setattr(winnow, "PIECE", 128)  # pieces change nothing
    assert found() == whole


def test_word_hashes():
    assert len(word_hashes(" a\tb\x0bc\x1cd  e\n".encode())) == 4  # \x1c is no white space here


def test_heavy_extents(spark):
    line = words(70, 3)
    texts = [words(80, 100 + i) + "\n" + "\n".join([line] * (1 + i % 5)) + words(5, i) for i in range(150)] + ["ab" * 900, line]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(brute_bytes([t.encode() for t in texts], 400)))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(remove_repeats(df, Scratch(spark, "t")))} == want
