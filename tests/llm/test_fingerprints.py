import hashlib

import pytest
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch
from talkgrain.llm.spotsigs import ANCHORS, edited_fingerprints, near_duplicates, signatures
from tests.llm.fixtures import documents, empty, rows, with_null_id, words


def brute(text):
    import re

    text = text or ""
    w = re.findall(r"[^\W_]+", text.lower())
    content = [(i, x) for i, x in enumerate(w) if x not in ANCHORS]
    found = set()
    for i, x in enumerate(w):
        after = [c for j, c in content if j > i][:2]
        if x in ANCHORS and len(after) == 2:
            found.add(" ".join([x, *after]))
    if not found and text:
        found = {" ".join(w) or text}
    return sorted({hashlib.md5(f.encode()).hexdigest()[:8] for f in found})


def test_signatures(spark):
    texts = ["The cat and the dog of the house sat on a mat.", "no anchors here", "the", "", None, "...", "the the the end now", "The " * 5000 + "big end", "1 of 2 and 3 4"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", signatures(F.col("text")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [brute(t) for t in texts]


@pytest.mark.parametrize("table", [documents, with_null_id])
def test_edited(spark, table):
    docs = table(spark)
    got = rows(edited_fingerprints(docs))
    key = lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or "")
    order = sorted(rows(docs), key=key)
    want = []
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, n = r["text"] or "", nxt["text"] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        a, b, c = (set(brute(x)) for x in (t, e, n))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        want.append((r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), like(a, b), like(a, c)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r.values())) for r in got)


def test_empty_and_single(spark):
    assert rows(edited_fingerprints(empty(spark))) == []
    (r,) = rows(edited_fingerprints(documents(spark).filter("doc_id = 0")))
    assert r["near_next"] == 1.0


def test_near_duplicates(spark):
    base = " ".join(f"the {w} of {v}" for w, v in zip(words(60, 1).split(), words(60, 2).split(), strict=True))
    parts = base.split()
    texts = {1: base, 2: base, 3: " ".join(parts[:-8]), 4: " ".join(parts[: len(parts) // 2]), 5: words(50, 7), 6: "", 7: None, 8: base + " the end now"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: set(brute(t)) for i, t in texts.items()}
    label = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if not sets[a] and not sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["class_id"] for r in rows(near_duplicates(df, Scratch(spark, "t")))}
    assert got == label
