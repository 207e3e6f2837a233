import numpy as np
import pytest

from talkgrain.llm import ngram_join
from talkgrain.llm.common import Scratch
from talkgrain.llm.embedding_dedup import compare, forest, links
from talkgrain.llm.ngram_join import join, keep_first, least_matches
from tests.llm.fixtures import documents, empty, rows, with_null_id, words


def labels(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def brute_links(data):
    def shingles(t):
        w = (t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    data = [r for r in data if r["doc_id"] is not None]
    sets = [shingles(r["text"]) for r in data]
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0) >= 0.8]
    n = [0] * len(data)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    label = labels(len(data), pairs)
    low = {c: min(r["doc_id"] for r, x in zip(data, label, strict=True) if x == c) for c in set(label)}
    return sorted((r["doc_id"], k, low[c]) for r, k, c in zip(data, n, label, strict=True))


def near_copies(spark):
    base = words(200, 1).split()
    texts = []
    for i in range(60):
        w = list(base)
        for j in range(i % 7):
            w[(i * 31 + j * 17) % 200] = f"edit{i}x{j}"
        texts.append(" ".join(w))
    texts += [words(150, 50 + i) for i in range(10)]
    return spark.createDataFrame([(i * 3, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int")


@pytest.mark.parametrize("table", [near_copies, documents, with_null_id])
def test_ngram_join(spark, table, monkeypatch):
    docs = table(spark)
    if table is near_copies:  # many tiles
        monkeypatch.setattr(ngram_join, "BUCKET_TILE", 16)
        monkeypatch.setattr(ngram_join, "SET_TILE", 8)
    got = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in rows(join(docs, Scratch(spark, "t"))))
    want = brute_links(rows(docs))
    if table is not near_copies:  # doc_id 3 and 4 occur twice; a class goes by doc_id
        got, want = sorted(x[0] for x in got), sorted(x[0] for x in want)
    assert got == want


def test_keep_first(spark):
    kept = keep_first(near_copies(spark), Scratch(spark, "t"))
    want = [d for d, _, c in brute_links(rows(near_copies(spark))) if d == c]
    assert sorted(r["doc_id"] for r in rows(kept)) == want and kept.columns == ["doc_id", "text", "n"]
    assert rows(keep_first(empty(spark), Scratch(spark, "t"))) == [] == rows(join(empty(spark), Scratch(spark, "t")))


def brute_classes(data):
    """doc_id, n_links, class_id of each row and the class's first row, rows told apart by their place."""
    sets = []
    for r in data:
        w = (r["text"] or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0) >= 0.8]
    label = labels(len(data), pairs)
    order = lambda i: (data[i]["doc_id"] is None, data[i]["doc_id"] or 0, data[i]["text"] or "")
    first = {c: min((i for i, x in enumerate(label) if x == c), key=order) for c in set(label)}
    return [(r["doc_id"], sum(i in p for p in pairs), data[first[c]]["doc_id"]) for i, (r, c) in enumerate(zip(data, label, strict=True))], [data[i] for i in first.values()]


def repeated_and_null_ids(spark):
    a, b, c, d = (words(80, 200 + i) for i in range(4))
    near = lambda t, k: t + f" tail{k}"
    data = [(1, a), (1, b), (2, near(a, 1)), (3, near(b, 2)), (1, near(b, 3)), (None, c), (None, near(c, 1)), (None, c), (None, d), (None, near(a, 5)), (0, words(60, 300)), (0, words(60, 301)), (None, words(60, 300)), (1, b), (None, None), (7, "")]
    return spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, n int")


@pytest.mark.parametrize("table", [documents, with_null_id, repeated_and_null_ids])
def test_repeated_and_missing_ids(spark, table):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    data = rows(table(spark))
    got = [(r["doc_id"], r["n_links"], r["class_id"]) for r in rows(join(table(spark), Scratch(spark, "t")))]
    assert sorted(got) == sorted(brute_classes([r for r in data if r["doc_id"] is not None])[0])
    kept = [(r["doc_id"], r["text"] or "") for r in rows(keep_first(table(spark), Scratch(spark, "t")))]
    assert sorted(kept, key=key) == sorted(((r["doc_id"], r["text"] or "") for r in brute_classes(data)[1]), key=key)


def test_common_by_matrix():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30_000, 900).astype(np.uint64)) for _ in range(60)]
    i, j = np.divmod(np.arange(3600), 60)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert ngram_join._common(sets, sets, i, j).tolist() == want == ngram_join._common(sets, sets, i[:1999], j[:1999]).tolist() + want[1999:]


def test_pruning_keeps_true_pairs():
    rng = np.random.default_rng(5)
    least = least_matches()
    for true, low, high in ((0.8, 0.9999, 1), (0.3, 0, 0.01)):
        same = rng.random((20_000, ngram_join.VALUES)) < true
        share = ngram_join.surviving(same.astype(np.uint16), np.ones_like(same, np.uint16), least).mean()
        assert low <= share <= high


def test_compare_and_forest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24))
    x[300:] = x[:300] + rng.normal(size=(300, 24)) * 0.1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.95), strict=True)}
    assert set(zip(*compare(x, x, axes, 0.95), strict=True)) == want
    pairs = [(int(rng.integers(80)), int(rng.integers(80))) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    i, j = np.array(pairs).T
    assert forest(i, j, 170).tolist() == labels(170, pairs)


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    vectors = [list(map(float, v)) for v in np.concatenate([base, base + rng.normal(size=base.shape) * 0.15, base[:5], base[:3] * 2])]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [1e-30] * 8, [1e30] * 8]
    data = [(i, v, 0, "x") for i, v in enumerate(vectors + odd)]
    df = spark.createDataFrame([*data, (None, vectors[0], 0, "x")], "vec_id long, embedding array<float>, label int, v string")
    stored = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for _, v, *_ in data]
    ok = [i for i, v in enumerate(stored) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]

    def cos(a, b):
        a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)

    pairs = [(i, j) for i in ok for j in ok if i < j and len(stored[i]) == len(stored[j]) and cos(stored[i], stored[j]) >= 0.95]
    label = labels(len(data), pairs)
    want = [(i, sum(i in p for p in pairs), label[i], label[i] == i) for i in range(len(data))]
    for tile in (2048, 10):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(links(df, Scratch(spark, "t"), tile=tile)))
        assert got == want
    assert rows(links(df.limit(0), Scratch(spark, "t"))) == []


def test_embedding_links_of_huge_and_tiny_components(spark):
    """Squares of these overflow or vanish; their cosines don't."""
    v = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1e-200, 1e-200]), (4, [1.0, -1.0]), (5, [1e308, -1e308])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(links(spark.createDataFrame(v, "vec_id long, embedding array<double>"), Scratch(spark, "t")))}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_embedding_links_where_ids_repeat(spark):
    """Vectors of one id are vectors of their own."""
    kind = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in [(1, "100"), (1, "010"), (2, [1, 0.01, 0]), (3, [0.01, 1, 0]), (1, "001"), (7, "002")]], kind)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(links(df, Scratch(spark, "t"))))
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 1, 1)]
    rng = np.random.default_rng(6)
    v = rng.normal(size=(12, 3))[rng.integers(0, 12, 90)] + rng.normal(size=(90, 3)) * 0.1
    v[80:] = v[:10]
    ids = rng.integers(0, 40, 90).tolist()
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    pairs = [(i, j) for i in range(90) for j in range(i) if u[i] @ u[j] >= 0.95]
    root = labels(90, pairs)
    low = {r: min(i for i, x in zip(ids, root, strict=True) if x == r) for r in root}
    want = sorted((ids[k], sum(k in p for p in pairs), low[root[k]]) for k in range(90))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], kind)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(links(df, Scratch(spark, "t"), tile=20))) == want


def test_links_of_a_full_tile_are_not_held():
    """All vectors linked: portions stay small, and the forest takes them one by one."""
    from talkgrain.llm.embedding_dedup import compared

    x = np.random.default_rng(1).normal(size=(1, 6)) + np.random.default_rng(2).normal(size=(1500, 6)) * 1e-3
    label, n = np.arange(1500), 0
    for i, j in compared(x, x, np.eye(6), 0.95):
        assert len(i) <= 200_000
        n += len(i)
        label = forest(i, j, 1500, label)
    assert n == 1500 * 1500 and not label.any()
