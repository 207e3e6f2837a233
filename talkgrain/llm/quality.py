"""Quality classifier: Bradley-Terry ranking of documents by preference pairs.

A document has hashed byte trigrams and a few counts of its text as features x and the score w.x. A pair of a good and a bad
document says that the good one is preferred, with probability sigmoid(w.(x_good - x_bad)); w has the
least regularised logistic loss over seeded pairs of a bounded sample of labelled rows. The threshold
is the quantile of the sample's scores that separates its labels best, and the score is shifted so
that this quantile maps to `cut`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import slices

FEATURES = ("capitals", "symbols", "bars", "shouts", "repeated_words", "distinct_words", "repeated_lines", "letters", "stops", "commas", "length")
#: Buckets that byte trigrams are hashed to; each is a feature behind FEATURES.
TRIGRAMS = 64
#: Labelled rows that the fit reads at most, the first by hash of doc_id.
SAMPLE = 20_000
PAIRS = 40_000
#: Ridge of the counts' weights, and of the trigrams', which are many and each say little.
RIDGE, TRIGRAM_RIDGE = 2.0, 200.0


def trigrams(text: np.ndarray) -> np.ndarray:
    """Shares of the buckets among a text's byte trigrams (uint8); zeros for a text of less than three bytes."""
    b = text.astype(np.uint32)
    h = b[:-2] * np.uint32(2654435761) ^ b[1:-1] * np.uint32(2246822519) ^ b[2:] * np.uint32(3266489917)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
    return np.bincount(h >> np.uint32(26), minlength=TRIGRAMS) / max(1, len(h))


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES and TRIGRAMS for each text; null counts as empty. Rates are square roots, which spreads the small ones."""
    out = np.zeros((len(texts), len(FEATURES) + TRIGRAMS))
    for i, t in enumerate(texts.to_pylist()):
        b = (t or "").encode("utf-8", "surrogatepass")
        data = np.frombuffer(b, np.uint8)
        c = np.bincount(data, minlength=256)
        words, lines = b.split(), [x for x in b.split(b"\n") if x]
        n, w = max(1, len(b)), max(1, len(words))
        upper, lower, high = int(c[65:91].sum()), int(c[97:123].sum()), int(c[128:].sum())
        same = sum(map(bytes.__eq__, words, words[1:]))
        out[i, len(FEATURES) :] = trigrams(data)
        out[i, : len(FEATURES)] = (
            min(0.3, max(0, upper - len(lines)) / n),
            min(1.0, int(c[35] + c[36] + c[37] + c[38] + c[42]) / w),
            min(1.0, int(c[124]) / w),
            min(1.0, int(c[33]) / w),
            same / w,
            len(set(words)) / w**0.9,
            1 - len(set(lines)) / max(1, len(lines)),
            (upper + lower + high) / n,
            min(1.0, int(c[46]) / w),
            min(1.0, int(c[44]) / w),
            min(1.0, w / 1000),
        )
    return np.sqrt(out)


@dataclass(frozen=True)
class Ranker:
    weights: tuple
    centre: tuple
    scale: tuple
    cut_at: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.centre)) / np.array(self.scale)) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut_at
        # At the quantile itself the score is exactly the cut.
        s = 1 / (1 + np.exp(-np.clip(z + np.log(self.cut / (1 - self.cut)), -700, 700)))
        return np.where(z >= 0, np.maximum(s, self.cut), np.minimum(s, np.nextafter(self.cut, 0)))


def preferences(z: np.ndarray, good: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Feature differences of seeded pairs, the good one's less the bad one's."""
    rng = np.random.default_rng(seed)
    return z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The quantile of the scores that separates the labels best: the lowest of those with the most right labels, halfway into its gap."""
    order = np.argsort(scores, kind="stable")
    right = good.sum() + np.concatenate([[0], np.cumsum(np.where(good[order], -1, 1))])
    at = [0, *(i for i in range(1, len(scores)) if scores[order[i]] > scores[order[i - 1]])]
    best = max(right[i] for i in at)
    i = [i for i in at if right[i] == best][0]
    return float(scores[order[i]] if i == 0 else (scores[order[i]] + scores[order[i - 1]]) / 2)


def fit(x: np.ndarray, good: np.ndarray, cut: float = 0.3, pairs: int = PAIRS, ridge: float = RIDGE, trigram_ridge: float = TRIGRAM_RIDGE, seed: int = 7) -> Ranker:
    """Newton's method on the pairs' loss. Without a good or without a bad row nothing is preferred, and every score is at the cut."""
    k = x.shape[1]
    if not good.any() or good.all():
        return Ranker((0.0,) * k, (0.0,) * k, (1.0,) * k, 0.0, cut)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - centre) / scale
    d = preferences(z, good, pairs, seed)
    penalty = np.where(np.arange(k) < len(FEATURES), ridge, trigram_ridge)
    w = np.zeros(k)
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), d.T @ p - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Ranker(tuple(w), tuple(centre), tuple(scale), best_cut(z @ w, good), cut)


def learn(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample: int = SAMPLE) -> Ranker:
    """Fits on labels(doc_id, quality) of the documents(doc_id, text) that aren't held out.

    At most `sample` rows are read, those with the smallest hash of doc_id. Null labels, labels of null doc_ids and labels of
    unknown documents are left out; of labels that repeat a doc_id the highest counts, and rows of docs that repeat it all count with it.
    Other columns are ignored, whatever their names. Empty tables give the ranker of no preferences.
    """
    rows = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out())
    ids = rows.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by the sample
    got = _features_of(chosen, "doc_id", "quality").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES) + TRIGRAMS)
    return fit(x, (got["quality"] == 1).to_numpy(), cut)


def held_out():
    """Whether a document's label isn't learnt from; false for a null doc_id, which has no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _features_of(docs: DataFrame, *keep: str) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "x array<double>"]))


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score, a row for each row of docs, null and repeated doc_ids included. An empty or null text has the score of its (zero) features."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ranker.score(features(b.column("text"))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of docs that the ranker doesn't reject, all columns as they are, whatever their names. A null text counts as empty; null and repeated doc_ids stay as they are."""

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(ranker.score(features(b.column("text"))) >= ranker.cut))

    return docs.mapInArrow(run, docs.schema)
