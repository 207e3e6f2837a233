import corpus_pipeline as cp
from talkgrain.llm import mixing, ngram_join, piece_sampling, quality, suffix_dedup
from talkgrain.llm.common import Scratch, table
from tests.llm.fixtures import rows
from tests.llm.test_pairs import brute_links
from tests.llm.test_repeats import brute_rest

D = "/root/testdata/sf0.001"


def test_stages_follow_brute_force(spark, tmp_path):
    docs = table(spark, D, "documents")
    names = docs.columns
    results = []
    for name, stage in cp.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results.append(docs)
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "encoding"]
    assert all(r.columns == names for r in results[:-1])
    good, single, cut, mixed, pieces = results

    raw = table(spark, D, "documents")
    ranker = quality.learn(raw, table(spark, D, "labels"))
    score = {r["doc_id"]: r["score"] for r in rows(quality.scored(raw, ranker))}
    assert {r["doc_id"] for r in rows(good)} == {d for d, s in score.items() if s >= ranker.cut}

    assert sorted(r["doc_id"] for r in rows(single)) == [d for d, _, c in brute_links(rows(good)) if d == c]

    before = rows(single)
    left = brute_rest([r["text"].encode() for r in before], 400, 51)
    assert {r["doc_id"]: r["text"].encode() for r in rows(cut)} == {r["doc_id"]: t for r, t in zip(before, left, strict=True)}  # no range here cuts a character

    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.mix(cut, Scratch(spark, "t"))) if r["taken"]}
    words = {}
    for r in rows(mixed):
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == taken

    p = piece_sampling.load()
    texts = sorted((r["doc_id"], r["text"]) for r in rows(mixed))
    assert sorted((r["doc_id"], piece_sampling.decode(r["ids"], p).decode()) for r in rows(pieces)) == texts
    assert suffix_dedup.LEAST == 400 and ngram_join.THRESHOLD == 0.8


def test_run(spark):
    out = cp.run(spark, D)
    assert out.columns == ["doc_id", "n_pieces", "ids"] and out.count() > 0
