import random

from talkgrain.llm.bwt import END, build, merge, repeated_intervals


def rows(shards):
    out = [(s[i:], sh, t, s[i - 1] + 1 if i else END, i) for sh, texts in enumerate(shards) for t, s in enumerate(texts) for i in range(len(s) + 1)]
    return sorted(out, key=lambda x: x[:3])


def test_merge_against_sorting():
    r = random.Random(1)
    for _ in range(150):
        shards = [[bytes(r.choice(b"abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 4))] for _ in range(2)]
        want = rows(shards)
        lcp = [0]
        for x, y in zip(want, want[1:], strict=False):
            k = 0
            while k < min(len(x[0]), len(y[0])) and x[0][k] == y[0][k]:
                k += 1
            lcp.append(k)
        bwt, got, z = merge(build(shards[0]), build(shards[1]), 20)
        assert bwt.tolist() == [x[3] for x in want] and got.tolist() == lcp and z.tolist() == [x[1] == 1 for x in want]
        # The repeated intervals are the strings that occur twice.
        spans = {s[i : i + 3] for texts in shards for s in texts for i in range(len(s) - 2)}
        many = {x for x in spans if sum(s[i : i + 3] == x for texts in shards for s in texts for i in range(len(s) - 2)) > 1}
        assert {want[i][0][:3] for i, _ in repeated_intervals(got, 3)} == many
        # Rounds may stop at the length asked for: what shares it is in one interval, if in no order yet.
        assert merge(build(shards[0]), build(shards[1]), 3)[1].tolist() == [min(x, 3) for x in lcp]


def test_three_shards():
    a, b, c = ([b"banana"], [b"ananas", b""], [b"nab"])
    ab = merge(build(a), build(b), 9)[0]
    assert merge(ab, build(c), 9)[0].tolist() == [x[3] for x in rows([a, b, c])]
