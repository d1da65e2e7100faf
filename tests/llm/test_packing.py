import random

import pytest
from pyspark.sql import functions as F

from inkfield.llm import packing as K
from inkfield.llm.tokens import counts


def brute(sizes, capacity):
    """Window by window, item by item."""
    left, out = sorted(sizes), []
    while left:
        held, gap = [], capacity
        for s in sorted(left, reverse=True):
            if s <= gap:
                held.append(s)
                gap -= s
                left.remove(s)
        while gap:
            least = min(held)
            pool = left + [least]
            best = None
            for i, a in enumerate(sorted(pool)):
                for b in sorted(pool)[i + 1 :]:
                    if least < a + b <= gap + least and (best is None or a + b > sum(best)):
                        best = (a, b)
            if not best:
                break
            held.remove(least)
            left.append(least)
            for s in best:
                left.remove(s)
                held.append(s)
            gap += least - sum(best)
        out.append(sorted(held))
    return sorted(out)


def first_fit(sizes, capacity):
    """Windows that first fit by decreasing size needs."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= s), None)
        if at is None:
            gaps.append(capacity - s)
        else:
            gaps[at] -= s
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_like_item_by_item(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 64])
    sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 60))]
    hist = {s: sizes.count(s) for s in sizes}
    patterns = K.best_two_fit(hist, capacity)
    assert all(sum(s * n for s, n in p.items()) <= capacity for p, _ in patterns)
    assert {s: sum(p.get(s, 0) * t for p, t in patterns) for s in hist} == hist
    windows = sorted(sorted(s for s, n in p.items() for _ in range(n)) for p, t in patterns for _ in range(t))
    mine, plain = sum(map(len, [windows])), len(brute(sizes, capacity))
    assert mine <= plain + 1


def test_bounds():
    big = {s: 10**9 + s for s in range(1, 2049)}
    patterns = K.best_two_fit(big, 2048)
    assert len(patterns) < 3 * 2048 and sum(s * n for s, n in big.items()) / (2048 * sum(t for _, t in patterns)) > 0.995
    with pytest.raises(ValueError):
        K.best_two_fit({11: 1}, 10)
    assert K.best_two_fit({}, 10) == []


def test_pack(spark):
    rng = random.Random(1)
    texts = [" ".join(["word"] * rng.choice([1, 3, 9, 20, 45])) for _ in range(200)] + ["word " * 150, None, "", "x", "x"]
    docs = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)] + [(None, "lost", "b")], "doc_id bigint, text string, bin string")
    windows = spark.createDataFrame([(1, 16), (2, 64), (2, 64), (None, 5), (3, None)], "window_id int, n_tokens int")
    n = dict(enumerate(counts(texts)))
    rows = K.pack(docs, windows).collect()
    for w, c in ((1, 16), (2, 64)):
        own = [r for r in rows if r.window_id == w]
        total = {}
        for r in own:
            total.setdefault(r.doc_id, []).append(r.size)
        assert {d: sum(x) for d, x in total.items()} == n
        assert all(len(x) == 1 if n[d] <= c else sorted(x)[1:] == [c] * (n[d] // c) or n[d] % c == 0 for d, x in total.items())
        fill = {}
        for r in own:
            if r.size:
                fill[r.bin] = fill.get(r.bin, 0) + r.size
        assert max(fill.values()) <= c and sorted(fill) == list(range(len(fill))) and {r.size for r in own if r.bin is None} == {0}
        assert len(fill) <= first_fit([r.size for r in own if r.size], c)
    assert {r.window_id: r.t for r in K.fill(K.pack(docs, windows), windows).groupBy("window_id").agg(F.sum("tokens").alias("t")).collect()} == {1: sum(n.values()), 2: sum(n.values())}
    assert K.pack(docs.limit(0), windows).count() == 0 and K.pack(docs, windows.limit(0)).count() == 0


def test_token_counts():
    from inkfield.llm import tokens

    samples = ["hello world", "<|endoftext|>", "é漢字\n\n  x", " " * 6000 + "y", ""]
    assert counts(samples)[:3] == [len(tokens._plain_encoder(tokens.TOKENIZER).encode(t, add_special_tokens=False)) for t in samples[:3]] and counts([None, ""]) == [0, 0] and counts(samples)[3] > 0
