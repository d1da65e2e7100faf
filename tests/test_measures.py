"""Queries that SQL can't follow, held against plain computations on the same rows."""

import difflib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfield.functions import images as I
from inkfield.functions import sequences as Q
from inkfield.functions import similarity as S
from inkfield.functions import text as T
from inkfield.operators import bleu as B
from inkfield.queries import catalogue
from inkfield.queries.texts import pairs


@pytest.fixture(scope="module")
def rows(spark, data):
    clean = lambda c: T.clean_code(F.col(c))
    got = pairs(spark, data).select("row_id", "original_code", "generated_code", clean("original_code").alias("a"), clean("generated_code").alias("b"), T.preprocess(F.col("original_code")).alias("pa"), T.preprocess(F.col("generated_code")).alias("pb"))
    return {r.row_id: r for r in got.collect()}


def plain_distance(h, r):
    """By the definition, in fifths."""
    if not r:
        return 1.0
    row, visits = [0] + [5] * len(h), [-1] * (len(h) + 1)
    for sign in r:
        new = [row[0] + 5]
        for j in range(1, len(row)):
            new.append(min(row[j - 1] + 5 * (h[j - 1] != sign), row[j] + 5, new[-1] + 1))
        least = new.index(min(new))
        visits[least] += 1
        row = [min(v, new[least] + 10) for v in new] if sign == " " else new
    penalty = 0.3 * sum(v if v >= 0 else 1 for v in visits)
    return min(1.0, (row[-1] / 5 + penalty) / (len(r) + penalty))


def test_edit_distance_of_many():
    rng = random.Random(4)
    words = ["ab", "c", " ", "  ", "draw", "д", "𝒳", "\n"]
    text = lambda: "".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
    some = [(text(), text()) for _ in range(300)] + [("", "a b"), ("a", ""), ("", ""), ("a b", "a b")]
    assert Q.edit_distance_many(some).tolist() == pytest.approx([plain_distance(h, r) for h, r in some]) and len(Q.edit_distance_many([])) == 0


def test_edit_distances(spark, data, rows):
    got = {r.row_id: r.distance for r in catalogue.QUERIES["edit_distances"](spark, data).collect()}
    assert set(got) == set(rows) and all(got[k] == pytest.approx(plain_distance(Q.tex_normal(r.generated_code), Q.tex_normal(r.original_code)), abs=1e-6) for k, r in list(rows.items())[:12])


def bleu_of(pair, shared):
    grams = lambda t, n: Counter(g for g in zip(*(t[i:] for i in range(n))) if g not in shared)
    h, r = pair
    m, t = ([sum((grams(h, n) & grams(r, n)).values()) for n in range(1, 5)], [sum(grams(h, n).values()) for n in range(1, 5)])
    return 0.0 if not all(m) else (1 if len(h) > len(r) else math.exp(1 - len(r) / len(h))) * math.exp(sum(math.log(x / y) for x, y in zip(m, t)) / 4)


def test_final_difficulty(spark, data, rows):
    tokens = {k: (Q.tex_tokens(r.b), Q.tex_tokens(r.a)) for k, r in rows.items()}
    every = Counter(g for _, a in tokens.values() for n in range(1, 5) for g in zip(*(a[i:] for i in range(n))))
    shared = set(sorted(every, key=lambda g: (-every[g], len(g), "\x1f".join(g)))[:500])
    blend = {r.row_id: r for r in catalogue.QUERIES["similarity_full"](spark, data).collect()}
    assert set(blend) == set(rows) and all(blend[k].sequence == pytest.approx(difflib.SequenceMatcher(None, r.a, r.b).ratio(), abs=1e-6) for k, r in rows.items())
    over = {r.row_id: r for r in catalogue.QUERIES["overlap_ratios"](spark, data).collect()}
    bleu = {r.row_id: r.bleu for r in catalogue.QUERIES["tex_bleu"](spark, data).collect()}
    final = {r.row_id: r for r in catalogue.QUERIES["final_difficulty"](spark, data).collect()}
    for k, r in list(rows.items())[:80]:
        scores = {n: over[k][n] for n in ("command", "coordinate", "style", "edge")} | {"sequence": blend[k].sequence}
        have = {n: v for n, v in scores.items() if v is not None}
        lost = sum(S.CUSTOM[n] for n in scores if n not in have) / len(have)
        custom = sum((S.CUSTOM[n] + lost) * v for n, v in have.items())
        ted = Q.edit_distance(Q.tex_normal(r.pb), Q.tex_normal(r.pa))
        want = bleu_of(tokens[k], shared)
        assert (final[k].custom, final[k].bleu, bleu[k], final[k].ted) == pytest.approx((custom, want, want, ted), abs=3e-6) and blend[k].custom == final[k].custom
        assert final[k].difficulty == pytest.approx(1 - (custom + 0.35 * want + 0.25 * (1 - min(ted / 100, 1))), abs=5e-6)


def test_image_measures(spark, data):
    images = {r.row_id: r for r in spark.read.parquet(f"{data}/upload_data.parquet").select("row_id", "original_image", "generated_image").collect()}
    got = {r.row_id: r for r in catalogue.QUERIES["image_measures"](spark, data).collect()}
    assert set(got) == {k for k, r in images.items() if r.original_image is not None and r.generated_image is not None}
    once = {r.row_id: r.rmse for r in catalogue.QUERIES["image_errors_once"](spark, data).collect()}
    for k in list(got)[:80]:
        a, b = (I.decode_png(bytes(images[k][c])).astype(float) for c in ("original_image", "generated_image"))
        ink = ((a <= 250).any(-1)) | ((b <= 250).any(-1))
        d = (a - b)[ink] / 255
        assert (got[k].rmse, got[k].abs_diff) == pytest.approx((np.sqrt((d**2).mean()), np.abs(d).mean()), abs=1e-6) and once[k] == got[k].rmse
        assert got[k].combined == pytest.approx(0.125 * got[k].rmse + 0.125 * (got[k].ssim or 0) + 0.75 * got[k].structural, abs=3e-6)
    shapes = {r.row_id: r for r in catalogue.QUERIES["image_shapes"](spark, data).collect()}
    for k, r in list(images.items())[:80]:
        if r.original_image is not None:
            p = I.decode_png(bytes(r.original_image))
            assert (shapes[k].height, shapes[k].width, shapes[k].colours) == (*p.shape[:2], len({tuple(x) for x in p.reshape(-1, 3).tolist()}))


def test_transport_and_kernel(spark, data):
    from itertools import permutations

    vectors = {r.vec_id: (r.label, np.array(r.embedding, float)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    got = {r.vec_id: r.similarity for r in catalogue.QUERIES["transport_pairs"](spark, data).collect()}
    assert set(got) == {k for k in vectors if k + 1 in vectors}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in list(got)[:3]:
        cost = 1 - unit(vectors[k][1].reshape(8, -1)) @ unit(vectors[k + 1][1].reshape(8, -1)).T
        least = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(8))) / 8
        assert got[k] == pytest.approx(2 * math.tanh(-least) + 1, abs=1e-4)
    row = catalogue.QUERIES["kernel_distance"](spark, data).first()
    sides = [[v for label, v in vectors.values() if label % 2 == s] for s in (0, 1)]
    k = lambda p, q: (np.dot(p, q) / len(p) + 1) ** 3
    same = lambda x: np.mean([k(p, q) for i, p in enumerate(x) for j, q in enumerate(x) if i != j])
    whole = same(sides[0]) + same(sides[1]) - 2 * np.mean([k(p, q) for p in sides[0] for q in sides[1]])
    assert abs(row["mean"] - whole) <= 4 * row["std"] + 1e-6


def test_edit_distance_in_bytes():
    rng = random.Random(5)
    text = lambda parts, n: "".join(rng.choice(parts) for _ in range(rng.randrange(0, n)))
    parts = ["aa", "b", "abcdefg", " ", "abab", "д𝒳", "bababababababa"]
    some = [(text(parts, n), text(parts, n)) for n in (10, 40, 120) for _ in range(40)] + [("a" * 60, "b" * 60), ("", "a" * 22 + " b"), ("ab " * 90, "ab " * 90)]
    assert {max(map(len, r.split(" "))) <= Q.RUN for _, r in some} == {True, False}
    assert Q.edit_distance_many(some).tolist() == pytest.approx([plain_distance(h, r) for h, r in some])
    signs = "".join(chr(0x4E00 + i) + " " for i in range(Q.SIGNS + 5))
    assert Q._byte_distances([(signs, signs)]) is None and Q.edit_distance(signs, signs[4:]) == pytest.approx(plain_distance(signs, signs[4:]))


def test_sequence_ratio_is_difflibs():
    rng, some = random.Random(6), []
    for _ in range(1200):
        letters = rng.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz0123456789[]^-\\ \n", "aбв𝒳 "])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice([2, 40, 450])))) for _ in "ab")
        b = b[:40] + a[10 : rng.randrange(11, 300)] + b[40:]
        some.append((a, b))
    some += [("", ""), ("", "a"), (None, "a"), ("a", None), ("a" * 9000, "ab" * 9000), ("".join(map(chr, range(5000, 9000))), "".join(map(chr, range(7000, 9999))))]
    want = [None if None in p else difflib.SequenceMatcher(None, *p).ratio() for p in some]
    assert Q.sequence_ratios(*zip(*some)) == want and [Q.sequence_ratio(*p) for p in some[:9]] == want[:9]


def test_pair_counts_of_many():
    rng = random.Random(7)
    text = lambda: [rng.choice("abcde") for _ in range(rng.choice([0, 1, 2, 3, 5, 20]))]
    for m in (0, 1, 30):
        pairs, shared = [(text(), text()) for _ in range(m)], frozenset(tuple(rng.choice("abcdez") for _ in range(rng.randrange(1, 5))) for _ in range(m))
        got = B.pair_counts_many(*([p[side] for p in pairs] for side in (0, 1)), shared)
        for (h, r), counts in zip(pairs, got.itertuples(index=False), strict=True):
            grams = lambda t, n: Counter(g for g in B.grams_of(t, n) if g not in shared)
            assert counts == (len(h), len(r), *(x for n in B.ORDERS for x in ((grams(h, n) & grams(r, n)).total(), grams(h, n).total())))


def test_final_difficulty_in_one_pass(spark, data):
    """Codes are cleaned and cut into tokens once for all measures: one Arrow function, and no part joined to the others."""
    plan = catalogue.QUERIES["final_difficulty"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
