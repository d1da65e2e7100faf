import random

import numpy as np
import pytest

from inkfield.llm import repetition as P


def brute(text, passage=P.PASSAGE):
    t = "".join((text or "").split())
    seen, covered = set(), [False] * len(t)
    for i in range(len(t) - passage + 1):
        w = t[i : i + passage]
        if w in seen:
            covered[i : i + passage] = [True] * passage
        seen.add(w)
    return sum(covered) / len(t) if t else 0.0


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["alpha", "бета", "\\draw", "(0,1)", "--", "漢字", ";", "\n", "x\u00a0y", "𝒳"]
    out = [None, "", " \n", "a" * 39, "a" * 40, "a" * 41, "ab" * 300]
    for i in range(n):
        t = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 120))]
        out.append(" ".join(t * (1 if i % 3 else rng.randrange(1, 6)) + t[: i % 7]))
    return out


def test_exact_share():
    for group in (texts(200), texts(60, 1) + ["long " * 40000]):
        assert P.repeated_shares(group) == pytest.approx([brute(t) for t in group])


def test_collisions_of_upper_bits(monkeypatch):
    real = P._pairs
    monkeypatch.setattr(P, "_pairs", lambda keyed, bits: real(keyed, max(bits, 50)))
    group = texts(80, 2)
    assert P.repeated_shares(group) == pytest.approx([brute(t) for t in group])


def test_reach_bounds_the_share(spark):
    rng = random.Random(9)
    group = texts(300, 3) + ["ab" * 30_000, "long words " * 400]
    for i in range(200):  # repeated passages of just over the least length, at any shift
        passage = "".join(rng.choice("abcdefgh") for _ in range(40 + i % 25))
        noise = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(60)))
        group.append(noise() + passage + noise() + passage + noise() + passage[: rng.randrange(41)])
    df = spark.createDataFrame(list(enumerate(group)), "i int, t string")
    got = {r.i: r.x for r in P.with_statistics(df, "t", "x").collect()}
    shares = P.repeated_shares(group)
    assert all(got[i].reach >= s - 1e-12 for i, s in enumerate(shares) if group[i] is not None)
    assert [tuple(got[i]) for i in (1, 2)] == [(0, 0, 0)] * 2 and got[0].chars is None
    assert got[300 + 7].reach > 1 and sum(x.reach <= 0.5 for i, x in got.items() if x.reach is not None) > 100
    assert [x.statement_dup for x in (r.x for r in P.with_statistics(spark.createDataFrame([("a;b;a;",), ("a b; ab",)], "t string"), "t", "x").collect())] == pytest.approx([1 - 2 / 3, 0.5])


def test_without_blanks(spark):
    group = [t for t in texts(100, 5) if t] + ["a\x0b\x0c\x1c\x1d\x1e\x1f\t\r\nb", "\x85\u2003é \u3000", "  "]
    df = spark.createDataFrame([(t,) for t in group], "t string").select("t", P.without_blanks("t").alias("b"))
    assert all(r.b == "".join(r.t.split()) for r in df.collect())


def test_learner():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    y = (x["a"] < 0.4) & (x["b"] > 0.3) | (x["c"] > 0.9)
    rules = P.learn(x, y)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= r.covers(x, 900)
    assert rules and not (hit & ~y).any() and (hit & y).sum() > 0.9 * y.sum()
    z = {k: rng.random(900) for k in x}
    truth, hit = (z["a"] < 0.4) & (z["b"] > 0.3) | (z["c"] > 0.9), np.zeros(900, bool)
    for r in rules:
        hit |= r.covers(z, 900)
    assert (hit == truth).mean() > 0.93  # held out


def test_repeated(spark):
    group = texts(300, 4)
    rows = [(i, t, "x") for i, t in enumerate(group)] + [(7, group[7], "x"), (None, "ab" * 100, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, generated_code string, share string")
    want = {i: round(brute(t), 6) for i, t in enumerate(group)}
    rules = P.learn_plain(df, "row_id", "generated_code", 0.5, 100)
    assert rules and all(("reach", "le") in [t[:2] for t in r.terms] for r in rules)
    for r in (None, rules, []):
        assert {x.row_id: x.share for x in P.repeated(df, rules=r).collect()} == pytest.approx({i: s for i, s in want.items() if s > 0.5})
    assert {x.row_id: x.share for x in P.shares(df).collect()} == pytest.approx(want)
    assert P.repeated(df.limit(0)).count() == 0 and P.learn_plain(df.limit(0), "row_id", "generated_code", 0.5) == []
