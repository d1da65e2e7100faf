"""Difficulty table, evaluation, search, program elements and n-gram precision against brute force and goldens."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkfield.operators import bleu as B
from inkfield.operators import difficulty as D
from inkfield.operators import evaluation as E
from inkfield.operators import programs as P
from inkfield.operators import search as H


def test_difficulty_table(spark):
    rows = [("s1", 1, "main", 0.2, 0.5), ("s1", 2, "3", None, 0.3), ("s2", 3, "1", 1.7, None), ("s2", 4, "2", 0.2, 0.1), ("s2", 1, "main", 0.9, 0.9), ("s3", None, "1", 0.1, 0.1), ("s3", 5, "x", 0.1, 0.1)]
    df = spark.createDataFrame(rows, "shard_file string, example_number int, combination_number string, image_similarity double, code_similarity double").withColumn("written_at", F.lit(None).cast("timestamp"))
    out = {r.example_number: r for r in D.difficulty_table(df).collect()}
    assert {k: (round(r.combined_score, 6), r["rank"]) for k, r in out.items()} == {1: (0.29, 2), 2: (0.79, 3), 3: (1.0, 4), 4: (0.17, 1)}
    assert out[1].combination_number == -1 and out[3].rank_norm == 1.0
    t = D.difficulty_table(df)
    assert D.describe(t).first()["q50"] == pytest.approx(0.54)
    assert D.quartiles(t).groupBy("quartile").count().count() == 4
    assert D.difficulty_table(df.limit(0)).count() == 0 and D.describe(D.difficulty_table(df.limit(0))).first()["count"] == 0


def test_winsorised_mean(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 5.0, -3.0])) for g in "ab" for _ in range(157 if g == "a" else 9)] + [("c", None), ("a", None)]

    def plain(x):
        x, k = sorted(x), int(0.05 * len(x))
        return sum(min(max(v, x[k]), x[-1 - k]) for v in x) / len(x)

    have = {r.g: r["mean"] for r in E.winsorised_mean(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert have == {g: pytest.approx(plain([v for h, v in rows if h == g and v is not None])) for g in "ab"}


def test_deal_and_back(spark):
    df = spark.range(7)
    rows = E.sharded(df, [F.col("id")], 3).orderBy("pos", "shard").collect()
    assert [r.id for r in rows] == list(range(7))
    assert [[r.id for r in rows if r.shard == s] for s in range(3)] == [[0, 3, 6], [1, 4], [2, 5]]


def test_best_and_stop(spark):
    c = spark.createDataFrame([(1, 0, 0.5, 10), (1, 1, 0.9, 30), (1, 2, 0.9, 60), (2, 0, None, 5)], "i int, k int, s double, n int")
    assert {(r.i, r.k) for r in E.best_of(c, "i", "s", "k").collect()} == {(1, 1), (2, 0)}
    assert {r.i: r.efficiency for r in E.token_efficiency(c, "i", "s", "n", "k").collect()} == {1: 0.3, 2: 1.0}
    r = spark.createDataFrame([(1, t, t == 3, float(t)) for t in range(9)] + [(2, 0, False, 0.0)], "i int, o int, ok boolean, e double")
    keep = lambda timeout, cap: sorted((x.i, x.o) for x in E.until_stop(r, "i", "o", F.col("ok"), F.col("e"), timeout, cap).collect())
    assert keep(None, 99) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)] and len(keep(5.0, 7)) == 9
    m = E.minmax(spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 6.0), (2, 5.0)], "g int, v double"), "g", "v")
    assert sorted(x.norm for x in m.collect()) == [0, 0, 0.5, 1]


def test_search(spark):
    cut = spark.createDataFrame([(6,), (7,)], "n int").select(H.expansion(F.col("n"))).collect()
    assert [r[0] for r in cut] == [2, 3]
    nodes = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, 1, 2.0), (1, 3, 1, 4.0), (1, 4, 3, 8.0), (2, 1, None, 5.0)], "t int, n int, p int, v double")
    assert {(r.t, r.n): (r.visits, r.value) for r in H.back_propagated(nodes, "t", "n", "p", "v").collect()} == {(1, 1): (4, 15.0), (1, 2): (1, 2.0), (1, 3): (2, 12.0), (1, 4): (1, 8.0), (2, 1): (1, 5.0)}
    assert {(r.t, r.n): r.depth for r in H.depths(nodes, "t", "n", "p").collect()} == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (2, 1): 0}
    assert [r.n for r in H.descent(nodes, "t", "n", "p", "v").filter("t = 1").orderBy("step").collect()] == [1, 3, 4]
    u = spark.range(1).select(H.uct(F.lit(3.0), F.lit(2), F.lit(10)), H.uct(F.lit(3.0), F.lit(0), F.lit(10), widen=F.lit(True)), H.reward(F.lit(None).cast("double"), F.lit(True), F.lit(True)), H.reward(F.lit(0.4), F.lit(True), F.lit(True)), H.reward(F.lit(0.4), F.lit(False), F.lit(True)), H.failed_expansion(F.lit(16), F.lit(4), F.lit(1))).first()
    assert u[0] == pytest.approx(1.5 + 0.6 * math.sqrt(math.log(10) / 2)) and u[1] == pytest.approx(0.6 * math.sqrt(math.log(10))) and u[2:] == (0.0, 0.4, -1.0, 2)


def test_deep_trees(spark):
    chain = spark.createDataFrame([(1, i, i - 1 if i else None, 1.0) for i in range(8)], "t int, n int, p int, v double")
    args = (chain, "t", "n", "p", "v")
    assert {r.n: r.visits for r in H.back_propagated(*args, max_depth=7).collect()} == {i: 8 - i for i in range(8)}
    assert H.depths(*args[:4], max_depth=8).count() == 8 == H.descent(*args, max_depth=8).count()
    for call in (lambda: H.back_propagated(*args, max_depth=4), lambda: H.depths(*args[:4], max_depth=4), lambda: H.descent(*args, max_depth=4)):
        with pytest.raises(RuntimeError, match="not closed"):
            call()


def test_programs(spark):
    d = spark.createDataFrame([("a", ["\\coordinate (p) at (0,1);", "\\draw (p) -- (0,1);", "\\node {x};", "\\end{scope}"]), ("b", [])], "id string, e array<string>")
    parts = P.elements(d, "id", F.col("e"))
    assert {(r.src, r.dst) for r in P.dependencies(parts, "id").collect()} == {(0, 1), (1, 0), (0, 3), (1, 3)} - {(0, 3), (1, 3)} | {(s, t) for s, t in ((0, 3), (1, 3)) if "p" in "\\end{scope}"}
    strict = P.dependencies(parts, "id", strict=True)
    assert {(r.src, r.dst) for r in strict.collect()} == {(0, 1)}
    assert [(r.size, len(r.prefix)) for r in P.prefixes(d, "id", F.col("e")).orderBy("size").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert P.prefixes(d, "id", F.col("e"), most=2).count() <= 2
    assert P.subset_validity(3, [(0, 1), (1, 2)]) == [1, 2, 3, 4, 6, 7] and P.subset_validity(2, [(0, 1), (1, 0)]) == [1, 2]
    assert {r.mask for r in P.valid_subsets(parts, strict, "id").collect()} == {1, 2, 3, 4, 8}
    with pytest.raises(ValueError):
        P.subset_validity(P.MOST_ELEMENTS + 1, [])


def test_subsets_of_any_size(spark):
    rng = random.Random(6)

    def valid(n, edges, mask):
        held = [i for i in range(n) if mask >> i & 1]
        inner = [(a, b) for a, b in edges if a != b and a in held and b in held]
        reach = {held[0]}
        for _ in held:
            reach |= {x for a, b in inner for x in (a, b) if a in reach or b in reach}
        left = set(held)
        for _ in held:
            left -= {i for i in left if not any(b == i and a in left for a, b in inner)}
        return len(reach) == len(held) and not left

    for n in [*range(8), 7, 7]:
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))] if n else []
        found = list(P.grow_subsets(n, edges))
        assert sorted(found) == [m for m in range(1, 1 << n) if valid(n, edges, m)] and len(set(found)) == len(found)
    # A chain of 20 lines has a subset for each of its runs; lines without a dependency are subsets of their own.
    d = spark.createDataFrame([("chain", [f"\\draw (n{i}) -- (n{i + 1});" for i in range(20)]), ("plain", ["\\draw x;"] * 70), ("few", ["\\draw x;"] * 13), ("none", [])], "id string, e array<string>")
    parts = P.elements(d, "id", F.col("e"))
    strict = P.dependencies(parts, "id", strict=True)
    assert {r.id: r.subsets for r in P.subset_counts(parts, strict, "id").collect()} == {"chain": 210, "plain": 70, "few": 13}
    fits = P.valid_subsets(parts.filter("id <> 'plain'"), strict, "id").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in fits} == {"chain": 210, "few": 13}
    with pytest.raises(Exception, match="at most 63 elements"):
        P.valid_subsets(parts, strict, "id").collect()


def test_bleu(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randrange(0, 15))], [rng.choice("abcd") for _ in range(rng.randrange(1, 15))]) for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(h), " ".join(r)) for i, h, r in rows], "id int, h string, r string")
    frequent = B.trivial(B.corpus_grams(df, F.col("r")), 3)
    every = Counter(g for _, _, r in rows for n in B.ORDERS for g in B.grams_of(r, n))
    assert {(x.n, tuple(x.gram.split(B.JOINT)), x.total) for x in B.corpus_grams(df, F.col("r")).collect()} == {(len(g), g, c) for g, c in every.items()}
    out = B.shared_grams(frequent)
    assert len(out) == 3 and min(every[g] for g in out) >= sorted(every.values())[-3]
    grams = lambda t, n: Counter(g for g in B.grams_of(t, n) if g not in out)
    pairs = df.select("id", B.pair_counts(F.col("h"), F.col("r"), out).alias("b")).select("id", "b.*")

    def score(sub):
        m = [sum(sum((grams(a, n) & grams(b, n)).values()) for _, a, b in sub) for n in range(1, 5)]
        t = [sum(sum(grams(a, n).values()) for _, a, b in sub) for n in range(1, 5)]
        hyp, ref = sum(len(a) for _, a, _ in sub), sum(len(b) for _, _, b in sub)
        return 0.0 if not all(m) else (1 if hyp > ref else math.exp(1 - ref / hyp)) * math.exp(sum(math.log(a / b) for a, b in zip(m, t)) / 4)

    assert B.corpus_bleu(pairs.withColumn("g", F.lit(1)), ["g"]).first()["bleu"] == pytest.approx(score(rows))
    running = {x.id: x.bleu for x in B.running_bleu(pairs, [F.col("id")]).collect()}
    assert all(running[i] == pytest.approx(score(rows[: i + 1])) for i in range(30))
    assert all(x.bleu == pytest.approx(score([rows[x.id]])) for x in B.pair_bleu(pairs).collect())
    held = B.RunningBleu(out)
    for part in ("id < 10", "id >= 10"):
        held.update(df.filter(part), "h", "r")
    assert held.compute(spark) == pytest.approx(score(rows)) and {x.id for x in held.per_row(df, "h", "r").collect()} == set(range(30))
    held.reset()
    assert held.compute(spark) == 0.0
    odd = spark.createDataFrame([(1, None, "a b"), (2, "", None), (3, "a", "a")], "id int, h string, r string")
    got = {x.id: tuple(x.b) for x in odd.select("id", B.pair_counts(F.col("h"), F.col("r")).alias("b")).collect()}
    assert got == {1: (0, 2, *[0] * 8), 2: (0,) * 10, 3: (1, 1, 1, 1, *[0] * 6)}
    assert B.corpus_grams(odd.limit(0), F.col("h")).count() == 0


