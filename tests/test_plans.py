"""Plan helpers against brute force, under skew, ties, nulls and empty tables."""

import random

from pyspark.sql import functions as F

from inkfield.plans.components import components
from inkfield.plans.order import quantiles, ranked, running
from inkfield.plans.skew import pairs_within, running_before, salted_join


def brute(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for n, k in links:
        if n is not None and k is not None:
            a, b = root(("n", n)), root(("k", k))
            up[a] = b
    groups = {}
    for n, k in links:
        if n is not None and k is not None:
            groups.setdefault(root(("n", n)), set()).add(n)
    return {n: min(g) for g in groups.values() for n in g}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, f"c{i // 2}") for i in range(1, 60)] + [(i + 1, f"c{i // 2}") for i in range(1, 60)]
    star = [(1000 + i, "hub") for i in range(300)]
    rest = [(rng.randrange(2000, 2300), f"r{rng.randrange(260)}") for _ in range(300)]
    links = chain + star + rest + [(None, "hub"), (5, None), (7, "c1"), (7, "c1")]
    df = spark.createDataFrame(links, "node bigint, key string")
    assert {r.node: r.component for r in components(df).collect()} == brute(links)
    assert components(df.limit(0)).count() == 0
    assert [tuple(r) for r in components(spark.createDataFrame([(3, "a"), (4, "b")], "node bigint, key string")).orderBy("node").collect()] == [(3, 3), (4, 4)]


def test_salted_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        have = {tuple(r) for r in salted_join(big, small, "k", F.xxhash64("id"), how, hot_rows=50, salts=4).select("id", "v").collect()}
        assert have == {tuple(r) for r in big.join(small, "k", how).select("id", "v").collect()}


def test_salted_join_by_known_counts(spark):
    big = spark.range(300).select((F.col("id") % 2).alias("k"), "id")
    small = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    for more in ({"counts": counts}, {"most": 300}, {"most": 10}):
        assert salted_join(big, small, "k", F.xxhash64("id"), hot_rows=50, salts=4, **more).count() == 300


def test_pairs_within(spark):
    rows = [("hot", i) for i in range(70)] + [("two", 100), ("two", 101), ("one", 102), (None, 103), (None, 104)]
    df = spark.createDataFrame(rows, "g string, k bigint")
    have = [tuple(r) for r in pairs_within(df, "g", "k", block=8).collect()]
    assert sorted(have) == sorted((a, b) for g, a in rows for h, b in rows if g and g == h and a < b)
    assert pairs_within(df.limit(0), "g", "k").count() == 0


def test_running_before(spark):
    rows = [(g, i, random.Random(i).randrange(-(2**63), 2**63), i % 4) for i in range(500) for g in ("a",) if i % 5 or True] + [("b", 1, 5, 3), ("b", 2, 5, 4)]
    df = spark.createDataFrame(rows, "g string, id bigint, h bigint, w bigint")
    have = {(r.g, r.id): r.before for r in running_before(df, ["g"], "h", "id", F.col("w")).collect()}
    for g in "ab":
        total = 0
        for _, i, _, w in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            assert have[g, i] == total
            total += w


def test_global_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.rank == r.x + 1 for r in ranked(df, [F.col("x")]).collect())
    got = {r.x: r.s for r in running(df, [F.col("x")], {"s": F.col("x")}).collect()}
    assert got[999] == 999 * 500 and got[10] == 55
    q = quantiles(ranked(df.filter("x < 10"), [F.col("x")]), "x", [0.25, 0.5]).first()
    assert tuple(q) == (2.25, 4.5)
    assert ranked(df.limit(0), [F.col("x")]).count() == 0
    assert quantiles(ranked(df.limit(0), [F.col("x")]), "x", [0.5]).first()[0] is None
