import math
import random

import pytest
from pyspark.sql import functions as F

from inkfield.llm import ranking as R


def brute(rows, weights=(1, 1, 1), tail=R.TAIL, e=R.EXPONENT):
    out, groups = {}, {}
    for g, k, *x in {r[1]: r for r in rows if r[0] is not None and r[1] is not None and all(v is not None and v == v for v in r[2:])}.values():
        groups.setdefault(g, []).append((k, x))
    for g, members in groups.items():
        good, bad = dict.fromkeys((k for k, _ in members), 0.0), dict.fromkeys((k for k, _ in members), 0.0)
        for i, w in enumerate(weights):
            v = sorted(x[i] for _, x in members)
            q = lambda p: v[max(0, -(-int(round(p * len(v) * 10**9)) // 10**9) - 1)]
            lo, hi = q(tail), q(1 - tail)
            y = {k: min(max(x[i], lo), hi) - lo for k, x in members}
            norm = math.hypot(*y.values())
            if norm > 0:
                for k in y:
                    good[k] += (w * y[k] / norm) ** e
                    bad[k] += (w * (max(y.values()) - y[k]) / norm) ** e
        for k in good:
            near, far = good[k] ** (1 / e), bad[k] ** (1 / e)
            out[k] = (g, far / (near + far) if near + far else 1.0)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "g bigint, k bigint, a double, b double, c double, _s0 string").select("*")


ROWS = [(g, g * 1000 + i, random.Random(g * i).random() ** 5 * 1000, 0.4 + random.Random(i).random() / 100, float(random.Random(i + g).randrange(4))) for g in (1, 2) for i in range(60)]
ODD = [(3, 1, 1.0, 1.0, 1.0), (3, 1, 1.0, 1.0, 1.0), (3, 2, 1.0, 1.0, 1.0), (3, 3, None, 1.0, 1.0), (3, 4, float("nan"), 1.0, 1.0), (None, 5, 1.0, 2.0, 3.0), (3, None, 1.0, 2.0, 3.0), (4, 6, 0.0, 0.0, 0.0)]


def test_against_brute_force(spark):
    rows = ROWS + ODD
    got = {r.k: (r.g, r.closeness) for r in R.ideal_point(frame(spark, [(*r, "x") for r in rows]), "g", "k", ["a", "b", "c"]).collect()}
    want = brute(rows)
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)
    assert got[1][1] == got[2][1] == got[6][1] == 1.0


def test_every_step_counts(spark):
    """Tails are pulled in, the norm doesn't cancel, and the order isn't that of a sum of scaled scores."""
    plain = {k: v[1] for k, v in brute(ROWS).items()}
    others = [{k: v[1] for k, v in brute(ROWS, **o).items()} for o in ({"tail": 1e-9}, {"e": 1.0})]
    order = lambda c: sorted((k for k in c if k < 2000), key=lambda k: -c[k])
    assert all(order(plain) != order(o) for o in others)


def test_sketched_quantiles_of_a_large_group(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("a"))
    got = R.ideal_point(rows, "g", "k", ["a"]).filter("closeness = 1").count()
    assert abs(got - R.TAIL * n) <= n / R.ACCURACY + 1


def test_scale_does_not_matter(spark):
    base = R.ideal_point(frame(spark, [(*r, "x") for r in ROWS]), "g", "k", ["a", "b", "c"])
    big = R.ideal_point(frame(spark, [(g, k, a * 1e6 + 5, b, c / 1000, "x") for g, k, a, b, c in ROWS]), "g", "k", ["a", "b", "c"])
    a, b = ({r.k: r.closeness for r in x.collect()} for x in (base, big))
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_places(spark):
    ranked = R.ideal_point(frame(spark, [(*r, "x") for r in ROWS + ODD]), "g", "k", ["a", "b", "c"])
    rows = {(r.g, r.k): r for r in R.places(ranked, "g", "k").collect()}
    for g in {k[0] for k in rows}:
        order = sorted((r for r in rows.values() if r.g == g), key=lambda r: (-r.closeness, r.k))
        assert [r.place for r in order] == list(range(1, len(order) + 1))
    top = {(r.g, r.k) for r in R.best(ranked, "g", "k", 3).collect()}
    assert top == {k for k, r in rows.items() if r.place <= 3}


def test_empty_and_weights(spark):
    empty = frame(spark, [(1, 1, 1.0, 1.0, 1.0, "x")]).limit(0)
    assert R.places(R.ideal_point(empty, "g", "k", ["a"]), "g", "k").count() == 0
    with pytest.raises(ValueError):
        R.ideal_point(empty, "g", "k", ["a", "b"], [1.0])
    one = R.ideal_point(frame(spark, [(*r, "x") for r in ROWS]), "g", "k", ["a", "b", "c"], [0.0, 1.0, 0.0])
    order = [r.k for r in one.filter("g = 1").orderBy("closeness", ascending=False).collect()]
    assert order[0] == min((r for r in ROWS if r[0] == 1), key=lambda r: r[3])[1] or len(order) == 60


def test_hot_group(spark):
    rows = [(1, i, float(i % 977), float(i % 31), float(i), "x") for i in range(4000)] + [(2, 10**6 + i, float(i), 1.0, 2.0, "x") for i in range(5)]
    ranked = R.ideal_point(frame(spark, rows), "g", "k", ["a", "b", "c"])
    assert ranked.count() == 4005 and R.places(ranked, "g", "k").filter("g = 1").agg({"place": "max"}).first()[0] == 4000
