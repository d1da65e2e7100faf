import random

import pytest

from inkfield.llm import splits as S
from tests.test_plans import brute as brute_components

ORIGIN = "origin_id bigint, example_number int, author string, figure_ref string, component string"


def test_links(spark):
    rows = [(1, 1, "  AB_0f1 ", None), (2, 2, "ab_0F1", "none"), (3, 2, "unknown", "FIG-00-ab12"), (4, 3, None, "\tfig-00-AB12 "), (5, 4, "unknown", ""), (6, 5, "unknown", ""), (7, 5, "-", "N/A"), (8, None, "ab_0f1", None), (9, 6, "anonymous_x", "fig-1-a"), (10, 7, None, None), (10, 7, None, None)]
    got = {r.node: r.component for r in S.groups(spark.createDataFrame([(*r, "c") for r in rows], ORIGIN)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert S.groups(spark.createDataFrame([], ORIGIN)).count() == 0


def test_allocate_keeps_quotas():
    rng = random.Random(2)
    bundles = [(float(s), y, rng.randrange(1, 40)) for s in range(1, 30) for y in "abc"] + [(900.0, "a", 1), (300.0, "b", 2)]
    plan = S.allocate(bundles, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert [sum(p) for p in plan] == [b[2] for b in bundles] and min(min(p) for p in plan) >= 0
    total = sum(s * n for s, _, n in bundles)
    for k, share in enumerate((0.8, 0.1, 0.1)):
        assert abs(sum(b[0] * p[k] for b, p in zip(bundles, plan)) / total - share) < 0.005
        for y in "abc":
            own = sum(b[0] * b[2] for b in bundles if b[1] == y)
            assert abs(sum(b[0] * p[k] for b, p in zip(bundles, plan) if b[1] == y) / own - share) < 0.06
    assert S.allocate([(5.0, "a", 1)], {"train": 0.8, "test": 0.2}) == [[1, 0]]


def test_flow_is_the_least():
    """Against all ways of sharing out small bundles, and below what rounding by the largest remainders gives."""
    from itertools import product

    import numpy as np

    rng, better = np.random.default_rng(5), 0
    share = np.array([0.8, 0.1, 0.1])
    for _ in range(60):
        n = int(rng.integers(1, 5))
        left, size = rng.integers(0, 3, n), float(rng.integers(1, 30))
        holds = rng.dirichlet(np.ones(3), n) * size
        fair, beyond, off = left[:, None] * share + rng.random((n, 3)) - 0.5, rng.normal(0, 40, 3), rng.normal(0, 20, (3, 3))
        ways = [[w for w in product(range(3), repeat=3) if sum(w) == m] for m in left]
        cost = lambda x: S.flow_cost(np.array(x), size, holds, fair, beyond, off)
        x = S.transport(size, holds, left, fair, beyond, off)
        assert x.sum(1).tolist() == left.tolist() and cost(x) == pytest.approx(min(map(cost, product(*ways))), abs=1e-6)
        rounded = np.zeros((n, 3))
        for b in range(n):
            for j in np.argsort(-fair[b], kind="stable")[: left[b]]:
                rounded[b, j] += 1
        better += cost(x) < cost(rounded) - 1e-6
    assert better > 20


def test_flow_lowers_the_deviation(monkeypatch):
    import numpy as np

    def remainders(size, holds, left, fair, beyond, off):
        x = np.zeros(fair.shape, np.int64)
        for b in range(len(left)):
            for j in np.argsort(-fair[b], kind="stable")[: left[b]]:
                x[b, j] += 1
        return x

    def deviation(bundles, plan):
        total, labels = sum(s * n for s, _, n in bundles), {y for _, p, _ in bundles for y in p}
        goals = sum(abs(sum(b[0] * p[k] for b, p in zip(bundles, plan)) - share * total) for k, share in enumerate(S.PROPORTIONS.values()))
        own = {y: sum(p.get(y, 0) * n for _, p, n in bundles) for y in labels}
        return goals, sum(abs(sum(b[1].get(y, 0) * p[k] for b, p in zip(bundles, plan)) - share * own[y]) for y in labels for k, share in enumerate(S.PROPORTIONS.values()))

    rng = random.Random(6)
    sets = []
    for _ in range(20):
        bundles = []
        for _ in range(rng.randrange(20, 120)):
            size = rng.choice([2, 3, 5, 5, 8, 40])
            a = rng.randrange(size + 1)
            bundles.append((float(size), {"a": a, "b": size - a}, rng.choice([1, 1, 1, 2, 7])))
        sets.append(bundles)
    by_flow = [deviation(b, S.allocate(b, S.PROPORTIONS)) for b in sets]
    monkeypatch.setattr(S, "transport", remainders)
    plain = [deviation(b, S.allocate(b, S.PROPORTIONS)) for b in sets]
    assert all(f[0] < 0.2 * p[0] for f, p in zip(by_flow, plain)) and sum(f[1] for f in by_flow) < 0.5 * sum(p[1] for p in plain)


def test_splits_never_part(spark):
    rng = random.Random(4)
    origin = [(i, rng.randrange(400), f"au_{rng.randrange(300):x}" if rng.random() < 0.7 else "unknown", f"fig-00-{rng.randrange(300):x}" if rng.random() < 0.3 else None, "x") for i in range(350)]
    records = [(i, rng.randrange(500) if rng.random() < 0.7 else 17, rng.choice(["g1", "g2", None]), "e") for i in range(3000)]
    records += records[:50] + [(9001, None, "g1", "e"), (9002, None, None, "e"), (None, 3, "g1", "e")]
    df = spark.createDataFrame(records, "row_id bigint, example_number int, generator string, split string")
    out = S.assign_splits(df, spark.createDataFrame(origin, ORIGIN)).collect()
    assert sorted(r.row_id for r in out) == sorted({r[0] for r in records if r[0] is not None})
    links = [(e, a) for _, e, a, _, _ in origin if a != "unknown"] + [(e, f) for _, e, _, f, _ in origin if f]
    joined = brute_components(links)
    by = {}
    for r in out:
        if r.example_number is not None:
            assert r.component == joined.get(r.example_number, r.example_number)
            by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    sizes = {s: sum(r.split == s for r in out) for s in S.PROPORTIONS}
    assert sum(sizes.values()) == 3002 and abs(sizes["test"] / 3002 - 0.1) < 0.02
    again = {r.row_id: r.split for r in S.assign_splits(df.orderBy("generator"), spark.createDataFrame(origin, ORIGIN)).collect()}
    assert again == {r.row_id: r.split for r in out}
    assert S.assign_splits(df.limit(0), spark.createDataFrame([], ORIGIN)).count() == 0


def test_report_counts_exactly(spark, tmp_path):
    from inkfield.llm import queries

    records = [(i, i // 2, "g1") for i in range(8000)] + [(9001, None, "g1"), (9002, None, None), (9003, None, "g1")]
    spark.createDataFrame(records, "row_id bigint, example_number int, generator string").write.parquet(f"{tmp_path}/upload_data.parquet")
    spark.createDataFrame([(1, 0, "ab_0f1", None, "c"), (2, 1, "ab_0f1", None, "c")], ORIGIN).write.parquet(f"{tmp_path}/example_origin.parquet")
    given = queries.p2_splits(spark, str(tmp_path)).collect()
    have = {r.split: (r.records, r.components) for r in queries.p2_report(spark, str(tmp_path)).collect()}
    want = {s: (sum(r.split == s for r in given), len({r.component if r.component is not None else -r.row_id for r in given if r.split == s})) for s in {r.split for r in given}}
    assert have == want and sum(c for _, c in have.values()) == 4002
