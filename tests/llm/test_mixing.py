import random

import pytest
from pyspark.sql import functions as F

from inkfield.llm import mixing as M
from inkfield.llm.tokens import counts


def test_water_fill():
    have, share, most = {"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 2, "b": 4, "c": 1, "d": 3}
    free = M.water_fill(have, share, most)
    assert free["b"] == pytest.approx(40) and free["a"] / free["b"] == pytest.approx(5 / 3) and free["d"] == 0
    held = M.water_fill(have, share, most, 300)
    assert held["b"] == 40 and held["a"] == pytest.approx(260 * 5 / 7) and held["c"] == pytest.approx(260 * 2 / 7)
    full = M.water_fill(have, share, most, 10**6)
    assert full == {"a": 200, "b": 40, "c": 1000, "d": 0}
    assert M.water_fill({}, share, most) == dict.fromkeys(share, 0.0)


def test_top_up():
    assert M.top_up({3: 1, 5: 1, 9: 1}, 8) == {5: 1, 3: 1} and M.top_up({9: 1}, 8) == {9: 1} and M.top_up({9: 1}, 4) == {}
    assert M.top_up({4: 5, 7: 1}, 18.5) == {7: 1, 4: 3} and M.top_up({4: 1, 3: 9}, 13) == {4: 1, 3: 3} and M.top_up({}, 5) == {}


def test_all_records_can_close_a_gap(spark):
    """One long record after hundreds of long ones has just the size that is missing, whatever its place."""
    rows = [(i, "word " * 60, "a") for i in range(900)] + [(10_000, "word " * 31, "a")] + [(20_000 + i, "word " * 60, "b") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    size = {i: counts([t])[0] for i, t, _ in (rows[0], rows[900])}
    total = (2 * size[0] + size[10_000]) / 0.9
    out = {r.doc_id: r.tokens for r in M.mix(docs, targets, total).collect() if r.source == "a"}
    assert 10_000 in out and sum(out.values()) == pytest.approx(total * 0.9)


def test_repeated_keys_count_once(spark):
    docs = spark.createDataFrame([(i % 50, "word " * (i % 50 + 1), "a") for i in range(200)], "doc_id bigint, text string, source string")
    out = M.mix(docs, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")).collect()
    assert len(out) == 50 and all(r.uses == 2 for r in out)


def test_mix(spark):
    rng = random.Random(8)
    texts = [("ab"[i % 2] if i % 7 else "c", "word " * rng.randrange(1, 40)) for i in range(600)]
    rows = [(i, t, s, 1) for i, (s, t) in enumerate(texts)] + [(9001, None, "a", 1), (9002, "", "b", 1), (9003, "x", None, 1), (9004, "x", "zero", 1), (None, "x", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, uses int")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 1), ("c", 0.3, 4), ("zero", 0.0, 2), ("gone", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    n = {i: counts([t])[0] for i, t, s, _ in rows if i is not None}
    for total in (None, 20_000):
        out = M.mix(docs, targets, total).collect()
        assert len({r.doc_id for r in out}) == len(out) and all(n[r.doc_id] == r.tokens for r in out)
        assert all(1 <= r.uses <= {"a": 3, "b": 1, "c": 4}[r.source] for r in out)
        got = {s: sum(r.tokens * r.uses for r in out if r.source == s) for s in "abc"}
        have = {s: sum(n[i] for i, _, z, _ in rows if z == s and i is not None) for s in "abc"}
        want = M.water_fill(have, {"a": 0.5, "b": 0.2, "c": 0.3}, {"a": 3, "b": 1, "c": 4}, total)
        assert all(abs(got[s] - want[s]) <= 3 for s in "abc")
        assert all(max(r.uses for r in out if r.source == s) - min(r.uses for r in out if r.source == s) <= 1 for s in "abc")
    report = {r.source: r for r in M.shares(M.mix(docs, targets), targets).collect()}
    assert abs(report["a"].share - 0.5) < 0.01 and report["zero"].records == 0
    assert sorted(r[:] for r in M.mix(docs.orderBy(F.desc("doc_id")), targets).collect()) == sorted(r[:] for r in M.mix(docs, targets).collect())
    assert M.mix(docs.limit(0), targets).count() == 0 and M.mix(docs, targets.limit(0)).count() == 0
    assert M.shares(M.mix(docs.limit(0), targets), targets).filter("share = 0").count() == 5


def test_budget_draw_clamps(spark, data):
    from inkfield.llm import queries

    most = {r.source: r.max_repeats for r in spark.read.parquet(f"{data}/mix_targets.parquet").collect()}
    drawn = queries.QUERIES["p7_budget_mix"](spark, data).collect()
    tokens = {s: sum(r.tokens * r.uses for r in drawn if r.source == s) for s in most}
    assert all(1 <= r.uses <= most[r.source] for r in drawn) and any(all(r.uses == most[s] for r in drawn if r.source == s) for s in most if tokens[s])
    assert {r.source: r.tokens for r in queries.p7_budget_shares(spark, data).collect()} == tokens
