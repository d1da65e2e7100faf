"""Functions by distinct input, known prefixes, metrics by name, draws, sorted checks."""

import pytest
from pyspark.sql import functions as F

from inkfield.operators import difficulty as D
from inkfield.operators import evaluation as E
from inkfield.operators import reuse as R
from inkfield.operators import search as H


def test_by_distinct_input(spark):
    rows = [(1, "a", "b"), (2, "a", "b"), (3, None, "b"), (4, None, "b"), (5, "null", "b"), (6, "", None)]
    df = spark.createDataFrame(rows, "k int, x string, y string")
    out = R.by_distinct_input(df, ["x", "y"], F.concat(F.coalesce("x", F.lit("-")), F.coalesce("y", F.lit("-"))), "z", "k")
    assert {r.k: r.z for r in out.collect()} == {k: (x if x is not None else "-") + (y if y is not None else "-") for k, x, y in rows}
    assert R.by_distinct_input(df.limit(0), ["x"], F.col("x"), "z", "k").count() == 0


def test_longest_known_prefix(spark):
    c = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b"]), (3, []), (4, ["a", None])], "k int, p array<string>")
    known = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "x"],), ([],)], "p array<string>")
    assert {r.k: r.depth for r in R.longest_known_prefix(c, known, "k", "p").collect()} == {1: 2, 2: 0, 3: 0, 4: 1}


def test_metrics():
    R.register_metric("zero", lambda a, b: F.lit(0))
    assert R.metric("zero") is R.METRICS["zero"] and R.metric(len) is len
    with pytest.raises(KeyError):
        R.metric("none such")


def test_sorted(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (1, 3, 5.0), (2, 1, 3.0), (2, 2, 2.0), (3, 1, None), (None, 1, 1.0)], "g int, o int, v double")
    assert {r.g: r["sorted"] for r in D.is_sorted(df, ["o"], "v", ["g"]).collect()} == {1: True, 2: False, 3: True, None: True}


def test_draw_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 6), ("b", 9, 2)], "g string, n int, v int")
    assert {r.g: r.n for r in H.draw_by_visits(df, "g", "n", "v", F.lit(0.25)).collect()} == {"a": 2, "b": 9}
    assert E.winsorised_mean(df.limit(0), ["g"], "v").count() == 0 and E.minmax(df.limit(0), "g", "v").count() == 0
    assert H.draw_by_visits(df.limit(0), "g", "n", "v", F.lit(0.5)).count() == 0


def test_lazy_metrics():
    R.register_metric("late", "inkfield.functions.vectors:dot")
    R.register_metric("missing", "no_such_module:f")
    from inkfield.functions.vectors import dot

    assert R.metric("late") is dot
    with pytest.raises(ModuleNotFoundError):
        R.metric("missing")


def test_growing_and_merging(spark):
    nodes = spark.createDataFrame([(1, 1, "ab"), (1, 2, ""), (1, 3, None)], "t int, n int, s string")
    kids = H.grown(nodes, "t", "n", "s", lambda c: F.split(c, "", -1), lambda c: F.length(c))
    assert sorted((r.parent, r.state, r.value) for r in kids.filter("state <> ''").collect()) == [(1, "a", 1), (1, "b", 1)]
    children = spark.createDataFrame([(1, 0, 5, "x", 2, 1.0), (1, 0, 4, "x", 3, 0.5), (1, 0, 6, None, 1, 0.0), (1, 0, 7, None, 1, 1.0), (1, 9, 8, "x", 1, 1.0)], "t int, p int, n int, s string, v int, w double")
    got = sorted((r.p, r.n, r.s or "", r.v, r.w, r.merged) for r in H.merged_children(children, "t", "p", "n", "s", "v", "w").collect())
    assert got == [(0, 4, "x", 5, 1.5, 2), (0, 6, "", 2, 1.0, 2), (9, 8, "x", 1, 1.0, 1)]
    assert [tuple(r) for r in H.expansion_counts(children, ["t"], F.col("w") < 1).collect()] == [(1, 5, 2)]


def test_ties_by_hash(spark):
    rows = [(t, 1, None, 0.0) for t in range(40)] + [(t, n, 1, 0.5) for t in range(40) for n in (2, 3, 4)]
    df = spark.createDataFrame(rows, "t int, n int, p int, s double")
    first = lambda seed: {r.t: r.n for r in H.descent(df, "t", "n", "p", "s", seed=seed).filter("step = 1").collect()}
    assert set(first(None).values()) == {2}
    a, b = first(1), first(2)
    assert a == first(1) and a != b and set(a.values()) <= {2, 3, 4} and len(set(a.values())) > 1


def test_deep_trees_raise(spark):
    chain = spark.range(1200).select(F.lit(1).alias("t"), (F.col("id") + 1).alias("n"), F.when(F.col("id") > 0, F.col("id")).alias("p"), F.lit(1.0).alias("v"))
    for walk in (H.back_propagated, H.depths, H.descent):
        with pytest.raises(RuntimeError):
            walk(chain, "t", "n", "p", "v", max_depth=30) if walk is not H.depths else walk(chain, "t", "n", "p", max_depth=30)


def test_models_means_and_attempts(spark):
    assert E.model_paths(["a=x.json", "b = y=z", "a=w"]) == {"a": "w", "b": "y=z"}
    for bad in ("a", "=x", "a="):
        with pytest.raises(ValueError):
            E.model_paths([bad])
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.25), (0, None)], "k int, v double")
    assert {r.k: r["mean"] for r in E.running_mean(df, [F.col("k")], "v").collect()} == {0: None, 1: 0.5, 2: 0.5, 3: 0.375}
    tries = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "c", 2), (2, "c", 1)], "d int, e string, s int")
    best = lambda engines: {r.d: r.e for r in E.best_attempt(tries, "d", "e", F.col("s"), engines).collect()}
    assert best(None) == {1: "c", 2: "c"} and best(["b", "a"]) == {1: "b"}
    assert E.extended(df, spark.createDataFrame([(9, "x")], "k int, w string")).count() == 5


def test_control(spark, tmp_path):
    import threading

    from inkfield.streaming import control as C

    src = lambda: spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    query = C.start_once(str(tmp_path / "c"), src)
    with pytest.raises(RuntimeError):
        C.start_once(str(tmp_path / "c"), src)
    stop = threading.Event()
    stop.set()
    assert not C.run_for(query, 60, stop) and not query.isActive
    again = C.start_once(str(tmp_path / "c"), src)
    assert not C.run_for(again, 0.5) and C.stop_all(spark) == 0
    assert C.run_limited(["cat"], 10, b"x") == (0, b"x") and C.run_limited(["sh", "-c", "echo a; sleep 60 & sleep 60"], 0.5)[0] is None
