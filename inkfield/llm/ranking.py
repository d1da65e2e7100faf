"""One ranking from several differently scaled scores, per group, by distance to an ideal point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfield.plans.order import running
from inkfield.plans.skew import salted_join

#: Share of each tail that is pulled in before scores are scaled: at least one record of either end from 34 records on.
TAIL = 0.03
#: Exponent of the distances. 1 adds the scores up, so that the anti-ideal point says nothing of its own; under 2 one bad score
#: outweighs two good ones. README has how often the easiest three agree with other equal ways of counting.
EXPONENT = 1.2
#: Rank error of the sketched quantiles is rows/ACCURACY; groups of fewer rows get exact ones.
ACCURACY = 10_000


def ideal_point(df: DataFrame, group: str, key: str, scores: Sequence[str], weights: Sequence[float] | None = None, tail: float = TAIL, exponent: float = EXPONENT) -> DataFrame:
    """(group, key, closeness): 1 at the ideal point of the group, 0 at its opposite. Low scores are good.

    Per group each score is winsorised at its `tail` and 1-`tail` quantiles, counted from the lower of them, and divided by
    its vector norm, so all have equal say whatever their range, in proportion to their weights. The ideal point holds each
    score's least value, which is 0, the anti-ideal one its greatest. A distance is the exponent-th root of the sum of weighted
    differences to that power. Closeness is d(anti-ideal) / (d(ideal) + d(anti-ideal)), rounded to 9 digits.

    Rows where a score is null or NaN are left out, as are null keys and null groups; rows repeated under one key count once.
    A score that is the same throughout its group has no say there; if all are, closeness is 1. An empty table gives no rows.
    Quantiles come from a mergeable sketch and the rest are plain sums, so a group of any size is combined before the
    shuffle; its rows are spread by hash for the look-up of its figures.
    """
    weights = list(weights or [1.0] * len(scores))
    if len(weights) != len(scores) or min(weights) < 0 or not sum(weights):
        raise ValueError("one weight of at least 0 for each score, not all 0")
    names = [f"_s{i}" for i in range(len(scores))]
    there = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), *(F.col(s).cast("double").alias(n) for s, n in zip(scores, names, strict=True)))
    there = there.filter(" and ".join(f"{n} is not null and not isnan({n})" for n in names) + " and _g is not null and _k is not null").dropDuplicates(["_k"])
    tails = F.array(F.lit(tail), F.lit(1 - tail))
    sketched = there.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *(F.percentile_approx(n, tails, ACCURACY).alias(f"{n}_q") for n in names))
    bounds = sketched.select("_g", *(F.col(f"{n}_q")[i].alias(f"{n}_{at}") for n in names for i, at in enumerate(("lo", "hi"))))
    spread = F.xxhash64("_k")
    wins = salted_join(there, bounds, "_g", spread, counts=sketched).select("_g", "_k", *((F.least(F.greatest(n, f"{n}_lo"), f"{n}_hi") - F.col(f"{n}_lo")).alias(n) for n in names))
    figures = wins.groupBy("_g").agg(*(x for n in names for x in (F.sqrt(F.sum(F.col(n) * F.col(n))).alias(f"{n}_norm"), F.max(n).alias(f"{n}_max"))))
    both = salted_join(wins, figures, "_g", spread, counts=sketched)
    good, bad = F.lit(0.0), F.lit(0.0)
    for n, w in zip(names, weights, strict=True):
        says = F.col(f"{n}_norm") > 0
        good = good + F.when(says, F.pow(w * F.col(n) / F.col(f"{n}_norm"), F.lit(exponent))).otherwise(0.0)
        bad = bad + F.when(says, F.pow(w * (F.col(f"{n}_max") - F.col(n)) / F.col(f"{n}_norm"), F.lit(exponent))).otherwise(0.0)
    near, far = F.pow(good, F.lit(1 / exponent)), F.pow(bad, F.lit(1 / exponent))
    closeness = F.when(near + far > 0, far / (near + far)).otherwise(1.0)
    return both.select(F.col("_g").alias(group), F.col("_k").alias(key), F.round(closeness, 9).alias("closeness"))


def best(ranked: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The n rows of each group that are closest to its ideal point, with their place. Ties go to the lower key."""
    order = Window.partitionBy(group).orderBy(F.desc("closeness"), key)
    return ranked.withColumn("place", F.row_number().over(order).cast("bigint")).filter(F.col("place") <= n)


def places(ranked: DataFrame, group: str, key: str) -> DataFrame:
    """Every row with its place in the group's order (1: closest), the lower key first among ties.

    Rows are ranked once in the order of (group, closeness, key), in ranges that cut through groups and ties of any size; a
    group's least rank is then taken off.
    """
    every = running(ranked, [F.col(group), F.desc("closeness"), F.col(key)], {"_rank": F.lit(1)})
    first = every.groupBy(group).agg((F.min("_rank") - 1).alias("_before"))
    return salted_join(every, first, group, F.xxhash64(key)).select(*ranked.columns, (F.col("_rank") - F.col("_before")).alias("place"))
