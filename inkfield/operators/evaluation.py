"""Evaluation of models: winsorised means, best of several, efficiency, alignment, shards, batches, early stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfield.plans.order import group_key, ranked, running, running_in_groups
from inkfield.plans.skew import salted_join


def winsorised_mean(rows: DataFrame, group: list[str], value: str, share: float = 0.05) -> DataFrame:
    """Mean per group after the k = int(share n) lowest and highest values are set to the nearest one kept.

    Values are counted first (one row per distinct value of a group, combined before the shuffle); the two bounds are found on
    running counts that cut through large groups. Nulls are left out; a group without values has no row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_in_groups(counts, group, [F.col(value)], F.col("_c"), "_upto").withColumn("_g", group_key(group))
    k = F.floor(F.col("_upto_all") * share)
    low = (F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k)
    high = (F.col("_upto") >= F.col("_upto_all") - k) & (F.col("_upto") - F.col("_c") < F.col("_upto_all") - k)
    bounds = placed.groupBy("_g").agg(F.max(F.when(low, F.col(value))).alias("_lo"), F.max(F.when(high, F.col(value))).alias("_hi"))
    at = salted_join(placed, bounds, "_g", F.xxhash64(value))
    return at.groupBy(*group).agg((F.sum(F.least(F.greatest(value, "_lo"), "_hi") * F.col("_c")) / F.sum("_c")).alias("mean"))


def best_of(candidates: DataFrame, item: str, score: str, tie: str, lowest: bool = False) -> DataFrame:
    """The candidate of each item with the highest (or lowest) score; null scores come last, ties go to the lower `tie`."""
    order = F.struct(F.col(score).isNull().alias("n"), (F.col(score) if lowest else -F.col(score)).alias("s"), F.col(tie).alias("t"))
    others = F.struct(*(c for c in candidates.columns if c != item))
    return candidates.groupBy(item).agg(F.min_by(others, order).alias("_b")).select(item, "_b.*")


def token_efficiency(candidates: DataFrame, item: str, score: str, length: str, tie: str) -> DataFrame:
    """(item, candidates, efficiency): length of the best candidate over that of all. Null if nothing has a length."""
    order = F.struct(F.col(score).isNotNull().alias("h"), F.col(score).alias("s"), (-F.col(tie)).alias("t"))
    return candidates.groupBy(item).agg(F.count(F.lit(1)).alias("candidates"), (F.max_by(F.col(length), order) / F.nullif(F.sum(length), F.lit(0))).alias("efficiency"))


def aligned(references: DataFrame, predictions: DataFrame, order_r: list[Column], order_p: list[Column]) -> DataFrame:
    """References and predictions joined by position in their orders (0-based `position`)."""
    left, right = ranked(references, order_r, "position"), ranked(predictions, order_p, "position")
    return left.join(right, "position").withColumn("position", F.col("position") - 1)


def sharded(rows: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """With shard and pos of a round-robin deal in a total order; ordering by (pos, shard) restores it."""
    out = ranked(rows, order, "_r")
    return out.withColumns({"shard": (F.col("_r") - 1) % shards, "pos": F.floor((F.col("_r") - 1) / shards)}).drop("_r")


def batched(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    return ranked(rows, order, "_r").withColumn("batch", F.floor((F.col("_r") - 1) / size)).drop("_r")


def minmax(rows: DataFrame, group: str, value: str) -> DataFrame:
    """With `norm`: value scaled to 0..1 over its group; 0 where the range is 0. Joined, not windowed: one row per group."""
    ends = rows.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return salted_join(rows, ends, group, F.xxhash64(value)).withColumn("norm", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def until_stop(rollouts: DataFrame, item: str, order: str, success: Column, elapsed: Column, timeout: float | None, cap: float) -> DataFrame:
    """The rollouts of each item up to the first that stops it: a success once `timeout` has passed (any, without), or the cap.

    The first stop is found by an aggregate, so only one row per item is joined back.
    """
    stops = (success & (F.lit(True) if timeout is None else elapsed >= timeout)) | (elapsed >= cap)
    first = rollouts.filter(stops).groupBy(item).agg(F.min(order).alias("_stop"))
    return salted_join(rollouts, first, item, F.xxhash64(order), "left").filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def best_attempt(attempts: DataFrame, item: str, engine: str, order: Column, engines: list[str] | None = None) -> DataFrame:
    """The attempt of each item that is greatest in `order`; with a list of engines, only theirs, an earlier one before a later."""
    rows = attempts if engines is None else attempts.filter(F.col(engine).isin(engines))
    rank = F.lit(0) if engines is None else -F.array_position(F.array(*map(F.lit, engines)), F.col(engine))
    others = F.struct(*(c for c in attempts.columns if c != item))
    return rows.groupBy(item).agg(F.max_by(others, F.struct(order, rank)).alias("_b")).select(item, "_b.*")


def running_mean(rows: DataFrame, order: list[Column], value: str, name: str = "mean", digits: int = 9) -> DataFrame:
    """Each row with the mean of `value` over all rows up to it in a total order; nulls don't count. Values are summed as whole
    numbers of 10**-digits, so that the sums don't depend on how rows are spread."""
    sums = running(rows, order, {"_sum": F.coalesce(F.round(F.col(value) * 10**digits).cast("bigint"), F.lit(0)), "_n": F.col(value).isNotNull().cast("int")})
    return sums.withColumn(name, F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n") / 10**digits)).drop("_sum", "_n")


def model_paths(named: list[str]) -> dict[str, str]:
    """MODEL=PATH arguments as a map; a later one of a model holds. One without a name or a path raises ValueError."""
    out = {}
    for text in named:
        model, mark, path = text.partition("=")
        if not (mark and model.strip() and path.strip()):
            raise ValueError(f"{text!r} isn't MODEL=PATH")
        out[model.strip()] = path.strip()
    return out


def extended(corpus: DataFrame, more: DataFrame) -> DataFrame:
    """A corpus with further rows; columns that only one side has are null on the other."""
    return corpus.unionByName(more, allowMissingColumns=True)


def sample_per_group(rows: DataFrame, group: str, key: str, k: int, seed: str = "0") -> DataFrame:
    """k rows of each group by seeded hash order; all of a group that has no more. Cut per task before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key)
    return rows.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= k).drop("_i")
