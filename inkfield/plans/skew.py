"""Joins and running sums that hold when one key owns a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows than this is hot. At most rows/HOT_ROWS keys can be, which bounds the broadcast list of them.
HOT_ROWS = 200_000
SALTS = 64
#: Members of a group on one side of a block of pairs.
PAIR_BLOCK = 2_000
#: Ordered hash ranges that a group is cut into for ranks and running sums: 2**RANGE_BITS.
RANGE_BITS = 12


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner", hot_rows: int = HOT_ROWS, salts: int = SALTS, counts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Join `big` with `small`, which has one row per `key`.

    Rows of hot keys are spread over `salts` tasks by `spread`, and only their rows of `small` are repeated as often. The
    list of hot keys is broadcast; it holds at most rows(big)/hot_rows keys. Null keys match nothing ('inner' drops them,
    'left' keeps them). Keys are counted here unless `counts` (key, _n) says how many rows of `big` each of them has. `most`
    is a number that no key's rows exceed, such as that of all rows: where it is no more than hot_rows, nothing can be hot.
    """
    if most is not None and most <= hot_rows:
        return big.join(small, key, how)
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    hot = counts.filter((F.col("_n") > hot_rows) & F.col(key).isNotNull()).select(F.col(key).alias("_hot"))
    left = big.join(F.broadcast(hot), big[key] == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    right = small.join(F.broadcast(hot), small[key] == F.col("_hot"), "left").withColumn("_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def running_before(df: DataFrame, group: list[str], order: str, tie: str, weight: Column, name: str = "before") -> DataFrame:
    """Adds `name`: the sum of `weight` over the rows of the same group that come before in (order, tie).

    `order` is a 64-bit hash. Each group is cut into 2**RANGE_BITS ranges of it; ranges are summed first (combined before the
    shuffle), and only rows of one range are sorted together, so no task sees a whole group. Groups must not be null.
    """
    cut = df.withColumn("_range", F.shiftright(F.col(order), 64 - RANGE_BITS).cast("int")).withColumn("_w", weight.cast("bigint"))
    keys = [*group, "_range"]
    sums = cut.groupBy(*keys).agg(F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return local.join(offset, keys).withColumn(name, F.col("_local") + F.col("_offset")).drop("_range", "_w", "_local", "_offset")


def pairs_within(rows: DataFrame, group: str, key: str, block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b), a < b: all pairs of different keys of one group. `rows` holds each (group, key) once.

    A group of n keys is cut into n/block blocks by hash on one side and repeated for each of them on the other, so that a
    task pairs about `block` keys with a group, not a group with itself. Groups of one key and null groups drop out first.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & F.col(group).isNotNull())
    blocks = sizes.select(group, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    sized = salted_join(rows.select(group, key), blocks, group, F.xxhash64(key), counts=sizes)
    left = sized.select(group, F.col(key).alias("a"), F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int").alias("_b"))
    right = sized.select(group, F.col(key).alias("b"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"))
    return left.join(right, [group, "_b"]).filter("a < b").select("a", "b")
