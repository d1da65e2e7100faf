"""Global ranks and running sums of a total order, without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfield.plans.shared import cut
from inkfield.plans.skew import salted_join


def attach(df: DataFrame, figures: DataFrame) -> DataFrame:
    """df with the columns of `figures`, an aggregate of one row, as constants."""
    row = figures.first()
    return df.withColumns({c: F.lit(row[c]).cast(kind) for c, kind in figures.dtypes})


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each of `sums`, its total over all rows up to and including this one in the order (BIGINT).

    Rows are range-partitioned by the order and kept in the shared folder, so that the ranges stay as they are; each range is
    summed on its own, and the ranges' totals, one row each, are added on. `order` must be total for the result to be unique.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    window = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumns({n: F.sum(c.cast("bigint")).over(window) for n, c in sums.items()})
    totals = held.groupBy("_part").agg(*(F.sum(c.cast("bigint")).alias(f"_{n}") for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    both = local.join(F.broadcast(offsets), "_part")  # one row per partition
    return both.select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rank, 1..N, in a total order."""
    return running(df, order, {name: F.lit(1)})


def group_key(columns: list[str]) -> Column:
    """One column that tells groups apart, nulls included."""
    return F.to_json(F.struct(*(F.struct(F.col(c).isNull(), F.col(c)) for c in columns))) if columns else F.lit("")


def running_in_groups(df: DataFrame, group: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """df with `name`, the sum of `amount` over the rows of its group up to and including this one, and `name`_all, over all of
    them (BIGINT). Sums run once over the order of (group, order), in ranges that cut through groups of any size; what came
    before a group is then taken off."""
    every = running(df.withColumns({"_g": group_key(group), "_a": amount.cast("bigint")}), [F.col("_g"), *order], {"_r": F.col("_a")})
    ends = every.groupBy("_g").agg(F.min(F.col("_r") - F.col("_a")).alias("_base"), F.sum("_a").alias(f"{name}_all"))
    return salted_join(every, ends, "_g", F.xxhash64("_r")).withColumn(name, F.col("_r") - F.col("_base")).drop("_g", "_a", "_r", "_base")


def quantiles(ranked_df: DataFrame, value: str, shares: list[float], rank: str = "rank") -> DataFrame:
    """One row of q0, q1, ...: exact quantiles of `value`, by which the table is ranked, with linear interpolation. Only the
    two neighbours of each are read from the ranked rows."""
    n = ranked_df.agg(F.max(rank).alias("_n"))
    at = [(F.col("_n") - 1) * s for s in shares]
    rows = attach(ranked_df.select(F.col(value).alias("_v"), F.col(rank).alias("_r")), n)
    low = [F.max(F.when(F.col("_r") == F.floor(a) + 1, F.col("_v"))).alias(f"l{i}") for i, a in enumerate(at)]
    high = [F.max(F.when(F.col("_r") == F.ceil(a) + 1, F.col("_v"))).alias(f"h{i}") for i, a in enumerate(at)]
    got = rows.agg(*low, *high, F.max("_n").alias("_n"))
    return got.select(*((F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (a - F.floor(a))).alias(f"q{i}") for i, a in enumerate(at)))
