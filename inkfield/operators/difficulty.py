"""The difficulty table: shards normalised, deduplicated, imputed, blended, ranked, described."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.functions.similarity import difficulty
from inkfield.functions.text import example_id, merged_path
from inkfield.plans.order import attach, quantiles, ranked

PATHS = ("original_image_path", "generated_image_path", "original_code_path", "generated_code_path")


def normalised(shards: DataFrame) -> DataFrame:
    """Shard rows with typed keys ('main': -1) and merged paths. Where keys are missing they are read from example_file.

    Rows whose keys can't be read are dropped; extra columns stay.
    """
    if "example_number" not in shards.columns:
        shards = shards.withColumns(example_id(F.col("example_file")))
    else:
        shards = shards.withColumns({"example_number": F.col("example_number").cast("int"), "combination_number": F.when(F.col("combination_number").cast("string") == "main", -1).otherwise(F.col("combination_number").cast("string").try_cast("int"))})
    paths = {p: merged_path(F.col(p)) for p in PATHS if p in shards.columns}
    return shards.withColumns(paths).filter("example_number is not null and combination_number is not null")


def first_per_key(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row, in `order`, of each (example_number, combination_number).

    Combined before the shuffle: the smallest struct per key, so that a hot key moves one row per task.
    """
    others = [c for c in rows.columns if c not in ("example_number", "combination_number", *order)]
    packed = F.struct(*(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in (*order, *others)))
    best = rows.groupBy("example_number", "combination_number").agg(F.min(packed).alias("_m"))
    return best.select(*(F.col(c) if c in ("example_number", "combination_number") else F.col(f"_m.{c}.v").alias(c) for c in rows.columns))


def scored(rows: DataFrame) -> DataFrame:
    """With combined_score: the blend of the imputed, clipped dissimilarities."""
    return rows.withColumn("combined_score", difficulty(F.col("image_similarity"), F.col("code_similarity")))


def rank_table(rows: DataFrame) -> DataFrame:
    """With rank 1..N by combined_score, ties by keys, and rank_norm in 0..1."""
    order = [F.col("combined_score"), F.col("example_number"), F.col("combination_number")]
    out = ranked(rows, order)
    n = out.agg(F.count(F.lit(1)).alias("_n"))
    return attach(out, n).withColumn("rank_norm", F.when(F.col("_n") > 1, (F.col("rank") - 1) / (F.col("_n") - 1)).otherwise(0.0)).drop("_n")


def difficulty_table(shards: DataFrame, order: list[str] | None = None) -> DataFrame:
    """From shard rows to the ranked table. `order` says which of a key's rows is kept: the first."""
    return rank_table(scored(first_per_key(normalised(shards), order or ["shard_file", "written_at"])))


def describe(table: DataFrame, value: str = "combined_score") -> DataFrame:
    """count, mean, std, min, exact quartiles, max of a ranked table."""
    head = table.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(table, value, [0.25, 0.5, 0.75])
    return attach(head, q).select("count", "mean", "std", "min", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def quartiles(table: DataFrame, value: str = "combined_score") -> DataFrame:
    """With quartile 0..3: right-closed bins on the interpolated edges. Equal edges leave a bin empty."""
    q = quantiles(table, value, [0.25, 0.5, 0.75])
    bin_ = F.when(F.col(value) <= F.col("q0"), 0).when(F.col(value) <= F.col("q1"), 1).when(F.col(value) <= F.col("q2"), 2).otherwise(3)
    return attach(table, q).withColumn("quartile", bin_.cast("bigint")).drop("q0", "q1", "q2")


def card(table: DataFrame) -> DataFrame:
    """Figures of the dataset card."""
    return table.agg(F.count(F.lit(1)).alias("rows"), F.avg("image_similarity").alias("mean_image"), F.avg("code_similarity").alias("mean_code"), F.avg("combined_score").alias("mean_combined"), F.min("combined_score").alias("least"), F.max("combined_score").alias("most"))


def extremes(table: DataFrame, n: int = 50) -> DataFrame:
    """The n lowest and the n highest scored rows."""
    low = table.orderBy("rank").limit(n).withColumn("section", F.lit("lowest_score"))
    high = table.orderBy(F.desc("rank")).limit(n).withColumn("section", F.lit("highest_score"))
    return low.unionByName(high)


def is_sorted(rows: DataFrame, order: list[str], value: str, partition: list[str]) -> DataFrame:
    """Per partition: whether `value` never falls along the order, which must be total; nulls come first.

    It doesn't if the order by (value, order) is the same: two ranks that cut through large partitions, compared row by row.
    """
    keys = [F.col(c) for c in (*partition, *order)]
    once = ranked(rows.select(*dict.fromkeys((*partition, *order, value))), keys, "_by_order")
    both = ranked(once, [*(F.col(c) for c in partition), F.col(value), *(F.col(c) for c in order)], "_by_value")
    return both.groupBy(*partition).agg(F.bool_and(F.col("_by_order") == F.col("_by_value")).alias("sorted"))
