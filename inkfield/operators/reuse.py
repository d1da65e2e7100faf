"""Work done once: expensive functions by distinct input, known states by longest prefix, metrics by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.plans.skew import salted_join

#: name -> function of (original, generated) columns giving a column, or "module:function" of one; register_metric adds to it.
METRICS: dict[str, Callable[[Column, Column], Column] | str] = {}


def register_metric(name: str, build: Callable[[Column, Column], Column] | str) -> None:
    """A metric given as "module:function" is imported when it is first asked for, so what it needs may be missing until then."""
    METRICS[name] = build


def metric(name: str | Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A metric by its name, or a function of the same form as it is."""
    if callable(name):
        return name
    if name not in METRICS:
        raise KeyError(f"no metric {name!r}; there are {', '.join(sorted(METRICS)) or 'none'}")
    if isinstance(METRICS[name], str):
        module, _, function = METRICS[name].partition(":")
        METRICS[name] = getattr(import_module(module), function)
    return METRICS[name]


def by_distinct_input(rows: DataFrame, inputs: list[str], result: Column, name: str, key: str) -> DataFrame:
    """rows with `result`, a function of the input columns, worked out once for each distinct combination of them.

    Combinations are told apart by 256-bit digests of all of their values, nulls included. `key` spreads the rows of
    combinations that are frequent.
    """
    parts = [F.coalesce(F.sha2(F.col(c).cast("binary"), 256), F.lit("null")) for c in inputs]
    marked = rows.withColumn("_d", F.sha2(F.concat_ws("|", *parts), 256))
    once = marked.groupBy("_d").agg(*(F.first(c).alias(c) for c in inputs)).select("_d", result.alias(name))
    return salted_join(marked.drop(name), once, "_d", F.xxhash64(key), "left").drop("_d")


def longest_known_prefix(candidates: DataFrame, known: DataFrame, key: str, parts: str) -> DataFrame:
    """(key, depth): how many leading parts of each candidate form a sequence that `known` (an array column of the same name)
    holds; 0 if none. Prefixes are compared by digest, so the join is on one column, whatever their length."""
    def digest(n: Column) -> Column:
        return F.md5(F.to_json(F.slice(parts, F.lit(1), n)))

    sizes = F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))))
    asked = candidates.filter(F.size(parts) > 0).select(key, F.col(parts), sizes.alias("_n")).select(key, "_n", digest(F.col("_n")).alias("_d"))
    have = known.filter(F.size(parts) > 0).select(digest(F.size(parts)).alias("_d")).distinct()
    deep = asked.join(have, "_d", "left_semi").groupBy(key).agg(F.max("_n").alias("depth"))
    return candidates.select(key).distinct().join(deep, key, "left").select(key, F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))
