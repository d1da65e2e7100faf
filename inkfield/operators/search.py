"""Candidate search: tree statistics, selection values, rewards, draws by visits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.plans.order import running_in_groups
from inkfield.plans.shared import cut

#: Fixed value: weight of the exploration term.
EXPLORATION = 0.6


def uct(win: Column, visits: Column, parent_visits: Column, policy: Column | None = None, widen: Column | None = None, weight: float = EXPLORATION) -> Column:
    """win/visits plus weight * policy * sqrt(ln(parent)/visits). No visits count as one; a widening node has no win term."""
    v = F.when(visits > 0, visits).otherwise(1)
    gain = win / v if widen is None else F.when(widen, 0.0).otherwise(win / v)
    explore = F.lit(weight) * (F.lit(1.0) if policy is None else F.coalesce(policy, F.lit(1.0))) * F.sqrt(F.ln(parent_visits) / v)
    return gain + F.coalesce(explore, F.lit(0.0))


def reward(score: Column, scorable: Column, with_errors: Column) -> Column:
    """The metric's score if there is one, else 1 or 0 for compiling cleanly; -1 where nothing can be scored."""
    return F.when(~scorable, -1.0).when(score.isNotNull(), score).otherwise(1.0 - with_errors.cast("double"))


def expansion(n: Column) -> Column:
    """Nodes added along a successful rollout of n steps."""
    return F.round(F.sqrt(n)).cast("bigint")


def failed_expansion(n: Column, error_line: Column, depth: Column) -> Column:
    """Nodes added along a failed rollout: at most those before the first error."""
    return F.least(F.greatest(F.greatest(F.lit(1), error_line) - 1 - depth, F.lit(0)), expansion(n))


def _closed(more: DataFrame, max_depth: int) -> None:
    """Raises an error if there are rows left to walk after the last step."""
    if not more.isEmpty():
        raise RuntimeError(f"trees are not closed after {max_depth} levels")


def back_propagated(nodes: DataFrame, tree: str, node: str, parent: str, value: str, max_depth: int = 1000) -> DataFrame:
    """(tree, node, visits, value): sums of each node and all below it.

    Levels are walked from the leaves' side: in every step each row climbs to its parent and is summed there first, so the
    rows shrink with the height. Roots have a null parent. A tree of more than `max_depth` levels below its root raises an error.
    """
    links = cut(nodes.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p")))
    front = nodes.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.lit(1).cast("bigint").alias("visits"), F.col(value).cast("double").alias("value"))
    levels = [front]
    for step in range(max_depth):
        front = front.join(links, ["t", "n"]).filter("p is not null").groupBy("t", F.col("p").alias("n")).agg(F.sum("visits").alias("visits"), F.sum("value").alias("value"))
        if step % 3 == 2:
            front = cut(front)
            if front.isEmpty():
                break
        levels.append(front)
    else:
        _closed(front.join(links, ["t", "n"]).filter("p is not null"), max_depth)
    whole = levels[0]
    for part in levels[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(F.col("t").alias(tree), F.col("n").alias(node)).agg(F.sum("visits").alias("visits"), F.sum("value").alias("value"))


def depths(nodes: DataFrame, tree: str, node: str, parent: str, max_depth: int = 1000) -> DataFrame:
    """(tree, node, depth) of the nodes that hang on a root (null parent), level by level from the roots. More than
    `max_depth` levels raise an error."""
    links = cut(nodes.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p")))
    level = links.filter("p is null").select("t", "n")
    out = level.withColumn("depth", F.lit(0).cast("bigint"))
    for depth in range(1, max_depth):
        level = links.join(level.select("t", F.col("n").alias("p")), ["t", "p"]).select("t", "n")
        if depth % 3 == 0:
            level = cut(level)
            if level.isEmpty():
                break
        out = out.unionByName(level.withColumn("depth", F.lit(depth).cast("bigint")))
    else:
        _closed(links.join(level.select("t", F.col("n").alias("p")), ["t", "p"]), max_depth)
    return out.select(F.col("t").alias(tree), F.col("n").alias(node), "depth")


def descent(scored: DataFrame, tree: str, node: str, parent: str, score: str, max_depth: int = 1000, seed: int | None = None) -> DataFrame:
    """(tree, node, step): the path from each root to a leaf that takes the best child at every node; ties to the lower node, or,
    with a seed, to any of them by hash order. More than `max_depth` nodes on a path raise an error."""
    tie = F.col(node) if seed is None else F.md5(F.concat_ws("|", F.col(tree).cast("string"), F.col(node).cast("string"), F.lit(seed)))
    child = cut(scored.filter(F.col(parent).isNotNull()).groupBy(F.col(tree).alias("t"), F.col(parent).alias("n")).agg(F.min_by(F.col(node), F.struct(-F.col(score), tie, F.col(node))).alias("next")))
    level = scored.filter(F.col(parent).isNull()).select(F.col(tree).alias("t"), F.col(node).alias("n"))
    out = level.withColumn("step", F.lit(0).cast("bigint"))
    for step in range(1, max_depth):
        level = level.join(child, ["t", "n"]).select("t", F.col("next").alias("n"))
        if step % 3 == 0:
            level = cut(level)
            if level.isEmpty():
                break
        out = out.unionByName(level.withColumn("step", F.lit(step).cast("bigint")))
    else:
        _closed(level.join(child, ["t", "n"]), max_depth)
    return out.select(F.col("t").alias(tree), F.col("n").alias(node), "step")


def grown(nodes: DataFrame, tree: str, node: str, state: str, find: Callable[[Column], Column], evaluate: Callable[[Column], Column]) -> DataFrame:
    """(tree, parent, state, value): the children of every node. `find` gives the array of child states of a state, `evaluate` the
    value of one; both are functions of columns, built-in or Arrow ones. Null arrays and states have no children."""
    child = nodes.select(F.col(tree), F.col(node).alias("parent"), F.explode(find(F.col(state))).alias("state")).filter("state is not null")
    return child.withColumn("value", evaluate(F.col("state")))


def merged_children(children: DataFrame, tree: str, parent: str, node: str, state: str, visits: str, value: str) -> DataFrame:
    """Children of one parent whose states are equal become one: that of the lowest node, with the sums of visits and values and
    the number of those merged. States are told apart by 256-bit digests; a null state is a state."""
    digest = F.coalesce(F.sha2(F.col(state).cast("binary"), 256), F.lit("null"))
    by = children.groupBy(tree, parent, digest.alias("_d"))
    return by.agg(F.min(node).alias(node), F.min(state).alias(state), F.sum(visits).alias(visits), F.sum(value).alias(value), F.count(F.lit(1)).alias("merged")).drop("_d")


def expansion_counts(rollouts: DataFrame, tree: list[str], failed: Column) -> DataFrame:
    """Expansions of each tree, and how many of them failed."""
    return rollouts.groupBy(*tree).agg(F.count(F.lit(1)).alias("expansions"), F.count_if(failed).alias("failed"))


def draw_by_visits(children: DataFrame, group: str, node: str, visits: str, draw: Column) -> DataFrame:
    """Per group the first child whose cumulative share of visits reaches `draw` (0..1)."""
    placed = running_in_groups(children, [group], [F.col(node)], F.col(visits), "_upto")
    return placed.filter(F.col("_upto") / F.col("_upto_all") >= draw).groupBy(group).agg(F.min(node).alias(node))
