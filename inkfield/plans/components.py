"""Connected components of a two-sided graph (nodes that share keys), by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.plans.shared import cut
from inkfield.plans.skew import salted_join


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(node BIGINT, key STRING) -> (node, component), component the smallest node of those joined through shared keys.

    In each round every key points its nodes at the one of lowest priority (a hash that changes by round, so that chains
    break after a few steps, whatever the numbering), every node takes the lowest of its keys' offers, and the graph is
    contracted. Only keys that still join two nodes go on, so the work shrinks from round to round; at the end the moves are
    replayed backwards. Keys and nodes are counted in the sums that each round needs anyway, so that its look-ups know which of
    them are hot. Rows with a null node or key link nothing, and a node that only they name isn't in the result.
    """
    live = cut(links.filter("node is not null and key is not null").select(F.col("node").cast("bigint").alias("rep"), "key").distinct())
    nodes = live.select(F.col("rep").alias("node")).distinct()
    moves: list[DataFrame] = []
    for turn in range(max_rounds):
        first = F.xxhash64(F.col("rep"), F.lit(turn))
        rows = live.count()
        keyed = live.groupBy("key").agg(F.min(F.struct(first.alias("p"), F.col("rep"))).alias("o"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.count(F.lit(1)).alias("_n")).filter("a < b")
        offers = keyed.select("key", F.col("o.p").alias("p"), F.col("o.rep").alias("to"))
        joined = salted_join(live, offers, "key", F.xxhash64("rep"), counts=keyed, most=rows)
        best = cut(joined.groupBy("rep").agg(F.min(F.struct("p", "to")).alias("o"), F.count(F.lit(1)).alias("_n")).select("rep", F.col("o.to").alias("to"), "_n"))
        move = best.filter("rep <> to").select("rep", "to")
        if move.isEmpty():
            break
        moves.append(move)
        live = cut(salted_join(joined.select("rep", "key"), move, "rep", F.xxhash64("key"), "left", counts=best, most=rows).select(F.coalesce("to", "rep").alias("rep"), "key").distinct())
    else:
        raise RuntimeError(f"components are not closed after {max_rounds} rounds")
    n = nodes.count()
    end = None
    for move in reversed(moves):
        # A row for every representative that was moved in this round or later: where it ends.
        here = move if end is None else salted_join(move.withColumnRenamed("to", "via"), end.select(F.col("rep").alias("via"), "to"), "via", F.xxhash64("rep"), "left", most=n).select("rep", F.coalesce("to", "via").alias("to"))
        end = cut(here if end is None else here.unionByName(end.join(here.select("rep"), "rep", "left_anti")))
    if end is None:
        return nodes.withColumn("component", F.col("node"))
    ends = nodes.join(end.withColumnRenamed("rep", "node"), "node", "left").select("node", F.coalesce("to", "node").alias("to"))
    least = ends.groupBy("to").agg(F.min("node").alias("component"))
    return salted_join(ends, least, "to", F.xxhash64("node"), most=n).select("node", "component")
