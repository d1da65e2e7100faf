"""Records drawn so that each source has its share of the tokens, with capped repeats."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.tokens import TOKENIZER, n_tokens
from inkfield.plans.order import attach
from inkfield.plans.shared import cut
from inkfield.plans.skew import running_before

#: Sources whose targets are read to the driver; their table is broadcast.
MOST_SOURCES = 1_000


def water_fill(have: Mapping[str, int], share: Mapping[str, float], repeats: Mapping[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens to draw from each source.

    Without `total`, as many tokens as allow every source its share. With it, sources that would need more than `repeats`
    times what they have are clamped there, and what they lack goes to the others in proportion to their shares, until
    nothing more is clamped; if all are clamped, less than `total` is drawn. A source with a share above 0 but no tokens
    counts as clamped at 0 (and is ignored in finding the feasible total). Shares of 0 draw nothing.
    """
    cap = {s: float(have.get(s, 0)) * max(0, repeats[s]) for s in share}
    live = [s for s in share if share[s] > 0 and cap[s] > 0]
    if not live:
        return dict.fromkeys(share, 0.0)
    if total is None:
        weight = sum(share[s] for s in live)
        total = min(cap[s] * weight / share[s] for s in live)
    out, rest = dict.fromkeys(share, 0.0), float(total)
    while live and rest > 0:
        weight = sum(share[s] for s in live)
        over = [s for s in live if share[s] / weight * rest >= cap[s] * (1 + 1e-12)]
        if not over:
            for s in live:
                out[s] = min(cap[s], share[s] / weight * rest)
            break
        for s in over:
            out[s] = cap[s]
            rest -= cap[s]
        live = [s for s in live if s not in over]
    return out


def top_up(sizes: Mapping[int, int], lack: float) -> dict[int, int]:
    """How many records of each size (size -> how many there are) come close to `lack` tokens together: what fits, from the
    largest down, then one of the smallest that are left if the sum is nearer to the goal with it."""
    out: dict[int, int] = {}
    for size in sorted(sizes, reverse=True):
        n = min(sizes[size], int(lack // size))
        if n > 0:
            out[size] = n
            lack -= n * size
    left = min((size for size in sizes if sizes[size] > out.get(size, 0)), default=None)
    if left is not None and abs(left - lack) < lack:
        out[left] = out.get(left, 0) + 1
    return out


def _top_ups(pdf: pd.DataFrame) -> pd.DataFrame:
    """top_up of one source's (tokens, n, lack) rows, one per size."""
    found = top_up(dict(zip(pdf["tokens"], pdf["n"], strict=True)), float(pdf["lack"].iloc[0]))
    return pd.DataFrame({"_s": pdf["_s"].iloc[0], "tokens": list(found), "_more": list(found.values())}).astype({"tokens": "int64", "_more": "int64"})


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, key: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER, seed: int = 5) -> DataFrame:
    """(key, source, tokens, uses) of the drawn records.

    A source that needs e times its tokens uses every record floor(e) times, and once more those that come first in a seeded
    hash order as long as they fit into the fraction. What is then still missing, less than one record's tokens, is made up of
    all the others that fit, the largest first, and by one more where that comes closer to the goal: how many of each size is
    found on the source's counts of sizes, which of them by hash order again.
    No record is used more than max_repeats times. Null, empty and untargeted records aren't drawn, nor those of
    null sources; targets with a null or negative share draw nothing. Of a source that targets name twice, the first row in
    the order of share and max_repeats holds, of a key that records repeat, the least row. Only per-source sums reach the driver.
    """
    asked = {}
    for r in targets.filter("source is not null").select("source", "target_share", "max_repeats").orderBy("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect():
        asked.setdefault(r["source"], (max(0.0, r["target_share"] or 0.0), max(0, r["max_repeats"] or 0)))
    if len(asked) > MOST_SOURCES:
        raise ValueError(f"at most {MOST_SOURCES} sources")
    wanted = [s for s, (share, n) in asked.items() if share > 0 and n > 0]
    known = docs.filter(F.col(key).isNotNull() & F.col(source).isin(wanted) & (F.length(text) > 0)) if wanted else docs.filter("false")
    counted = known.select(F.col(key).alias("_k"), F.struct(F.col(source).alias("_s"), n_tokens(F.col(text), path).alias("tokens")).alias("r"))
    sized = cut(counted.groupBy("_k").agg(F.min("r").alias("r")).select("_k", "r.*"))
    have = {r["_s"]: r["n"] for r in sized.groupBy("_s").agg(F.sum("tokens").alias("n")).collect()}
    goal = water_fill(have, {s: v[0] for s, v in asked.items()}, {s: v[1] for s, v in asked.items()}, total)
    plan = [(s, int(goal[s] / n + 1e-9), max(0.0, goal[s] - int(goal[s] / n + 1e-9) * n), asked[s][1]) for s, n in have.items() if n]
    plan_df = docs.sparkSession.createDataFrame(plan, "_s string, whole int, part double, most int")
    ordered = cut(running_before(sized.filter("tokens > 0").withColumn("_h", F.xxhash64("_k", F.lit(seed))), ["_s"], "_h", "_k", F.col("tokens")).join(F.broadcast(plan_df), "_s"))
    fits = (F.col("before") + F.col("tokens") <= F.col("part")) & (F.col("whole") < F.col("most"))
    taken = {r["_s"]: r["n"] for r in ordered.filter(fits).groupBy("_s").agg(F.sum("tokens").alias("n")).collect()}
    lacks = [(s, part - taken.get(s, 0)) for s, whole, part, most in plan if part > taken.get(s, 0) and whole < most]
    lacking = docs.sparkSession.createDataFrame(lacks, "_s string, lack double")
    # Sizes under twice what is missing; what is taken of them adds up to less than that, so few of them are.
    others = ordered.filter(~fits).join(F.broadcast(lacking), "_s").filter(F.col("tokens") < 2 * F.col("lack"))
    sizes = others.groupBy("_s", "tokens", "lack").agg(F.count(F.lit(1)).alias("n"))
    more = cut(sizes.groupBy("_s").applyInPandas(_top_ups, "_s string, tokens bigint, _more bigint"))
    nexts = running_before(others.join(F.broadcast(more), ["_s", "tokens"]), ["_s", "tokens"], "_h", "_k", F.lit(1), "_i").filter(F.col("_i") < F.col("_more"))
    drawn = ordered.withColumn("uses", F.col("whole") + F.when(fits, 1).otherwise(0)).filter("uses > 0").select("_k", "_s", "tokens", "uses")
    drawn = drawn.unionByName(nexts.select("_k", "_s", "tokens", F.lit(1).alias("uses"))).groupBy("_k", "_s", "tokens").agg(F.sum("uses").alias("uses"))
    return drawn.select(F.col("_k").alias(key), F.col("_s").alias(source), "tokens", F.col("uses").cast("bigint").alias("uses"))


def shares(drawn: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Per target: the share asked for and the one reached, records drawn, tokens drawn, the most uses of one record."""
    each = drawn.groupBy(source).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    whole = each.agg(F.sum("tokens").alias("_all"))
    asked = targets.filter("source is not null").select(F.col("source").alias(source), "target_share").dropDuplicates([source])
    both = attach(asked.join(each, source, "left"), whole)
    return both.select(source, "target_share", F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("share"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
