"""Train/validation/test splits that never part related records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.plans.components import components
from inkfield.plans.order import attach
from inkfield.plans.shared import cut
from inkfield.plans.skew import running_before, salted_join

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Sizes up to EXACT_SIZE are bundles of their own; larger ones share steps of an eighth of a doubling, unless they are giants.
EXACT_SIZE = 256
#: A component with more than 1/GIANTS of all records is a bundle of its own: there are fewer than GIANTS of these.
GIANTS = 1000
#: Labels told apart in a bundle's profile, the others sharing one name, and the steps in which their shares are written there.
#: A profile shares out at most STEPS + LABELS / 2 steps to LABELS + 1 names, which bounds the bundles sent to the driver.
LABELS, STEPS = 8, 4
#: Bundles of one size that a flow is found for at a time.
TOGETHER = 16
#: The forms of a known author and of a known figure reference, after trimming and lower-casing.
REAL_AUTHOR = r"^[a-z]+_[0-9a-f]+$"
REAL_FIGURE = r"^fig-[0-9]{2}-[0-9a-f]+$"


def origin_links(origin: DataFrame) -> DataFrame:
    """(node, key) of the examples in example_origin with each real author and figure_ref they name.

    An example whose fields are all null, blank or filler gets a key of its own, so it stays in the result as a group of one.
    """
    def clean(c: str):
        return F.lower(F.regexp_replace(F.col(c), r"^(?U)[\s\p{Z}]+|(?U)[\s\p{Z}]+$", ""))

    author, figure = clean("author"), clean("figure_ref")
    keys = F.array_compact(F.array(F.when(author.rlike(REAL_AUTHOR), F.concat(F.lit("a:"), author)), F.when(figure.rlike(REAL_FIGURE), F.concat(F.lit("f:"), figure)), F.concat(F.lit("e:"), F.col("example_number").cast("string"))))
    return origin.filter("example_number is not null").select(F.col("example_number").cast("bigint").alias("node"), F.explode(keys).alias("key"))


def groups(origin: DataFrame) -> DataFrame:
    """(node, component) of every example in example_origin; component is the smallest example number of its group."""
    return components(origin_links(origin))


def allocate(bundles: Sequence[tuple[float, Mapping[str, float] | str, int]], proportions: Mapping[str, float]) -> list[list[int]]:
    """Components of each bundle (size, records by label, count) for each split, by min-cost flows. A label alone stands for all
    of the size.

    Whole quotas, the floor of a bundle's count times each split's share, go first; fewer components than splits are left of a
    bundle. These are the flow: in components of one size, so that it is integral as it comes, from the bundles through the
    splits. A unit costs the records by which it moves a split, its bundle and its labels away from their quotas (weights 4, 1
    and 2), less those by which it brings them closer. Sizes follow each other from the largest down, a few bundles at a time;
    quotas are shares of what has come up to then, so that what large components leave uneven is made up by smaller ones.
    """
    share = np.array(list(proportions.values()), float)
    share = share / share.sum()
    profiles = [p if isinstance(p, Mapping) else {p: size} for size, p, _ in bundles]
    at = {y: i for i, y in enumerate(sorted({y for p in profiles for y in p}))}
    size = np.array([b[0] for b in bundles], float)
    count = np.array([b[2] for b in bundles], np.int64)
    holds = np.zeros((len(bundles), len(at)))
    for b, profile in enumerate(profiles):
        for y, n in profile.items():
            holds[b, at[y]] = n
    plan = np.floor(count[:, None] * share + 1e-9).astype(np.int64)
    left = count - plan.sum(1)
    beyond, beyond_label = np.zeros(len(share)), np.zeros((len(at), len(share)))  # records over the quotas up to now
    order = np.lexsort((np.arange(len(size)), -size))
    for first in (0, *(np.flatnonzero(np.diff(size[order])) + 1)):
        same = order[first:][size[order[first:]] == size[order[first]]]
        for some in (same[i : i + TOGETHER] for i in range(0, len(same), TOGETHER)):
            fair = count[some, None] * share
            beyond = beyond + ((plan[some] - fair) * size[some, None]).sum(0)
            beyond_label = beyond_label + holds[some].T @ (plan[some] - fair)
            if left[some].any():
                flow = transport(float(size[some[0]]), holds[some], left[some], fair - plan[some], beyond, beyond_label)
                plan[some] += flow
                beyond = beyond + flow.sum(0) * size[some[0]]
                beyond_label = beyond_label + holds[some].T @ flow
    return plan.tolist()


def transport(size: float, holds: np.ndarray, left: np.ndarray, fair: np.ndarray, beyond: np.ndarray, beyond_label: np.ndarray) -> np.ndarray:
    """Units of each bundle for each split at least cost, by shortest augmenting paths; what flow_cost() counts is the least.

    All arcs are convex: a bundle's to a split by its deviation from the fair number and its labels', a split's to the end by
    the split's. A path may push units of other bundles from one split to the next, so it is found over the splits alone, with
    the cheapest bundle for each step between two.
    """
    k = len(beyond)
    by_label = _label_costs(holds, beyond_label)
    x = np.zeros((len(left), k), np.int64)
    for b in np.repeat(np.arange(len(left)), left):
        more = by_label + size * (np.abs(x + 1 - fair) - np.abs(x - fair))
        less = np.where(x > 0, by_label + size * (np.abs(x - fair) - np.abs(x - 1 - fair)), -np.inf)
        steps = more[:, None, :] - less[:, :, None]  # bundle, from, to
        via, step = steps.argmin(0), steps.min(0)
        filled = beyond + x.sum(0) * size
        leave = 4 * (np.abs(filled + size) - np.abs(filled))
        dist, came = more[b].copy(), np.full(k, -1)
        for _ in range(k - 1):
            for i in range(k):
                for j in range(k):
                    if i != j and dist[i] + step[i, j] < dist[j] - 1e-9:
                        dist[j], came[j] = dist[i] + step[i, j], i
        j = int(np.argmin(np.round(dist + leave, 6)))
        while came[j] >= 0:
            i = came[j]
            x[via[i, j], i] -= 1
            x[via[i, j], j] += 1
            j = i
        x[b, j] += 1
    return x


def _label_costs(holds: np.ndarray, beyond_label: np.ndarray) -> np.ndarray:
    """By how many records a component of each bundle moves its labels away from their quotas in each split, twice."""
    return 2 * (np.abs(beyond_label[None] + holds[:, :, None]) - np.abs(beyond_label)[None]).sum(1)


def flow_cost(x: np.ndarray, size: float, holds: np.ndarray, fair: np.ndarray, beyond: np.ndarray, beyond_label: np.ndarray) -> float:
    """What the flow x of a transport() costs."""
    return float((_label_costs(holds, beyond_label) * x).sum() + size * np.abs(x - fair).sum() + 4 * np.abs(beyond + x.sum(0) * size).sum())


def assign_splits(records: DataFrame, origin: DataFrame, key: str = "row_id", example: str = "example_number", label: str = "generator", proportions: Mapping[str, float] | None = None, seed: int = 7) -> DataFrame:
    """(key, example, component, split) of each distinct record.

    Related records (one example, or examples joined through origin_links, directly or by way of others) share a split.
    Components are bundled by size and by their label profile: what share each label has of their records, to a quarter;
    `allocate` gives each bundle's quota for every split, and the members of a bundle are assigned by the order of their hash.
    Records repeated under one key count once; null keys are dropped. A record with a null example has no relation and is a
    component of its own, with a null component. Null labels count as a label. Empty tables give no rows. Only the bundles'
    counts reach the driver; LABELS, STEPS, EXACT_SIZE and GIANTS bound them.
    """
    proportions = dict(proportions or PROPORTIONS)
    spark = records.sparkSession
    rows = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(example).cast("bigint").alias("_e"), F.coalesce(F.col(label).cast("string"), F.lit("?")).alias("_y")).dropDuplicates(["_k"])
    per = rows.filter("_e is not null").groupBy("_e", "_y").agg(F.count(F.lit(1)).alias("n"))
    who = groups(origin).withColumnRenamed("node", "_e")
    per = cut(per.join(who, "_e", "left").withColumn("component", F.coalesce("component", "_e")))
    lone = rows.filter("_e is null").select((-F.abs(F.xxhash64("_k")) - 1).alias("component"), "_y", F.lit(1).cast("bigint").alias("n"))
    tally = per.select("component", "_y", "n").unionByName(lone).groupBy("component", "_y").agg(F.sum("n").alias("n"))
    top = [r[0] for r in tally.groupBy("_y").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "_y").limit(LABELS).collect()]
    of_label = [F.sum(F.when(F.col("_y") == y, F.col("n")).otherwise(0)).alias(f"n{i}") for i, y in enumerate(top)]
    comps = tally.groupBy("component").agg(F.sum("n").alias("size"), *of_label)
    comps = cut(comps.withColumn(f"n{len(top)}", F.col("size") - sum((F.col(f"n{i}") for i in range(len(top))), F.lit(0))))
    counts = [f"n{i}" for i in range(len(top) + 1)]
    total = comps.agg(F.sum("size")).first()[0]
    shape = F.when(F.col("size") <= EXACT_SIZE, F.col("size").cast("double")).when(F.col("size") > total / GIANTS if total else F.lit(True), F.col("component") + F.lit(1e15)).otherwise(-F.floor(F.log2("size") * 8)).cast("double")
    profile = F.concat_ws(",", *(F.round(F.col(c) * STEPS / F.col("size")).cast("int").cast("string") for c in counts))
    comps = comps.withColumns({"shape": shape, "profile": profile})
    found = comps.groupBy("shape", "profile").agg(F.avg("size").alias("size"), F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in counts)).orderBy("shape", "profile").collect()
    plan = allocate([(r["size"], {c: r[c] for c in counts if r[c]}, r["n"]) for r in found], proportions) if found else []
    quota = [(r["shape"], r["profile"], [int(x) for x in np.cumsum(p)]) for r, p in zip(found, plan, strict=True)]
    quotas = spark.createDataFrame(quota, "shape double, profile string, upto array<bigint>")
    ordered = running_before(comps.withColumn("_h", F.xxhash64("component", F.lit(seed))), ["shape", "profile"], "_h", "component", F.lit(1))
    names = F.array(*(F.lit(n) for n in proportions))
    split = F.element_at(names, (F.size(F.filter("upto", lambda u: u <= F.col("before"))) + 1).cast("int"))
    given = ordered.join(F.broadcast(quotas), ["shape", "profile"]).select("component", split.alias("split"))
    whole = salted_join(per.select("_e", "component").distinct(), given, "component", F.xxhash64("_e")).select("_e", "component", "split")
    out = salted_join(rows.filter("_e is not null"), whole, "_e", F.xxhash64("_k")).select("_k", "_e", "component", "split")
    alone = rows.filter("_e is null").withColumn("component", -F.abs(F.xxhash64("_k")) - 1).join(given, "component").select("_k", "_e", F.lit(None).cast("bigint").alias("component"), "split")
    return out.unionByName(alone).select(F.col("_k").alias(key), F.col("_e").alias(example), "component", "split")


def report(given: DataFrame) -> DataFrame:
    """(split, records, components, share) of what assign_splits gives: counts of each split and its share of all records.

    Components are counted exactly, a row for each of them first; a record with a null component is one by itself.
    """
    each = given.groupBy("split", "component").agg(F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("component").isNull(), F.col("n")).otherwise(F.lit(1))
    per = each.groupBy("split").agg(F.sum("n").alias("records"), F.sum(parts).alias("components"))
    return attach(per, per.agg(F.sum("records").alias("_all"))).select("split", "records", "components", F.round(F.col("records") / F.col("_all"), 6).alias("share"))
