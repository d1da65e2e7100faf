"""Texts laid into windows of fixed capacity: best-two-fit over the histogram of sizes, then ranks into places."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.llm.tokens import TOKENIZER, n_tokens
from inkfield.plans.shared import cut
from inkfield.plans.skew import running_before


#: Window sizes that are laid at once.
MOST_WINDOWS = 100


def best_two_fit(histogram: Mapping[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) of windows that hold the whole histogram of sizes; a pattern gives how many items of each size.

    A window is filled greedily, the largest size that fits first. Then its smallest item is replaced by two unpacked ones
    that fill the gap it would leave more tightly, as long as that helps. The same pattern is used again while the items for
    it last, so the number of steps grows with the number of different sizes (at most `capacity`), not of items.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    sizes = sorted(left)
    out: list[tuple[dict[int, int], int]] = []
    while sizes:
        held: dict[int, int] = {}
        gap = capacity
        spare = lambda s, held=held: left[s] - held.get(s, 0)
        at = len(sizes) - 1
        while at >= 0 and gap > 0:
            s = sizes[at]
            take = min(spare(s), gap // s)
            if take > 0:
                held[s] = held.get(s, 0) + take
                gap -= take * s
            at = min(at, bisect_right(sizes, gap)) - 1
        while gap > 0:
            least = min(held)
            pair = _two(sizes, lambda s: spare(s) + (s == least), gap + least, least)
            if pair is None:
                break
            held[least] -= 1
            if not held[least]:
                del held[least]
            for s in pair:
                held[s] = held.get(s, 0) + 1
            gap += least - sum(pair)
        times = min(left[s] // n for s, n in held.items())
        out.append((held, times))
        for s, n in held.items():
            left[s] -= n * times
            if not left[s]:
                sizes.remove(s)
    return out


def _two(sizes: list[int], spare, room: int, least: int) -> tuple[int, int] | None:
    """The two available sizes with the largest sum in (least, room], or None."""
    best, found = least, None
    i, j = 0, bisect_right(sizes, room) - 1
    while i <= j:
        a, b = sizes[i], sizes[j]
        total = a + b
        if total > room:
            j -= 1
            continue
        if total > best and spare(a) > 0 and spare(b) > (1 if i == j else 0):
            best, found = total, (a, b)
            if best == room:
                break
        i += 1
    return found


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank, first window and items per window of each run of ranks that fills windows of one pattern."""
    used: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for pattern, times in patterns:
        for s, n in pattern.items():
            runs.setdefault(s, []).append((used.get(s, 0), first, n))
            used[s] = used.get(s, 0) + n * times
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


def items(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(window_id, capacity, key, piece, size): each text once per window size. A text longer than the window is cut into full
    pieces and a rest; others stay whole. Null and empty texts have one piece of size 0. Null keys are dropped."""
    caps = windows.filter("n_tokens > 0 and window_id is not null").groupBy("window_id").agg(F.max("n_tokens").alias("n")).orderBy("window_id").limit(MOST_WINDOWS + 1).collect()
    if len(caps) > MOST_WINDOWS:
        raise ValueError(f"at most {MOST_WINDOWS} window sizes")
    sized = cut(docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), n_tokens(F.col(text), path).alias("tokens")))
    kind = dict(windows.dtypes)["window_id"]
    each = F.array(*(F.struct(F.lit(c["window_id"]).cast(kind).alias("window_id"), F.lit(c["n"]).cast("bigint").alias("capacity")) for c in caps)) if caps else F.array().cast(f"array<struct<window_id: {kind}, capacity: bigint>>")
    pieces = F.explode(F.sequence(F.lit(0), (F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)) - 1).cast("int")))
    every = sized.select("_k", "tokens", F.explode(each).alias("w")).select("_k", "tokens", "w.*").withColumn("piece", pieces)
    return every.select("window_id", "capacity", F.col("_k").alias(key), "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("size"))


def pack(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, seed: int = 3) -> DataFrame:
    """(window_id, key, piece, size, bin): where each text (or piece of one longer than the window) lies.

    Only the histogram of sizes reaches the driver (at most the capacity's number of rows for each window size). It is packed
    by best_two_fit; items of one size are numbered by hash order and take the places of their size in turn, so every row is
    assigned by its size and number alone. Items of size 0 need no room: their bin is null. Repeated rows of one key are
    separate items. Empty tables give no rows.
    """
    every = items(docs, windows, key, text, path)
    full = every.filter("size > 0")
    bars: dict[int, tuple[int, dict[int, int]]] = {}
    for r in full.groupBy("window_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n")).collect():
        bars.setdefault(r["window_id"], (r["capacity"], {}))[1][r["size"]] = r["n"]
    table = {w: places(best_two_fit(h, c)) for w, (c, h) in bars.items()}

    def batches(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for window, size, rank in frames:
            out = np.zeros(len(rank), np.int64)
            frame = pd.DataFrame({"w": window, "s": size})
            for (w, s), rows in frame.groupby(["w", "s"]).indices.items():
                start, first, each = table[w][s]
                r = rank.to_numpy()[rows]
                run = np.searchsorted(start, r, side="right") - 1
                out[rows] = first[run] + (r - start[run]) // each[run]
            yield pd.Series(out)

    ranked = running_before(full.withColumn("_h", F.xxhash64(F.col(key), F.col("piece"), F.lit(seed))), ["window_id", "size"], "_h", key, F.lit(1), "_rank")
    laid = ranked.select("window_id", key, "piece", "size", F.pandas_udf(batches, "bigint")(F.col("window_id"), F.col("size"), F.col("_rank")).alias("bin"))
    return laid.unionByName(every.filter("size = 0").select("window_id", key, "piece", "size", F.lit(None).cast("bigint").alias("bin")))


def fill(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, bin, items, tokens, fill) of each window; fill is the share of the capacity that is used."""
    used = packed.filter("bin is not null").groupBy("window_id", "bin").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("tokens"))
    return used.join(F.broadcast(windows.select("window_id", "n_tokens").dropDuplicates(["window_id"])), "window_id").select("window_id", "bin", "items", "tokens", F.round(F.col("tokens") / F.col("n_tokens"), 6).alias("fill"))
