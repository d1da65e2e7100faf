"""Elements of programs: dependencies, prefixes, valid subsets, rebuilt programs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.functions.text import DEPENDENCY_COORDINATES, DEPENDENCY_NAMES

#: Bits of a mask in a BIGINT. Masks of more elements are refused; `subset_counts` counts those of any number.
MOST_ELEMENTS = 63
#: Masks held at once by a task.
CHUNK = 10_000


def elements(programs: DataFrame, key: str, parts: Column) -> DataFrame:
    """(key, pos, element): the elements of each program, numbered from 0."""
    return programs.select(F.col(key), F.posexplode(parts).alias("pos", "element"))


def dependencies(parts: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(key, src, dst): element src defines a name or coordinate that dst mentions.

    By default any substring counts, so two elements that share a name depend on each other; names are exploded once per element
    and looked for within their program. strict asks for the name in brackets and for an earlier definition, which is a join
    on the name.
    """
    names = F.array_distinct(F.concat(F.regexp_extract_all("element", F.lit(DEPENDENCY_NAMES), F.lit(1)), F.regexp_extract_all("element", F.lit(DEPENDENCY_COORDINATES), F.lit(1))))
    defined = parts.select(key, F.col("pos").alias("src"), F.explode(names).alias("_name"))
    if strict:
        return defined.join(defined.withColumnRenamed("src", "dst"), [key, "_name"]).filter("src < dst").select(key, "src", "dst").distinct()
    used = parts.select(key, F.col("pos").alias("dst"), F.col("element").alias("_e"))
    return defined.join(used, key).filter(F.contains("_e", F.col("_name")) & (F.col("src") != F.col("dst"))).select(key, "src", "dst").distinct()


def prefixes(programs: DataFrame, key: str, parts: Column, most: int = 10, skip: str = "\\end{", seed: int = 0) -> DataFrame:
    """(key, size, prefix): prefixes of each program; `most` sizes by hash order where there are more, without those whose
    last element holds `skip`."""
    n = F.size(parts)
    sizes = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    drawn = F.slice(F.transform(F.array_sort(F.transform(sizes, lambda s: F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), s.cast("string"), F.lit(seed))).alias("h"), s.alias("s")))), lambda x: x["s"]), 1, most)
    taken = programs.select(F.col(key), parts.alias("_p"), F.explode(F.array_sort(F.when(n > most, drawn).otherwise(sizes))).alias("size"))
    return taken.filter(~F.contains(F.element_at("_p", F.col("size")), F.lit(skip))).select(key, "size", F.slice("_p", F.lit(1), F.col("size")).alias("prefix"))


def grow_subsets(n: int, edges: list[tuple[int, int]]) -> Iterator[int]:
    """Bit masks, each once, of the non-empty subsets of 0..n-1 that are weakly connected and without a cycle under the edges.

    A subset grows by one neighbour at a time from its lowest element; neighbours passed over are barred for good, so no
    subset comes up twice. What holds a cycle isn't grown, as all that contains it holds one too. So the work follows the
    number of valid subsets, not 2**n; that number itself may double with each element of a dense program.
    """
    near, onto = [0] * n, [0] * n
    for a, b in edges:
        if a != b:
            near[a] |= 1 << b
            near[b] |= 1 << a
            onto[a] |= 1 << b

    def cyclic(mask: int, i: int) -> bool:
        """Whether element i, added last, is on a cycle within the mask."""
        seen = todo = onto[i] & mask
        while todo:
            bit = todo & -todo
            more = onto[bit.bit_length() - 1] & mask & ~seen
            seen |= more
            todo = todo & ~bit | more
        return bool(seen >> i & 1)

    for first in range(n):
        barred = (1 << (first + 1)) - 1
        stack = [(1 << first, near[first] & ~barred, barred)]
        while stack:
            mask, border, barred = stack.pop()
            yield mask
            while border:
                bit = border & -border
                border ^= bit
                barred |= bit
                i = bit.bit_length() - 1
                if not cyclic(mask | bit, i):
                    stack.append((mask | bit, border | near[i] & ~barred, barred))


def subset_validity(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """The masks of `grow_subsets` in order."""
    if n > MOST_ELEMENTS:
        raise ValueError(f"at most {MOST_ELEMENTS} elements")
    return sorted(grow_subsets(n, edges))


def _with_edges(parts: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, n, e): each program's number of elements and its edges, null where it has none."""
    sizes = parts.groupBy(key).agg((F.max("pos") + 1).alias("n"))
    links = edges.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("e"))
    return sizes.join(links, key, "left")


def valid_subsets(parts: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, mask) of the valid subsets of each program. A program of more than MOST_ELEMENTS elements raises an error."""
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids, kind = frame.column(0), frame.schema.field(0).type
            large = [k for k, n in zip(ids.to_pylist(), frame.column(1).to_pylist(), strict=True) if n > MOST_ELEMENTS]
            if large:
                raise ValueError(f"masks hold at most {MOST_ELEMENTS} elements: {large[:5]}")
            found = ((k, m) for k, n, e in zip(ids.to_pylist(), frame.column(1).to_pylist(), frame.column(2).to_pylist(), strict=True) for m in grow_subsets(n, [(z["src"], z["dst"]) for z in e or []]))
            while some := list(islice(found, CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], kind), pa.array([m for _, m in some], pa.int64())], [key, "mask"])

    all_of = _with_edges(parts, edges, key).select(key, "n", "e")
    return all_of.mapInArrow(batches, f"`{key}` {all_of.schema[key].dataType.simpleString()}, mask bigint")


def subset_counts(parts: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, subsets): the number of valid subsets of each program, whatever its number of elements."""
    def batches(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for n, e in frames:
            yield pd.Series([sum(1 for _ in grow_subsets(int(x), [] if y is None else [(int(z["src"]), int(z["dst"])) for z in y])) for x, y in zip(n, e, strict=True)], dtype="int64")

    return _with_edges(parts, edges, key).select(key, F.pandas_udf(batches, "bigint")(F.col("n"), F.col("e")).alias("subsets"))
