"""Consolidation of many small files into few sorted ones: distinct contents, byte-sized ranges, reconciled before the swap.

Nothing is left behind: files that name no record go to a part of their own and are counted in the reconciliation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfield.plans.shared import file_system, new_folder
from inkfield.plans.skew import pairs_within, salted_join

TARGET_BYTES = 256 * 1024 * 1024
#: Keys sampled for the boundaries, over all; what reaches the driver. The sample is by hash: its size varies by its square root.
SAMPLE_KEYS = 100_000
#: Contents of which only one named file's body is shuffled, at most; their list is broadcast.
LISTED = 100_000
#: The folder and the extension of a path give the field that a file holds.
FIELDS = {("original", "tex"): "original_code", ("original", "png"): "original_image", ("generated", "tex"): "generated_code"}
#: Example, combination, copy marks and extension of a file name; written in any letter case.
NAME = r"(?i)^example_(\d+)_(?:combination_)?(main|-?\d+)(?:[ ._~-]*(?:\(\d+\)|copy\d*|retry\d*|\d+))*\.(tex|png)$"



def parse_path(files: DataFrame, path: str) -> DataFrame:
    """files with the field, example_number and combination_number (-1: main) that a path names; null where it names none.

    Separators may be slashes or backslashes, doubled or with dots between; copy marks before the extension don't count. The
    path is matched once; its parts are cut from the result.
    """
    flat = F.translate(F.trim(path), "\\", "/")
    parts = F.split(F.lower(F.regexp_replace(F.substring_index(flat, "/", -1), NAME, "$1|$2|$3")), r"\|")
    folder = F.lower(F.try_element_at(F.filter(F.split(flat, "/+"), lambda x: (x != ".") & (x != "")), F.lit(-2)))
    # A generator of one row: what is built on its output, filters too, doesn't evaluate the patterns again.
    found = F.struct(F.when(F.contains(flat, F.lit("/")), parts).alias("parts"), folder.alias("folder"))
    out = files.withColumn("_found", F.explode(F.array(found))).withColumns({"_parts": F.col("_found.parts"), "_in": F.col("_found.folder")})
    field = None
    for (where, ending), name in FIELDS.items():
        hit = (F.col("_in") == where) & (F.col("_parts")[2] == ending)
        field = F.when(hit, name) if field is None else field.when(hit, name)
    whole = F.size("_parts") == 3
    number = F.when(F.col("_parts")[1] == "main", -1).otherwise(F.col("_parts")[1].try_cast("int"))
    return out.withColumns({"field": F.when(whole, field), "example_number": F.when(whole, F.col("_parts")[0].try_cast("int")), "combination_number": F.when(whole, number)}).drop("_found", "_parts", "_in")


def parsed(files: DataFrame, file_id: str = "file_id", path: str = "path", body: str = "body") -> DataFrame:
    """(file_id, path, field, example_number, combination_number, named, body) of every file. `named`: it has an id and its path
    names a record. A null body counts as an empty one."""
    columns = files.select(F.col(file_id).alias("file_id"), F.col(path).alias("path"), F.coalesce(F.col(body), F.lit(b"")).alias("body"))
    named = F.expr("file_id is not null and field is not null and example_number is not null and combination_number is not null")
    return parse_path(columns, "path").select("file_id", "path", "field", "example_number", "combination_number", named.alias("named"), "body")


def named(files: DataFrame, file_id: str = "file_id", path: str = "path", body: str = "body") -> DataFrame:
    """(file_id, field, example_number, combination_number, n_bytes, digest, body) of the files that are named. Sizes are those of
    the bodies."""
    every = parsed(files, file_id, path, body).filter("named")
    return every.select("file_id", "field", "example_number", "combination_number", F.length("body").cast("bigint").alias("n_bytes"), F.sha2("body", 256).alias("digest"), "body")


def order_key() -> Column:
    """Clustering key as text that sorts like (example, combination, field, content)."""
    return F.concat(F.lpad(F.col("example_number").cast("string"), 10, "0"), F.lpad((F.col("combination_number") + 1).cast("string"), 10, "0"), F.lpad("field", 14, "_"), F.substring("digest", 1, 16))


def boundaries(rows: DataFrame, key: str, weight: str, target: int, sample_keys: int = SAMPLE_KEYS) -> list[str]:
    """Keys that cut the rows into ranges of about `target` bytes, from those of about sample_keys of them whose hash is lowest
    (all, where there are fewer). The same rows give the same cuts in every run."""
    total = rows.agg(F.sum(weight).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return []
    share = int(min(1.0, sample_keys / total["n"]) * (1 << 30))
    sample = sorted((r[0], r[1]) for r in rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) <= share).select(key, weight).collect())
    parts = max(1, round(total["b"] / target))
    sizes = np.cumsum([w + 1 for _, w in sample])
    cuts = np.searchsorted(sizes, sizes[-1] * np.arange(1, parts) / parts) if len(sample) else []
    return sorted({sample[i][0] for i in cuts})


def range_part(key: str, cuts: list[str]) -> Column:
    edges = np.array(cuts, dtype="S64")

    def batches(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(np.searchsorted(edges, s.to_numpy().astype("S64"), side="left").astype(np.int32))

    return F.pandas_udf(batches, "int")(F.col(key))


_LISTING = "file_id bigint, example_number int, combination_number int, field string, digest string, n_bytes bigint, mark bigint, path string, body binary, named boolean"


@dataclass(frozen=True)
class Compacted:
    """Where a consolidation lies: the records, which file each of them came from, and the files that name no record."""

    folder: str
    parts: int
    contents: int
    files: int
    unnamed: int

    def records(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/records")

    def origins(self, spark) -> DataFrame:
        return spark.read.schema(_LISTING).parquet(f"{self.folder}/listing").filter("named").drop("named", "mark", "path", "body")

    def rest(self, spark) -> DataFrame:
        """(file_id, path, body) of the files that name no record or have no id, as they were."""
        return spark.read.schema(_LISTING).parquet(f"{self.folder}/listing").filter("not named").select("file_id", "path", "body")


def _move(fs, source, to) -> None:
    if not fs.exists(source) or fs.exists(to) or not fs.rename(source, to):
        raise OSError(f"{source} could not be moved to {to}")


def recover(spark, target: str) -> None:
    """Ends what a crash may have left half done: a target that was moved aside and not replaced comes back, an old one that was
    replaced goes, as does what was staged. The old folder only exists from the first move of a swap to its end."""
    fs, at = file_system(spark, target)
    old, staged = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}.{x}") for x in ("old", "new"))
    if fs.exists(old) and not fs.exists(at):
        _move(fs, old, at)
    fs.delete(old, True)
    fs.delete(staged, True)


def swap(spark, target: str) -> None:
    """Puts the staged folder in the target's place. Where it can't be moved, the target is moved back before the error is raised."""
    fs, at = file_system(spark, target)
    old, staged = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}.{x}") for x in ("old", "new"))
    there = fs.exists(at)
    if there:
        _move(fs, at, old)
    try:
        _move(fs, staged, at)
    except Exception:
        if there:
            _move(fs, old, at)
        raise
    fs.delete(old, True)


def _totals(df: DataFrame, size: Column, mark: Column):
    """Rows, bytes and the sum of their marks."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(F.sum(mark.cast("decimal(38,0)")), F.lit(0)).alias("sum")).first()


def compact(files: DataFrame, target: str | None = None, target_bytes: int = TARGET_BYTES) -> Compacted:
    """Writes the distinct contents of each record's field, exactly once, to few files of about target_bytes, and swaps.

    Rows are range-partitioned by (example, combination, field, content) at boundaries sampled by bytes, so one example of
    any size spreads over several files, and sorted within each. A listing holds for every named source file the content it
    had, and, as they were, the files whose path names no record and those without an id. All are written beside the target. Two sums must agree before the swap: the records written with the distinct contents of the origins, and origins
    and unnamed files together with the whole source, read anew; each by rows, bytes and checksum. On a difference the new
    folder is removed, the target stays as it is, and RuntimeError is raised. A target left half swapped by a crash is put
    right first. Files without a body are contents of 0 bytes. An empty source gives empty folders.

    Of a content with more copies than rows/LISTED (of every repeated one in a small table), only one body is shuffled.
    """
    spark = files.sparkSession
    target = target or new_folder(spark, "compacted")
    recover(spark, target)
    staged, sort = f"{target}.new", ["example_number", "combination_number", "field", "digest"]
    mark = F.xxhash64("file_id", "body")
    wide = max(1, spark.sparkContext.defaultParallelism)
    apart = lambda c: F.when(~F.col("named"), F.col(c)).alias(c)
    listing = parsed(files).select("named", "file_id", *sort[:3], F.when(F.col("named"), F.sha2("body", 256)).alias("digest"), F.length("body").cast("bigint").alias("n_bytes"), mark.alias("mark"), apart("path"), apart("body"))
    listing.repartition(wide, "file_id").write.mode("overwrite").partitionBy("named").parquet(f"{staged}/listing")
    origins, rest = (spark.read.schema(_LISTING).parquet(f"{staged}/listing").filter(F.col("named") == n) for n in (True, False))
    kept, left = _totals(origins, F.col("n_bytes"), F.col("mark")), _totals(rest, F.length("body"), mark)
    heads = origins.groupBy(*sort).agg(F.first("n_bytes").alias("n_bytes"), F.min("file_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    cuts = boundaries(heads.withColumn("at", order_key()), "at", "n_bytes", target_bytes)
    parts = len(cuts) + 1
    often = heads.filter(F.col("_n") > max(1, kept["rows"] // LISTED)).select(*sort, "_keep")  # at most LISTED rows
    single = named(files).join(F.broadcast(often), sort, "left").filter("_keep is null or _keep = file_id").drop("_keep")
    # Copies of a content have one key, so those that are left meet in one range, where the first of them stays.
    ranged = single.withColumn("at", order_key()).withColumn("_part", range_part("at", cuts)).drop("at")
    inside = Window.partitionBy("_part").orderBy(*sort, "file_id")
    same = F.lit(True)
    for c in sort:
        same = same & (F.lag(c).over(inside) == F.col(c))
    once = ranged.repartitionById(parts, F.col("_part")).withColumn("_again", F.coalesce(same, F.lit(False))).filter("not _again")
    once.select("file_id", *sort, "n_bytes", "body").write.mode("overwrite").parquet(f"{staged}/records")
    written = spark.read.parquet(f"{staged}/records").withColumn("digest", F.sha2("body", 256))
    got = _totals(written, F.length("body"), F.xxhash64(*sort))
    source = _totals(files.select(F.col("file_id"), F.coalesce("body", F.lit(b"")).alias("body")), F.length("body"), mark)
    both = tuple(a + b for a, b in zip(kept, left, strict=True))
    if got != _totals(heads, F.col("n_bytes"), F.xxhash64(*sort)) or both != tuple(source):
        fs, new = file_system(spark, staged)
        fs.delete(new, True)
        raise RuntimeError("the written files differ from the source; the target is unchanged")
    swap(spark, target)
    return Compacted(target, parts, got["rows"], kept["rows"], left["rows"])


def content_key() -> Column:
    """One column that tells the contents of record fields apart."""
    return F.concat_ws("|", "example_number", "combination_number", "field", "digest")


def equal_files(origins: DataFrame) -> DataFrame:
    """(file_a, file_b), file_a < file_b: all pairs of files that hold one content of one record's field."""
    held = origins.select(content_key().alias("_g"), "file_id").distinct()
    return pairs_within(held, "_g", "file_id").withColumnsRenamed({"a": "file_a", "b": "file_b"})


def file_sets(origins: DataFrame) -> DataFrame:
    """(file_id, first_file, copies): every file with the lowest of the files that hold the same content of the same record's
    field, and their number. One row per file, however many copies there are."""
    held = origins.select(content_key().alias("_g"), "file_id").distinct()
    sets = held.groupBy("_g").agg(F.min("file_id").alias("first_file"), F.count(F.lit(1)).alias("_n"))
    return salted_join(held, sets.withColumn("copies", F.col("_n")).drop("_n"), "_g", F.xxhash64("file_id"), counts=sets).select("file_id", "first_file", "copies")


def file_report(compacted: Compacted, spark) -> DataFrame:
    """(part, records, bytes, first_example, last_example) of each file written; `part` is the number of its range."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint")
    rows = compacted.records(spark).select(part.alias("part"), "n_bytes", "example_number")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("records"), F.sum("n_bytes").alias("bytes"), F.min("example_number").alias("first_example"), F.max("example_number").alias("last_example"))
