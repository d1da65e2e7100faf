"""Outputs: sized Parquet, CSV, JSON, files, reports, caches."""

from __future__ import annotations

import html
import io
import math
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.operators.difficulty import card, extremes
from inkfield.plans.shared import cut, file_system

#: Bounds of an output shard's bytes; rows of either end of the report.
LEAST_SHARD, MOST_SHARD, REPORT_ROWS = 100_000_000, 1_000_000_000, 50
#: Codes of a document of predictions, in bytes: what one task puts together.
DOCUMENT_BYTES = 64 * 1024 * 1024


def shard_bytes(total: int) -> int:
    return min(max(total // 10, LEAST_SHARD), MOST_SHARD)


def write_parquet(df: DataFrame, path: str, total_bytes: int | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet, in shards of a tenth of the total within bounds where the total is known."""
    if total_bytes is not None:
        df = df.repartition(max(1, math.ceil(total_bytes / shard_bytes(total_bytes))))
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV folder with headers. Appending adds files; task commits take the place of a lock."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the output hasn't, once each; returns how many."""
    from inkfield.sources.files import done_keys

    new = df.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(done_keys(df.sparkSession, path, key), key, "left_anti").select(*df.columns).persist()
    n = new.count()
    if n:
        write_csv(new, path, append=True)
    new.unpersist()
    return n


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_predictions(candidates: DataFrame, path: str, item: str, order: str, code: str, document_bytes: int = DOCUMENT_BYTES) -> None:
    """Documents that hold the list of each item's codes, ascending by `order`: one of about document_bytes for each range of items,
    below part=<number of the range>."""
    per = candidates.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, code))), lambda x: x[code]).alias("codes"))
    total = candidates.agg(F.sum(F.octet_length(code))).first()[0] or 0
    ranged = cut(per.repartitionByRange(max(1, math.ceil(total / document_bytes)), item).withColumn("part", F.format_string("%09d", F.spark_partition_id())))
    whole = ranged.groupBy("part").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(item, "codes"))), lambda x: x["codes"])).alias("value"))
    whole.write.mode("overwrite").partitionBy("part").text(path)


def arrow_folder(folder: str):
    """(Arrow file system, path) of a folder's address; file:/a, file:///a and /a name the same."""
    return FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def write_files(df: DataFrame, folder: str, path: str, content: str) -> DataFrame:
    """(path, written): each row's bytes to a file below the folder, by the tasks that hold them. Null content: false, as for a
    path that leads out of the folder. The folder may lie in any file system that Arrow knows by its address."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = arrow_folder(folder)
        made = set()
        for pdf in batches:
            done = []
            for name, body in zip(pdf["path"], pdf["content"], strict=True):
                inside = name is not None and posixpath.normpath(name).split("/")[0] not in ("..", "")
                if inside and body is not None:
                    to = posixpath.join(base, posixpath.normpath(name))
                    if (above := posixpath.dirname(to)) not in made:
                        store.create_dir(above, recursive=True)
                        made.add(above)
                    with store.open_output_stream(to, compression=None) as out:
                        out.write(body)
                done.append(inside and body is not None)
            yield pd.DataFrame({"path": pdf["path"], "written": done})

    return df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInPandas(write, "path string, written boolean")


def write_archives(df: DataFrame, folder: str, path: str, content: str, kind: str = "tar.gz") -> DataFrame:
    """(archive, members): each task packs its rows' bytes into one archive below the folder, a tar.gz or a zip, named by its
    number, so that a task that runs again writes the same one. Rows without a path or bytes are left out."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = arrow_folder(folder)
        store.create_dir(base, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():05d}.{kind}", 0
        with store.open_output_stream(posixpath.join(base, name), compression=None) as out:
            pack = zipfile.ZipFile(out, "w") if kind == "zip" else tarfile.open(fileobj=out, mode="w|gz")
            with pack:
                for pdf in batches:
                    for member, body in zip(pdf["path"], pdf["content"], strict=True):
                        if member is None or body is None:
                            continue
                        n += 1
                        if kind == "zip":
                            pack.writestr(member, body)
                        else:
                            info = tarfile.TarInfo(member)
                            info.size = len(body)
                            pack.addfile(info, io.BytesIO(body))
        yield pd.DataFrame({"archive": [name], "members": [n]})

    return df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInPandas(write, "archive string, members bigint")


def html_report(table: DataFrame, n: int = REPORT_ROWS) -> str:
    """The n lowest and n highest scored rows of a ranked table as a page; at most 2n rows are collected. Nulls are blank."""
    rows = extremes(table, n).orderBy("section", "rank").collect()
    columns = [c for c in table.columns]
    out = ["<!doctype html><meta charset=utf-8><title>Scores</title>"]
    for section in ("lowest_score", "highest_score"):
        out.append(f"<h2>{section}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>")
        out += [f"<tr>{''.join(f'<td>{html.escape(str(r[c])) if r[c] is not None else ''}</td>' for c in columns)}</tr>" for r in rows if r["section"] == section]
        out.append("</table>")
    return "\n".join(out)


def dataset_card(table: DataFrame, title: str = "Scored programs") -> str:
    """Markdown with the figures of card(): one row is collected."""
    r = card(table).first()
    number = lambda x: "-" if x is None else f"{x:.4f}"
    return "\n".join([f"# {title}", "", "| figure | value |", "|-|-|", f"| rows | {r['rows']} |", *(f"| {k.replace('_', ' ')} | {number(r[k])} |" for k in ("mean_image", "mean_code", "mean_combined", "least", "most"))])


def cached(corpus: DataFrame, column: str, folder: str, build) -> DataFrame:
    """build(corpus), kept below the folder under the md5 of the sorted corpus: rebuilt only when its content changes.

    The digest is taken over the sum and the count of the rows' hashes, so no task gathers the corpus.
    """
    spark = corpus.sparkSession
    h = F.xxhash64(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))
    key = corpus.agg(F.md5(F.concat_ws("|", F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h).cast("decimal(38,0)")), F.count(F.lit(1)))).alias("k")).first()["k"]
    path = f"{folder}/{key}"
    fs, where = file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(where):
        build(corpus).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def tree_dot(nodes: DataFrame, node: str, parent: str, label: str) -> DataFrame:
    """(line): edges and labelled nodes of a tree in DOT; labels are escaped like JSON strings."""
    quoted = F.regexp_replace(F.regexp_replace(F.col(label).cast("string"), r"\\", r"\\\\"), '"', r'\\"')
    shown = nodes.select(F.concat(F.lit("n"), F.col(node), F.lit(' [label="'), F.coalesce(quoted, F.lit("")), F.lit('"];')).alias("line"))
    edges = nodes.filter(F.col(parent).isNotNull()).select(F.concat(F.lit("n"), F.col(parent), F.lit(" -> n"), F.col(node), F.lit(";")).alias("line"))
    return shown.unionByName(edges)
