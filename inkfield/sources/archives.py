"""Figure archives as a Spark data source: one partition per tar or zip file, members streamed."""

from __future__ import annotations

import glob
import io
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

META = "struct<figure_id: string, captions: array<string>, ocr_result: struct<ocr_result: array<struct<text: string>>>>"
SCI = "struct<images: array<struct<id: string, file_name: string, ocr: array<string>>>, annotations: array<struct<image_id: string, caption_no_index: string, mention: array<array<string>>, paragraph: array<string>>>>"


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.suffixes = tuple(s for s in options.get("suffixes", "").lower().split(",") if s)

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        wanted = lambda name: not self.suffixes or name.lower().endswith(self.suffixes)
        for name, body in members(partition.path):
            if wanted(name):
                yield partition.path, name, body


def members(path: str) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the files in a tar (plain or compressed) or zip. A zip split into .z01, .z02, ... is read with its
    parts put before it. A damaged archive gives what comes before the damage."""
    if path.lower().endswith(".zip"):
        pieces = sorted(glob.glob(f"{glob.escape(path[:-4])}.z[0-9][0-9]"))
        data: io.IOBase | str = io.BytesIO(b"".join(Path(p).read_bytes() for p in [*pieces, path])) if pieces else path
        try:
            with zipfile.ZipFile(data) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield info.filename, z.read(info)
        except zipfile.BadZipFile:
            return
    else:
        try:
            with tarfile.open(path, "r|*") as t:
                for info in t:
                    if info.isfile():
                        yield info.name, t.extractfile(info).read()
        except (tarfile.TarError, EOFError):
            return


class ArchiveSource(DataSource):
    """spark.read.format("figure_archive").option("suffixes", ".png,.json").load(glob): archive, name, content."""

    @classmethod
    def name(cls) -> str:
        return "figure_archive"

    def schema(self) -> str:
        return "archive string, name string, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive_members(spark: SparkSession, pattern: str, suffixes: str = "") -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("figure_archive").option("suffixes", suffixes).load(pattern)


def paper_figures(spark: SparkSession, pattern: str) -> DataFrame:
    """(caption, mention, ocr, image) of archives with JSON metadata and PNG members, joined on figure_id.

    A JSON file holds the metadata of one figure or a list of them. The first caption is the caption, the others are mentions. Images without metadata are dropped; orphans() finds them.
    """
    every = archive_members(spark, pattern, ".json,.png")
    text = F.decode("content", "UTF-8")
    meta = every.filter(F.endswith("name", F.lit(".json"))).select(F.explode(F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, f"array<{META}>")).otherwise(F.array(F.from_json(text, META)))).alias("m")).select("m.*").filter("figure_id is not null").dropDuplicates(["figure_id"])
    image = every.filter(F.endswith("name", F.lit(".png"))).select(F.regexp_extract("name", r"([^/]+)\.png$", 1).alias("figure_id"), F.col("content").alias("image"))
    rest = F.filter(F.array(F.slice("captions", F.lit(2), F.greatest(F.size("captions"), F.lit(0)))), lambda a: F.size(a) > 0)
    ocr = F.transform(F.coalesce("ocr_result.ocr_result", F.array()), lambda x: x["text"])
    return image.join(meta, "figure_id").select("figure_id", F.try_element_at("captions", F.lit(1)).alias("caption"), rest.alias("mention"), ocr.alias("ocr"), "image")


def orphans(spark: SparkSession, pattern: str) -> DataFrame:
    """Names of images without metadata."""
    every = archive_members(spark, pattern, ".json,.png")
    have = paper_figures(spark, pattern).select("figure_id")
    return every.filter(F.endswith("name", F.lit(".png"))).select(F.regexp_extract("name", r"([^/]+)\.png$", 1).alias("figure_id"), "name").join(have, "figure_id", "left_anti")


def science_figures(spark: SparkSession, texts: str, images: str) -> DataFrame:
    """(caption, mention, paragraph, ocr, image) of JSON shards and zip archives: annotations to images by id, images to
    archive members by file name."""
    shard = spark.read.text(texts, wholetext=True).select(F.from_json("value", SCI).alias("j"))
    image = shard.select(F.explode("j.images").alias("i")).select(F.col("i.id").alias("image_id"), F.substring_index("i.file_name", "/", -1).alias("file"), "i.ocr")
    note = shard.select(F.explode("j.annotations").alias("a")).select("a.*")
    member = archive_members(spark, images, ".png,.jpg").select(F.substring_index("name", "/", -1).alias("file"), F.col("content").alias("image"))
    return note.join(image, "image_id").join(member, "file").select("image_id", F.col("caption_no_index").alias("caption"), "mention", "paragraph", "ocr", "image")
