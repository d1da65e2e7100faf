"""Tables and file trees: Parquet, CSV, JSON, folders of programs and images, slices in a total order."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfield.functions.text import example_id
from inkfield.plans.order import attach, ranked

RESULTS = T.StructType([T.StructField("example_number", T.IntegerType()), T.StructField("combination_number", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("image_similarity", "code_similarity", "combined_score")), *(T.StructField(c, T.StringType()) for c in ("original_image_path", "generated_image_path", "original_code_path", "generated_code_path"))])
RESULTS_BY_FILE = T.StructType([T.StructField("example_file", T.StringType()), *RESULTS.fields[2:]])
#: Loaders by name; register_source adds to them.
_registry: dict[str, object] = {}


def register_source(name: str, load) -> None:
    """load(spark, path) -> DataFrame for resolve()."""
    _registry[name] = load


def resolve(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """A registered loader by its name; otherwise a local folder or file of Parquet; otherwise Spark's own reader of that path."""
    if name in _registry:
        return _registry[name](spark, path)
    return spark.read.parquet(str(Path(name)) if Path(name).exists() else name)


def results_csv(spark: SparkSession, paths: str | list[str], by_file: bool = False) -> DataFrame:
    """Result shards with a header: typed by schema, never inferred. Missing columns are null, rows that don't parse are kept
    with nulls, unreadable files are skipped."""
    read = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return read.schema(RESULTS_BY_FILE if by_file else RESULTS).csv(paths)


def shards_csv(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All shards of a folder, columns united by name; a file of another layout than the first leaves its other columns null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", F.substring_index(F.decode(F.substring("content", 1, 4096), "UTF-8"), "\n", 1).alias("head"))
    layouts = files.groupBy("head").agg(F.collect_list("path").alias("paths")).orderBy("head").collect()  # one row per header line
    out = None
    for row in layouts:
        part = results_csv(spark, row["paths"], "example_file" in row["head"]).withColumn("shard_file", F.input_file_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], RESULTS.add("shard_file", T.StringType()))


def done_keys(spark: SparkSession, path: str, key: str = "example_file") -> DataFrame:
    """Distinct keys of an output that may not exist yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.option("header", True).csv(path).select(key).distinct()


def predictions_json(spark: SparkSession, path: str) -> DataFrame:
    """(item, candidate, code) of documents that hold a list of lists of codes, ascending by score. Items are numbered on through
    the documents of a folder in the order of their names; of these only the sizes meet in one place."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<array<string>>").alias("items"))
    before = F.coalesce(F.sum(F.size("items")).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = text.select("file", F.col("items")).select("file", before.alias("before"))  # one row per document
    rows = text.join(sizes, "file").select("before", F.posexplode("items").alias("at", "codes"))
    return rows.select((F.col("before") + F.col("at")).alias("item"), F.posexplode("codes").alias("candidate", "code"))


def trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """(epoch): that of the last entry of a trainer state's log; null if it has none."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.try_element_at(F.from_json("value", "struct<log_history: array<struct<epoch: double>>>").log_history, F.lit(-1)).epoch.alias("epoch"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def decomposed_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(id, png, code) of folders example_i/code/{combination_j,original}.tex and example_i/png/{combination_j,main}.png.

    Images and codes are joined on their stem; original.tex belongs to main.png. Examples whose images are main.png alone are
    left out, as nothing of them compiled; so are files without a partner.
    """
    files = binary_files(spark, folder)
    part = F.regexp_extract_all("path", F.lit(r"(example_\d+)/(code|png)/(combination_\d+|original|main)\.(?:tex|png)$"), F.lit(0))
    at = files.filter(F.size(part) > 0).select(F.regexp_extract("path", r"(example_\d+)/(code|png)/", 1).alias("example"), F.regexp_extract("path", r"(example_\d+)/(code|png)/", 2).alias("kind"), F.replace(F.regexp_extract("path", r"/([^/]+)\.(tex|png)$", 1), F.lit("original"), F.lit("main")).alias("stem"), "content")
    png = at.filter("kind = 'png'").select("example", "stem", F.col("content").alias("png"))
    code = at.filter("kind = 'code'").select("example", "stem", F.decode("content", "UTF-8").alias("code"))
    several = png.groupBy("example").agg(F.count_if(F.col("stem") != "main").alias("n")).filter("n > 0").select("example")
    return png.join(code, ["example", "stem"]).join(several, "example", "left_semi").select(F.concat_ws("_", "example", "stem").alias("id"), "png", "code")


def flat_images(spark: SparkSession, folder: str, start: int = 0, end: int | None = None) -> DataFrame:
    """example_*_combination_*.png of a folder in the order of their names, as text, sliced by position."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "example_*_combination_*.png").load(folder).select(F.substring_index("path", "/", -1).alias("name"), "content")
    rows = ranked(files.select("name"), [F.col("name")], "r").filter((F.col("r") > start) & (F.lit(True) if end is None else F.col("r") <= end))
    return files.join(rows, "name").withColumns(example_id(F.col("name")))


def first_rows(df: DataFrame, order: list[Column], n: int | None = None, share: float | None = None) -> DataFrame:
    """The first n rows, or the first share of all, in a total order."""
    if n is not None:
        return df.orderBy(*order).limit(n)
    r = ranked(df, order, "_r")
    most = r.agg(F.floor(F.max("_r") * share).alias("_m"))
    return attach(r, most).filter(F.col("_r") <= F.col("_m")).drop("_r", "_m")


def corpus_sample(df: DataFrame, key: str, most: int = 1000, seed: int = 0) -> DataFrame:
    """At most `most` rows without replacement, by seeded hash order of the key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key).limit(most)


def shard_archives(spark: SparkSession, shards: Mapping[str, str]) -> DataFrame:
    """(shard, archive) of a mapping given by the caller."""
    return spark.createDataFrame(sorted(shards.items()), "shard string, archive string")
