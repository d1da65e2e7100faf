"""Queries of streams, sources and sinks over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.plans.shared import new_folder
from inkfield.queries.evaluation import _tree
from inkfield.session import table
from inkfield.sinks import files as sinks
from inkfield.sources import archives
from inkfield.sources import files as sources
from inkfield.streaming import streams


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(table(spark, folder, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/{name}.parque[t]")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives until it is drained, from the shared folder."""
    spark, out = df.sparkSession, new_folder(df.sparkSession, "stream")
    if mode == "append":
        streams.append_stream(df, out, f"{out}-state").awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def last(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    df.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_windows(spark, folder):
    out = drained(streams.tumbling(stream(spark, folder, "events"), "ts", "1 day", "event_type", "value"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, folder):
    out = drained(streams.tumbling(stream(spark, folder, "events"), "ts", "12 hours", "event_type", "value", slide="6 hours"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_sessions(spark, folder):
    """Sessions per user, gap 12 hours."""
    out = drained(streams.sessions(stream(spark, folder, "events"), "ts", "12 hours", "user_id"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def stream_best(spark, folder):
    return drained(streams.best_so_far(stream(spark, folder, "events").filter("value is not null"), "user_id", "value", "event_id"), "complete").select("user_id", F.round("best", 4).alias("best"), "candidate", "seen")


def stream_scores(spark, folder):
    """Keys scored by the incremental scorer, each once."""
    rows = stream(spark, folder, "results_v1")
    out = drained(streams.scored_stream(rows, ["example_number", "combination_number"]).select("example_number", "combination_number", "combined_score"), "append")
    return out.filter("combined_score is not null").select("example_number", "combination_number")


def csv_round_trip(spark, folder):
    """Result rows written as CSV and read back by their schema."""
    out = new_folder(spark, "csv")
    rows = table(spark, folder, "results_v1").select(*sources.RESULTS.names)
    sinks.write_csv(rows, out)
    back = sources.results_csv(spark, out)
    return back.groupBy("example_number", "combination_number").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("image_similarity"), 4).alias("image"), F.count_if(F.col("original_code_path").isNull() | (F.col("original_code_path") == "")).alias("no_path"))


def json_round_trip(spark, folder):
    """Codes of each example as one document of lists, read back."""
    out = new_folder(spark, "json")
    rows = table(spark, folder, "decomposed").select(F.regexp_extract("id", r"example_([0-9]+)", 1).cast("int").alias("example"), "id", F.md5("code").alias("code")).dropDuplicates(["id"])
    sinks.write_predictions(rows, out, "example", "id", "code")
    back = sources.predictions_json(spark, out)
    return back.select(F.col("item").cast("bigint").alias("item"), F.col("candidate").cast("bigint").alias("candidate"), "code")


def resume_append(spark, folder):
    """Keys of an output that was appended to in two steps that overlap."""
    out = new_folder(spark, "append")
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("example_file"), F.coalesce("source", F.lit("none")).alias("source"))
    sinks.append_new(docs.filter("source < 'm'"), out, "example_file")
    sinks.append_new(docs, out, "example_file")
    return spark.read.option("header", True).schema("example_file string, source string").csv(out)


def tree_lines(spark, folder):
    """The event heaps as lines of DOT."""
    t = _tree(spark, folder).withColumns({"n": F.concat_ws("_", "tree", "node"), "p": F.when(F.col("parent").isNotNull(), F.concat_ws("_", "tree", "parent"))})
    return sinks.tree_dot(t, "n", "p", "node")


def _programs(spark, folder):
    """(id, example, stem, png, code) of the decomposed table, each id once."""
    d = table(spark, folder, "decomposed").groupBy("id").agg(F.min("png").alias("png"), F.min("code").alias("code"))
    return d.select("id", F.regexp_extract("id", r"^(example_\d+)_", 1).alias("example"), F.regexp_extract("id", r"^example_\d+_(.*)$", 1).alias("stem"), "png", "code")


def _local(folder: str) -> str:
    """A folder's address as a path, for readers that take patterns of paths."""
    return sinks.arrow_folder(folder)[1]


def _done(written: DataFrame) -> None:
    written.write.format("noop").mode("overwrite").save()


def folder_tree(spark, folder):
    """Programs written as a tree of folders and read back; examples with nothing but their main image are left out."""
    out, d = new_folder(spark, "tree"), _programs(spark, folder)
    pngs = d.select(F.concat_ws("/", "example", F.lit("png"), F.concat("stem", F.lit(".png"))).alias("path"), F.col("png").alias("content"))
    codes = d.select(F.concat_ws("/", "example", F.lit("code"), F.concat(F.when(F.col("stem") == "main", "original").otherwise(F.col("stem")), F.lit(".tex"))).alias("path"), F.col("code").cast("binary").alias("content"))
    _done(sinks.write_files(pngs.unionByName(codes), out, "path", "content"))
    return sources.decomposed_tree(spark, out).select("id", F.md5("png").alias("png"), F.md5("code").alias("code"))


def flat_slice(spark, folder):
    """Images of one folder from the eleventh on, by name."""
    out, d = new_folder(spark, "flat"), _programs(spark, folder).filter("stem <> 'main'")
    _done(sinks.write_files(d.select(F.concat("id", F.lit(".png")).alias("path"), "png"), out, "path", "png"))
    return sources.flat_images(spark, out, start=10).select("name", "example_number", "combination_number", F.md5("content").alias("png"))


def archive_figures(spark, folder):
    """Figures packed into tar archives, each with a JSON file of captions and recognised text, joined with their images again."""
    out, d = new_folder(spark, "archives"), _programs(spark, folder)
    lines = F.slice(F.split("code", "\n", -1), 1, 3)
    meta = F.to_json(F.struct(F.col("id").alias("figure_id"), lines.alias("captions"), F.struct(F.array(F.struct(F.col("stem").alias("text"))).alias("ocr_result")).alias("ocr_result")))
    members = d.select(F.explode(F.array(F.struct(F.concat("id", F.lit(".json")).alias("path"), meta.cast("binary").alias("content")), F.struct(F.concat("id", F.lit(".png")).alias("path"), F.col("png").alias("content")))).alias("m")).select("m.*")
    _done(sinks.write_archives(members, out, "path", "content"))
    found = archives.paper_figures(spark, f"{_local(out)}/*.tar.gz")
    return found.select("figure_id", F.md5("caption").alias("caption"), F.size(F.flatten("mention")).alias("mentions"), F.element_at("ocr", 1).alias("ocr"), F.md5("image").alias("image"))


#: Figures of one shard of texts.
SHARD_ROWS = 1000


def archive_texts(spark, folder):
    """Texts of figures in JSON shards of annotations, joined with images that lie in zip archives."""
    out, d = new_folder(spark, "shards"), _programs(spark, folder)
    shards = max(1, -(-d.count() // SHARD_ROWS))
    image = F.struct(F.col("id"), F.concat(F.lit("figures/"), "id", F.lit(".png")).alias("file_name"), F.array("stem").alias("ocr"))
    note = F.struct(F.col("id").alias("image_id"), F.col("example").alias("caption_no_index"), F.array(F.array("stem")).alias("mention"), F.array(F.col("code")).alias("paragraph"))
    doc = F.to_json(F.struct(F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations")))
    d.groupBy(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("part")).agg(doc.alias("value")).write.partitionBy("part").text(f"{out}/texts")
    _done(sinks.write_archives(d.select(F.concat(F.lit("x/"), "id", F.lit(".png")).alias("path"), "png"), f"{out}/images", "path", "png", "zip"))
    found = archives.science_figures(spark, f"{out}/texts", f"{_local(out)}/images/*.zip")
    return found.select("image_id", "caption", F.element_at("ocr", 1).alias("ocr"), F.md5(F.element_at("paragraph", 1)).alias("paragraph"), F.md5("image").alias("image"))


def united_shards(spark, folder):
    """Result shards of two layouts, keys in columns or in a file name, read together."""
    out, rows = new_folder(spark, "united"), table(spark, folder, "results_v1")
    main = F.col("combination_number") == "main"
    sinks.write_csv(rows.filter(main).select(*sources.RESULTS.names), f"{out}/a")
    named = rows.filter(~main).withColumn("example_file", F.concat(F.lit("example_"), "example_number", F.lit("_combination_"), "combination_number", F.lit(".png")))
    sinks.write_csv(named.select(*sources.RESULTS_BY_FILE.names), f"{out}/b")
    back = sources.shards_csv(spark, out)
    return back.groupBy("example_number", "combination_number", "example_file").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("code_similarity"), 4).alias("code"))


def stream_lines(spark, folder):
    """Texts that arrive in pieces of 16 characters, put out line by line: lines, characters and open ends of each document."""
    out = new_folder(spark, "pieces")
    pieces = F.concat(F.regexp_extract_all("text", F.lit(r"(?s).{1,16}"), F.lit(0)), F.array(F.lit(None).cast("string")))
    table(spark, folder, "documents").filter("text is not null").select("doc_id", F.posexplode(pieces).alias("pos", "piece")).write.parquet(out)
    src = spark.readStream.schema("doc_id bigint, pos int, piece string").parquet(out)
    lines = drained(streams.rechunk_lines(src, "doc_id", "pos", "piece"), "append")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"), F.count_if("last").alias("open_ends"))


def stream_fan_out(spark, folder):
    """Events passed to two sinks at once: counts of both."""
    out = new_folder(spark, "fan")
    high, low = (lambda batch, i, side=side, ok=ok: batch.filter(ok).select("event_id", "event_type").write.mode("append").parquet(f"{out}/{side}") for side, ok in (("high", "value > 50"), ("low", "value <= 50")))
    streams.fan_out(stream(spark, folder, "events"), [high, low], f"{out}-state").awaitTermination()
    both = [spark.read.schema("event_id bigint, event_type string").parquet(f"{out}/{side}").withColumn("side", F.lit(side)) for side in ("high", "low")]
    return both[0].unionByName(both[1]).groupBy("side", "event_type").agg(F.count(F.lit(1)).alias("n"))


#: Parts that the events arrive in, and how long late ones are waited for.
ARRIVALS, DELAY_DAYS = 4, 10


def stream_late(spark, folder):
    """Daily counts in append mode, of events that arrive in four parts by id: what comes behind the watermark of the parts before
    is dropped, and only days that the last watermark has passed are put out."""
    out, events = new_folder(spark, "late"), table(spark, folder, "events").filter("ts is not null")
    part = F.floor(F.col("event_id") * ARRIVALS / (events.agg(F.max("event_id")).first()[0] + 1))
    for k in range(ARRIVALS):
        events.filter(part == k).write.mode("append").parquet(f"{out}/in")
        src = spark.readStream.schema(events.schema).parquet(f"{out}/in")
        streams.append_stream(streams.tumbling(src, "ts", "1 day", "event_type", "value", f"{DELAY_DAYS} days"), f"{out}/out", f"{out}/state").awaitTermination()
    back = spark.read.parquet(f"{out}/out")
    return back.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def parquet_round_trip(spark, folder):
    """Scored rows in shards of a size that follows from the total, by generator, read again by the name of a loader."""
    out = new_folder(spark, "parquet")
    rows = table(spark, folder, "upload_data").select("row_id", "generator", "batch_id", F.octet_length("original_code").alias("size")).dropDuplicates(["row_id"])
    sinks.write_parquet(rows, out, rows.agg(F.sum("size")).first()[0] or 0, ["generator"])
    sources.register_source("scored_rows", lambda s, path: s.read.parquet(path))
    back = sources.resolve(spark, "scored_rows", out)
    return back.groupBy("generator").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_distinct("batch_id").alias("batches"))


def best_per_model(spark, folder):
    """By generator and example: the row of the least code score and the number of all codes, written by generator."""
    out = new_folder(spark, "models")
    rows = table(spark, folder, "upload_data").filter("generator is not null").select("row_id", "generator", "example_number", F.when(~F.isnan("code_score"), F.col("code_score")).alias("score"), "generated_code").dropDuplicates(["row_id"])
    low = F.struct(F.col("score").isNull(), "score", "row_id")
    sinks.write_parquet(rows.groupBy("generator", "example_number").agg(F.min_by("row_id", low).alias("best_row"), F.count("generated_code").alias("codes")), out, partition_by=["generator"])
    return spark.read.parquet(out).select("generator", "example_number", "best_row", "codes")


def cached_corpus(spark, folder):
    """Lengths of the distinct original codes, kept under the digest of the corpus; built once though asked for twice."""
    out, built = new_folder(spark, "cache"), []
    corpus = table(spark, folder, "upload_data").filter("original_code is not null").select("original_code").distinct()

    def build(df: DataFrame) -> DataFrame:
        built.append(1)
        return df.groupBy(F.length("original_code").alias("length")).agg(F.count(F.lit(1)).alias("n"))

    for order in (corpus, corpus.orderBy("original_code")):
        found = sinks.cached(order, "original_code", out, build)
    return found.select("length", "n", F.lit(len(built)).alias("builds"))


_TREE = "t AS (SELECT event_id // 512 AS tree, event_id % 512 + 1 AS node, CASE WHEN event_id % 512 > 0 THEN (event_id % 512 + 1) // 2 END AS parent FROM events)"
QUERIES = {f.__name__: f for f in (stream_windows, stream_sliding, stream_sessions, stream_best, stream_scores, csv_round_trip, json_round_trip, resume_append, tree_lines, folder_tree, flat_slice, archive_figures, archive_texts, united_shards, stream_lines, stream_fan_out, stream_late, parquet_round_trip, best_per_model, cached_corpus)}
SQL = {
    "stream_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS start, event_type FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_best": "SELECT user_id, round(max(value), 4) AS best, first(event_id ORDER BY value DESC, event_id) AS candidate, count(*) AS seen FROM events WHERE value IS NOT NULL GROUP BY 1",
    "stream_scores": "SELECT DISTINCT example_number, combination_number FROM results_v1",
    "csv_round_trip": "SELECT example_number, combination_number, count(*) AS n, round(sum(image_similarity), 4) AS image, count(*) FILTER (coalesce(original_code_path, '') = '') AS no_path FROM results_v1 GROUP BY ALL",
    "json_round_trip": "WITH d AS (SELECT regexp_extract(id, 'example_([0-9]+)', 1)::INT AS e, id, md5(min(code)) AS code FROM decomposed GROUP BY id) SELECT dense_rank() OVER (ORDER BY e) - 1 AS item, row_number() OVER (PARTITION BY e ORDER BY id) - 1 AS candidate, code FROM d",
    "resume_append": "SELECT doc_id::VARCHAR AS example_file, coalesce(source, 'none') AS source FROM documents",
    "tree_lines": f"""WITH {_TREE} SELECT 'n' || tree || '_' || node || ' [label="' || node || '"];' AS line FROM t UNION ALL SELECT 'n' || tree || '_' || parent || ' -> n' || tree || '_' || node || ';' FROM t WHERE parent IS NOT NULL""",
    "folder_tree": "WITH d AS (SELECT id, regexp_extract(id, '^(example_[0-9]+)_', 1) AS e, min(png) AS png, min(code) AS code FROM decomposed GROUP BY id) SELECT id, md5(png) AS png, md5(code) AS code FROM d WHERE e IN (SELECT e FROM d WHERE id NOT LIKE '%main')",
    "flat_slice": "WITH d AS (SELECT id, md5(min(png)) AS png, row_number() OVER (ORDER BY id || '.png') AS r FROM decomposed WHERE id NOT LIKE '%main' GROUP BY id) SELECT id || '.png' AS name, regexp_extract(id, 'example_([0-9]+)', 1)::INT AS example_number, regexp_extract(id, 'combination_([0-9]+)', 1)::INT AS combination_number, png FROM d WHERE r > 10",
    "archive_figures": "WITH d AS (SELECT id, min(png) AS png, string_split(min(code), chr(10)) AS l FROM decomposed GROUP BY id) SELECT id AS figure_id, md5(l[1]) AS caption, len(l[2:3])::INT AS mentions, regexp_extract(id, '^example_[0-9]+_(.*)$', 1) AS ocr, md5(png) AS image FROM d",
    "archive_texts": "SELECT id AS image_id, regexp_extract(id, '^(example_[0-9]+)_', 1) AS caption, regexp_extract(id, '^example_[0-9]+_(.*)$', 1) AS ocr, md5(min(code)) AS paragraph, md5(min(png)) AS image FROM decomposed GROUP BY id",
    "united_shards": "SELECT CASE WHEN m THEN example_number END AS example_number, CASE WHEN m THEN combination_number END AS combination_number, CASE WHEN NOT m THEN 'example_' || example_number || '_combination_' || combination_number || '.png' END AS example_file, count(*) AS n, round(sum(code_similarity), 4) AS code FROM (SELECT *, combination_number = 'main' AS m FROM results_v1) GROUP BY ALL",
    "stream_lines": "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + (NOT ends_with(text, chr(10)))::INT)::BIGINT AS lines, length(text)::BIGINT AS chars, (NOT ends_with(text, chr(10)))::BIGINT AS open_ends FROM documents WHERE text <> ''",
    "stream_fan_out": "SELECT CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS side, event_type, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "stream_late": f"""WITH e AS (SELECT *, floor(event_id * {ARRIVALS} / (SELECT max(event_id) + 1 FROM events WHERE ts IS NOT NULL)::DOUBLE)::INT AS part FROM events WHERE ts IS NOT NULL),
      m AS (SELECT part, epoch_ms(max(ts)) - {DELAY_DAYS} * 86400000 AS mark FROM e GROUP BY part),
      k AS (SELECT p AS part, (SELECT max(mark) FROM m WHERE m.part < p) AS mark FROM (SELECT unnest(range({ARRIVALS + 1})) AS p)),
      d AS (SELECT part, time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, value FROM e),
      seen AS (SELECT d.* FROM d JOIN k USING (part) WHERE mark IS NULL OR epoch_ms(start) + 86400000 > mark)
      SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM seen WHERE epoch_ms(start) + 86400000 <= (SELECT mark FROM k WHERE part = {ARRIVALS}) GROUP BY ALL""",
    "parquet_round_trip": "WITH u AS (SELECT DISTINCT ON (row_id) row_id, generator, batch_id, strlen(original_code) AS size FROM upload_data) SELECT generator, count(*) AS n, sum(size)::BIGINT AS bytes, count(DISTINCT batch_id) AS batches FROM u GROUP BY generator",
    "best_per_model": "WITH u AS (SELECT DISTINCT ON (row_id) row_id, generator, example_number, CASE WHEN NOT isnan(code_score) THEN code_score END AS score, generated_code FROM upload_data WHERE generator IS NOT NULL) SELECT generator, example_number, first(row_id ORDER BY score NULLS LAST, row_id) AS best_row, count(generated_code) AS codes FROM u GROUP BY ALL",
    "cached_corpus": "SELECT length(original_code)::INT AS length, count(*) AS n, 1 AS builds FROM (SELECT DISTINCT original_code FROM upload_data WHERE original_code IS NOT NULL) GROUP BY 1",
}
