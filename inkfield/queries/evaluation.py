"""Queries of evaluation, search, joins, curriculum, program elements, vectors and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.functions import curriculum as C
from inkfield.functions import images as I
from inkfield.functions import sequences as Q
from inkfield.functions import text as T
from inkfield.functions import vectors as V
from inkfield.operators import difficulty as D
from inkfield.operators import evaluation as E
from inkfield.operators import programs as P
from inkfield.operators import reuse as R
from inkfield.operators import search as H
from inkfield.plans.order import attach
from inkfield.session import table
from inkfield.sources.files import corpus_sample


def rows(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "upload_data").select("row_id", *columns).dropDuplicates(["row_id"])


def _valid(c: str) -> str:
    return f"{c} is not null and not isnan({c})"


def winsor_mean(spark, folder):
    """Mean code score by generator, five per cent of either tail pulled in."""
    r = rows(spark, folder, "generator", "code_score").filter(_valid("code_score")).withColumn("code_score", F.col("code_score").cast("double"))
    return E.winsorised_mean(r, ["generator"], "code_score").select("generator", F.round("mean", 4).alias("mean"))


def best_candidate(spark, folder):
    """Per example: the row of the lowest code score, and that of the highest."""
    r = rows(spark, folder, "example_number", "code_score").filter(_valid("code_score"))
    low = E.best_of(r, "example_number", "code_score", "row_id", lowest=True).select("example_number", F.col("row_id").alias("low_row"))
    high = E.best_of(r, "example_number", "code_score", "row_id").select("example_number", F.col("row_id").alias("high_row"))
    return low.join(high, "example_number")


def sampling_efficiency(spark, folder):
    r = rows(spark, folder, "example_number", "code_score", "generated_code").filter(_valid("code_score")).withColumn("n", F.length("generated_code"))
    return E.token_efficiency(r, "example_number", "code_score", "n", "row_id").select("example_number", "candidates", F.round("efficiency", 6).alias("efficiency"))


def throughput(spark, folder):
    """Winsorised mean number of candidates per example, all examples together."""
    per = rows(spark, folder, "example_number").groupBy("example_number").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return E.winsorised_mean(per, [], "n").select(F.round("mean", 6).alias("mean"))


def model_means(spark, folder):
    """Means by generator: of rendered rows only, and of all scores that are numbers."""
    r = rows(spark, folder, "generator", "image_score", "code_score", "generated_image")
    num = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    return r.groupBy("generator").agg(F.round(F.avg(F.when(F.col("generated_image").isNotNull(), num("image_score"))), 4).alias("rendered_image"), F.round(F.avg(num("code_score")), 4).alias("code"), F.count_if(F.col("generated_image").isNull()).alias("missing"))


def minmax_scores(spark, folder):
    """Scores scaled to 0..1 within each batch."""
    r = rows(spark, folder, "batch_id", "image_score").filter(_valid("image_score")).withColumn("image_score", F.col("image_score").cast("double"))
    return E.minmax(r, "batch_id", "image_score").select("batch_id", "row_id", F.round("norm", 5).alias("norm"))


def shard_interleave(spark, folder):
    r = table(spark, folder, "documents").select("doc_id", "source")
    return E.sharded(r, [F.col("source"), F.col("doc_id")], 7).select("doc_id", F.col("shard").cast("bigint").alias("shard"), F.col("pos").cast("bigint").alias("pos"))


def batches_of(spark, folder):
    out = E.batched(table(spark, folder, "documents").select("doc_id"), [F.col("doc_id")], 32)
    return out.groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def positional_align(spark, folder):
    """Captions of the two corpora joined by position in text order."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source").filter("text is not null and text <> ''")
    side = lambda s, n: docs.filter(F.col("source") == s).select(F.col("doc_id").alias(n), F.col("text").alias(f"{n}_t"))
    out = E.aligned(side("captions_a", "a"), side("captions_b", "b"), [F.col("a_t"), F.col("a")], [F.col("b_t"), F.col("b")])
    return out.select("position", "a", "b")


def stop_prefix(spark, folder):
    """Events of each user up to the first purchase-like value above 60 after a day, or 20 days."""
    e = table(spark, folder, "events").select("user_id", "event_id", "ts", "value")
    start = e.groupBy("user_id").agg(F.min("ts").alias("s"))
    t = e.join(start, "user_id").withColumn("elapsed", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("s").cast("timestamp"))) / 1e6)
    t = t.withColumn("o", F.struct("elapsed", "event_id"))
    return E.until_stop(t, "user_id", "o", F.col("value") > 60, F.col("elapsed"), 86400.0, 20 * 86400.0).select("user_id", "event_id")


def group_sample(spark, folder):
    return E.sample_per_group(table(spark, folder, "documents").filter("source is not null").select("source", "doc_id"), "source", "doc_id", 20)


def head_and_share(spark, folder):
    """The first 200 documents, and the first per cent of them, in key order."""
    docs = table(spark, folder, "documents").select("doc_id")
    one = D.ranked(docs, [F.col("doc_id")], "r")
    n = one.agg(F.max("r").alias("n"))
    return attach(one, n).filter((F.col("r") <= 200) | (F.col("r") <= F.floor(F.col("n") * 0.01))).select("doc_id", (F.col("r") <= 200).alias("head"), (F.col("r") <= F.floor(F.col("n") * 0.01)).alias("share"))


def resume_anti(spark, folder):
    """Program documents without a compile attempt."""
    docs = table(spark, folder, "documents").filter("source = 'program_text'").select("doc_id")
    return docs.join(table(spark, folder, "compile_logs").select("doc_id"), "doc_id", "left_anti")


def existing_semi(spark, folder):
    """Decomposed programs whose key is in the result shards."""
    have = table(spark, folder, "results_v1").select(F.concat(F.lit("example_"), F.col("example_number"), F.lit("_"), F.when(F.col("combination_number") == "main", "main").otherwise(F.concat(F.lit("combination_"), F.col("combination_number")))).alias("id"))
    return table(spark, folder, "decomposed").select("id").distinct().join(have, "id", "left_semi")


def metadata_join(spark, folder):
    """Line items with their part's brand and supplier's nation, summed."""
    l, p, s, n = (table(spark, folder, t) for t in ("lineitem", "part", "supplier", "nation"))
    j = l.select("l_partkey", "l_suppkey", "l_quantity").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").join(s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), "l_suppkey").join(F.broadcast(n.select("n_nationkey", "n_name")), "n_nationkey")  # nation: 25 rows
    return j.groupBy("p_brand", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def paired_files(spark, folder):
    """Images and codes of the decomposed table matched by their stem, the main pair included."""
    d = table(spark, folder, "decomposed").select("id", F.md5("png").alias("png"), F.md5("code").alias("code")).distinct()
    return d.select("id", "png").join(d.select("id", "code"), "id").withColumn("main", F.endswith("id", F.lit("main")))


def pair_scores(spark, folder):
    """Result rows with the scored rows of the same key."""
    r = D.first_per_key(D.normalised(table(spark, folder, "results_v1").select("example_number", "combination_number", "image_similarity", "shard_file", "written_at")), ["written_at", "shard_file"])
    u = rows(spark, folder, "example_number", "combination_number")
    return r.join(u, ["example_number", "combination_number"]).groupBy("example_number", "combination_number").agg(F.count(F.lit(1)).alias("rows"), F.round(F.min("image_similarity"), 6).alias("image"))


def corpus_union(spark, folder):
    a = table(spark, folder, "decomposed").select("id", "code").distinct().withColumn("part", F.lit("decomposed"))
    b = table(spark, folder, "documents").filter("source = 'program_text'").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("code"), "lang").withColumn("part", F.lit("documents"))
    return a.unionByName(b, allowMissingColumns=True).select("part", "id", "lang", F.length("code").cast("bigint").alias("n"))


def cardinality_guard(spark, folder):
    """Examples with at least one and fewer than 20 decomposed rows; those with nothing but the main one are marked."""
    e = T.example_id(F.col("id"))
    d = table(spark, folder, "decomposed").select("id", *(c.alias(k) for k, c in e.items())).distinct()
    return d.groupBy("example_number").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("combination_number") == -1).alias("main_only")).filter("n < 20")


def distinct_pairs(spark, folder):
    """Candidates per example after equal (score, code) pairs are dropped, and rows that failed to render."""
    r = rows(spark, folder, "example_number", "code_score", "generated_code", "generated_image")
    return r.groupBy("example_number").agg(F.countDistinct(F.coalesce("code_score", F.lit(-1.0)), F.coalesce("generated_code", F.lit(""))).alias("kept"), F.count_if(F.col("generated_image").isNull()).alias("failed"))


def shard_size(spark, folder):
    """Bytes of each shard's codes and the output shard size they give: a tenth, between 1e6 and 1e9."""
    r = rows(spark, folder, "generator", "original_code", "original_image")
    b = F.coalesce(F.octet_length("original_code"), F.lit(0)) + F.coalesce(F.length("original_image"), F.lit(0))
    return r.groupBy("generator").agg(F.sum(b).alias("bytes")).withColumn("shard", F.least(F.greatest(F.floor(F.col("bytes") / 10), F.lit(10**6)), F.lit(10**9)).cast("bigint"))


def curriculum_thresholds(spark, folder):
    e = F.col("id").cast("double")
    kinds = {"root_p": dict(grow=3, start=0.3, p=3), "linear": dict(grow=3, start=0.3), "geometric": dict(grow=3, start=0.3), "geometric_exact": dict(grow=3, start=0.3), "baby_step": dict(grow=3)}
    return spark.range(6).select(F.col("id").alias("epoch"), *(F.round(C.threshold(k, e, **o), 6).alias(k) for k, o in kinds.items()))


def curriculum_visible(spark, folder):
    """Rows of the ranked difficulty table that each of eight epochs sees, with the hardest one."""
    t = D.difficulty_table(table(spark, folder, "results_v1").select("example_number", "combination_number", "image_similarity", "code_similarity", "shard_file", "written_at"), ["written_at", "shard_file"]).select("rank", "combined_score")
    n = t.agg(F.count(F.lit(1)).alias("n"))
    epoch = F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>"))
    sizes = attach(t, n).withColumn("epoch", epoch).withColumn("visible", C.visible_size(C.threshold("root_p", (F.col("epoch") + 1).cast("double"), grow=8, start=0.3, p=2), F.col("n")))
    seen = sizes.filter(F.col("rank") <= F.col("visible"))
    return seen.groupBy("epoch", "visible").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("combined_score"), 6).alias("hardest"))


def _labels(spark, folder, limit=None):
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w).cast("int"))
    docs = table(spark, folder, "documents").select("doc_id", C.with_patches(ids, 0, 2, limit).alias("ids"))
    return docs.select("doc_id", F.array_join(C.label_mask(F.col("ids"), F.lit(0)).cast("array<string>"), " ").alias("labels"))


def label_masks(spark, folder):
    """Labels of word-length ids behind two patch tokens, cut to the MODEL_LIMIT ids that a model takes."""
    return _labels(spark, folder, C.MODEL_LIMIT)


def label_masks_whole(spark, folder):
    """Labels of all word-length ids behind two patch tokens, however many there are."""
    return _labels(spark, folder)


def padded_rows(spark, folder):
    """Length of each document's ids after padding to its batch of 16, in key order."""
    docs = E.batched(table(spark, folder, "documents").select("doc_id", "text"), [F.col("doc_id")], 16).withColumn("ids", F.transform(T.words(F.col("text")), lambda w: F.length(w).cast("int")))
    most = docs.groupBy("batch").agg(F.max(F.size("ids")).alias("m"))
    return docs.join(most, "batch").select("doc_id", F.size(C.padded(F.col("ids"), F.col("m"), 0)).cast("bigint").alias("n"), F.col("batch").cast("bigint").alias("batch"))


def checkpoint_marks(spark, folder):
    return spark.range(1, 201).filter(C.checkpoint_steps(F.col("id"), 50, 0.25)).select(F.col("id").alias("step"))


_SPLIT = "filter(transform(split(code, '\\n', -1), x -> trim(x)), x -> startswith(x, '\\\\draw') or startswith(x, '\\\\node') or startswith(x, '\\\\fill') or startswith(x, '\\\\coordinate'))"


def _elements(spark, folder):
    """Drawing lines of the decomposed programs."""
    d = table(spark, folder, "decomposed").groupBy("id").agg(F.min("code").alias("code"))
    return d.select("id", F.expr(_SPLIT).alias("parts"))


def element_dependencies(spark, folder):
    """Dependency edges between the drawing lines of each program: their number and the highest source."""
    d = _elements(spark, folder)
    return P.dependencies(P.elements(d, "id", F.col("parts")), "id").groupBy("id").agg(F.count(F.lit(1)).alias("edges"), F.max("src").cast("bigint").alias("last"))


def prefix_enumeration(spark, folder):
    return P.prefixes(_elements(spark, folder), "id", F.col("parts")).select("id", F.col("size").cast("bigint").alias("size"), F.md5(F.array_join("prefix", "\n")).alias("prefix"))


def subset_enumeration(spark, folder):
    """Number of valid subsets of each program's drawing lines, under strict dependencies, for programs of any length."""
    parts = P.elements(_elements(spark, folder), "id", F.col("parts"))
    return P.subset_counts(parts, P.dependencies(parts, "id", strict=True), "id")


def program_rebuilt(spark, folder):
    """Programs taken apart and put together again from all of their elements."""
    d = table(spark, folder, "decomposed").groupBy("id").agg(F.min("code").alias("code")).withColumn("d", Q.decompose_column(F.col("code")))
    pre = F.substring_index(F.col("d.preamble"), "\\begin{tikzpicture}", 1)
    return d.select("id", F.size("d.elements").cast("bigint").alias("elements"), F.md5(T.reconstruct(F.col("d.preamble"), F.col("d.options"), F.col("d.elements"), T.wrappers(F.col("code")), T.brace_balance(pre))).alias("code"))


def program_elements(spark, folder):
    """Options and elements of each program's picture."""
    d = table(spark, folder, "decomposed").groupBy("id").agg(F.min("code").alias("code")).withColumn("d", Q.decompose_column(F.col("code")))
    return d.select("id", F.md5("d.options").alias("options"), F.size("d.elements").cast("bigint").alias("elements"), F.md5(F.array_join("d.elements", "|")).alias("digest"))


def _tree(spark, folder):
    """All events as heaps: the ids of every block of 512 are the nodes 1 to 512 of a tree."""
    e = table(spark, folder, "events").select(F.floor(F.col("event_id") / 512).alias("tree"), (F.col("event_id") % 512 + 1).alias("node"), "value")
    return e.withColumn("parent", F.when(F.col("node") > 1, F.floor(F.col("node") / 2)))


def tree_backprop(spark, folder):
    out = H.back_propagated(_tree(spark, folder), "tree", "node", "parent", "value")
    return out.select("tree", "node", "visits", F.round("value", 4).alias("value"))


def tree_depths(spark, folder):
    return H.depths(_tree(spark, folder), "tree", "node", "parent")


def uct_scores(spark, folder):
    t = _tree(spark, folder)
    s = H.back_propagated(t, "tree", "node", "parent", "value").withColumnRenamed("value", "win")
    up = s.select("tree", F.col("node").alias("parent"), F.col("visits").alias("pv"))
    j = t.join(s, ["tree", "node"]).join(up, ["tree", "parent"], "left")  # a root has no parent and nothing to explore
    return j.select("tree", "node", F.round(H.uct(F.col("win"), F.col("visits"), F.col("pv")), 4).alias("uct"))


def best_path(spark, folder):
    """From each root the children of the highest value, down to a leaf."""
    return H.descent(_tree(spark, folder), "tree", "node", "parent", "value")


def tree_merged(spark, folder):
    """Children of one parent that have the same state, their event type, as one."""
    t = _tree(spark, folder).filter("parent is not null").join(table(spark, folder, "events").select(F.floor(F.col("event_id") / 512).alias("tree"), (F.col("event_id") % 512 + 1).alias("node"), "event_type"), ["tree", "node"])
    return H.merged_children(t.withColumn("visits", F.lit(1)), "tree", "parent", "node", "event_type", "visits", "value").select("tree", "parent", "node", "event_type", "visits", F.round("value", 4).alias("value"), "merged")


def grown_children(spark, folder):
    """Children of each program: its statements as states, their length as value."""
    d = table(spark, folder, "decomposed").groupBy("id").agg(F.min("code").alias("code"))
    out = H.grown(d.withColumn("tree", F.lit(1)), "tree", "id", "code", lambda c: F.split(c, ";", -1), lambda c: F.length(c))
    return out.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.max("value").cast("bigint").alias("most"), F.md5(F.min("state")).alias("least"))


def expansion_counts(spark, folder):
    return H.expansion_counts(table(spark, folder, "compile_logs").distinct(), ["engine"], F.col("status") != 0)


def preferred_engine(spark, folder):
    """Per document: the attempt that compiled, of two engines only, the first before the second; later attempts last."""
    rows = table(spark, folder, "compile_logs").select("doc_id", "engine", "attempt", "status").distinct()
    return E.best_attempt(rows, "doc_id", "engine", F.struct((F.col("status") == 0).alias("ok"), -F.col("attempt")), ["pdflatex", "xelatex"])


def running_means(spark, folder):
    """Mean code score of all rows up to each one, as a scorer that is never reset gives it."""
    r = rows(spark, folder, "code_score").withColumn("x", F.when(~F.isnan("code_score"), F.col("code_score").cast("double")))
    return E.running_mean(r, [F.col("row_id")], "x").select("row_id", F.round("mean", 5).alias("mean"))


def failure_defaults(spark, folder):
    """Image dissimilarity and path of every row: 1 and no path where nothing was rendered."""
    ok = F.col("generated_image").isNotNull()
    path = F.concat_ws("_", F.lit("generated/example"), "example_number", "combination_number")
    return rows(spark, folder, "generated_image", "image_score", "example_number", "combination_number").select("row_id", F.round(F.when(~ok, 1.0).otherwise(F.when(~F.isnan("image_score"), F.col("image_score").cast("double"))), 5).alias("image"), F.when(ok, path).alias("path"))


def visit_draw(spark, folder):
    e = table(spark, folder, "events").filter("value > 0").select("event_type", "event_id", F.ceil("value").cast("bigint").alias("v"))
    return H.draw_by_visits(e, "event_type", "event_id", "v", F.lit(0.5))


def rollout_rewards(spark, folder):
    c = table(spark, folder, "compile_logs").distinct()
    ok = F.coalesce("has_image", F.lit(False))
    n = F.length(F.coalesce("log", F.lit(""))).cast("bigint")
    line = T.first_error(T.error_lines(F.col("log"), F.lit("main.tex")))
    return c.select("doc_id", "engine", "attempt", H.reward(F.lit(None).cast("double"), ok, F.col("status") != 0).alias("reward"), H.expansion(n).alias("grown"), H.failed_expansion(n, line.cast("bigint"), F.lit(0)).alias("grown_failed"))


def cosine_pairs(spark, folder):
    """Each embedding with the next one."""
    e = table(spark, folder, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"), F.round(V.dream_similarity(1 - V.cosine(F.col("embedding"), F.col("other"))), 4).alias("dream"))


def transport_pairs(spark, folder):
    e = table(spark, folder, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.transport_column(F.col("embedding"), F.col("other"), 8), 4).alias("similarity"))


def kernel_distance(spark, folder):
    """Between embeddings of even and odd label."""
    e = table(spark, folder, "embeddings").select("vec_id", (F.col("label") % 2).alias("side"), "embedding")
    return V.kernel_distance(e, "vec_id", "side", "embedding").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def pixel_error(spark, folder):
    """Masked error of neighbouring embeddings, read as 64 grey levels."""
    grey = lambda c: F.transform(c, lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)))
    e = table(spark, folder, "embeddings").select("vec_id", grey(F.col("embedding")).alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(I.pixel_rmse(F.col("a"), F.col("b"), 250), 6).alias("rmse"))


def image_measures(spark, folder):
    """All measures of the original against the generated image."""
    r = rows(spark, folder, "original_image", "generated_image").filter("original_image is not null and generated_image is not null")
    m = r.withColumn("m", I.compare_column(F.col("original_image"), F.col("generated_image")))
    return m.select("row_id", *(F.round(f"m.{c}", 6).alias(c) for c in ("rmse", "ssim", "abs_diff", "components", "structural", "complexity", "combined")))


def image_shapes(spark, folder):
    """Size, colours and ink of the original images; blank ones have one colour."""
    r = rows(spark, folder, "original_image").withColumn("d", I.describe_column(F.col("original_image")))
    return r.select("row_id", "d.height", "d.width", "d.colours", F.round("d.ink", 6).alias("ink"), (F.col("d.colours") > 1).alias("drawn"))


def image_errors_once(spark, folder):
    """Masked error of image pairs, each distinct pair compared once."""
    r = rows(spark, folder, "original_image", "generated_image")
    m = R.by_distinct_input(r, ["original_image", "generated_image"], R.metric("image")(F.col("original_image"), F.col("generated_image")), "m", "row_id")
    return m.select("row_id", F.round("m.rmse", 6).alias("rmse"))


def known_prefixes(spark, folder):
    """How many leading lines of each decomposed program are a whole program of the table, less its last line."""
    d = table(spark, folder, "decomposed").groupBy("id").agg(F.min("code").alias("code")).select("id", F.split("code", "\n", -1).alias("lines"))
    known = d.filter(F.size("lines") > 3).select(F.slice("lines", F.lit(1), F.size("lines") - 3).alias("lines"))
    return R.longest_known_prefix(d, known, "id", "lines")


def squared_images(spark, folder):
    """Original images trimmed to their ink, squared and scaled to four pixels; the share of ink left."""
    r = rows(spark, folder, "original_image").select("row_id", I.square_column(F.col("original_image"), 4).alias("p"))
    return r.select("row_id", I.describe_column(F.col("p")).alias("d")).select("row_id", "d.height", "d.width", F.round("d.ink", 6).alias("ink"))


def corpus_sampled(spark, folder):
    """A thousand original codes by hash order."""
    r = rows(spark, folder, "original_code").filter("original_code is not null and original_code <> ''")
    return corpus_sample(r.select("row_id"), "row_id", 1000)


R.register_metric("image", I.compare_column)
R.register_metric("sequence", Q.sequence_ratio_column)
R.register_metric("edit_distance", Q.edit_distance_column)

_U = "u AS (SELECT DISTINCT ON (row_id) * FROM upload_data)"
_TREE = "t AS (SELECT event_id // 512 AS tree, event_id % 512 + 1 AS node, CASE WHEN event_id % 512 > 0 THEN (event_id % 512 + 1) // 2 END AS parent, value FROM events)"
_UP = f"WITH RECURSIVE {_TREE}, up AS (SELECT tree, node AS here, value FROM t UNION ALL SELECT tree, here // 2, value FROM up WHERE here > 1), s AS (SELECT tree, here AS node, count(*) AS visits, sum(value) AS win FROM up GROUP BY ALL)"
_WORDS = "CASE WHEN s = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(s, '" + T.WS + "+') END"
_DOCS = "d AS (SELECT doc_id, " + _WORDS + " AS w FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^" + T.WS + "+|" + T.WS + "+$', '', 'g') AS s FROM documents))"
_PARTS = r"el AS (SELECT id, list_filter(list_transform(string_split(min(code), chr(10)), lambda x: trim(x, ' ')), lambda x: starts_with(x, '\draw') OR starts_with(x, '\node') OR starts_with(x, '\fill') OR starts_with(x, '\coordinate')) AS parts FROM decomposed GROUP BY id)"

QUERIES = {
    f.__name__: f
    for f in (winsor_mean, best_candidate, sampling_efficiency, throughput, model_means, minmax_scores, shard_interleave, batches_of, positional_align, stop_prefix, group_sample, head_and_share, resume_anti, existing_semi, metadata_join, paired_files, pair_scores, corpus_union, cardinality_guard, distinct_pairs, shard_size, curriculum_thresholds, curriculum_visible, label_masks, label_masks_whole, padded_rows, checkpoint_marks, element_dependencies, prefix_enumeration, subset_enumeration, program_elements, program_rebuilt, tree_merged, grown_children, expansion_counts, preferred_engine, running_means, failure_defaults, tree_backprop, tree_depths, uct_scores, best_path, visit_draw, rollout_rewards, cosine_pairs, transport_pairs, kernel_distance, pixel_error, image_measures, image_shapes, image_errors_once, known_prefixes, squared_images, corpus_sampled)
}
SQL = {
    "winsor_mean": f"""WITH {_U}, o AS (SELECT generator, code_score::DOUBLE AS x, row_number() OVER (PARTITION BY generator ORDER BY code_score) AS r, count(*) OVER (PARTITION BY generator) AS n FROM u WHERE code_score IS NOT NULL AND NOT isnan(code_score)),
      e AS (SELECT generator, max(x) FILTER (r = (0.05::DOUBLE * n)::BIGINT - ((0.05::DOUBLE * n)::BIGINT > 0.05::DOUBLE * n)::INT + 1) AS lo, max(x) FILTER (r = n - ((0.05::DOUBLE * n)::BIGINT - ((0.05::DOUBLE * n)::BIGINT > 0.05::DOUBLE * n)::INT)) AS hi FROM o GROUP BY 1)
      SELECT o.generator, round(avg(least(greatest(x, lo), hi)), 4) AS mean FROM o JOIN e ON o.generator IS NOT DISTINCT FROM e.generator GROUP BY 1""",
    "best_candidate": f"WITH {_U}, v AS (SELECT example_number, row_id, code_score FROM u WHERE code_score IS NOT NULL AND NOT isnan(code_score)) SELECT example_number, first(row_id ORDER BY code_score, row_id) AS low_row, first(row_id ORDER BY code_score DESC, row_id) AS high_row FROM v GROUP BY 1",
    "sampling_efficiency": f"WITH {_U}, v AS (SELECT example_number, row_id, code_score, length(generated_code) AS n FROM u WHERE code_score IS NOT NULL AND NOT isnan(code_score)) SELECT example_number, count(*) AS candidates, round(list(n ORDER BY code_score DESC, row_id)[1] / nullif(sum(n), 0)::DOUBLE, 6) AS efficiency FROM v GROUP BY 1",
    "throughput": f"WITH {_U}, c AS (SELECT count(*)::DOUBLE AS x FROM u GROUP BY example_number), o AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM c), e AS (SELECT max(x) FILTER (r = floor(0.05 * n) + 1) AS lo, max(x) FILTER (r = n - floor(0.05 * n)) AS hi FROM o) SELECT round(avg(least(greatest(x, lo), hi)), 6) AS mean FROM o, e",
    "model_means": f"WITH {_U} SELECT generator, round(avg(image_score::DOUBLE) FILTER (generated_image IS NOT NULL AND NOT isnan(image_score)), 4) AS rendered_image, round(avg(code_score::DOUBLE) FILTER (NOT isnan(code_score)), 4) AS code, count(*) FILTER (generated_image IS NULL) AS missing FROM u GROUP BY 1",
    "minmax_scores": f"WITH {_U}, v AS (SELECT batch_id, row_id, image_score::DOUBLE AS x FROM u WHERE image_score IS NOT NULL AND NOT isnan(image_score)), e AS (SELECT batch_id, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1) SELECT batch_id, row_id, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END, 5) AS norm FROM v JOIN e USING (batch_id)",
    "shard_interleave": "SELECT doc_id, (r - 1) % 7 AS shard, (r - 1) // 7 AS pos FROM (SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS r FROM documents)",
    "batches_of": "SELECT (r - 1) // 32 AS batch, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) GROUP BY 1",
    "positional_align": "WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY text, doc_id) - 1 AS position FROM documents WHERE text IS NOT NULL AND text <> '') SELECT a.position, a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b USING (position) WHERE a.source = 'captions_a' AND b.source = 'captions_b'",
    "stop_prefix": "WITH t AS (SELECT user_id, event_id, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS el FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY el, event_id) AS r FROM t), s AS (SELECT user_id, min(r) AS stop FROM o WHERE (value > 60 AND el >= 86400) OR el >= 20 * 86400 GROUP BY 1) SELECT o.user_id, event_id FROM o LEFT JOIN s USING (user_id) WHERE stop IS NULL OR r <= stop",
    "group_sample": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|0'), doc_id) AS r FROM documents WHERE source IS NOT NULL) WHERE r <= 20",
    "head_and_share": "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, r <= 200 AS head, r <= floor(n * 0.01) AS share FROM o WHERE r <= 200 OR r <= floor(n * 0.01)",
    "resume_anti": "SELECT doc_id FROM documents WHERE source = 'program_text' AND doc_id NOT IN (SELECT doc_id FROM compile_logs WHERE doc_id IS NOT NULL)",
    "existing_semi": "SELECT DISTINCT id FROM decomposed WHERE id IN (SELECT 'example_' || example_number || '_' || CASE WHEN combination_number = 'main' THEN 'main' ELSE 'combination_' || combination_number END FROM results_v1)",
    "metadata_join": "SELECT p_brand, n_name, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
    "paired_files": "WITH d AS (SELECT DISTINCT id, md5(png) AS png, md5(code) AS code FROM decomposed) SELECT a.id, a.png, b.code, a.id LIKE '%main' AS main FROM d a JOIN d b USING (id)",
    "pair_scores": f"""WITH {_U}, n AS (SELECT example_number, CASE WHEN combination_number = 'main' THEN -1 ELSE TRY_CAST(combination_number AS INT) END AS combination_number, image_similarity, written_at, shard_file FROM results_v1),
      o AS (SELECT *, row_number() OVER (PARTITION BY example_number, combination_number ORDER BY written_at, shard_file, image_similarity NULLS LAST) AS rn FROM n WHERE combination_number IS NOT NULL)
      SELECT o.example_number, o.combination_number, count(*) AS rows, round(min(o.image_similarity), 6) AS image FROM o JOIN u ON o.example_number = u.example_number AND o.combination_number = u.combination_number WHERE rn = 1 GROUP BY ALL""",
    "corpus_union": "SELECT 'decomposed' AS part, id, NULL::VARCHAR AS lang, length(code) AS n FROM (SELECT DISTINCT id, code FROM decomposed) UNION ALL SELECT 'documents', doc_id::VARCHAR, lang, length(text) FROM documents WHERE source = 'program_text'",
    "cardinality_guard": "WITH d AS (SELECT DISTINCT id, regexp_extract(id, 'example_([0-9]+)', 1)::INT AS example_number FROM decomposed) SELECT example_number, count(*) AS n, bool_and(id LIKE '%main') AS main_only FROM d GROUP BY 1 HAVING count(*) < 20",
    "distinct_pairs": f"WITH {_U} SELECT example_number, count(DISTINCT (coalesce(code_score, -1), coalesce(generated_code, ''))) AS kept, count(*) FILTER (generated_image IS NULL) AS failed FROM u GROUP BY 1",
    "shard_size": f"WITH {_U}, b AS (SELECT generator, sum(coalesce(strlen(original_code), 0) + coalesce(octet_length(original_image), 0))::BIGINT AS bytes FROM u GROUP BY 1) SELECT generator, bytes, least(greatest(bytes // 10, 1000000), 1000000000)::BIGINT AS shard FROM b",
    "curriculum_thresholds": "SELECT t AS epoch, round(least(1, pow(t * (1 - 0.3 ** 3) / 3 + 0.3 ** 3, 1 / 3.0)), 6) AS root_p, round(least(1, 0.3::DOUBLE + t * 0.7::DOUBLE / 3), 6) AS linear, round(least(1, pow(2, t * log2(1 - log2(0.3)) / 3 + log2(0.3))), 6) AS geometric, round(least(1, 0.3 * pow(1 / 0.3, t / 3.0)), 6) AS geometric_exact, round(least(1, (floor(t * 5 / 3.0) + 1) / 5::DOUBLE), 6) AS baby_step FROM (SELECT unnest(range(6)) AS t)",
    "label_masks": f"WITH {_DOCS}, i AS (SELECT doc_id, ([0, 0] || list_transform(w, lambda x: length(x)::INT))[1:{C.MODEL_LIMIT}] AS ids FROM d) SELECT doc_id, array_to_string(list_transform(ids, lambda x, j: CASE WHEN j <= 2 THEN -100 ELSE x END), ' ') AS labels FROM i",
    "label_masks_whole": f"WITH {_DOCS}, i AS (SELECT doc_id, [0, 0] || list_transform(w, lambda x: length(x)::INT) AS ids FROM d) SELECT doc_id, array_to_string(list_transform(ids, lambda x, j: CASE WHEN j <= 2 THEN -100 ELSE x END), ' ') AS labels FROM i",
    "padded_rows": f"WITH {_DOCS}, b AS (SELECT doc_id, len(w) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM d) SELECT doc_id, (ceil(max(n) OVER (PARTITION BY batch) / 8.0) * 8)::BIGINT AS n, batch FROM b",
    "checkpoint_marks": "SELECT s AS step FROM (SELECT unnest(range(1, 201)) AS s) WHERE s % 50 IN (12, 25, 38)",
    "element_dependencies": f"""WITH {_PARTS}, e AS (SELECT id, unnest(range(len(parts))) AS pos, unnest(parts) AS el FROM el),
      n AS (SELECT DISTINCT id, pos, unnest(regexp_extract_all(el, '{T.DEPENDENCY_NAMES}', 1) || regexp_extract_all(el, '{T.DEPENDENCY_COORDINATES}', 1)) AS name FROM e),
      x AS (SELECT DISTINCT n.id, n.pos AS src, e.pos AS dst FROM n JOIN e ON n.id = e.id AND n.pos <> e.pos AND contains(e.el, n.name)) SELECT id, count(*) AS edges, max(src) AS last FROM x GROUP BY id""",
    "prefix_enumeration": f"""WITH {_PARTS}, s AS (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS size FROM el), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(id || '|' || size || '|0'), size) AS k FROM s)
      SELECT id, size, md5(array_to_string(parts[1:size], chr(10))) AS prefix FROM r WHERE (len(parts) <= 10 OR k <= 10) AND NOT contains(parts[size], '\\end{{')""",
    "tree_backprop": _UP + " SELECT tree, node, visits, round(win, 4) AS value FROM s",
    "tree_depths": f"WITH RECURSIVE {_TREE}, d AS (SELECT tree, node, 0::BIGINT AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.tree, t.node, depth + 1 FROM t JOIN d ON t.tree = d.tree AND t.parent = d.node) SELECT * FROM d",
    "uct_scores": _UP + " SELECT t.tree, t.node, round(s.win / s.visits + coalesce(0.6 * sqrt(ln(p.visits) / s.visits), 0), 4) AS uct FROM t JOIN s USING (tree, node) LEFT JOIN s p ON p.tree = t.tree AND p.node = t.parent",
    "best_path": f"WITH RECURSIVE {_TREE}, c AS (SELECT tree, parent, first(node ORDER BY value DESC, node) AS next FROM t WHERE parent IS NOT NULL GROUP BY ALL), p AS (SELECT tree, node, 0::BIGINT AS step FROM t WHERE parent IS NULL UNION ALL SELECT p.tree, c.next, step + 1 FROM p JOIN c ON p.tree = c.tree AND p.node = c.parent) SELECT * FROM p",
    "visit_draw": "WITH e AS (SELECT event_type, event_id, ceil(value)::BIGINT AS v FROM events WHERE value > 0), s AS (SELECT event_type, event_id, sum(v) OVER (PARTITION BY event_type ORDER BY event_id) / sum(v) OVER (PARTITION BY event_type) AS share FROM e) SELECT event_type, min(event_id) AS event_id FROM s WHERE share >= 0.5 GROUP BY 1",
    "cosine_pairs": "WITH p AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(c, 4) + 0 AS cosine, round(1 - (1 - c), 4) + 0 AS dream FROM p",
    "pixel_error": "WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255)) AS v FROM embeddings), p AS (SELECT a.vec_id, unnest(a.v) AS x, unnest(b.v) AS y FROM g a JOIN g b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(coalesce(sqrt(avg(((x - y) / 255) ** 2) FILTER (x <= 250 OR y <= 250)), 0), 6) AS rmse FROM p GROUP BY 1",
}
SQL["known_prefixes"] = """WITH d AS (SELECT id, string_split(min(code), chr(10)) AS l FROM decomposed GROUP BY id), k AS (SELECT DISTINCT l[1:len(l) - 3] AS l FROM d WHERE len(l) > 3),
  p AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS n FROM d) SELECT d.id, coalesce(m.depth, 0) AS depth FROM d LEFT JOIN (SELECT p.id, max(n) AS depth FROM p JOIN k ON p.l[1:n] = k.l GROUP BY p.id) m USING (id)"""
from inkfield.queries.texts import _LOG  # noqa: E402

SQL["rollout_rewards"] = _LOG + "SELECT doc_id, engine, attempt, CASE WHEN NOT ok THEN -1.0 WHEN status <> 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS reward, round(sqrt(size))::BIGINT AS grown, least(greatest(greatest(1, first) - 1, 0), round(sqrt(size)))::BIGINT AS grown_failed FROM f"
SQL["corpus_sampled"] = f"WITH {_U} SELECT row_id FROM u WHERE original_code <> '' ORDER BY md5(row_id || '|0'), row_id LIMIT 1000"
SQL["tree_merged"] = "WITH t AS (SELECT event_id // 512 AS tree, event_id % 512 + 1 AS node, (event_id % 512 + 1) // 2 AS parent, event_type, value FROM events WHERE event_id % 512 > 0) SELECT tree, parent, min(node) AS node, event_type, count(*) AS visits, round(sum(value), 4) AS value, count(*) AS merged FROM t GROUP BY tree, parent, event_type"
SQL["grown_children"] = "WITH s AS (SELECT id, unnest(string_split(min(code), ';')) AS state FROM decomposed GROUP BY id) SELECT id AS parent, count(*) AS children, max(length(state)) AS most, md5(min(state)) AS least FROM s GROUP BY id"
SQL["expansion_counts"] = "SELECT engine, count(*) AS expansions, count(*) FILTER (status <> 0) AS failed FROM (SELECT DISTINCT * FROM compile_logs) GROUP BY engine"
SQL["preferred_engine"] = "WITH d AS (SELECT DISTINCT doc_id, engine, attempt, status FROM compile_logs WHERE engine IN ('pdflatex', 'xelatex')) SELECT doc_id, engine, attempt, status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (status = 0) DESC, attempt, engine) AS r FROM d) WHERE r = 1"
SQL["running_means"] = f"WITH {_U} SELECT row_id, round(avg(CASE WHEN NOT isnan(code_score) THEN code_score::DOUBLE END) OVER (ORDER BY row_id), 5) AS mean FROM u"
SQL["failure_defaults"] = f"WITH {_U} SELECT row_id, round(CASE WHEN generated_image IS NULL THEN 1.0 WHEN NOT isnan(image_score) THEN image_score::DOUBLE END, 5) AS image, CASE WHEN generated_image IS NOT NULL THEN 'generated/example_' || example_number || '_' || combination_number END AS path FROM u"
_ELEMENTS = r"""
WITH p AS (SELECT id, min(code) AS code FROM decomposed GROUP BY id),
a AS (SELECT *, instr(code, '\begin{document}') AS s FROM p),
b AS (SELECT *, CASE WHEN s > 0 AND instr(code[s:], '\begin{tikzpicture}') > 0 THEN s - 1 + instr(code[s:], '\begin{tikzpicture}') ELSE 0 END AS p0,
  CASE WHEN contains(code, '\end{tikzpicture}') THEN length(code) - instr(reverse(code), reverse('\end{tikzpicture}')) - 15 ELSE 0 END AS upto FROM a),
c AS (SELECT id, code, CASE WHEN p0 > 0 AND upto >= p0 THEN code[1:p0 - 1] ELSE '' END AS preamble, CASE WHEN p0 > 0 AND upto >= p0 THEN code[p0 + 19:upto - 1] END AS tail FROM b),
o AS (SELECT *, regexp_extract(tail, '^\s*(\[(?:[^\[\]]|\[[^\[\]]*\])*\])', 1) AS opt FROM c),
body AS (SELECT id, trim(CASE WHEN opt <> '' THEN regexp_replace(tail, '^\s*', '')[length(opt) + 1:] ELSE tail END, chr(10)) AS body FROM o WHERE tail IS NOT NULL),
l AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM body),
m AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
f AS (SELECT *, starts_with(bare, '\end{') OR starts_with(bare, '\endscope') AS closing, ends_with(bare, ';') AS stopped, sum(length(replace(line, '}', '')) - length(replace(line, '{', ''))) OVER w AS braces,
  sum((starts_with(bare, '\begin{') OR starts_with(bare, '\scope'))::INT - (starts_with(bare, '\end{') OR starts_with(bare, '\endscope'))::INT) OVER w AS env, sum(starts_with(bare, '\foreach')::INT - ends_with(bare, '}')::INT) OVER w AS loops
  FROM m WINDOW w AS (PARTITION BY id ORDER BY i)),
g AS (SELECT *, env - least(0, min(env) OVER w) AS inside, loops - least(0, min(loops) OVER w) AS looped FROM f WINDOW w AS (PARTITION BY id ORDER BY i)),
h AS (SELECT *, (braces = 0 AND inside = 0 AND closing)::INT + (braces = 0 AND inside = 0 AND looped = 0 AND stopped)::INT AS ends FROM g),
n AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e, sum(ends) OVER (PARTITION BY id) AS total FROM h),
t AS (SELECT id, total, e, string_agg(line, chr(10) ORDER BY i) AS element FROM n GROUP BY ALL),
k AS (SELECT id, max(total) AS total, map(list(e), list(element)) AS by_number FROM t GROUP BY id),
every AS (SELECT id, list_transform(range(0, total::BIGINT), lambda x: coalesce(by_number[x], '')) || CASE WHEN trim(coalesce(by_number[total], ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN [by_number[total]] ELSE []::VARCHAR[] END AS elements FROM k),
j AS (SELECT o.id, o.code, o.preamble, coalesce(o.opt, '') AS opt, coalesce(every.elements, []::VARCHAR[]) AS elements FROM o LEFT JOIN every USING (id))
"""
SQL["program_elements"] = _ELEMENTS + "SELECT id, md5(opt) AS options, len(elements)::BIGINT AS elements, md5(array_to_string(elements, '|')) AS digest FROM j"
SQL["program_rebuilt"] = _ELEMENTS + r""", r AS (SELECT *, length(replace(preamble, '}', '')) - length(replace(preamble, '{', '')) AS braces,
  CASE WHEN contains(code, '\begin{document}') THEN regexp_extract_all(string_split(string_split(code, '\begin{tikzpicture}')[1], '\begin{document}')[-1], '\\begin\{([^}]*)\}', 1) ELSE []::VARCHAR[] END AS wrap FROM j)
SELECT id, len(elements)::BIGINT AS elements, md5(preamble || chr(10) || chr(10) || '\begin{tikzpicture}' || trim(opt) || chr(10) || array_to_string(elements, chr(10)) || chr(10) || '\end{tikzpicture}'
  || array_to_string(list_transform(list_reverse(wrap), lambda w: chr(10) || '\end{' || w || '}'), '') || CASE WHEN braces > 0 THEN chr(10) || repeat('}', braces::INT) ELSE '' END || chr(10) || chr(10) || '\end{document}') AS code FROM r"""
from inkfield.queries.difficulty import _TABLE  # noqa: E402

SQL["curriculum_visible"] = _TABLE + ", e AS (SELECT unnest(range(8)) AS epoch), v AS (SELECT epoch, greatest(1, floor(least(1, sqrt((epoch + 1) * (1 - 0.09::DOUBLE) / 8 + 0.09::DOUBLE)) * (SELECT count(*) FROM t)))::BIGINT AS visible FROM e) SELECT epoch, visible, count(*) AS rows, round(max(combined), 6) AS hardest FROM v JOIN t ON rank <= visible GROUP BY ALL"
