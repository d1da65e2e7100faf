"""Queries of the difficulty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.operators import difficulty as D
from inkfield.session import table

ORDER = ["written_at", "shard_file"]
KEEP = ["example_number", "combination_number", "image_similarity", "code_similarity", "shard_file", "written_at"]


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "results_v1").select(*KEEP)


def _table(spark: SparkSession, folder: str) -> DataFrame:
    return D.difficulty_table(_shards(spark, folder), ORDER)


def difficulty_rank(spark, folder):
    return _table(spark, folder).select("example_number", "combination_number", F.round("combined_score", 6).alias("combined_score"), "rank", F.round("rank_norm", 6).alias("rank_norm"))


def results_normalised(spark, folder):
    out = D.normalised(table(spark, folder, "results_v1"))
    return out.groupBy("example_number", "combination_number").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("original_image_path").alias("images"), F.min("generated_code_path").alias("code_path"))


def difficulty_first(spark, folder):
    out = D.first_per_key(D.normalised(_shards(spark, folder)), ORDER)
    return out.select("example_number", "combination_number", "shard_file", F.round("image_similarity", 6).alias("image"), F.round("code_similarity", 6).alias("code"))


def difficulty_card(spark, folder):
    out = D.card(_table(spark, folder))
    return out.select("rows", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def difficulty_describe(spark, folder):
    out = D.describe(_table(spark, folder))
    return out.select("count", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def difficulty_quartiles(spark, folder):
    return D.quartiles(_table(spark, folder)).groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("combined_score"), 6).alias("least"), F.round(F.max("combined_score"), 6).alias("most"))


def difficulty_extremes(spark, folder):
    return D.extremes(_table(spark, folder)).select("section", "rank", "example_number", "combination_number", F.round("combined_score", 6).alias("combined_score"))


def stored_order(spark, folder):
    """Per batch: whether the stored rank never falls as the combined score rises (ties by row)."""
    rows = table(spark, folder, "upload_data").select("row_id", "batch_id", "combined_score", "rank").dropDuplicates(["row_id"]).filter("combined_score is not null and not isnan(combined_score) and rank is not null and not isnan(rank)")
    return D.is_sorted(rows, ["combined_score", "row_id"], "rank", ["batch_id"])


def index_range(spark, folder):
    """Every scored row with the range of a hundred example numbers that a worker would be given it in."""
    start = F.floor(F.col("example_number") / 100) * 100
    rows = table(spark, folder, "upload_data").select("row_id", "example_number", start.alias("start"), (start + 100).alias("stop"), (F.col("combination_number") == -1).alias("main"))
    return rows.distinct()


_TABLE = r"""
WITH n AS (SELECT example_number, CASE WHEN combination_number = 'main' THEN -1 ELSE TRY_CAST(combination_number AS INT) END AS combination_number,
  image_similarity, code_similarity, shard_file, written_at FROM results_v1),
ok AS (SELECT * FROM n WHERE example_number IS NOT NULL AND combination_number IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY example_number, combination_number ORDER BY written_at NULLS LAST, shard_file NULLS LAST, image_similarity NULLS LAST, code_similarity NULLS LAST) AS rn FROM ok),
s AS (SELECT example_number, combination_number, image_similarity, code_similarity, shard_file,
  0.7 * least(coalesce(CASE WHEN isnan(image_similarity) THEN NULL ELSE image_similarity END, 1), 1) + 0.3 * least(coalesce(CASE WHEN isnan(code_similarity) THEN NULL ELSE code_similarity END, 1), 1) AS combined FROM o WHERE rn = 1),
t AS (SELECT *, row_number() OVER (ORDER BY combined, example_number, combination_number) AS rank, count(*) OVER () AS c FROM s)
"""

QUERIES = {f.__name__: f for f in (difficulty_rank, results_normalised, difficulty_first, difficulty_card, difficulty_describe, difficulty_quartiles, difficulty_extremes, stored_order, index_range)}
SQL = {
    "difficulty_rank": _TABLE + "SELECT example_number, combination_number, round(combined, 6) + 0 AS combined_score, rank, round(CASE WHEN c > 1 THEN (rank - 1) / (c - 1)::DOUBLE ELSE 0 END, 6) AS rank_norm FROM t",
    "results_normalised": r"""
      WITH n AS (SELECT example_number, CASE WHEN combination_number = 'main' THEN -1 ELSE TRY_CAST(combination_number AS INT) END AS combination_number,
        CASE WHEN original_image_path LIKE 'merged\_results/%' ESCAPE '\' THEN original_image_path ELSE 'merged_results/' || nullif(original_image_path, '') END AS img,
        CASE WHEN generated_code_path LIKE 'merged\_results/%' ESCAPE '\' THEN generated_code_path ELSE 'merged_results/' || nullif(generated_code_path, '') END AS code FROM results_v1)
      SELECT example_number, combination_number, count(*) AS rows, count(DISTINCT img) AS images, min(code) AS code_path FROM n
      WHERE example_number IS NOT NULL AND combination_number IS NOT NULL GROUP BY ALL""",
    "difficulty_first": _TABLE + "SELECT example_number, combination_number, shard_file, round(image_similarity, 6) AS image, round(code_similarity, 6) AS code FROM s",
    "difficulty_card": _TABLE + "SELECT count(*) AS rows, round(avg(image_similarity), 6) AS mean_image, round(avg(code_similarity), 6) AS mean_code, round(avg(combined), 6) AS mean_combined, round(min(combined), 6) AS least, round(max(combined), 6) AS most FROM t",
    "difficulty_describe": _TABLE + "SELECT count(combined) AS count, round(avg(combined), 6) AS mean, round(stddev_samp(combined), 6) AS std, round(min(combined), 6) AS min, round(quantile_cont(combined, 0.25), 6) AS q25, round(quantile_cont(combined, 0.5), 6) AS q50, round(quantile_cont(combined, 0.75), 6) AS q75, round(max(combined), 6) AS max FROM t",
    "difficulty_quartiles": _TABLE + """, q AS (SELECT quantile_cont(combined, 0.25) AS a, quantile_cont(combined, 0.5) AS b, quantile_cont(combined, 0.75) AS d FROM t)
      SELECT CASE WHEN combined <= a THEN 0 WHEN combined <= b THEN 1 WHEN combined <= d THEN 2 ELSE 3 END::BIGINT AS quartile, count(*) AS n, round(min(combined), 6) AS least, round(max(combined), 6) AS most FROM t, q GROUP BY 1""",
    "difficulty_extremes": _TABLE + """SELECT 'lowest_score' AS section, rank, example_number, combination_number, round(combined, 6) AS combined_score FROM t WHERE rank <= 50
      UNION ALL SELECT 'highest_score', rank, example_number, combination_number, round(combined, 6) FROM t WHERE rank > c - 50""",
    "stored_order": """WITH u AS (SELECT DISTINCT ON (row_id) row_id, batch_id, combined_score, rank FROM upload_data WHERE combined_score IS NOT NULL AND NOT isnan(combined_score) AND rank IS NOT NULL AND NOT isnan(rank)),
      l AS (SELECT batch_id, rank, lag(rank) OVER (PARTITION BY batch_id ORDER BY combined_score, row_id) AS before FROM u)
      SELECT batch_id, bool_and(before IS NULL OR rank >= before) AS sorted FROM l GROUP BY batch_id""",
    "index_range": "SELECT DISTINCT row_id, example_number, (example_number // 100 * 100)::BIGINT AS start, (example_number // 100 * 100 + 100)::BIGINT AS stop, combination_number = -1 AS main FROM upload_data",
}
