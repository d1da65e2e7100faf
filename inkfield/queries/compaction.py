"""Queries of the small-file consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.operators import compaction
from inkfield.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of equal files of one record's field, from the origins that the consolidation wrote."""
    return compaction.equal_files(compaction.compact(table(spark, folder, "tiny_files")).origins(spark))


def p5_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The consolidated records: every distinct content of a record's field once."""
    return compaction.compact(table(spark, folder, "tiny_files")).records(spark).select("field", "example_number", "combination_number", "n_bytes", F.sha2("body", 256).alias("digest"))


def p5_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Every named file with the first of its copies and their number."""
    return compaction.file_sets(compaction.compact(table(spark, folder, "tiny_files")).origins(spark))


def p5_rest(spark: SparkSession, folder: str) -> DataFrame:
    """The files that name no record, which lie in a part of their own."""
    return compaction.compact(table(spark, folder, "tiny_files")).rest(spark).select("file_id", "path", F.md5("body").alias("body"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """The files written, with 256 KiB as their target so that many ranges come of these tables."""
    done = compaction.compact(table(spark, folder, "tiny_files"), target_bytes=REPORT_BYTES)
    return compaction.file_report(done, spark)


REPORT_BYTES = 256 * 1024
_NAMED = r"""
WITH p AS (
  SELECT file_id, coalesce(body, ''::BLOB) AS body, regexp_extract(replace(lower(trim(path)), '\', '/'),
    '(?:^|/)(original|generated)/+(?:\./+)*example_(\d+)_(?:combination_)?(main|-?\d+)(?:[ ._~-]*(?:\(\d+\)|copy\d*|retry\d*|\d+))*\.(tex|png)$',
    ['d', 'e', 'c', 'x']) AS m FROM tiny_files),
named AS (
  SELECT file_id, sha256(body) AS digest, octet_length(body)::BIGINT AS n_bytes,
    CASE WHEN m.d = 'original' AND m.x = 'tex' THEN 'original_code' WHEN m.d = 'original' AND m.x = 'png' THEN 'original_image'
         WHEN m.d = 'generated' AND m.x = 'tex' THEN 'generated_code' END AS field,
    TRY_CAST(m.e AS INT) AS example_number, CASE WHEN m.c = 'main' THEN -1 ELSE TRY_CAST(m.c AS INT) END AS combination_number
  FROM p)
"""

# Cuts lie where the bytes, and one for each content, reach the next equal share of all; a key at a cut ends its range.
_RANGES = f"""{_NAMED},
c AS (SELECT DISTINCT field, example_number, combination_number, n_bytes, digest, lpad(example_number::VARCHAR, 10, '0') || lpad((combination_number + 1)::VARCHAR, 10, '0') || lpad(field, 14, '_') || digest[1:16] AS pos
  FROM named WHERE field IS NOT NULL AND example_number IS NOT NULL AND combination_number IS NOT NULL),
o AS (SELECT pos, sum(n_bytes + 1) OVER (ORDER BY pos) AS upto, sum(n_bytes + 1) OVER () AS weight, greatest(1, round_even(sum(n_bytes) OVER () / {REPORT_BYTES}::DOUBLE, 0)) AS parts FROM c),
k AS (SELECT DISTINCT s.i, min(o.pos) AS cut FROM o, (SELECT unnest(range(1, (SELECT max(parts)::BIGINT FROM o))) AS i) s WHERE upto >= weight * s.i / parts GROUP BY s.i),
d AS (SELECT DISTINCT cut FROM k)
"""

QUERIES = {f.__name__: f for f in (p5_found, p5_contents, p5_sets, p5_rest, p5_report)}
SQL = {
    "p5_found": _NAMED + """SELECT a.file_id AS file_a, b.file_id AS file_b FROM named a JOIN named b
      ON a.field = b.field AND a.example_number = b.example_number AND a.combination_number = b.combination_number AND a.digest = b.digest AND a.file_id < b.file_id""",
    "p5_contents": _NAMED + """SELECT DISTINCT field, example_number, combination_number, n_bytes, digest FROM named
      WHERE field IS NOT NULL AND example_number IS NOT NULL AND combination_number IS NOT NULL""",
    "p5_sets": _NAMED + """SELECT file_id, min(file_id) OVER w AS first_file, count(*) OVER w AS copies FROM named
      WHERE field IS NOT NULL AND example_number IS NOT NULL AND combination_number IS NOT NULL WINDOW w AS (PARTITION BY field, example_number, combination_number, digest)""",
    "p5_rest": _NAMED + """SELECT t.file_id, t.path, md5(coalesce(t.body, ''::BLOB)) AS body FROM named n JOIN tiny_files t USING (file_id)
      WHERE field IS NULL OR example_number IS NULL OR combination_number IS NULL""",
    "p5_report": _RANGES + """SELECT part, count(*) AS records, sum(n_bytes)::BIGINT AS bytes, min(example_number) AS first_example, max(example_number) AS last_example
      FROM (SELECT c.*, (SELECT count(*) FROM d WHERE cut < c.pos) AS part FROM c) GROUP BY part""",
}
