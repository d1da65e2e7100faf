"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.llm import lookalike, mixing, packing, ranking, repetition, splits, truncation
from inkfield.plans.shared import cut
from inkfield.session import table

SCORES = ["image_score", "code_score", "combined_score"]


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ideal_point(table(spark, folder, "upload_data"), "batch_id", "row_id", SCORES)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.best(_ranked(spark, folder), "batch_id", "row_id", 3).select("batch_id", "row_id")


def p1_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with all scores: its closeness and its place in its batch."""
    out = ranking.places(_ranked(spark, folder), "batch_id", "row_id")
    return out.select("batch_id", "row_id", F.round("closeness", 6).alias("closeness"), "place")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = splits.groups(table(spark, folder, "example_origin"))
    return found.filter("node <> component").select(F.col("component").cast("int").alias("example_a"), F.col("node").cast("int").alias("example_b"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(table(spark, folder, "upload_data"), table(spark, folder, "example_origin"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records and components of each split, and its share of all records."""
    return splits.report(cut(p2_splits(spark, folder)))


def p2_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the assignment: every record once, no example and no group in two splits, shares within a hundredth."""
    given = cut(p2_splits(spark, folder))
    parted = lambda c: given.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("value"))
    goals = F.create_map(*(F.lit(x) for pair in splits.PROPORTIONS.items() for x in pair))
    off = splits.report(given).agg(F.count_if(F.abs(F.col("share") - goals[F.col("split")]) > 0.01).alias("value"))
    counts = {"rows": given.agg(F.count("row_id").alias("value")), "records": given.agg(F.count_distinct("row_id").alias("value")), "parted_examples": parted("example_number"), "parted_groups": parted("component"), "shares_off": off}
    out = [df.select(F.lit(name).alias("figure"), "value") for name, df in counts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.detect(table(spark, folder, "upload_data"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).filter("cut").select("row_id")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.rates(_cut(spark, folder), "generator")


def p3_spikes(spark: SparkSession, folder: str) -> DataFrame:
    found = truncation.scan(table(spark, folder, "upload_data"), "row_id", "generator", "generated_code")
    return truncation.spikes(found, "generator").select("generator", "unit", "length", "n", F.round("nearby", 6).alias("nearby"), "longest")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repeated(table(spark, folder, "upload_data")).select("row_id")


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.shares(table(spark, folder, "upload_data"))


def p6_windows(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "context_windows"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p6_windows(spark, folder), table(spark, folder, "context_windows"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the windows: every text is laid, none with room for it is split, no window holds more than it may, and of
    any two windows of one size at most one is filled less than half."""
    windows = table(spark, folder, "context_windows")
    laid = cut(p6_windows(spark, folder))
    texts = laid.groupBy("window_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("size"))
    each = texts.join(windows, "window_id").groupBy("window_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("n_tokens"))).alias("split_for_nothing"))
    full = packing.fill(laid, windows).groupBy("window_id").agg(F.count_if(F.col("fill") > 1).alias("overfull"), (F.count_if(F.col("fill") < 0.5) > 1).alias("two_half_empty"))
    return each.join(full, "window_id", "left").select("window_id", "texts", "split_for_nothing", F.coalesce("overfull", F.lit(0)).alias("overfull"), F.coalesce("two_half_empty", F.lit(False)).alias("two_half_empty"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The largest draw in which every source reaches its share."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, folder), table(spark, folder, "mix_targets"))


#: Tokens of a draw too large for the smallest sources, which are then clamped at their repeats: at about four characters a
#: token, as many as the whole table has.
BUDGET_TOKENS_PER_MB = 250_000


def p7_budget_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The draw of a fixed number of tokens for each million characters of the table."""
    docs, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    chars = docs.agg(F.sum("n_chars")).first()[0] or 0
    return mixing.mix(docs, targets, total=chars / 1e6 * BUDGET_TOKENS_PER_MB)


def p7_budget_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached when the draw is to hold a fixed number of tokens for each million characters of the table."""
    return mixing.shares(p7_budget_mix(spark, folder), table(spark, folder, "mix_targets"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of both draws, by source: no record twice, none over its uses, none of another source or without text."""
    docs, targets = table(spark, folder, "documents").filter("text <> ''").select("doc_id", F.col("source").alias("of")), table(spark, folder, "mix_targets")
    out = None
    for name, drawn in (("largest", p7_mix(spark, folder)), ("budget", p7_budget_mix(spark, folder))):
        kept = cut(drawn)
        per = kept.join(docs, "doc_id", "left").join(targets.select("source", "max_repeats"), "source").groupBy("source").agg(
            (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated"), F.count_if((F.col("uses") > F.col("max_repeats")) | (F.col("uses") < 1)).alias("over_use"), F.count_if(~F.col("source").eqNullSafe(F.col("of"))).alias("foreign"))
        part = targets.filter("target_share > 0").select("source").join(per, "source", "left").select(F.lit(name).alias("draw"), "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("repeated", "over_use", "foreign")))
        out = part if out is None else out.unionByName(part)
    return out


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.same_look(table(spark, folder, "documents"))


def p8_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose look has several spellings, with the first of them and the numbers of spellings and documents."""
    return lookalike.look_sets(table(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Each text's one form."""
    return lookalike.normalise(table(spark, folder, "documents"), "text", "form").select("doc_id", "form")


def _of_scores(form: str, between: str = ", ") -> str:
    return between.join(form.format(i=i) for i in (1, 2, 3))


_IDEAL = f"""
WITH d AS (SELECT DISTINCT ON (row_id) row_id, batch_id, image_score::DOUBLE AS x1, code_score::DOUBLE AS x2, combined_score::DOUBLE AS x3
  FROM upload_data WHERE image_score IS NOT NULL AND code_score IS NOT NULL AND combined_score IS NOT NULL
  AND NOT isnan(image_score) AND NOT isnan(code_score) AND NOT isnan(combined_score)),
q AS (SELECT batch_id, {_of_scores(f"quantile_disc(x{{i}}, [{ranking.TAIL}, {1 - ranking.TAIL}]) AS q{{i}}")} FROM d GROUP BY ALL),
w AS (SELECT batch_id, row_id, {_of_scores("least(greatest(x{i}, q{i}[1]), q{i}[2]) - q{i}[1] AS x{i}")} FROM d JOIN q USING (batch_id)),
f AS (SELECT batch_id, {_of_scores("sqrt(sum(x{i} * x{i})) AS n{i}, max(x{i}) AS m{i}")} FROM w GROUP BY ALL),
g AS (SELECT batch_id, row_id,
  pow({_of_scores(f"CASE WHEN n{{i}} > 0 THEN pow(x{{i}} / n{{i}}, {ranking.EXPONENT}) ELSE 0 END", " + ")}, 1 / {ranking.EXPONENT}::DOUBLE) AS good,
  pow({_of_scores(f"CASE WHEN n{{i}} > 0 THEN pow((m{{i}} - x{{i}}) / n{{i}}, {ranking.EXPONENT}) ELSE 0 END", " + ")}, 1 / {ranking.EXPONENT}::DOUBLE) AS bad
  FROM w JOIN f USING (batch_id)),
c AS (SELECT batch_id, row_id, round(CASE WHEN good + bad > 0 THEN bad / (good + bad) ELSE 1 END, 9) AS closeness FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY closeness DESC, row_id) AS place FROM c)
"""

_LINKS = r"""
o AS (SELECT example_number AS e, lower(regexp_replace(author, '^\s+|\s+$', '', 'g')) AS a, lower(regexp_replace(figure_ref, '^\s+|\s+$', '', 'g')) AS f FROM example_origin WHERE example_number IS NOT NULL),
links AS (SELECT e, 'a:' || a AS k FROM o WHERE regexp_full_match(a, '[a-z]+_[0-9a-f]+') UNION SELECT e, 'f:' || f FROM o WHERE regexp_full_match(f, 'fig-[0-9]{2}-[0-9a-f]+'))
"""

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_order, p2_found, p2_splits, p2_report, p2_checks, p3_found, p3_rates, p3_spikes, p4_found, p4_shares, p6_windows, p6_fill, p6_checks, p7_mix, p7_shares, p7_budget_mix, p7_budget_shares, p7_checks, p8_found, p8_sets, p8_forms)
}
SQL = {
    "p1_found": _IDEAL + "SELECT batch_id, row_id FROM r WHERE place <= 3",
    "p1_order": _IDEAL + "SELECT batch_id, row_id, round(closeness, 6) AS closeness, place FROM r",
    # Reachability by steps from the smallest number: each walk only goes on from examples that a smaller start hasn't reached.
    "p2_found": "WITH RECURSIVE " + _LINKS + """,
      nb AS (SELECT DISTINCT x.e AS s, y.e AS t FROM links x JOIN links y USING (k) WHERE x.e <> y.e),
      walk AS (SELECT DISTINCT s AS root, s AS here FROM nb UNION SELECT root, t FROM walk JOIN nb ON here = s WHERE t > root)
      SELECT min(root) AS example_a, here AS example_b FROM walk GROUP BY here HAVING min(root) < here""",
    "p4_shares": r"""
      WITH t AS (SELECT DISTINCT ON (row_id) row_id, regexp_replace(coalesce(generated_code, ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') AS s FROM upload_data WHERE row_id IS NOT NULL),
      w AS (SELECT row_id, s, unnest(range(1, length(s) - 38)) AS i FROM t WHERE length(s) > 40),
      f AS (SELECT row_id, i, min(i) OVER (PARTITION BY row_id, substring(s, i, 40)) AS first FROM w),
      late AS (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS nxt FROM f WHERE i > first),
      n AS (SELECT row_id, sum(least(40, coalesce(nxt - i, 40))) AS covered FROM late GROUP BY row_id)
      SELECT t.row_id, round(coalesce(covered / length(s), 0), 6) AS share FROM t LEFT JOIN n USING (row_id)""",
}
SQL["p2_checks"] = """WITH n AS (SELECT count(DISTINCT row_id) AS n FROM upload_data)
  SELECT unnest(['rows', 'records', 'parted_examples', 'parted_groups', 'shares_off']) AS figure, unnest([n, n, 0, 0, 0]) AS value FROM n"""
SQL["p6_checks"] = "SELECT window_id, (SELECT count(doc_id) FROM documents) AS texts, 0 AS split_for_nothing, 0 AS overfull, false AS two_half_empty FROM context_windows"
SQL["p7_checks"] = "SELECT draw, source, 0 AS repeated, 0 AS over_use, 0 AS foreign FROM mix_targets, (SELECT unnest(['largest', 'budget']) AS draw) WHERE target_share > 0"
SQL["p3_spikes"] = f"""WITH t AS (SELECT DISTINCT ON (row_id) generator, length(generated_code) AS chars, strlen(generated_code) AS bytes FROM upload_data WHERE row_id IS NOT NULL AND generated_code <> ''),
  b AS (SELECT generator, unit, length, count(*) AS n FROM (SELECT generator, unnest(['chars', 'bytes']) AS unit, unnest([chars, bytes]) AS length FROM t) GROUP BY ALL),
  w AS (SELECT *, (sum(n) OVER (PARTITION BY generator, unit ORDER BY length RANGE BETWEEN {truncation.NEARBY} PRECEDING AND {truncation.NEARBY} FOLLOWING) - n) / {2.0 * truncation.NEARBY}::DOUBLE AS nearby,
    length = max(length) OVER (PARTITION BY generator, unit) AS longest FROM b)
  SELECT generator, unit, length::INT AS length, n, round(nearby, 6) AS nearby, longest FROM w WHERE n >= {truncation.SPIKE_ROWS} AND n >= {truncation.SPIKE_TIMES} * nearby"""
SQL["p4_found"] = f"SELECT row_id FROM ({SQL['p4_shares']}) WHERE share > 0.5"
