"""Queries of the text functions, feature sets, similarity and n-gram precision."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfield.functions import sequences as Q
from inkfield.functions import similarity as S
from inkfield.functions import text as T
from inkfield.operators import bleu as B
from inkfield.session import table


def codes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Distinct scored rows with both codes."""
    rows = table(spark, folder, "upload_data").select("row_id", *(columns or ("original_code", "generated_code")))
    return rows.dropDuplicates(["row_id"])


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return codes(spark, folder).filter("original_code is not null and generated_code is not null and generated_code <> ''")


def code_clean(spark, folder):
    return codes(spark, folder, "generated_code").select("row_id", F.md5(T.clean_code(F.col("generated_code"))).alias("clean"), F.md5(T.preprocess(F.col("generated_code"))).alias("normal"))


def feature_sets(spark, folder):
    c = F.col("clean")  # a generator of one row: the code is cleaned once for all sets
    join = lambda a: F.array_join(a, "|")
    clean = codes(spark, folder, "original_code").select("row_id", F.explode(F.array(T.clean_code(F.col("original_code")))).alias("clean"))
    return clean.select("row_id", join(T.commands(c)).alias("commands"), join(T.edges(c)).alias("edges"), join(T.edge_styles(c)).alias("edge_styles"), join(T.styles(c)).alias("styles"), join(T.coordinates(c)).alias("coordinates"))


def overlap_ratios(spark, folder):
    return _scores(spark, folder).select("row_id", *(F.round(k, 6).alias(k) for k in T.FEATURES))


def _scores(spark, folder):
    return S.with_overlaps(pairs(spark, folder), "original_code", "generated_code")


def similarity_blend(spark, folder):
    """The blend with equal length share as its sequence score, which SQL can follow."""
    a, b = (F.length(T.clean_code(F.col(c))) for c in ("original_code", "generated_code"))
    rows = _scores(spark, folder).withColumn("sequence", F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0))
    return rows.select("row_id", F.round(S.blended({k: F.col(k) for k in S.OVERALL}, S.OVERALL), 6).alias("overall"), F.round(S.blended({k: F.col(k) for k in S.OVERALL}, S.CUSTOM), 6).alias("custom"))


def similarity_full(spark, folder):
    """Overall and custom score with the matching-block ratio of the cleaned codes."""
    rows = _scores(spark, folder).withColumn("sequence", Q.sequence_ratio_column(T.clean_code(F.col("original_code")), T.clean_code(F.col("generated_code"))))
    return rows.select("row_id", F.round("sequence", 6).alias("sequence"), F.round(S.blended({k: F.col(k) for k in S.OVERALL}, S.OVERALL), 6).alias("overall"), F.round(S.blended({k: F.col(k) for k in S.OVERALL}, S.CUSTOM), 6).alias("custom"))


def weights_in_effect(spark, folder):
    rows = _scores(spark, folder).withColumn("sequence", F.lit(1.0))
    w = S.redistributed({k: F.col(k) for k in S.OVERALL}, S.OVERALL)
    return rows.select("row_id", *(F.round(c, 6).alias(f"w_{k}") for k, c in w.items()))


def edit_distances(spark, folder):
    return pairs(spark, folder).select("row_id", F.round(Q.edit_distance_column(F.col("generated_code"), F.col("original_code")), 6).alias("distance"))


def token_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("n_words"))


def ngram_top(spark, folder):
    """The 500 most frequent n-grams, orders 1 to 4, of all original codes."""
    every = B.corpus_grams(codes(spark, folder, "original_code"), T.clean_code(F.col("original_code")), joint=" ")
    return B.trivial(every).withColumn("n", F.col("n").cast("bigint"))


def _cleaned(spark, folder):
    """Pairs with their cleaned codes, each cleaned once for all that use it."""
    clean = pairs(spark, folder).select("row_id", F.explode(F.array(T.clean_code(F.col("original_code")))).alias("original"), "generated_code")
    return clean.select("row_id", "original", F.explode(F.array(T.clean_code(F.col("generated_code")))).alias("generated"))


def _counted(spark, folder, tokenize=B.blank_split):
    """Pairs with their n-gram counts, without the n-grams that the original codes share most often. Codes are cleaned once."""
    clean = _cleaned(spark, folder)
    shared = B.shared_grams(B.trivial(B.corpus_grams(clean, F.col("original"), tokenize)))
    return clean.select("row_id", B.pair_counts(F.col("generated"), F.col("original"), shared, tokenize).alias("b")).select("row_id", "b.*")


def clipped_counts(spark, folder):
    return B.by_order(_counted(spark, folder), "row_id")


def corpus_bleu(spark, folder):
    """BLEU by generator, over words."""
    by = codes(spark, folder, "generator")
    return B.corpus_bleu(_counted(spark, folder).join(by, "row_id"), ["generator"]).select("generator", "hyp", "ref", F.round("bleu", 6).alias("bleu"))


def running_bleu(spark, folder):
    return B.running_bleu(_counted(spark, folder), [F.col("row_id")]).select("row_id", "r_hyp", "r_ref", F.round("bleu", 6).alias("bleu"))


def tex_bleu(spark, folder):
    """BLEU of each pair over TeX tokens."""
    return B.pair_bleu(_counted(spark, folder, Q.tex_tokens)).select("row_id", "hyp", "ref", F.round("bleu", 6).alias("bleu"))


def _measures(original, generated, shared):
    """Struct of the matching-block ratio, the edit distance and the n-gram counts of cleaned codes, whose TeX tokens are taken once.

    preprocess() would leave the tokens as they are: it takes out only blanks next to signs that no token goes over."""
    def batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in pairs:
            refs, hyps = ([Q.tex_tokens(t) for t in side] for side in (x, y))
            out = B.pair_counts_many(hyps, refs, shared)
            out.insert(0, "ted", Q.edit_distance_many([(Q.between_blanks(h), Q.between_blanks(r)) for h, r in zip(hyps, refs, strict=True)]))
            out.insert(0, "sequence", Q.sequence_ratios(x, y))
            yield out

    return F.pandas_udf(batches, "sequence double, ted double, " + B.PAIR_COUNTS)(original, generated)


def final_difficulty(spark, folder):
    """1 - (custom score + BLEU + edit distance), with all of its parts, per pair; BLEU over TeX tokens of the pair alone."""
    clean = _cleaned(spark, folder)
    shared = B.shared_grams(B.trivial(B.corpus_grams(clean, F.col("original"), Q.tex_tokens)))
    rows = S.with_clean_overlaps(clean.withColumn("m", _measures(F.col("original"), F.col("generated"), shared)), "original", "generated")
    rows = B.pair_bleu(rows.select("row_id", *T.FEATURES, "m.*"))
    rows = rows.withColumn("custom", S.blended({k: F.col(k) for k in S.OVERALL}, S.CUSTOM))
    bleu = F.coalesce("bleu", F.lit(0.0))
    return rows.select("row_id", F.round("custom", 6).alias("custom"), F.round(bleu, 6).alias("bleu"), F.round("ted", 6).alias("ted"), F.round(1 - S.final_score(F.col("custom"), bleu, F.col("ted")), 6).alias("difficulty"))


def text_flatten(spark, folder):
    """Each document as one text: its first line as caption, the second as a mention, the others as OCR lines."""
    docs = table(spark, folder, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    flat = T.flatten_text(F.try_element_at("l", F.lit(1)), F.array(F.slice("l", 2, 1)), F.slice("l", F.lit(3), F.greatest(F.size("l"), F.lit(0))))
    return docs.select("doc_id", F.md5(F.when(F.col("l").isNotNull(), flat).otherwise("")).alias("text"))


def text_filter(spark, folder):
    """Documents with text of at most 100 words and without the patch token; counts before and after."""
    rows = table(spark, folder, "documents").withColumn("w", F.size(T.words(F.col("text"))))
    keep = F.col("text").isNotNull() & (F.col("text") != "") & (F.col("w") <= 100) & ~F.contains("text", F.lit("<patch>"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("before"), F.count_if(keep).alias("after"))


def error_maps(spark, folder):
    """Per compile attempt: number of error lines, the first of them, and its message."""
    e = T.error_lines(F.col("log"), F.lit("main.tex"))
    rows = table(spark, folder, "compile_logs").distinct().withColumn("e", e)
    return rows.select("doc_id", "engine", "attempt", F.size("e").cast("bigint").alias("n"), T.first_error(F.col("e")).alias("first"), F.element_at("e", T.first_error(F.col("e"))).alias("message"))


def best_engine(spark, folder):
    """Per document: the attempt that compiled, else the one that came furthest before its first error."""
    rows = table(spark, folder, "compile_logs").distinct()
    far = F.when(F.col("status") == 0, 2**31 - 1).otherwise(T.first_error(T.error_lines(F.col("log"), F.lit("main.tex"))))
    best = F.max_by(F.struct("engine", "attempt", "status"), F.struct(far, -F.col("attempt"), "engine"))
    return rows.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.engine", "b.attempt", "b.status")


def validity(spark, folder):
    """Strict and lenient success of compile attempts by engine."""
    rows = table(spark, folder, "compile_logs").distinct()
    return rows.groupBy("engine").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == 0).alias("strict"), F.count_if(F.coalesce("has_image", F.lit(False))).alias("lenient"), F.count_if((F.col("status") != 0) & F.coalesce("has_image", F.lit(False))).alias("with_errors"))


def header_inserted(spark, folder):
    return table(spark, folder, "decomposed").select("id", F.md5(T.insert_header(F.col("code"), "\\usepackage{tikz}")).alias("code")).distinct()


def tokens_removed(spark, folder):
    """Documents without the patch token, and the lines of each that its source's first document hasn't."""
    docs = table(spark, folder, "documents").filter("text is not null").select("doc_id", "source", "text")
    first = docs.filter("source is not null").groupBy("source").agg(F.min_by("text", "doc_id").alias("first"))  # one row per source
    rows = docs.join(first, "source", "left")
    return rows.select("doc_id", F.md5(T.remove_token(F.col("text"), "<patch>")).alias("text"), F.size(T.line_difference(F.col("text"), F.coalesce("first", F.lit("")))).cast("bigint").alias("new_lines"))


def code_rechunked(spark, folder):
    """Number of prefixes a line-wise reader of each code sees, and the last one."""
    rows = table(spark, folder, "decomposed").select("id", T.rechunk(F.col("code")).alias("r")).distinct()
    return rows.select("id", F.size("r").cast("bigint").alias("n"), F.md5(F.coalesce(F.try_element_at("r", F.lit(-1)), F.lit(""))).alias("last"))


def id_parse(spark, folder):
    e = T.example_id(F.col("id"))
    return table(spark, folder, "decomposed").select("id", *(c.alias(k) for k, c in e.items()), T.ordinal(e["example_number"]).alias("ordinal"), F.concat_ws("/", F.lit("decomposed"), F.col("id"), F.lit("code.tex")).alias("path")).distinct()


def preamble_balance(spark, folder):
    """Unclosed braces and open environments in front of the picture."""
    pre = F.substring_index("code", "\\begin{tikzpicture}", 1)
    return table(spark, folder, "decomposed").select("id", T.brace_balance(pre).alias("braces"), F.array_join(T.wrappers(F.col("code")), "|").alias("wrappers")).distinct()


def corpus_digest(spark, folder):
    """Key of a cached corpus, by example: md5 of the number of its different codes and of two sums over their digests, so that no
    task gathers an example."""
    rows = codes(spark, folder, "example_number", "original_code").filter("original_code is not null")
    each = rows.select("example_number", F.md5("original_code").alias("m")).distinct()
    part = lambda at: F.sum(F.conv(F.substring("m", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return each.groupBy("example_number").agg(F.md5(F.concat_ws("|", F.count(F.lit(1)).cast("string"), part(1), part(16))).alias("digest"))


_SP = T.WS
_U = "u AS (SELECT DISTINCT ON (row_id) * FROM upload_data)"


def _clean(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '{T.COMMENT}', chr(10), 'g'), '{_SP}+', ' ', 'g'), '^{_SP}+|{_SP}+$', '', 'g')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"


def _set_sql(*parts: str) -> str:
    return f"list_sort(list_distinct({' || '.join(f'({p})' for p in parts)}))"


def _options_sql(c: str, patterns) -> list[str]:
    return [f"flatten(list_transform(regexp_extract_all({c}, '{p}', 1), lambda o: list_transform(string_split(o, ','), lambda s: {_strip('s')})))" for p in patterns]


def _feature_sql(c: str) -> dict[str, str]:
    return {
        "command": _set_sql(f"regexp_extract_all({c}, '{T.COMMANDS}', 1)"),
        "edge": _set_sql(*(f"regexp_extract_all({c}, '{p}', 0)" for p in T.EDGES)),
        "edge_style": _set_sql(*_options_sql(c, T.EDGE_STYLES)),
        "style": _set_sql(*_options_sql(c, (T.STYLES, *T.EDGE_STYLES))),
        "coordinate": _set_sql(f"regexp_extract_all({c}, '{T.COORDINATES}', 0)"),
    }


_A, _B = _feature_sql("a"), _feature_sql("b")
_PAIRS = f"""WITH {_U}, p AS (SELECT row_id, {_clean('original_code')} AS a, {_clean('generated_code')} AS b FROM u
  WHERE original_code IS NOT NULL AND generated_code IS NOT NULL AND generated_code <> ''),
  f AS (SELECT row_id, length(a) AS la, length(b) AS lb, {', '.join(f'{_A[k]} AS {k}_a, {_B[k]} AS {k}_b' for k in ('command', 'coordinate', 'style', 'edge'))} FROM p),
  o AS (SELECT row_id, la, lb, {', '.join(f"CASE WHEN greatest(len({k}_a), len({k}_b)) > 0 THEN len(list_intersect({k}_a, {k}_b)) / greatest(len({k}_a), len({k}_b))::DOUBLE END AS {k}" for k in ('command', 'coordinate', 'style', 'edge'))} FROM f)
"""


def _blend_sql(weights: dict[str, float]) -> str:
    lost = " + ".join(f"CASE WHEN {k} IS NULL THEN {w} ELSE 0.0::DOUBLE END" for k, w in weights.items())
    have = " + ".join(f"({k} IS NOT NULL)::INT" for k in weights)
    return f"round({' + '.join(f'coalesce({k}, 0.0::DOUBLE) * CASE WHEN {k} IS NULL THEN 0 ELSE {w}::DOUBLE + ({lost}) / ({have}) END' for k, w in weights.items())}, 6)"


def _words_sql(c: str) -> str:
    s = _strip(f"coalesce({c}, '')")
    return f"CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{_SP}+') END"


def _grams_sql(name: str, source: str, words: str) -> str:
    return f"""{name} AS (SELECT row_id, n, array_to_string(t[i:i + n - 1], ' ') AS gram, count(*) AS count FROM
      (SELECT row_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT row_id, {words} AS t FROM {source}), (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL)"""


_BLEU = f"""WITH {_U}, p AS (SELECT row_id, generator, {_clean('original_code')} AS a, {_clean('generated_code')} AS b FROM u
    WHERE original_code IS NOT NULL AND generated_code IS NOT NULL AND generated_code <> ''),
  {_grams_sql('ra', 'p', _words_sql('a'))}, {_grams_sql('hb', 'p', _words_sql('b'))},
  triv AS (SELECT n, gram FROM ra GROUP BY n, gram ORDER BY sum(count) DESC, n, gram LIMIT 500),
  r AS (SELECT * FROM ra WHERE (n, gram) NOT IN (SELECT (n, gram) FROM triv)), h AS (SELECT * FROM hb WHERE (n, gram) NOT IN (SELECT (n, gram) FROM triv)),
  c AS (SELECT h.row_id, h.n, sum(least(h.count, coalesce(r.count, 0)))::BIGINT AS matched, sum(h.count)::BIGINT AS total FROM h LEFT JOIN r USING (row_id, n, gram) GROUP BY ALL),
  l AS (SELECT row_id, generator, len({_words_sql('b')})::BIGINT AS hyp, len({_words_sql('a')})::BIGINT AS ref FROM p),
  w AS (SELECT l.row_id, l.generator, l.hyp, l.ref, {', '.join(f'coalesce(sum(matched) FILTER (n = {n}), 0)::BIGINT AS m{n}, coalesce(sum(total) FILTER (n = {n}), 0)::BIGINT AS t{n}' for n in range(1, 5))}
    FROM l LEFT JOIN c USING (row_id) GROUP BY ALL)
"""
_SCORE = "round(CASE WHEN m1 > 0 AND m2 > 0 AND m3 > 0 AND m4 > 0 THEN CASE WHEN hyp > ref THEN 1 ELSE exp(1 - ref / hyp::DOUBLE) END * exp(ln(m1 / t1::DOUBLE) / 4 + ln(m2 / t2::DOUBLE) / 4 + ln(m3 / t3::DOUBLE) / 4 + ln(m4 / t4::DOUBLE) / 4) ELSE 0 END, 6)"
_SUMS = ", ".join(f"sum({c}){{over}}::BIGINT AS {c}" for c in ("hyp", "ref", *(f"{x}{n}" for n in range(1, 5) for x in "mt")))
_LOG = r"""
  WITH d AS (SELECT DISTINCT * FROM compile_logs),
  l AS (SELECT doc_id, engine, attempt, status, unnest(regexp_split_to_array(coalesce(log, ''), '\r?\n')) AS x, generate_subscripts(regexp_split_to_array(coalesce(log, ''), '\r?\n'), 1) AS i FROM d),
  m AS (SELECT doc_id, engine, attempt, status, i, CASE WHEN regexp_extract(x, '^([^:\n]+):', 1) = 'main.tex' THEN TRY_CAST(regexp_extract(x, '^[^:\n]+:([0-9]+):', 1) AS INT) ELSE 0 END AS line, regexp_extract(x, '^[^:\n]+:[0-9]+:(.*)$', 1) AS message
    FROM l WHERE regexp_matches(x, '^[^:\n]+:[0-9]+:')),
  e AS (SELECT doc_id, engine, attempt, status, count(DISTINCT line) AS n, min(line) AS first FROM m GROUP BY ALL),
  f AS (SELECT d.doc_id, d.engine, d.attempt, d.status, coalesce(d.has_image, false) AS ok, length(coalesce(d.log, '')) AS size, coalesce(e.n, 1) AS n, coalesce(e.first, 0) AS first FROM d LEFT JOIN e ON d.doc_id = e.doc_id AND d.engine IS NOT DISTINCT FROM e.engine AND d.attempt IS NOT DISTINCT FROM e.attempt AND d.status IS NOT DISTINCT FROM e.status)
"""

QUERIES = {
    f.__name__: f
    for f in (code_clean, feature_sets, overlap_ratios, similarity_blend, similarity_full, weights_in_effect, edit_distances, token_counts, ngram_top, clipped_counts, corpus_bleu, running_bleu, tex_bleu, final_difficulty, text_flatten, text_filter, error_maps, best_engine, validity, header_inserted, tokens_removed, code_rechunked, id_parse, preamble_balance, corpus_digest)
}
SQL = {
    "code_clean": f"WITH {_U} SELECT row_id, md5({_clean('generated_code')}) AS clean, md5(regexp_replace({_clean('generated_code')}, '{T.PAIR}', '(\\1,\\2)', 'g')) AS normal FROM u",
    "feature_sets": f"WITH {_U}, p AS (SELECT row_id, {_clean('original_code')} AS a FROM u) SELECT row_id, " + ", ".join(f"array_to_string({_A[k]}, '|') AS {k}s" for k in _A) + " FROM p",
    "overlap_ratios": _PAIRS + "SELECT row_id, round(command, 6) AS command, round(coordinate, 6) AS coordinate, round(style, 6) AS style, round(edge, 6) AS edge FROM o",
    "similarity_blend": _PAIRS + f", s AS (SELECT *, CASE WHEN greatest(la, lb) > 0 THEN least(la, lb) / greatest(la, lb)::DOUBLE ELSE 1 END AS sequence FROM o) SELECT row_id, {_blend_sql(S.OVERALL)} AS overall, {_blend_sql(S.CUSTOM)} AS custom FROM s",
    "token_counts": f"SELECT doc_id, len({_words_sql('text')}) AS n_words FROM documents",
    "ngram_top": f"WITH {_U}, p AS (SELECT row_id, {_clean('original_code')} AS a FROM u), {_grams_sql('g', 'p', _words_sql('a'))} SELECT n::BIGINT AS n, gram, sum(count)::BIGINT AS total FROM g GROUP BY n, gram ORDER BY total DESC, n, gram LIMIT 500",
    "clipped_counts": _BLEU + "SELECT row_id, n::BIGINT AS n, matched, total FROM c",
    "corpus_bleu": _BLEU + f", g AS (SELECT generator, {_SUMS.format(over='')} FROM w GROUP BY generator) SELECT generator, hyp, ref, {_SCORE} AS bleu FROM g",
    "running_bleu": _BLEU + f", g AS (SELECT row_id, {_SUMS.format(over=' OVER (ORDER BY row_id)')} FROM w) SELECT row_id, hyp AS r_hyp, ref AS r_ref, {_SCORE} AS bleu FROM g",
    "text_filter": f"SELECT source, count(*) AS before, count(*) FILTER (text IS NOT NULL AND text <> '' AND len({_words_sql('text')}) <= 100 AND NOT contains(text, '<patch>')) AS after FROM documents GROUP BY source",
    "text_flatten": "SELECT doc_id, md5(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''), ' ')) AS text FROM documents",
    "error_maps": _LOG + "SELECT f.doc_id, f.engine, f.attempt, f.n, f.first, coalesce((SELECT max_by(message, i) FROM m WHERE m.doc_id = f.doc_id AND m.engine = f.engine AND m.attempt = f.attempt AND m.line = f.first), 'Fatal error occurred, no output PDF file produced!') AS message FROM f",
    "best_engine": _LOG + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN status = 0 THEN 2147483647 ELSE first END DESC, attempt, engine DESC) AS rn FROM f) SELECT doc_id, engine, attempt, status FROM r WHERE rn = 1",
    "validity": "SELECT engine, count(*) AS attempts, count(*) FILTER (status = 0) AS strict, count(*) FILTER (coalesce(has_image, false)) AS lenient, count(*) FILTER (status <> 0 AND coalesce(has_image, false)) AS with_errors FROM (SELECT DISTINCT * FROM compile_logs) GROUP BY engine",
    "header_inserted": r"SELECT DISTINCT id, md5(regexp_replace(code, '^([^\n]*)', '\1' || chr(10) || '\\usepackage{tikz}')) AS code FROM decomposed",
    "tokens_removed": f"""WITH d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL), f AS (SELECT source, arg_min(text, doc_id) AS first FROM d WHERE source IS NOT NULL GROUP BY source)
      SELECT doc_id, md5({_strip(f"regexp_replace(text, '{T.WS}*<patch>{T.WS}*', '', 'g')")}) AS text, len(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(string_split(coalesce(first, ''), chr(10)), x))) AS new_lines FROM d LEFT JOIN f USING (source)""",
    "code_rechunked": "SELECT DISTINCT id, (length(code) - length(replace(code, chr(10), '')) + CASE WHEN code = '' OR code LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS n, md5(code) AS last FROM decomposed",
    "id_parse": r"""SELECT DISTINCT id, TRY_CAST(regexp_extract(id, 'example_([0-9]+)', 1) AS INT) AS example_number, CASE WHEN id LIKE '%main' THEN -1 ELSE TRY_CAST(regexp_extract(id, 'combination_([0-9]+)', 1) AS INT) END AS combination_number,
      regexp_extract(id, 'example_([0-9]+)', 1) || CASE WHEN TRY_CAST(regexp_extract(id, 'example_([0-9]+)', 1) AS INT) % 100 BETWEEN 11 AND 13 THEN 'th' ELSE CASE TRY_CAST(regexp_extract(id, 'example_([0-9]+)', 1) AS INT) % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END AS ordinal,
      'decomposed/' || id || '/code.tex' AS path FROM decomposed""",
    "preamble_balance": r"""SELECT DISTINCT id, (length(replace(p, '}', '')) - length(replace(p, '{', '')))::BIGINT AS braces,
      CASE WHEN contains(code, '\begin{document}') THEN array_to_string(regexp_extract_all(string_split(p, '\begin{document}')[-1], '\\begin\{([^}]*)\}', 1), '|') ELSE '' END AS wrappers FROM (SELECT id, code, string_split(code, '\begin{tikzpicture}')[1] AS p FROM decomposed)""",
    "corpus_digest": f"WITH {_U} SELECT example_number, md5(count(*) || '|' || sum(('0x' || m[1:15])::BIGINT) || '|' || sum(('0x' || m[16:30])::BIGINT)) AS digest FROM (SELECT DISTINCT example_number, md5(original_code) AS m FROM u WHERE original_code IS NOT NULL) GROUP BY 1",
    "weights_in_effect": _PAIRS + ", s AS (SELECT *, 1.0 AS sequence FROM o) SELECT row_id, "
    + ", ".join(f"round(CASE WHEN {k} IS NULL THEN 0 ELSE {w}::DOUBLE + ({' + '.join(f'CASE WHEN {j} IS NULL THEN {v} ELSE 0.0::DOUBLE END' for j, v in S.OVERALL.items())}) / ({' + '.join(f'({j} IS NOT NULL)::INT' for j in S.OVERALL)}) END, 6) AS w_{k}" for k, w in S.OVERALL.items())
    + " FROM s",
}
