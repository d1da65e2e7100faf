"""Text functions over programs: cleaning, feature sets, n-grams, logs, program assembly. Native column expressions only.

All patterns are written so that Java's engine and RE2 read them alike: white space is the class WS (what Python's str calls
white space), and '.' is spelt out as 'not a line feed'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, the comment and number patterns, and the patterns of the feature sets.
WS = r"[\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
COMMENT = r"%[^\n]*\n"
NUMBER = r"-?[0-9]+\.?[0-9]*"
COMMANDS = r"\\(draw|fill|path|node|circle|rectangle|line|arrow|coordinate)"
EDGES = (rf"\\edge{WS}*(?:\[[^\]]*\])?{WS}*\([^)]*\){WS}*--{WS}*\([^)]*\)", rf"\([^)]*\){WS}*--{WS}*\([^)]*\)", rf"to{WS}*(?:\[[^\]]*\])?{WS}*\([^)]*\)")
EDGE_STYLES = (rf"\\edge{WS}*\[([^\n]*?)\]", rf"--{WS}*\[([^\n]*?)\]", rf"to{WS}*\[([^\n]*?)\]")
STYLES = r"\[([^\n]*?)\]"
COORDINATES = rf"\({WS}*{NUMBER}{WS}*,{WS}*{NUMBER}{WS}*\)"
PAIR = rf"\({WS}*({NUMBER}){WS}*,{WS}*({NUMBER}){WS}*\)"
DEPENDENCY_NAMES = r"\(([\p{L}\p{N}_]+)\)"
DEPENDENCY_COORDINATES = r"\(([-0-9.]+,[-0-9.]+)\)"
ENVIRONMENTS = r"\\begin\{([^}]*)\}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def clean_code(c: Column) -> Column:
    """Without comments that end in a line feed, white space as single blanks, stripped. Null stays null."""
    return strip(F.regexp_replace(F.regexp_replace(c, COMMENT, "\n"), rf"{WS}+", " "))


def preprocess(c: Column) -> Column:
    """clean_code with the blanks inside numeric pairs taken out."""
    return F.regexp_replace(clean_code(c), PAIR, "($1,$2)")


def _set(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _options(c: Column, patterns: tuple[str, ...]) -> Column:
    found = F.concat(*(_all(c, p, 1) for p in patterns))
    return F.flatten(F.transform(found, lambda o: F.transform(F.split(o, ",", -1), strip)))


def commands(c: Column) -> Column:
    return _set(_all(c, COMMANDS, 1))


def edges(c: Column) -> Column:
    return _set(*(_all(c, p) for p in EDGES))


def edge_styles(c: Column) -> Column:
    return _set(_options(c, EDGE_STYLES))


def styles(c: Column) -> Column:
    return _set(_options(c, (STYLES,)), _options(c, EDGE_STYLES))


def coordinates(c: Column) -> Column:
    return _set(_all(c, COORDINATES))


FEATURES = {"command": commands, "coordinate": coordinates, "style": styles, "edge": edges}


def ngrams(tokens: Column, n: int, left: str | None = None, right: str | None = None) -> Column:
    """Array of n-grams (arrays); with `left`/`right`, n-1 of these pads stand before and after. Fewer than n tokens: none."""
    pads = lambda p: F.array_repeat(F.lit(p), n - 1)
    t = tokens if left is None and right is None else F.concat(*([pads(left)] if left is not None else []), tokens, *([pads(right)] if right is not None else []))
    last = F.size(t) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(t, i, n))).otherwise(F.slice(F.array(t), 2, 1))


def words(c: Column) -> Column:
    """Tokens between white space; an empty or null text has none."""
    s = F.coalesce(strip(c), F.lit(""))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, rf"{WS}+"))


def brace_balance(c: Column) -> Column:
    return (F.length(F.replace(c, F.lit("}"), F.lit(""))) - F.length(F.replace(c, F.lit("{"), F.lit("")))).cast("bigint")


def wrappers(preamble: Column) -> Column:
    """Environments opened between the document's start and the picture's, in order."""
    inner = F.substring_index(F.substring_index(preamble, "\\begin{tikzpicture}", 1), "\\begin{document}", -1)
    return F.when(F.contains(preamble, F.lit("\\begin{document}")), _all(inner, ENVIRONMENTS, 1)).otherwise(F.array().cast("array<string>"))


def reconstruct(preamble: Column, options: Column, elements: Column, closers: Column, braces: Column) -> Column:
    """A whole program from a subset of its elements: preamble, picture with options, elements, closers in reverse, braces."""
    nl = F.lit("\n")
    ends = F.array_join(F.transform(F.reverse(closers), lambda w: F.concat(F.lit("\n\\end{"), w, F.lit("}"))), "")
    close = F.when(braces > 0, F.concat(nl, F.repeat(F.lit("}"), braces.cast("int")))).otherwise("")
    return F.concat(preamble, F.lit("\n\n\\begin{tikzpicture}"), strip(options), nl, F.array_join(elements, "\n"), F.lit("\n\\end{tikzpicture}"), ends, close, F.lit("\n\n\\end{document}"))


def insert_header(c: Column, header: str) -> Column:
    """A line put after the first one."""
    lines = F.split(c, "\n", -1)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.lit(header)), F.slice(lines, 2, F.size(lines))), "\n")


def remove_token(c: Column, token: str) -> Column:
    """Without a special token and the blanks around it, stripped."""
    return strip(F.regexp_replace(c, rf"{WS}*\Q{token}\E{WS}*", ""))


def flatten_text(caption: Column, mentions: Column, ocr: Column) -> Column:
    """Caption, mentions (array of arrays) and OCR lines as one text; null and empty parts are left out."""
    parts = F.concat(F.array(caption), F.coalesce(F.flatten(mentions), F.array().cast("array<string>")), F.coalesce(ocr, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def error_lines(log: Column, root: Column) -> Column:
    """Map line -> message of the `file:line:message` lines of a compiler log. Messages of other files have line 0; the last
    message of a line holds; a log without any is the map of 0 to a fatal error."""
    lines = F.filter(F.split(F.coalesce(log, F.lit("")), "\r?\n"), lambda x: F.rlike(x, F.lit(r"^[^:\n]+:[0-9]+:")))
    one = lambda x: F.struct(F.when(F.regexp_extract(x, r"^([^:\n]+):", 1) == root, F.regexp_extract(x, r"^[^:\n]+:([0-9]+):", 1).try_cast("int")).otherwise(0).alias("line"), F.regexp_extract(x, r"^[^:\n]+:[0-9]+:(.*)$", 1).alias("message"))
    found = F.transform(lines, one)
    keys = F.array_distinct(F.transform(found, lambda e: e["line"]))
    last = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda e: e["line"] == k), -1)["message"]))
    return F.when(F.size(found) > 0, last).otherwise(F.create_map(F.lit(0), F.lit("Fatal error occurred, no output PDF file produced!")))


def first_error(errors: Column) -> Column:
    return F.array_min(F.map_keys(errors))


def line_difference(child: Column, parent: Column) -> Column:
    """Lines of `child` that `parent` hasn't."""
    have = F.split(parent, "\n", -1)
    return F.filter(F.split(child, "\n", -1), lambda x: ~F.array_contains(have, x))


def rechunk(c: Column) -> Column:
    """What a reader of a token stream sees: the text up to and including each line feed, then all of it if a rest is left."""
    parts = F.split(c, "\n", -1)
    n = F.size(parts)
    upto = lambda i: F.array_join(F.slice(parts, 1, i), "\n")
    whole = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(upto(i), F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.element_at(parts, -1) == "", whole).otherwise(F.concat(whole, F.array(c)))


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def example_id(c: Column) -> dict[str, Column]:
    """example_number and combination_number (-1: main) of names like example_12_combination_3, example_12_3, example_12_main."""
    part = F.regexp_extract(c, r"example_[0-9]+_(?:combination_)?(main|[0-9]+)", 1)
    return {"example_number": F.regexp_extract(c, r"example_([0-9]+)", 1).try_cast("int"), "combination_number": F.when(part == "main", -1).otherwise(part.try_cast("int"))}


def merged_path(c: Column, prefix: str = "merged_results/") -> Column:
    """A path below the prefix; null and empty ones are null."""
    p = F.nullif(c, F.lit(""))
    return F.when(F.startswith(p, F.lit(prefix)), p).otherwise(F.concat(F.lit(prefix), p))
