"""Code that lost its tail: length spikes per source, and a scan for what is left open."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfield.plans.shared import cut

#: A length is a spike where at least SPIKE_ROWS values of a source have it, SPIKE_TIMES as many as lengths nearby have on average.
SPIKE_ROWS, SPIKE_TIMES, NEARBY = 8, 8.0, 12
#: Signs that may end a text in which nothing is opened.
TERMINAL = ".!?:;)]}>\"'\u00bb\u201d\u2019\u2026\u3002\uff01\uff1f"
_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\r\n]*")
_MARK = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}|\\([A-Za-z@]+)\*?|\\.|([{};])", re.S)
#: In what stands behind the last semicolon, groups are written {} or, if they hold a whole statement, {;}.
_OPTIONS = re.compile(r"\s*(?:(?:\[[^\]]*\]|\{;?\})\s*)*")
_CALLS = re.compile(r"(?:\\[A-Za-z@]+\*?(?:\{;?\})+\s*)+")
_SETTINGS = re.compile(r"(?:\\[A-Za-z@]+\*?(?:\[[^\]]*\]|\{;?\})+\s*)+")
_PATH = re.compile(r"\\[a-z]+\s*(?:\[[^\]]*\]\s*)?(?:at\s*)?\(|\\[a-z]+\s*\[[^\]]*$")


class _Frame:
    """An open environment or group: its name ('{' for a group), whether statements in it need semicolons, what it holds since
    the last one, whether it had a whole statement, and whether a picture without braces is open in it."""

    __slots__ = ("name", "drawing", "rest", "ended", "inline")

    def __init__(self, name: str, drawing: bool):
        self.name, self.drawing, self.rest, self.ended, self.inline = name, drawing, "", False, False

    def unfinished(self) -> bool:
        """Whether a statement is left without its semicolon. Commands with their arguments alone need none, nor does what ends
        in a group of whole statements. Outside of pictures only what is drawn like a path counts, or a command behind one."""
        rest = self.rest[_OPTIONS.match(self.rest).end() :].strip() if self.drawing else self.rest.strip()
        if not rest or rest.endswith("{;}"):
            return False
        if self.drawing:
            return not _CALLS.fullmatch(rest)
        return rest[0] == "\\" and not _SETTINGS.fullmatch(rest) and (self.ended or bool(_PATH.search(rest)))


def judge(code: str) -> tuple[str, bool]:
    """Why a TeX text is cut ('document', 'picture', 'group' or 'statement'; '' if nothing shows it), and whether it is bare: it
    opens nothing, so its structure can't tell, and its last sign isn't one that ends a text.

    Comments are blanked first. Environments and groups are followed on a stack. Where a picture, one of its environments or
    groups opens or ends, no statement may be left without its semicolon; nor at the end of a text of statements alone. Prose,
    settings and other environments need none. Text outside of everything is a remark.
    """
    text = _COMMENT.sub(r"\1", code)
    top = _Frame("", False)
    stack, why, classed, structured, at = [top], "", False, False, 0
    for m in _MARK.finditer(text):
        here = stack[-1]
        here.rest += text[at : m.start()]
        at = m.end()
        turn, name, command, sign = m.groups()
        if sign == ";":
            here.ended = here.ended or here.drawing or here.inline or here.name == "{" or bool(_PATH.search(here.rest))
            structured = structured or here.ended
            here.rest, here.inline = "", False
        elif sign == "{":
            picture = here.inline and not here.rest[_OPTIONS.match(here.rest).end() :].strip()
            here.inline = here.inline and not picture
            stack.append(_Frame("{", picture))
        elif sign == "}":
            if here.name == "{":
                if here.drawing and here.unfinished():
                    why = why or "statement"
                stack.pop()
                structured = structured or here.drawing
                stack[-1].rest = "" if here.drawing else stack[-1].rest + ("{;}" if here.ended else "{}")
        elif turn is None:
            if command == "tikz":
                here.inline, here.rest = True, ""
            else:
                classed = classed or command == "documentclass"
                here.rest += m[0]
        else:
            structured = True
            if (here.drawing or here is top) and here.unfinished():
                why = why or "statement"
            here.rest = ""
            if turn == "begin":
                classed = classed and name != "document"
                inside = here.drawing and here.name != "{" or name.endswith(("picture", "circuitikz"))
                stack.append(_Frame(name, inside))
            elif any(f.name == name for f in stack[1:]):
                while stack[-1].name != name:
                    why = why or ("group" if stack.pop().name == "{" else "picture")
                stack.pop()
    top.rest += text[at:] if len(stack) == 1 else ""
    if len(stack) > 1:
        return {"document": "document", "{": "group"}.get(stack[1].name, "picture"), False
    why = why or ("picture" if top.inline else "document" if classed else "statement" if top.unfinished() else "")
    return why, not why and not structured and text.strip()[-1:] not in TERMINAL


def left_open(code: str) -> str:
    """The first of what judge() says."""
    return judge(code)[0]


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for codes in batches:
        yield pd.DataFrame([judge(c) if c else ("", False) for c in codes], columns=["open", "bare"])


def scan(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, chars, bytes, open, bare): one row per distinct key. Null or empty text is whole, of length 0."""
    judged = F.pandas_udf(_scan, "open string, bare boolean")
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"), judged(F.col(text)).alias("j"))
    return rows.select("_k", "_s", "chars", "bytes", "j.*").dropDuplicates(["_k"]).withColumnsRenamed({"_k": key, "_s": source})


def spikes(scanned: DataFrame, source: str) -> DataFrame:
    """(source, unit, length, n, nearby, longest): lengths, in characters and in bytes, at which a source's values heap up.

    A length's count is held against the mean count of the lengths within NEARBY of it. `longest` says whether it is the source's
    greatest length; a limit that only some of its runs had shows below that. Histograms are summed before the shuffle; a window
    over (source, unit) sees one row per length, not per value.
    """
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    bars = scanned.filter("chars > 0").select(F.col(source), units.alias("u")).select(source, "u.*").groupBy(source, "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy(source, "unit")
    near = (F.sum("n").over(each.orderBy("length").rangeBetween(-NEARBY, NEARBY)) - F.col("n")) / (2.0 * NEARBY)
    beside = bars.withColumns({"nearby": near, "longest": F.col("length") == F.max("length").over(each)})
    return beside.filter((F.col("n") >= SPIKE_ROWS) & (F.col("n") >= SPIKE_TIMES * F.col("nearby")))


def detect(df: DataFrame, key: str = "row_id", source: str = "generator", text: str = "generated_code") -> DataFrame:
    """(key, source, chars, bytes, open, at_spike, cut, cause) of each distinct record.

    Terminal punctuation of code is that everything opened is closed and the last statement ended; `open` says what isn't. Such
    values are cut at any length. Those that open nothing, so that only their last sign can be looked at, are cut if that ends
    no text and their length lies on one of their source's spikes (`open` is 'text'). A cut value on a spike hit a field limit
    ('field_limit'), the others broke off on the way ('transfer'). A value with its terminal punctuation is never flagged for
    its length alone. Null sources are a source of their own. Empty tables give no rows.
    """
    found = cut(scan(df, key, source, text))  # no texts, just their lengths and what is open
    at = spikes(found, source)
    sides = {u: at.filter(F.col("unit") == u).select(F.col(source).alias(f"_{u}_s"), F.col("length").alias(f"_{u}"), F.lit(True).alias(f"_{u}_hit")) for u in ("chars", "bytes")}
    out = found.filter("open <> '' or bare")
    for u, side in sides.items():
        out = out.join(side, F.col(source).eqNullSafe(F.col(f"_{u}_s")) & (F.col(u) == F.col(f"_{u}")), "left")
    spiked = F.coalesce("_chars_hit", F.lit(False)) | F.coalesce("_bytes_hit", F.lit(False))
    why = F.when(F.col("bare") & spiked, "text").otherwise(F.col("open"))
    asked = out.select(key, source, "chars", "bytes", why.alias("open"), spiked.alias("at_spike"), (why != "").alias("cut"))
    broken = asked.withColumn("cause", F.when(F.col("cut"), F.when(F.col("at_spike"), "field_limit").otherwise("transfer")))
    whole = found.filter("open = '' and not bare").select(key, source, "chars", "bytes", "open", F.lit(False).alias("at_spike"), F.lit(False).alias("cut"), F.lit(None).cast("string").alias("cause"))
    return broken.unionByName(whole)


def rates(detected: DataFrame, source: str) -> DataFrame:
    """Per source: its distinct records, those cut, their share, and how many of them lie at a length spike."""
    return detected.groupBy(source).agg(F.count(F.lit(1)).alias("records"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"), F.count_if(F.col("cause") == "field_limit").alias("at_limit"))
