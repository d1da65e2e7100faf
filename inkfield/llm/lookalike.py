"""One form for texts that look the same: folding, then look-alike letters resolved by Viterbi over each token's lattice."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfield.plans.shared import cut
from inkfield.plans.skew import PAIR_BLOCK, pairs_within, salted_join

#: Letters of other scripts, and small capitals, that look like the Latin letter named first, upper and lower case
#: apart. Of what Unicode's table of confusable characters (UTS #39) puts together, those whose shapes are the same; a test
#: holds this table against the one in the ICU library that comes with Spark.
LOOKALIKES = {
    "a": "аɑ", "c": "сϲᴄꮯ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏ", "p": "рρ",
    "q": "ԛ", "s": "ѕꜱꮪ", "u": "սᴜ", "v": "ѵνᴠꮩ", "w": "ԝᴡꮃ", "x": "х", "y": "уү", "z": "ᴢꮓ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "Ꮮ",
    "M": "МΜϺᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ",
    "Y": "УΥҮ", "Z": "ΖᏃ",
}
#: Compatibility tags under which a character looks like its decomposition; superscripts, fractions and
#: circled characters don't.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")
#: Characters that show nothing though their category isn't Cf; format characters that do show.
IGNORABLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u180b\u180c\u180d\u180f" + "".join(map(chr, range(0xFE00, 0xFE10)))
SHOWN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u08e2"
HYPHENS = "\u2010\u2011"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
#: Log score of passing from one script to another inside a token.
SWITCH = -40.0
#: Tokens kept in a worker's memory with their form.
CACHE = 200_000

_REP = {x: latin for latin, others in LOOKALIKES.items() for x in others}
#: A plain ASCII token of other letters than these is held to Latin; so are such tokens in any other text.
_OPEN_ASCII = re.compile(rf"(?<![A-Za-z])[{''.join(LOOKALIKES)}]+(?![A-Za-z])")


@cache
def script(ch: str) -> str:
    """The one of the SCRIPTS that a letter belongs to, '' for other characters."""
    name = unicodedata.name(ch, "").partition(" ")[0]
    return name if name in SCRIPTS and unicodedata.category(ch)[0] == "L" else ""


#: The letters a look may stand for: the Latin one and those of other scripts. Latin variants are never chosen.
_CLASS = {latin: latin + "".join(x for x in others if script(x) != "LATIN") for latin, others in LOOKALIKES.items()}
#: A token: letters of the SCRIPTS in a row. All of their letters but some historic ones lie below U+3000 and around U+A640.
_TOKEN = re.compile("[" + "".join(c for c in map(chr, (*range(0x3000), *range(0xA640, 0xAC00))) if script(c)) + "]+")


class _Fold(dict):
    """Character -> what it looks like, filled on first use."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch in IGNORABLE or 0xE0100 <= code <= 0xE01EF or (kind == "Cf" and ch not in SHOWN):
            out = ""
        elif kind == "Zs":
            out = " "
        elif ch in _REP:
            out = ch  # though its compatibility form may look different
        elif ch in HYPHENS:
            out = "-"
        else:
            tag = unicodedata.decomposition(ch).partition(" ")[0]
            out = ch
            if tag in SAME_LOOK:
                out = unicodedata.normalize("NFKD", ch)
                if out != ch:
                    out = out.translate(self)
        self[code] = out
        return out


_FOLD = _Fold()


def _odd() -> re.Pattern:
    """Decomposed characters that have another look: those of the first plane by the rule above, and all beyond it."""
    odd = [c for c in range(128, 0x10000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4 and not 0x4E00 <= c < 0xA000 and _FOLD[c] != chr(c)]
    return re.compile("[" + "".join(re.escape(chr(c)) for c in odd) + "\U00010000-\U0010ffff]")


_ODD = _odd()


def fold(text: str) -> str:
    """Decomposed text without ignorable characters: widths, ligatures, hyphens, spaces and line ends in one form."""
    if not text.isascii():
        text, n = _ODD.subn(lambda m: _FOLD[ord(m[0])], unicodedata.normalize("NFD", text))
        if n:
            text = unicodedata.normalize("NFD", text)
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def bigrams(texts: Iterator[str | None]) -> Counter:
    """Counts of (previous, next) letters in the tokens of one script; '' stands for a token's edge, then the script follows."""
    tokens: Counter = Counter()
    for text in texts:
        if text:
            tokens.update(_TOKEN.findall(fold(text)))
    out: Counter = Counter()
    for token, n in tokens.items():
        found = {script(c) for c in token}
        if len(found) == 1 and (of := found.pop()):
            chars = ["^" + of, *token, "$" + of]
            for pair in zip(chars, chars[1:], strict=False):
                out[pair] += n
    return out


def _bigram_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    for pdf in batches:
        total.update(bigrams(pdf["_t"]))
    yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["a", "b", "n"])


def letter_counts(df: DataFrame, text: str) -> dict[tuple[str, str], int]:
    """Bigram counts over all texts. One row per pair of letters of one of the SCRIPTS and their edges: under 1,000,000 pairs."""
    counts = df.select(F.col(text).alias("_t")).filter("_t is not null and _t <> ''").mapInPandas(_bigram_batches, "a string, b string, n bigint")
    return {(r["a"], r["b"]): r["n"] for r in counts.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


class Speller:
    """Chooses the letters of a token. Its choice depends on how the token looks only, so equal looks give equal spellings."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.totals: Counter = Counter()
        for (a, _), n in counts.items():
            self.totals[a] += n
        self.counts = counts
        self.starts = {s: self.totals["^" + s] for s in SCRIPTS}
        self.known: dict[str, str] = {}

    def step(self, a: str, b: str) -> float:
        return math.log((self.counts.get((a, b), 0) + 0.05) / (self.totals.get(a, 0) + 10.0))

    def viterbi(self, look: str) -> str:
        """The best path through the lattice of all letters that look like those of `look` (Latin where there is a choice).

        If the letters of `look` that look like no other are of one script, so are the others wherever that script has them. Held
        to Latin, `look` stays as it is, as in a plain ASCII text.
        """
        sure = {of for ch in look if ch not in _CLASS and (of := script(ch))}
        held = sure.pop() if len(sure) == 1 else ""
        if held == "LATIN":
            return look
        paths: dict[tuple[str, str], tuple[float, str]] = {}
        every = sum(self.starts.values()) + len(SCRIPTS)
        for i, ch in enumerate(look):
            after: dict[tuple[str, str], tuple[float, str]] = {}
            options = _CLASS.get(ch, ch)
            for option in [o for o in options if held and script(o) == held] or options:
                of = script(option)
                if i == 0:
                    begin = math.log((self.starts.get(of, 0) + 1) / every)
                    ways = [(begin + self.step("^" + of, option), option)]
                else:
                    ways = []
                    for (last, kind), (score, done) in paths.items():
                        to = of or kind
                        here = self.step(last, option) if to == kind or not kind else SWITCH + self.step("^" + of, option)
                        ways.append((score + here, done + option))
                top = max(ways, key=lambda w: (w[0], w[1]))
                kind = of or (next(iter(paths))[1] if paths else "")
                if (option, kind) not in after or top > after[(option, kind)]:
                    after[(option, kind)] = top
            paths = after
        return max(((s + self.step(last, "$" + kind) if kind else s, done) for (last, kind), (s, done) in paths.items()), key=lambda w: (w[0], w[1]))[1]

    def token(self, m: re.Match) -> str:
        word = m[0]
        out = self.known.get(word)
        if out is None:
            look = "".join(_REP.get(c, c) for c in word)
            out = self.viterbi(look) if any(c in _CLASS for c in look) else look
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = out
        return out

    def text(self, text: str | None) -> str | None:
        """The one form of a text; null stays null."""
        if not text:
            return text
        flat = fold(text)
        if flat.isascii():
            return _OPEN_ASCII.sub(self.token, flat)
        return unicodedata.normalize("NFC", _TOKEN.sub(self.token, flat))


def one_form(counts: dict[tuple[str, str], int]):
    """Column function text -> its one form, under the given letter counts."""
    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        speller = Speller(counts)
        for batch in texts:
            yield pd.Series([speller.text(t) for t in batch], dtype=object)

    return F.pandas_udf(batches, "string")


def normalise(df: DataFrame, text: str, out: str, counts: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """df with the column `out`: the one form of `text`. Letter counts are taken over all rows unless given."""
    return df.withColumn(out, one_form(letter_counts(df, text) if counts is None else counts)(F.col(text)))


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, f, t): fingerprints, of 256 bits, of the form and of the characters of each text of which something shows."""
    rows = normalise(df.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_t", "_f").filter("_f <> ''")
    return cut(rows.select("_k", F.unhex(F.sha2("_f", 256)).alias("f"), F.unhex(F.sha2("_t", 256)).alias("t")))  # forms are found once


def same_look(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: rows whose texts have one form but not the same characters.

    Null and empty texts, and those of which nothing shows, are in no pair. Spellings of a form are paired first (one row each,
    however many copies they have), then joined to their rows, so that copies among themselves are never compared.
    """
    return pairs_of_variants(_marked(df, key, text))


def pairs_of_variants(marked: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(_k, f, t) -> all pairs of keys with equal f and unequal t.

    The keys of a spelling are cut into blocks of about `block` by hash, and spellings are paired block by block, so a spelling
    or a form of any number of keys is spread over tasks.
    """
    forms = marked.groupBy("f").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("_n"))
    held = cut(salted_join(marked, forms.filter("a <> b").select("f"), "f", F.xxhash64("_k"), counts=forms))  # only these are looked at further
    shown = held.groupBy("f", "t").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    couples = pairs_within(shown.select("f", F.struct("t", "n").alias("s")), "f", "s")
    blocks = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}.n") - 1))
    couples = couples.select(F.col("a.t").alias("ta"), F.col("b.t").alias("tb"), blocks("a").alias("ba"), "b").select("ta", "tb", "ba", blocks("b").alias("bb"))
    own = held.join(shown.select("t", "n"), "t").select("t", "_k", F.pmod(F.xxhash64("_k"), F.col("n")).cast("int").alias("_b"))
    first = couples.join(own.select(F.col("t").alias("ta"), F.col("_b").alias("ba"), F.col("_k").alias("x")), ["ta", "ba"])
    both = first.join(own.select(F.col("t").alias("tb"), F.col("_b").alias("bb"), F.col("_k").alias("y")), ["tb", "bb"]).filter("x <> y")
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def look_sets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, first, spellings, members) of each row whose look has several spellings: the lowest key of the set, how many
    spellings and how many rows it has. One row per row, whatever the number of pairs."""
    marked = _marked(df, key, text).distinct()
    sets = marked.groupBy("f", "t").agg(F.min("_k").alias("k"), F.count(F.lit(1)).alias("n")).groupBy("f").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("_n"))
    of = salted_join(marked.select("_k", "f"), sets.filter("spellings > 1").withColumn("members", F.col("_n")).drop("_n"), "f", F.xxhash64("_k"), counts=sets)
    return of.select(F.col("_k").alias(key), "first", "spellings", "members")
