"""Repeated passages inside one document: an exact measure, cheap statistics, and decision lists learned between them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.functions.text import WS

#: A passage counts from so many non-blank characters on.
PASSAGE = 40
#: Rows with the lowest hash of their key that the decision list is learned from; the bound of what reaches the driver.
SAMPLE_ROWS = 3000
#: Characters of the blocks that a text is probed with; one starts at every so many that each passage holds a whole one.
BLOCK = 12
STRIDE = PASSAGE - BLOCK + 1
#: Texts of more non-blank characters aren't cut into blocks, whose look-up grows with the square of the length; they are measured.
BLOCK_CHARS = 20_000
STATISTICS = ("reach", "statement_dup", "chars")
#: Documents are measured together up to so many characters, to bound a worker's memory.
CHUNK = 60_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mixed 64-bit values of all characters of the texts, and the number of the text each belongs to."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = (flat + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _windows(x: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of `length` characters; windows are put together from ones of powers of two."""
    if len(x) < length:
        return np.zeros(0, np.uint64)
    n, total, done, at = len(x) - length + 1, np.zeros(len(x) - length + 1, np.uint64), 0, x
    width = 1
    while width <= length:
        if length & width:
            total = total * np.uint64(pow(_BASE, width, 2**64)) + at[done : done + n]
            done += width
        at = at[: len(at) - width] * np.uint64(pow(_BASE, width, 2**64)) + at[width:] if len(at) > width else at
        width *= 2
    return total


def _pairs(keyed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key stood before in `keyed`, and the first position of that key; by the keys' upper 64-bits bits."""
    mask = np.uint64((1 << bits) - 1)
    order = np.sort((keyed & ~mask) | np.arange(len(keyed), dtype=np.uint64))
    place, key = (order & mask).astype(np.int64), order >> np.uint64(bits)
    same = np.zeros(len(order), bool)
    same[1:] = key[1:] == key[:-1]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return place[same], place[first[same]]


def _covered(bare: list[str], length: int) -> np.ndarray:
    """Characters of each text that lie in windows of `length` that already began earlier in it."""
    x, doc = _codes(bare)
    h = _windows(x, length)
    n = len(h)
    if not n:
        return np.zeros(len(bare))
    place = np.flatnonzero(doc[:n] == doc[length - 1 : length - 1 + n])
    keyed = (h * _MIX ^ (doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))[place]
    late, early = _pairs(keyed, max(1, int(len(keyed)).bit_length()))
    late, early = place[late], place[early]
    equal = doc[late] == doc[early]
    for j in range(length):
        equal &= x[late + j] == x[early + j]
    if not equal.all():  # windows that share upper bits: by the whole 64
        order = np.argsort(keyed, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = keyed[order][1:] == keyed[order][:-1]
        late = place[order[same]]
    edge = np.bincount(late, minlength=len(x) + 1) - np.bincount(late + length, minlength=len(x) + 1)
    return np.bincount(doc, np.cumsum(edge[: len(x)]) > 0, minlength=len(bare))


def _chunks(texts: Sequence[str | None], least: int) -> Iterator[tuple[list[int], list[str]]]:
    """Texts without their blanks, those longer than `least`, a few at a time."""
    group: list[int] = []
    bare: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        t = "".join(text.split()) if text else ""
        if len(t) <= least:
            continue
        if held and held + len(t) > CHUNK:
            yield group, bare
            group, bare, held = [], [], 0
        group.append(i)
        bare.append(t)
        held += len(t)
    if group:
        yield group, bare


def repeated_shares(texts: Sequence[str | None], passage: int = PASSAGE) -> list[float]:
    """Share of the non-blank characters of each text that lie in passages of at least `passage` of them that already began
    earlier in it. Overlap counts. Null, empty and shorter texts have 0."""
    out = np.zeros(len(texts))
    for group, bare in _chunks(texts, passage):
        out[group] = _covered(bare, passage) / [len(t) for t in bare]
    return out.tolist()


def _share_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(repeated_shares(texts.tolist()))


def share(text: Column) -> Column:
    return F.pandas_udf(_share_batches, "double")(text)


def without_blanks(text: str) -> Column:
    """The text without white space; of plain ASCII by replacements of fixed signs, which cost less than a pattern."""
    plain = F.col(text)
    for blank in " \n\r\t\x0b\x0c\x1c\x1d\x1e\x1f":
        plain = F.replace(plain, F.lit(blank), F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.regexp_replace(text, f"{WS}+", ""))


def with_statistics(df: DataFrame, text: str, name: str, only: Sequence[str] = STATISTICS) -> DataFrame:
    """df with the struct `name` of STATISTICS of a text (`only` those named), blanks left out, by built-in expressions. Null
    texts have null ones.

    reach: an upper bound of the repeated share. Of the blocks at every STRIDE characters, r stand somewhere before their own
    place too. A repeated passage, at whatever place, holds a whole block, which then stood in the earlier one; so only passages
    around the r are repeated, and these cover at most two passages less a block for each. Texts over BLOCK_CHARS have a reach
    above any share.
    statement_dup: share of the characters in statements seen before. chars: the length.

    Two generators of one row each, so that what is built on their output doesn't evaluate the expressions again.
    """
    bare = df.withColumn("_b", F.explode(F.array(without_blanks(text))))
    n = F.length("_b")
    blocks = F.when(n <= BLOCK_CHARS, F.regexp_extract_all("_b", F.lit(f"(?s)(.{{{BLOCK}}}).{{0,{STRIDE - BLOCK}}}"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    again = F.size(F.filter(blocks, lambda block, i: F.position(block, F.col("_b")) <= i * STRIDE))
    reach = F.when(n > BLOCK_CHARS, 2.0).otherwise(again * float(2 * PASSAGE - BLOCK) / F.greatest(n, F.lit(1)))
    once = F.aggregate(F.array_distinct(F.split("_b", ";")), F.lit(0), lambda total, part: total + F.length(part))
    parts = F.size(F.split("_b", ";"))
    dup = F.when(n - parts + 1 > 0, 1 - once / (n - parts + 1)).otherwise(0.0)
    built = {"reach": reach, "statement_dup": dup, "chars": n.cast("double")}
    return bare.withColumn(name, F.explode(F.array(F.struct(*(built[s].alias(s) for s in only))))).drop("_b")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, 'le' or 'gt', threshold)."""

    terms: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        hit = np.ones(n, bool)
        for name, side, bound in self.terms:
            hit &= x[name] <= bound if side == "le" else x[name] > bound
        return hit

    def column(self, of: dict[str, Column]) -> Column:
        hit = F.lit(True)
        for name, side, bound in self.terms:
            hit = hit & (of[name] <= F.lit(bound) if side == "le" else of[name] > F.lit(bound))
        return hit


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """Adds the term of highest FOIL gain until no negative is covered or nothing is gained. Thresholds lie halfway."""
    terms: list[tuple[str, str, float]] = []
    hit = np.ones(len(y), bool)
    while hit.any() and not y[hit].all():
        p, n = y[hit].sum(), (~y[hit]).sum()
        now, best = np.log2(p / (p + n)) if p else -30.0, (1e-9, None)
        for name, values in x.items():
            order = np.argsort(values[hit], kind="stable")
            v, pos = values[hit][order], np.cumsum(y[hit][order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            for side, good, size in (("le", pos[cuts], cuts + 1), ("gt", p - pos[cuts], len(v) - cuts - 1)):
                gain = good * (np.log2(np.maximum(good, 1e-9) / size) - now)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (name, side, float((v[cuts[i]] + v[cuts[i] + 1]) / 2)))
        if best[1] is None:
            break
        terms.append(best[1])
        hit = Rule(tuple(terms)).covers(x, len(y))
    return Rule(tuple(terms))


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """Drops final terms as long as (covered positives - negatives) / covered doesn't fall on rows the rule wasn't grown on."""
    def worth(r: Rule) -> float:
        hit = r.covers(x, len(y))
        return (y[hit].sum() - (~y[hit]).sum()) / hit.sum() if hit.any() else -1.0

    while len(rule.terms) > 1 and worth(Rule(rule.terms[:-1])) >= worth(rule):
        rule = Rule(rule.terms[:-1])
    return rule


def learn(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 0, most: int = 12) -> list[Rule]:
    """Ordered rules for the class y by sequential covering: each is grown on two thirds of the rows that are left, pruned on
    the rest, and kept if it covers no row of the other class; the rows it covers are then set aside. At most `most` rules: what
    they leave is measured."""
    rng, rules = np.random.default_rng(seed), []
    left = np.arange(len(y))
    while len(rules) < most and len(left) and y[left].any():
        part = rng.random(len(left)) < 2 / 3
        sub = lambda i: ({k: v[i] for k, v in x.items()}, y[i])
        grown = _grow(*sub(left[part]))
        pruned = _prune(grown, *sub(left[~part]))
        kept = next((r for r in (pruned, grown) if r.terms and not (r.covers(x, len(y)) & ~y).any()), None)
        if kept is None:
            break
        hit = kept.covers({k: v[left] for k, v in x.items()}, len(left))
        if not (hit & y[left]).any():
            break
        rules.append(kept)
        left = left[~hit]
    return rules


def learn_plain(df: DataFrame, key: str, text: str, limit: float, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules under which a document is plain (repeated share at most `limit`), learned from the sample_rows rows whose keys
    have the lowest hashes, labelled by the exact measure. A sample with one class only gives no rules.

    Each rule gets the term reach <= limit, or keeps a tighter one: as reach is never below the repeated share, no rule can set
    a repeated document aside, whatever the sample missed.
    """
    picked = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).orderBy(F.xxhash64(key, F.lit(11)), key).limit(sample_rows).select(F.col(text).alias("t"))
    rows = with_statistics(picked.repartition(max(1, min(8, sample_rows // 200))), "t", "x").select("x.*", share(F.col("t")).alias("y")).toPandas().sort_values([*STATISTICS, "y"])
    y = rows["y"].to_numpy() <= limit
    if y.all() or not y.any():
        return []
    found = learn({s: rows[s].to_numpy() for s in STATISTICS}, y)
    return [Rule((*(t for t in r.terms if t[:2] != ("reach", "le")), ("reach", "le", min([limit, *(t[2] for t in r.terms if t[:2] == ("reach", "le"))])))) for r in found]


def repeated(df: DataFrame, key: str = "row_id", text: str = "generated_code", limit: float = 0.5, rules: list[Rule] | None = None) -> DataFrame:
    """(key, rule, share) of the distinct records whose repeated share is over `limit`.

    An ordered decision list over the STATISTICS (learned by learn_plain unless given) sets the plain documents aside:
    `when(rule 1) ... when(rule n)`; all others are measured exactly. Null and empty texts are plain, null keys are dropped,
    rows repeated under one key count once. Without rules (one class in the sample, an empty table) every row is measured.
    """
    rules = learn_plain(df, key, text, limit) if rules is None else rules
    rows = df.filter(F.col(key).isNotNull() & (F.length(text) > PASSAGE)).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    if rules:
        used = sorted({name for r in rules for name, _, _ in r.terms})
        rows = with_statistics(rows, "_t", "_x", used)
        of = {s: F.col(f"_x.{s}") for s in used}
        plain = F.when(rules[0].column(of), F.lit(1))
        for i, rule in enumerate(rules[1:], 2):
            plain = plain.when(rule.column(of), F.lit(i))
        rows = rows.filter(plain.otherwise(0) == 0)
    return rows.select("_k", share(F.col("_t")).alias("share")).filter(F.col("share") > limit).dropDuplicates(["_k"]).select(F.col("_k").alias(key), F.round("share", 6).alias("share"))


def shares(df: DataFrame, key: str = "row_id", text: str = "generated_code") -> DataFrame:
    """(key, share): the exact repeated share of every distinct record, rounded to 6 digits; 0 for null and empty texts."""
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.round(share(F.col(text)), 6).alias("share")).dropDuplicates(["_k"]).withColumnRenamed("_k", key)
