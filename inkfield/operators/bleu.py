"""Corpus n-gram precision without trivially shared n-grams: per pair, over a corpus, and running along an order.

Both texts of a pair stand in one row, so they are counted and clipped there, in Arrow batches, and a pair becomes ten numbers.
Only counts over a whole corpus are shuffled, summed by task first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.plans.order import running

#: Highest order of n-grams, number of trivially shared ones that are left out.
ORDER, TRIVIAL = 4, 500
#: Different n-grams that a task holds before it passes their counts on.
HELD = 500_000
#: Texts whose n-grams are numbered together.
AT_ONCE = 2_000
#: Stands between the tokens of an n-gram that is kept as text.
JOINT = "\x1f"
ORDERS = range(1, ORDER + 1)
_COUNTS = [f"{c}{n}" for n in ORDERS for c in "mt"]
PAIR_COUNTS = ", ".join(f"{c} bigint" for c in ("hyp", "ref", *_COUNTS))

Tokenizer = Callable[[str], list[str]]


def blank_split(text: str) -> list[str]:
    """Tokens of a text whose white space is single blanks."""
    return text.split(" ") if text else []


def grams_of(tokens: list[str], n: int) -> Iterable[tuple[str, ...]]:
    return zip(*(tokens[i:] for i in range(n)), strict=False)


def _numbered(texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order: n, and the text, the place among all tokens and the number of each n-gram, equal for equal ones; the place of the first of each number."""
    lengths = np.array([len(t) for t in texts], np.int64)
    token = pd.factorize(np.array([x for t in texts for x in t], dtype=object))[0].astype(np.int64)
    text, number, different = np.repeat(np.arange(len(texts)), lengths), token, int(token.max(initial=-1)) + 1
    place = np.arange(len(token))
    for n in ORDERS:
        if n > 1:
            inside = place + n - 1 < len(token)
            inside[inside] = text[place[inside] + n - 1] == text[place[inside]]
            place, number = place[inside], number[inside]
            number = pd.factorize(number * different + token[place + n - 1])[0].astype(np.int64)
        first = np.empty(int(number.max(initial=-1)) + 1, np.int64)
        first[number[::-1]] = place[::-1]
        yield n, text[place], place, number, first


def corpus_grams(texts: DataFrame, text: Column, tokenize: Tokenizer = blank_split, joint: str = JOINT) -> DataFrame:
    """(n, gram, total): how often a corpus has each n-gram of the ORDERS. Null texts have none."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, str], int] = {}

        def done() -> pd.DataFrame:
            out = pd.DataFrame([(n, g, total) for (n, g), total in held.items()], columns=["n", "gram", "total"])
            held.clear()
            return out

        for pdf in frames:
            for at in range(0, len(pdf), AT_ONCE):
                some = [tokenize(t) for t in pdf["t"].iloc[at : at + AT_ONCE] if t]
                every = [x for t in some for x in t]
                for n, _, _, number, first in _numbered(some):
                    for p, total in zip(first.tolist(), np.bincount(number).tolist(), strict=True):
                        key = (n, joint.join(every[p : p + n]))
                        held[key] = held.get(key, 0) + total
                if len(held) > HELD:
                    yield done()
        yield done()

    return texts.select(text.alias("t")).mapInPandas(batches, "n int, gram string, total bigint").groupBy("n", "gram").agg(F.sum("total").alias("total"))


def trivial(corpus: DataFrame, k: int = TRIVIAL) -> DataFrame:
    """(n, gram, total): the k most frequent n-grams of a corpus; ties in the grams' order. k rows."""
    return corpus.orderBy(F.desc("total"), "n", "gram").limit(k)


def shared_grams(frequent: DataFrame, joint: str = JOINT) -> frozenset[tuple[str, ...]]:
    """The rows of trivial() on the driver, as token tuples: `k` of them."""
    return frozenset(tuple(r["gram"].split(joint)) for r in frequent.select("gram").collect())


def pair_counts_many(hypotheses: list[list[str]], references: list[list[str]], shared: frozenset = frozenset()) -> pd.DataFrame:
    """The numbers of pair_counts for pairs of token lists, the n-grams of AT_ONCE pairs counted together."""
    parts = [_pair_counts(hypotheses[at : at + AT_ONCE], references[at : at + AT_ONCE], shared) for at in range(0, max(len(hypotheses), 1), AT_ONCE)]
    return pd.concat(parts, ignore_index=True)


def _pair_counts(hypotheses: list[list[str]], references: list[list[str]], shared: frozenset) -> pd.DataFrame:
    pairs, known = len(hypotheses), list(shared)
    out = {"hyp": [len(t) for t in hypotheses], "ref": [len(t) for t in references]}
    for n, text, _, number, first in _numbered([*hypotheses, *references, *map(list, known)]):
        plain = np.ones(len(first), bool)
        fits = np.array([len(g) == n for g in known], bool)
        is_known = text >= 2 * pairs
        plain[number[is_known][fits[text[is_known] - 2 * pairs]]] = False
        asked = ~is_known & plain[number]
        text, number = text[asked], number[asked]
        key, different = pd.factorize(text % max(pairs, 1) * len(first) + number)
        ours = text < pairs
        have, found = (np.bincount(key[side], minlength=len(different)) for side in (ours, ~ours))
        pair = different // max(len(first), 1)
        out[f"m{n}"], out[f"t{n}"] = (np.bincount(pair, c, pairs).astype(np.int64)[:pairs] for c in (np.minimum(have, found), have))
    return pd.DataFrame(out, columns=["hyp", "ref", *_COUNTS], dtype="int64")


def pair_counts(hypothesis: Column, reference: Column, shared: frozenset = frozenset(), tokenize: Tokenizer = blank_split) -> Column:
    """Struct of hyp and ref, the tokens of either text, and of m1, t1, ... m4, t4: by order, the hypothesis n-grams found in the
    reference, each at most as often as there, and all of them. n-grams in `shared` are left out. Null texts have no tokens."""
    def batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sides in pairs:
            yield pair_counts_many(*([tokenize(t) if t else [] for t in side] for side in sides), shared)

    return F.pandas_udf(batches, PAIR_COUNTS)(hypothesis, reference)


def by_order(pairs: DataFrame, key: str) -> DataFrame:
    """(key, n, matched, total) of rows with the counts of pair_counts; an order without n-grams has no row."""
    each = F.explode(F.array(*(F.struct(F.lit(n).cast("bigint").alias("n"), F.col(f"m{n}").alias("matched"), F.col(f"t{n}").alias("total")) for n in ORDERS)))
    return pairs.select(key, each.alias("_o")).select(key, "_o.*").filter("total > 0")


def precision_product(matched: list[Column], total: list[Column], hypothesis: Column, reference: Column) -> Column:
    """BLEU of summed counts: geometric mean of the precisions times the brevity penalty; 0 if an order has no match."""
    some = F.lit(True)
    logs = F.lit(0.0)
    for m, t in zip(matched, total, strict=True):
        some = some & (F.coalesce(m, F.lit(0)) > 0)
        logs = logs + F.log(m / t) / len(matched)
    brevity = F.when(hypothesis > reference, 1.0).otherwise(F.exp(1 - reference / hypothesis))
    return F.when(some, brevity * F.exp(logs)).otherwise(0.0)


def _bleu(prefix: str = "") -> Column:
    of = lambda c: F.col(f"{prefix}{c}")
    return precision_product([of(f"m{n}") for n in ORDERS], [of(f"t{n}") for n in ORDERS], of("hyp"), of("ref"))


def pair_bleu(pairs: DataFrame) -> DataFrame:
    """Each pair with its own BLEU."""
    return pairs.withColumn("bleu", _bleu())


def corpus_bleu(pairs: DataFrame, group: list[str]) -> DataFrame:
    """BLEU of each group of pairs, from sums over its pairs."""
    return pair_bleu(pairs.groupBy(*group).agg(*(F.sum(c).alias(c) for c in ("hyp", "ref", *_COUNTS))))


def running_bleu(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """Each pair with the BLEU of all pairs up to it in the order."""
    return running(pairs, order, {f"r_{c}": F.col(c) for c in ("hyp", "ref", *_COUNTS)}).withColumn("bleu", _bleu("r_"))


class RunningBleu:
    """The measure as an accumulator on the driver: update() with pairs, compute() over all since reset(), per_row() without
    touching the state. What is held is ten sums."""

    def __init__(self, shared: frozenset = frozenset(), tokenize: Tokenizer = blank_split):
        self.shared, self.tokenize = shared, tokenize
        self.reset()

    def reset(self) -> None:
        self.sums = dict.fromkeys(("hyp", "ref", *_COUNTS), 0)

    def counted(self, pairs: DataFrame, hypothesis: str, reference: str) -> DataFrame:
        return pairs.withColumn("_b", pair_counts(F.col(hypothesis), F.col(reference), self.shared, self.tokenize)).select(*pairs.columns, "_b.*")

    def per_row(self, pairs: DataFrame, hypothesis: str, reference: str) -> DataFrame:
        return pair_bleu(self.counted(pairs, hypothesis, reference)).select(*pairs.columns, "bleu")

    def update(self, pairs: DataFrame, hypothesis: str, reference: str) -> None:
        new = self.counted(pairs, hypothesis, reference).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.sums)).first()
        self.sums = {c: n + new[c] for c, n in self.sums.items()}

    def compute(self, spark) -> float:
        row = spark.createDataFrame([tuple(self.sums.values())], ", ".join(f"{c} bigint" for c in self.sums))
        return pair_bleu(row).first()["bleu"]
