"""Scores of a pair of programs: overlap of feature sets, weights that missing features pass on, the final blend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfield.functions.text import FEATURES, clean_code

#: Weights of the overall similarity and of the custom score.
OVERALL = {"command": 0.25, "coordinate": 0.25, "style": 0.15, "sequence": 0.05, "edge": 0.30}
CUSTOM = {"command": 0.10, "coordinate": 0.10, "style": 0.05, "sequence": 0.05, "edge": 0.10}
BLEU, TED, TED_SCALE = 0.35, 0.25, 100.0
IMAGE, CODE = 0.7, 0.3


@dataclass(frozen=True)
class Weights:
    """Weights by feature; they must sum to 1."""

    values: dict[str, float]

    def __post_init__(self):
        if abs(sum(self.values.values()) - 1) > 1e-6:
            raise ValueError("weights must sum to 1")


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the size of the larger set; null if both are empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most)


def with_overlaps(rows: DataFrame, original: str, generated: str) -> DataFrame:
    """rows with the overlap of each feature set of two codes, null where neither has any.

    Cleaned codes and sets are columns of steps of their own, so that each is worked out once for all that use it.
    """
    return with_clean_overlaps(rows.withColumns({"_a": clean_code(F.col(original)), "_b": clean_code(F.col(generated))}), "_a", "_b").select(*rows.columns, *FEATURES)


def with_clean_overlaps(rows: DataFrame, original: str, generated: str) -> DataFrame:
    """with_overlaps of two codes that are cleaned already."""
    out = rows.withColumns({"_a": F.col(original), "_b": F.col(generated)})
    out = out.withColumns({f"_{name}{side}": f(F.col(side)) for name, f in FEATURES.items() for side in ("_a", "_b")})
    return out.withColumns({name: overlap(F.col(f"_{name}_a"), F.col(f"_{name}_b")) for name in FEATURES}).select(*rows.columns, *FEATURES)


def redistributed(scores: dict[str, Column], weights: dict[str, float]) -> dict[str, Column]:
    """Weights in effect: those of null scores are split equally over the others and become 0."""
    lost = sum((F.when(scores[k].isNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    present = sum((F.when(scores[k].isNotNull(), 1).otherwise(0) for k in weights), F.lit(0))
    return {k: F.when(scores[k].isNull(), 0.0).otherwise(F.lit(w) + lost / F.greatest(present, F.lit(1))) for k, w in weights.items()}


def blended(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    return sum((F.coalesce(scores[k], F.lit(0.0)) * w for k, w in redistributed(scores, weights).items()), F.lit(0.0))


def final_score(custom: Column, bleu: Column, ted: Column, scale: float = TED_SCALE) -> Column:
    """custom + .35 BLEU + .25 (1 - min(TED/scale, 1))."""
    return custom + BLEU * bleu + TED * (1 - F.least(ted / scale, F.lit(1.0)))


def difficulty(image: Column, code: Column) -> Column:
    """.7 image + .3 code of two dissimilarities. Null and NaN count as 1, values over 1 as 1; negative ones stay."""
    def ready(c: Column) -> Column:
        c = c.cast("double")
        return F.least(F.coalesce(F.when(~F.isnan(c), c), F.lit(1.0)), F.lit(1.0))

    return IMAGE * ready(image) + CODE * ready(code)
