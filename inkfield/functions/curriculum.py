"""Curriculum thresholds and training rows: schedules, label masks, padding, checkpoints."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label that is ignored in training, and the most ids of a text that the described model takes.
IGNORED, MODEL_LIMIT = -100, 2048


def root_p(epoch: Column, grow: float, start: float, p: float) -> Column:
    """min(1, (t (1 - start^p) / grow + start^p)^(1/p))"""
    return F.least(F.lit(1.0), F.pow(epoch * ((1 - start**p) / grow) + start**p, F.lit(1 / p)))


def linear(epoch: Column, grow: float, start: float) -> Column:
    return F.least(F.lit(1.0), F.lit(start) + epoch * ((1 - start) / grow))


def geometric(epoch: Column, grow: float, start: float) -> Column:
    """Grows by a constant factor; the factor is taken from log2(1 - log2(start)), so 1 is reached only after `grow`."""
    low = math.log2(start)
    return F.least(F.lit(1.0), F.pow(F.lit(2.0), epoch * (math.log2(1 - low) / grow) + low))


def geometric_exact(epoch: Column, grow: float, start: float) -> Column:
    """Grows by a constant factor from start to 1 at `grow`."""
    return F.least(F.lit(1.0), F.lit(start) * F.pow(F.lit(1 / start), epoch / grow))


def baby_step(epoch: Column, grow: float, buckets: int = 5) -> Column:
    return F.least(F.lit(1.0), (F.floor(epoch * buckets / grow) + 1).cast("double") / buckets)


SCHEDULES = {"root_p": root_p, "linear": linear, "geometric": geometric, "geometric_exact": geometric_exact, "baby_step": baby_step}


def threshold(kind: str, epoch: Column, **options: float) -> Column:
    """Share of the data that is visible in an epoch; 1 for a kind that isn't known."""
    return SCHEDULES[kind](epoch, **options) if kind in SCHEDULES else F.lit(1.0)


def visible_size(share: Column, rows: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(share * rows)).cast("bigint")


def label_mask(ids: Column, patch: Column) -> Column:
    """Labels of token ids: those up to the end of the first run of the patch token are ignored; all, if there is none."""
    first = F.array_position(ids, patch)
    after = F.array_position(F.transform(F.slice(ids, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(ids), F.lit(1))), lambda x: x != patch), True)
    end = F.when(first == 0, F.size(ids)).when(after == 0, F.size(ids)).otherwise(first + after - 2).cast("int")
    return F.concat(F.array_repeat(F.lit(IGNORED), end), F.slice(ids, end + 1, F.greatest(F.size(ids) - end, F.lit(0))))


def with_patches(ids: Column, patch: int, n: int, limit: int | None = None) -> Column:
    """n patch tokens before the ids, cut to `limit`, if there is one."""
    full = F.concat(F.array_repeat(F.lit(patch), n), ids)
    return full if limit is None else F.slice(full, 1, limit)


def padded(ids: Column, longest: Column, pad: int, multiple: int = 8) -> Column:
    """Padded to the batch's longest row, rounded up to a multiple."""
    to = (F.ceil(longest / multiple) * multiple).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(to - F.size(ids), F.lit(0))))


def checkpoint_steps(step: Column, per_epoch: int, every: float) -> Column:
    """Whether a step is one of the fractions every, 2 every, ... below 1 of an epoch."""
    marks, k = [], 1
    while k * every < 1 - 1e-12:
        marks.append(round(k * every * per_epoch))
        k += 1
    return (step % per_epoch).isin(marks) if marks else F.lit(False)


def accumulation(batch: int, micro: int, devices: int) -> int:
    """Gradient accumulation steps of a batch over devices."""
    return batch // micro // devices
