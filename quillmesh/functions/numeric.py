"""Numeric expressions: probabilities, guarded ratios, signals that skip nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN as null; both mean missing."""
    return F.when(F.isnan(x.cast("double")), F.lit(None)).otherwise(x.cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -60.0, 60.0)))


def softmax_second(a: Column, b: Column) -> Column:
    """The share of the second of two logits."""
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))


def clip(x: Column, low: float, high: float) -> Column:
    """x held between bounds; null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.bround(100 * part / F.greatest(whole, F.lit(1)), digits)


def margin(p: Column) -> Column:
    return F.abs(p - 0.5)


def confidence(p: Column, label: Column) -> Column:
    """The probability given to the true label."""
    return F.when(label == 1, p).otherwise(1 - p)


def mean_known(*signals: Column, default: float | None = None) -> Column:
    """The mean of the signals that are neither null nor NaN."""
    have = F.filter(F.array(*[known(s) for s in signals]), lambda x: x.isNotNull())
    total = F.aggregate(have, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, F.size(have).cast("double"))
    return mean if default is None else F.coalesce(mean, F.lit(default))


def first_known(*scores: Column, default: float = 0.5) -> Column:
    return F.coalesce(*[known(s) for s in scores], F.lit(default))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def micro(x: Column) -> Column:
    """A double as whole millionths, for results that are compared exactly."""
    return F.round(x * 1000000).cast("bigint")


def label_of(value: Column, extended: bool = False, flip: bool = False) -> Column:
    """0 or 1 from a label name or number; null for anything else."""
    text = F.lower(F.trim(value.cast("string")))
    yes = ["fake", "1", "1.0"] + (["false", "not_credible", "not credible"] if extended else [])
    no = ["real", "0", "0.0"] + (["true", "credible"] if extended else [])
    one, zero = (0, 1) if flip else (1, 0)
    return F.when(text.isin(yes), one).when(text.isin(no), zero)


def l2_normalise(v: Column, floor: float = 1e-12) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(floor)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
