"""Scores of gaps as Spark arrays: softmax, best gap, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

MIN_UNITS = 13
MIN_CONFIDENCE = 0.45
MAX_WINDOW = 256


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def gap_probabilities(scores: Column) -> Column:
    """Softmax; zeros if any score is not finite; empty for no scores."""
    shared = lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z))
    powers = lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    return let(scores, lambda s: F.when(F.forall(s, finite), let(powers(s), shared)).otherwise(F.transform(s, lambda _: F.lit(0.0))))


def best_gap(scores: Column, allowed: Column | None = None) -> Column:
    """Index of the largest finite score among the allowed gaps, the first of equal ones; null if none."""
    use = F.transform(scores, lambda s: F.when(finite(s), s))
    if allowed is not None:
        use = F.zip_with(use, allowed, lambda s, ok: F.when(ok, s))
    return let(use, lambda u: let(F.array_max(u), lambda top: F.when(top.isNotNull(), (F.array_position(u, top) - 1).cast("int"))))


def model_windows(n_tokens: Column, radius: int) -> Column:
    """(cursor, gap_end, start, end) of the windows in which each gap is scored once."""
    stride = MAX_WINDOW - 2 * radius - 1
    if radius < 0 or stride < 1:
        raise ValueError("the receptive field exceeds the window")
    step = F.when(n_tokens <= MAX_WINDOW, n_tokens - 1).otherwise(F.lit(stride))
    cursors = F.when(n_tokens >= 2, F.sequence(F.lit(0), n_tokens - 2, F.greatest(step, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(cursors, lambda c: F.struct(c.alias("cursor"), F.least(n_tokens - 1, c + step).alias("gap_end"), F.greatest(F.lit(0), c - radius).alias("start"), F.least(n_tokens, F.least(n_tokens - 1, c + step) + radius + 1).alias("end")))


def normalized_layer(values: Column) -> Column:
    """Population mean and variance to 0 and 1 (epsilon 1e-5)."""
    scaled = lambda d: let(total(F.transform(d, lambda x: x * x)) / F.size(d), lambda v: F.transform(d, lambda x: x / F.sqrt(v + 1e-5)))
    return let(values, lambda x: let(total(x) / F.size(x), lambda m: let(F.transform(x, lambda y: y - m), scaled)))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x)))
