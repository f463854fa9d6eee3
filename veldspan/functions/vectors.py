"""Arithmetic on arrays of numbers, as higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, eps: float = 0.0) -> Column:
    """a / |a|; null for a zero vector unless ``eps`` is added to the norm."""
    n = norm(a) + F.lit(eps)
    return F.transform(doubles(a), lambda v: F.try_divide(v, n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether all elements are nearly equal, as numpy's allclose has it."""
    near = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y.cast("double")))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda ok: F.coalesce(ok, F.lit(False)))


def slice_or_pad(a: Column, start: int, end: int, fill: float = 0.0) -> Column:
    """Elements start..end; an array shorter than ``end`` is padded to ``end`` whole, and start is ignored."""
    missing = F.greatest(F.lit(end) - F.size(a), F.lit(0))
    padded = F.concat(doubles(a), F.array_repeat(F.lit(fill), missing))
    return F.when(F.size(a) < end, padded).otherwise(F.slice(doubles(a), start + 1, end - start))


def average_pool(a: Column, width: int) -> Column:
    """Means of consecutive groups of ``width`` elements; a last group that is not full is dropped."""
    groups = F.expr("sequence(0, -1, -1)") if width < 1 else F.sequence(F.lit(0), F.floor(F.size(a) / width).cast("int") - 1)
    return F.transform(groups, lambda g: F.aggregate(F.slice(doubles(a), g * width + 1, width), F.lit(0.0), lambda s, v: s + v) / width)


def mean_of(rows: Column) -> Column:
    """The mean of each element over an array of arrays of one length."""
    n = F.size(rows)
    return F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda i: F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.get(r, i)) / n)


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(doubles(a), F.abs))


def peak_normalised(a: Column, peak: float = 0.95, silence: float = 1e-6) -> Column:
    """Scaled to the peak; null for silence, which is tested first."""
    top = max_abs(a)
    return F.when(top >= silence, F.transform(doubles(a), lambda v: v / top * peak))


def finite(a: Column) -> Column:
    return ~F.exists(doubles(a), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: (x.cast("double") + y) / 2)


def mix(a: Column, b: Column, weight: Column) -> Column:
    """weight a + (1 - weight) b, element by element."""
    return F.zip_with(a, b, lambda x, y: weight * x.cast("double") + (1 - weight) * y.cast("double"))


def guided(a: Column, b: Column, weight: Column) -> Column:
    """A guidance mix; below weight 1 it is ``a`` alone."""
    return F.when(weight < 1, doubles(a)).otherwise(mix(a, b, weight))


def mean_square_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, F.lit(2))), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def gaussian_kl(mean: Column, logvar: Column, low: float = -30.0, high: float = 20.0) -> Column:
    """KL divergence of a diagonal Gaussian from the standard one, log variances clamped."""
    part = F.zip_with(mean, F.transform(logvar, lambda v: F.least(F.greatest(v.cast("double"), F.lit(low)), F.lit(high))), lambda m, v: m * m + F.exp(v) - 1 - v)
    return F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / 2


def reparameterised(mean: Column, std: Column, noise: Column) -> Column:
    """mean + std * noise; the noise is data, so that reruns agree."""
    return F.zip_with(mean, F.zip_with(std, noise, lambda s, e: s * e), lambda m, x: m + x)


def transposed(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))


def linspace(start: float, end: float, steps: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.lit(start) + (F.lit(end) - F.lit(start)) * i / steps)


def euler(start: Column, velocity, steps: int) -> Column:
    """Integrates x' = velocity(x, t) from t = 1 down to 0 in equal steps; x is a number."""
    size = 1.0 / steps
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start.cast("double"), lambda x, i: x - velocity(x, 1 - i * size) * size)


def rotated(a: Column, angle: Column) -> Column:
    """Neighbouring pairs of elements turned by an angle, as rotary positions do."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(a) / 2).cast("int") - 1)
    turned = F.transform(
        pairs,
        lambda i: F.array(
            F.get(a, 2 * i) * F.cos(angle) - F.get(a, 2 * i + 1) * F.sin(angle), F.get(a, 2 * i) * F.sin(angle) + F.get(a, 2 * i + 1) * F.cos(angle)
        ),
    )
    return F.flatten(turned)


def timestep_embedding(t: Column, width: int, period: float = 10_000.0) -> Column:
    """cos and sin of t at width / 2 frequencies falling geometrically."""
    half = width // 2
    at = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: t * F.exp(F.lit(-math.log(period)) * i / half))
    return F.concat(F.transform(at, F.cos), F.transform(at, F.sin))


def preserving_sum(a: Column, b: Column, weight: float = 0.5) -> Column:
    """A weighted sum scaled so that independent unit inputs give a unit output."""
    scale = ((1 - weight) ** 2 + weight**2) ** 0.5
    return F.zip_with(a, b, lambda x, y: (x * (1 - weight) + y * weight) / scale)


def adaptive_weight(square: Column, gamma: float = 0.0, c: float = 1e-3) -> Column:
    """d / (d + c) ** (1 - gamma): a squared error weighted down where it is large."""
    return square / F.pow(square + F.lit(c), F.lit(1.0 - gamma))


def signed_range(a: Column) -> Column:
    """[0, 1] to [-1, 1], element by element."""
    return F.transform(doubles(a), lambda v: v * 2 - 1)


def unit_range(a: Column) -> Column:
    """[-1, 1] to [0, 1], element by element."""
    return F.transform(doubles(a), lambda v: (v + 1) * 0.5)


def padded_rows(rows: Column, length: int, width: int) -> Column:
    """An array of arrays cut or filled with rows of zeros to ``length`` rows."""
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), width), F.greatest(F.lit(length) - F.size(rows), F.lit(0)))
    return F.slice(F.concat(rows, zeros), 1, length)


def pooled_with_first(rows: Column, width: int = 8) -> Column:
    """The first row, then the means of groups of ``width`` of the others; a last group that is not full is dropped."""
    others = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    groups = F.floor(F.size(others) / width).cast("int")
    pooled = F.transform(F.sequence(F.lit(1), groups), lambda g: mean_of(F.slice(others, (g - 1) * width + 1, width)))
    return F.when(groups > 0, F.concat(F.slice(rows, 1, 1), pooled)).otherwise(F.slice(rows, 1, 1))
