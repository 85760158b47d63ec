"""Column builders on vectors (arrays of numbers), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """Rows scaled to length 1; ``eps`` keeps a zero vector at zero."""
    return F.transform(v, lambda x: x / (norm(v) + eps))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return clip(dot(a, b) / ((norm(a) + eps) * (norm(b) + eps)), -1.0, 1.0)


def mean_square(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def psnr(a: Column, b: Column, peak: float = 255.0) -> Column:
    return 10 * F.log10(F.lit(peak * peak) / mean_square(a, b))


def half_square(a: Column, b: Column) -> Column:
    """Half of the mean squared difference."""
    return mean_square(a, b) / 2


def dissimilarity(a: Column, b: Column, c1: float = 6.5025, c2: float = 58.5225) -> Column:
    """(1 - structural similarity) / 2 over the whole of two signals on a scale of 0 to 255."""
    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    va = total(F.transform(a, lambda x: x * x)) / n - ma * ma
    vb = total(F.transform(b, lambda x: x * x)) / n - mb * mb
    cov = dot(a, b) / n - ma * mb
    similar = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return (1 - similar) / 2


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (F.lit(b) if not isinstance(b, Column) else b for b in (low, high))
    return F.least(F.greatest(x, low), high)
