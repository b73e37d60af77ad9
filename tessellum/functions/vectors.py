"""Vector expressions: Column -> Column, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the lengths differ."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _zero(), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), s)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, _zero(), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 where a length is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; null where the lengths differ."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), _zero(), lambda acc, x: acc + x * x)
    return F.when(F.size(a) == F.size(b), F.sqrt(s))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def l2_normalize(a: Column) -> Column:
    """A unit vector; values that are not finite count as 0, and a zero vector stays."""
    clean = F.transform(a, lambda x: F.when(_finite(x), x.cast("double")).otherwise(0.0))
    n = norm(clean)
    return F.when(n > 0, F.transform(clean, lambda x: x / n)).otherwise(clean)


def is_invalid(a: Column) -> Column:
    """Whether a vector has a value that is not finite, or nothing but zeros."""
    return F.exists(a, lambda x: ~_finite(x)) | F.forall(a, lambda x: x == 0)


def rms(a: Column) -> Column:
    """Root mean square of a window of samples."""
    return norm(a) / F.sqrt(F.size(a).cast("double"))


def pcm(a: Column) -> Column:
    """16-bit samples as fractions."""
    return F.transform(a, lambda x: x.cast("double") / 32767)


def pixels(a: Column) -> Column:
    """8-bit pixels, centred to -1..1."""
    return F.transform(a, lambda x: (x.cast("double") / 255 - 0.5) / 0.5)
