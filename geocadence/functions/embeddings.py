"""Embedding codecs and vector arithmetic as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dequantise_curve(q: Column) -> Column:
    """int8 to [-1, 1]: sign(v) (v / 127.5)^2; -128 is missing."""
    return F.transform(q, lambda v: F.when(v != -128, F.signum(v.cast("double")) * F.pow(v / 127.5, 2)))


def quantise_curve(x: Column) -> Column:
    """Inverse of ``dequantise_curve``; null becomes -128."""
    code = lambda v: F.signum(v) * F.round(F.sqrt(F.abs(v)) * 127.5)
    return F.transform(x, lambda v: F.coalesce(F.greatest(F.lit(-127), F.least(F.lit(127), code(v))), F.lit(-128)).cast("int"))


def dequantise_scaled(q: Column, scale: Column) -> Column:
    """int8 times a scale per row; a scale that is not finite gives missing values."""
    good = F.when(~F.isnan(scale) & (F.abs(scale) != float("inf")), scale)
    return F.transform(q, lambda v: v * good)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))
