"""Vector functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(dot(a, b) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


def scale(v: Column) -> Column:
    """Largest magnitude over 127; 1 for a zero vector."""
    top = F.aggregate(F.transform(v, lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return F.when(top == 0, 1.0).otherwise(top / 127.0)


def quantize(v: Column, s: Column) -> Column:
    """Codes -127..127, halves to even."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") / s, 0).cast("int"))).cast("tinyint"))


def dequantize(codes: Column, s: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") * s)


def error_ratio(a: Column, b: Column) -> Column:
    """Root of the squared error over the squared norm; 0 for a zero vector."""
    err = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.sqrt(err / F.nullif(dot(a, a), F.lit(0.0))), F.lit(0.0))


def code_bytes(codes: Column) -> Column:
    """int8 codes as unsigned bytes (shifted by 128) in hexadecimal."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.hex((c + 128).cast("long")), 2, "0")), "")


def bytes_codes(packed: Column) -> Column:
    """The codes of ``code_bytes``."""
    n = F.length(packed) / 2
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.conv(F.substr(packed, (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("int") - 128))
