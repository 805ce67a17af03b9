"""Cosine similarity in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.rows import bound


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """`otherwise` for empty vectors, different lengths, components that are null or not finite, and zero norms."""
    finite = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def of(x: Column, y: Column) -> Column:
        norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        usable = (F.size(x) > 0) & (F.size(x) == F.size(y)) & finite(x) & finite(y)
        return F.when(F.coalesce(usable, F.lit(False)), F.coalesce(F.try_divide(dot(x, y), norms), F.lit(otherwise))).otherwise(F.lit(otherwise))

    return bound(a, lambda x: bound(b, lambda y: of(x, y)))


def cosine_or_minus_one(a: Column, b: Column) -> Column:
    return cosine(a, b, -1.0)


#: Letters whose counts make up the built-in embedding; a stand-in for a model, exact in SQL.
LETTERS = "etaoinshrdlu"


def letter_embedding(text: Column) -> Column:
    size = F.length(text)
    return F.array(*[(size - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
