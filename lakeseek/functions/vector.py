"""Vector and text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """0 where either vector has no length."""
    na, nb = norm(a) if na is None else na, norm(b) if nb is None else nb
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda x: x != "")
