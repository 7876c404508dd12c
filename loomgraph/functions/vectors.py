"""Vector arithmetic on array columns (JVM side, used for pair-wise work on given pairs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def trilinear_score(head: Column, relation: Column, tail: Column) -> Column:
    return dot(times(head, relation), tail)


def _halves(v: Column, dim: int) -> tuple[Column, Column]:
    half = dim // 2
    return F.slice(v, 1, half), F.slice(v, half + 1, half)


def complex_score(head: Column, relation: Column, tail: Column, dim: int) -> Column:
    """Real part of <h, r, conj(t)>; first half real, second half imaginary."""
    hr, hi = _halves(head, dim)
    rr, ri = _halves(relation, dim)
    tr, ti = _halves(tail, dim)
    return (
        dot(times(hr, rr), tr) + dot(times(hi, rr), ti) + dot(times(hr, ri), ti) - dot(times(hi, ri), tr)
    )


def rotation_score(head: Column, phase: Column, tail: Column, dim: int) -> Column:
    """-sum |h*e^(i phase) - t| per complex coordinate, 1e-8 under the root."""
    hr, hi = _halves(head, dim)
    tr, ti = _halves(tail, dim)
    cos, sin = F.transform(phase, F.cos), F.transform(phase, F.sin)
    re = minus(minus(times(hr, cos), times(hi, sin)), tr)
    im = minus(plus(times(hr, sin), times(hi, cos)), ti)
    return -total(F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b + 1e-8)))
