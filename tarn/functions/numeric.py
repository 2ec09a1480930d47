"""Scalar expressions whose edge cases matter: coercion, clipping, rounding, right-closed bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a numeric string looks like: plain or exponent notation, or an infinity. Suffixes such as "1.0d" are no numbers.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def to_number(x: Column, kind: str = "double") -> Column:
    """A double, or null where the value is missing, NaN or no number."""
    if kind == "string":
        return nan_to_null(F.when(x.rlike(NUMBER), F.trim(x).try_cast("double")))
    return nan_to_null(x.try_cast("double"))


def clip01(x: Column) -> Column:
    """Between 0 and 1; null stays null, which greatest() and least() would not grant."""
    return F.when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)


def round_even(x: Column, digits: int = 4) -> Column:
    """Scale, round half to even, scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


#: Units in which exact_sum adds, and the largest value that it takes.
UNIT, LARGEST = 10**9, 1e18


def exact_sum(x: Column) -> Column:
    """The sum of doubles, whatever the order of the rows: whole multiples of 1 / UNIT are added as integers. Sums with a value beyond LARGEST are plain; null without any value."""
    whole = F.sum(F.rint(F.when(F.abs(x) <= LARGEST, x) * F.lit(float(UNIT))).cast("decimal(38,0)")).cast("double") / F.lit(float(UNIT))
    return F.when(F.max(F.abs(x)) <= LARGEST, whole).otherwise(F.sum(x))


def binned(x: Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """The label of the bin (edge, next edge] that x lies in, else null. The last edge may be infinity."""
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = x > F.lit(float(low))
        if high != float("inf"):
            inside &= x <= F.lit(float(high))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def ordinal(x: Column, labels: tuple[str, ...]) -> Column:
    """The place of a label in its domain, from 0."""
    out = F.when(x == F.lit(labels[0]), F.lit(0))
    for k, label in enumerate(labels[1:], 1):
        out = out.when(x == F.lit(label), F.lit(k))
    return out


# Edges and labels that results are expected to have.
INF = float("inf")
DURATION = ((0, 1, 8, 24, INF), ("Short (<1h)", "Medium (1-8h)", "Long (8-24h)", "Very Long (>24h)"))
SIZE = ((0, 16, 64, 256, INF), ("Small (1-16)", "Medium (17-64)", "Large (65-256)", "Very Large (>256)"))
SEVERITY = ((0, 0.25, 0.5, 0.75, 1.0), ("Low (0-25%)", "Medium (25-50%)", "High (50-75%)", "Very High (75-100%)"))
DOMAINS = {"duration_category": DURATION[1], "size_category": SIZE[1], "waste_category": SEVERITY[1]}
