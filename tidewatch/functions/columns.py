"""Reusable Column builders: safe numbers, bins, statistics of trades, intervals of proportions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def quotient(a: Column, b: Column) -> Column:
    """a / b as doubles divide: by zero an infinity, or NaN for 0 / 0, where ANSI mode would stop the job."""
    return F.when(b == 0, a * float("inf")).otherwise(F.try_divide(a, b))


def ln(x: Column) -> Column:
    """The natural logarithm of doubles: minus infinity for 0 and NaN below, where Spark's own has null."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.log(x))


def rounded(x: Column, digits: int = 6) -> Column:
    """Doubles to some digits, halves away from 0 after scaling, as SQL engines over doubles do; Spark's own rounds the decimal text."""
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def first_number(*keys: Column) -> Column:
    """The first of several spellings of a field that holds a number."""
    return F.coalesce(*(k.try_cast("double") for k in keys))


def interval_bin(x: Column, edges: Sequence[float]) -> Column:
    """'<= lo', '(lo, hi]', ..., '> hi', and MISSING for null."""
    out = F.when(x.isNull(), "MISSING").when(x <= edges[0], f"<= {edges[0]:g}")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(x <= hi, f"({lo:g}, {hi:g}]")
    return out.otherwise(f"> {edges[-1]:g}")


def profit_factor(r: Column) -> Column:
    """Gains over losses; 999 without a loss, null without a trade."""
    gain, loss = F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))
    return F.when(F.count(r) == 0, F.lit(None).cast("double")).when(loss == 0, 999.0).otherwise(gain / F.nullif(loss, F.lit(0.0)))


def trade_metrics(r: Column) -> dict[str, Column]:
    n = F.count(r)
    return {"signals": F.count(F.lit(1)), "resolved": n, "wins": F.count_if(r > 0), "losses": F.count_if(r < 0), "win_pct": 100 * F.count_if(r > 0) / F.nullif(n, F.lit(0)), "expectancy": F.avg(r), "profit_factor": profit_factor(r)}


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a proportion."""
    p = wins / n
    middle, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (middle - half) / scale, (middle + half) / scale


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, F.lit(2.0)))
