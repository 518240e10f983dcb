"""Bars from ticks and bars from bars, on a regular UTC grid. A bar's ts is its open; it is closed from ts + step on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_utc(rows: DataFrame, column: str = "ts") -> DataFrame:
    """A time column without zone read as UTC, whatever the session's zone is; one with a zone stays."""
    if dict(rows.dtypes)[column] != "timestamp_ntz":
        return rows
    return rows.withColumn(column, F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")))


def floor_ts(ts: Column, step: int) -> Column:
    """The start of the step (seconds) that holds ts."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / step) * step)


def ticks(events: DataFrame, groups: int | None = None) -> DataFrame:
    """Event rows as ticks: symbol, ts, price. With `groups`, users are dealt into that many symbols for each type."""
    symbol = F.col("event_type") if groups is None else F.concat_ws("_", "event_type", F.pmod("user_id", F.lit(groups)).cast("string"))
    return with_utc(events).where("ts IS NOT NULL AND value IS NOT NULL").select(symbol.alias("symbol"), "ts", F.col("value").alias("price"))


def from_ticks(rows: DataFrame, step: int, *ties: str) -> DataFrame:
    """Tumbling bars; the aggregation combines on the map side, so only one row for each bar and task is shuffled. Of ticks of one time, the first by the columns `ties` opens and closes a bar, as arg_min and arg_max over ordered ticks have it; without `ties`, any of them."""
    opens, closes = F.struct("ts", *ties), F.struct(-F.unix_micros("ts"), *ties)
    return rows.groupBy("symbol", floor_ts(F.col("ts"), step).alias("bar")).agg(
        F.min_by("price", opens if ties else "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), (F.min_by("price", closes) if ties else F.max_by("price", "ts")).alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum("price").alias("amount"),
    ).withColumnRenamed("bar", "ts")


def resample(bars: DataFrame, step: int) -> DataFrame:
    """Coarser bars from finer ones."""
    return bars.groupBy("symbol", floor_ts(F.col("ts"), step).alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    ).withColumnRenamed("bar", "ts")


def closed(bars: DataFrame, at: Column, step: int) -> DataFrame:
    """Only bars whose whole span lies at or before `at`."""
    return bars.where(F.unix_seconds("ts") + step <= F.unix_seconds(at))


def on_grid(bars: DataFrame, step: int) -> DataFrame:
    """Every slot from a symbol's first to last bar; missing ones have nulls and are never filled."""
    spans = bars.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    slots = spans.select("symbol", F.explode(F.sequence(F.unix_seconds("lo"), F.unix_seconds("hi"), F.lit(step).cast("long"))).alias("s"))
    return slots.select("symbol", F.timestamp_seconds("s").alias("ts")).join(bars, ["symbol", "ts"], "left")


def coverage(bars: DataFrame, step: int, least: float = 0.9) -> DataFrame:
    """Present and expected bars, longest gap in bars, and whether the share is enough, for each symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    t = F.unix_seconds("ts")
    gaps = bars.select("symbol", t.alias("t"), ((F.lead(t).over(w) - t) / step - 1).alias("gap"))
    out = gaps.groupBy("symbol").agg(F.count("*").alias("present"), ((F.max("t") - F.min("t")) / step + 1).cast("long").alias("expected"), F.max("gap").cast("long").alias("longest_gap"), F.count_if(F.col("gap") > 0).alias("gaps"))
    return out.withColumns({"coverage": F.col("present") / F.col("expected"), "eligible": F.col("present") / F.col("expected") >= least})


def integrity(bars: DataFrame) -> Column:
    """True where prices are positive and low <= open, close <= high."""
    return F.coalesce((F.col("low") > 0) & (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high")), F.lit(False))
