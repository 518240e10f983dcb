"""Causal per-bar features. All share one window by symbol and time, so Spark sorts a feature table once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.columns import quotient
from tidewatch.operators.scans import SPAN, carried, running, with_history, with_position


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def by_time() -> WindowSpec:
    return Window.partitionBy("ts")


def rows(lo: int, hi: int) -> WindowSpec:
    return by_symbol().rowsBetween(lo, hi)


def returns(n: int, price: str = "close") -> Column:
    """Percent change over n bars; null while history is short, infinite from a price of 0."""
    return (quotient(F.col(price), F.lag(price, n).over(by_symbol())) - 1) * 100


def true_range() -> Column:
    before = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - before), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - before), F.lit(0.0)))


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Plain mean of the true range over n bars; null with fewer than max(5, n // 2)."""
    ranged = bars.withColumn("_tr", true_range())
    enough = F.count("_tr").over(rows(1 - n, 0)) >= max(5, n // 2)
    return ranged.withColumn("atr", F.when(enough, F.avg("_tr").over(rows(1 - n, 0)))).drop("_tr")


def ema(span: int, lookback: int = 180, price: str = "close") -> Column:
    """Exponential mean seeded with the first of the last `lookback` bars, as one expression. scans.with_ema gives the mean over the whole history."""
    alpha = 2 / (span + 1)
    values = F.collect_list(price).over(rows(1 - lookback, 0))
    return F.aggregate(F.slice(values, 2, lookback), F.element_at(values, 1), lambda s, x: x * alpha + s * (1 - alpha))


def volume_ratio(n: int = 20) -> Column:
    """Volume over the median of the n bars before; 1 where there are fewer than n or the median is 0."""
    base = F.percentile("volume", F.lit(0.5)).over(rows(-n, -1))
    return F.when((F.count("volume").over(rows(-n, -1)) == n) & (base > 0), F.col("volume") / base).otherwise(1.0)


def bollinger(n: int = 20) -> dict[str, Column]:
    mean, sigma = F.avg("close").over(rows(1 - n, 0)), F.stddev_pop("close").over(rows(1 - n, 0))
    return {"bb_mean": mean, "bb_sigma": sigma, "bb_z": (F.col("close") - mean) / F.nullif(sigma, F.lit(0.0))}


def vwap(n: int = 24) -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.coalesce(F.sum(typical * F.col("volume")).over(rows(1 - n, 0)) / F.nullif(F.sum("volume").over(rows(1 - n, 0)), F.lit(0.0)), F.col("close"))


def range_position(n: int = 24) -> Column:
    high, low = F.max("high").over(rows(1 - n, 0)), F.min("low").over(rows(1 - n, 0))
    return (F.col("close") - low) / F.nullif(high - low, F.lit(0.0))


def anatomy() -> dict[str, Column]:
    """Shares of a candle's range."""
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return {"body": (top - bottom) / span, "upper_wick": (F.col("high") - top) / span, "lower_wick": (bottom - F.col("low")) / span, "close_position": (F.col("close") - F.col("low")) / span, "bearish": F.col("close") < F.col("open")}


def swings() -> dict[str, Column]:
    """Two-left two-right swings with ties, known two bars later."""
    high = F.when(F.count("high").over(rows(-2, 2)) == 5, F.col("high") >= F.max("high").over(rows(-2, 2)))
    low = F.when(F.count("low").over(rows(-2, 2)) == 5, F.col("low") <= F.min("low").over(rows(-2, 2)))
    return {"_swing_high": high, "_swing_low": low}


def with_swings(bars: DataFrame) -> DataFrame:
    """swing_high and swing_low: the price of the swing that this bar confirms, two bars after it."""
    marked = bars.withColumns(swings())
    known = lambda flag, price: F.when(F.lag(flag, 2).over(by_symbol()), F.lag(price, 2).over(by_symbol()))
    return marked.withColumns({"swing_high": known("_swing_high", "high"), "swing_low": known("_swing_low", "low")}).drop("_swing_high", "_swing_low")


def with_strict_pivots(bars: DataFrame) -> DataFrame:
    """pivot_low and pivot_high: strict to the left, with ties to the right, known two bars later."""
    low = (F.col("low") < F.min("low").over(rows(-2, -1))) & (F.col("low") <= F.min("low").over(rows(1, 2)))
    high = (F.col("high") > F.max("high").over(rows(-2, -1))) & (F.col("high") >= F.max("high").over(rows(1, 2)))
    whole = (F.count("low").over(rows(-2, -1)) == 2) & (F.count("low").over(rows(1, 2)) == 2)
    marked = bars.withColumns({"_low": whole & low, "_high": whole & high})
    known = lambda flag, price: F.when(F.lag(flag, 2).over(by_symbol()), F.lag(price, 2).over(by_symbol()))
    return marked.withColumns({"pivot_low": known("_low", "low"), "pivot_high": known("_high", "high")}).drop("_low", "_high")


def with_pivot_age(bars: DataFrame) -> DataFrame:
    """For bars with strict pivots: how far the highs around a confirmed low rise above it, and how many bars ago the last confirmed low was."""
    placed = with_position(bars, name="_at")
    prominence = F.max("high").over(rows(-2, 2)) - F.col("low")
    marked = placed.withColumn("_prominence", prominence).withColumn("low_prominence", F.when(F.col("pivot_low").isNotNull(), F.lag("_prominence", 2).over(by_symbol())))
    known = carried(marked.withColumn("_low_at", F.when(F.col("pivot_low").isNotNull(), F.col("_at") - 2)), {"_low_at": "_last_at"})
    return known.withColumn("low_age", F.col("_at") - F.col("_last_at")).drop("_at", "_prominence", "_low_at", "_last_at")


def with_structure(bars: DataFrame, spans: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """Trend structure (column atr given): means over the whole history (the slowest one only from its own length on, the one before it until then), atr_pct, whether the last two confirmed swing highs and lows fall, and the bearish orders of price and means."""
    out = with_history(with_swings(bars), spans, {"swing_high": "highs", "swing_low": "lows"})
    fast, middle, slow = (f"ema{s}" for s in spans)
    out = out.withColumn(slow, F.when(F.col("position") >= spans[2] - 1, F.col(slow)).otherwise(F.col(middle)))
    falls = lambda k: F.coalesce(F.try_element_at(f"last_{k}", F.lit(-1)) < F.try_element_at(f"last_{k}", F.lit(-2)), F.lit(False))
    close = F.col("close")
    named = {
        "atr_pct": quotient(F.col("atr"), close) * 100, "last_high": F.try_element_at("last_highs", F.lit(-1)), "last_low": F.try_element_at("last_lows", F.lit(-1)),
        "ema_bear": (close < F.col(fast)) & (F.col(fast) < F.col(middle)), "macro_bear": (F.col(middle) <= F.col(slow)) | (close < F.col(slow)), "lower_high": falls("highs"), "lower_low": falls("lows"),
    }
    return out.withColumns(named).drop("position", "last_highs", "last_lows")


def with_sweep(bars: DataFrame, n: int = 20, keep: int = 8, over: float = 1.001) -> DataFrame:
    """The newest liquidity sweep of the last `keep` bars: high above the n bars before and close back below."""
    level = F.max("high").over(rows(-n, -1))
    hit = (F.count("high").over(rows(-n, -1)) == n) & (F.col("high") > level * over) & (F.col("close") < level)
    numbered = bars.withColumns({"_rn": F.row_number().over(by_symbol()), "_hit": F.when(hit, F.struct(F.row_number().over(by_symbol()).alias("rn"), level.alias("level")))})
    newest = F.last("_hit", ignorenulls=True).over(rows(1 - keep, 0))
    return numbered.withColumn("_newest", newest).withColumns({"sweep_level": F.col("_newest.level"), "sweep_bars_ago": (F.col("_rn") - F.col("_newest.rn")).cast("long")}).drop("_rn", "_hit", "_newest")


def with_runs(bars: DataFrame, condition: Column, name: str = "run", *, span: int = SPAN) -> DataFrame:
    """How many bars in a row up to this one fulfil the condition.

    Runs are counted within spans of time; the first run of a span takes on what the spans before it end with. Only one row for each span is ordered by symbol.
    """
    flagged = bars.withColumns({"_ok": F.coalesce(condition, F.lit(False)), "_span": F.floor(F.unix_seconds("ts") / span)})
    upto = Window.partitionBy("symbol", "_span").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    island = flagged.withColumn("_island", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(upto))
    own = F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(Window.partitionBy("symbol", "_span", "_island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    within = island.withColumn("_run", own)
    spans = within.groupBy("symbol", "_span").agg(F.count("*").alias("n"), F.max_by("_run", "ts").alias("tail"), F.max("_island").alias("breaks"))
    order = Window.partitionBy("symbol").orderBy("_span")
    summed = spans.withColumn("upto", F.sum("n").over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    handed = F.coalesce(F.last("upto").over(before), F.lit(0)) + F.coalesce(F.last(F.when(F.col("breaks") > 0, F.col("tail") - F.col("upto")), ignorenulls=True).over(before), F.lit(0))
    out = within.join(summed.select("symbol", "_span", handed.alias("_handed")), ["symbol", "_span"])
    return out.withColumn(name, (F.col("_run") + F.when(F.col("_island") == 0, F.col("_handed")).otherwise(0)).cast("long")).drop("_ok", "_span", "_island", "_run", "_handed")


def touch_episodes(bars: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """How often each symbol enters the zone: runs of bars that overlap it."""
    touched = bars.select("symbol", "ts", ((F.col("high") >= lower) & (F.col("low") <= upper)).alias("touched"))
    entered = touched.withColumn("entered", F.col("touched") & ~F.coalesce(F.lag("touched").over(by_symbol()), F.lit(False)))
    return entered.groupBy("symbol").agg(F.count_if("entered").alias("episodes"), F.count_if("touched").alias("bars"))


def cross_section(features: DataFrame, column: str) -> DataFrame:
    """Rank, rank share and weakness (1 for the lowest) among the symbols of each timestamp; ties by symbol."""
    order = by_time().orderBy(F.col(column).desc_nulls_last(), "symbol")
    n = F.count("*").over(by_time())
    rank = (F.row_number().over(order) - 1).cast("long")
    return features.withColumns({"rank": rank, "rank_share": rank / n, "weakness": rank / F.greatest(n - 1, F.lit(1))})


def equity(trades: DataFrame, keys: list[str], order: list[str], r: str = "r", span_of: Column | None = None) -> DataFrame:
    """Running total, its peak (0 at least) and the drawdown, in order, for each key. `span_of` cuts a key along its order (default: days of the first order column)."""
    return running(trades, keys, order, r, span_of=F.floor(F.col(order[0]) / 86_400) if span_of is None else span_of)


def price_clusters(levels: DataFrame, keys: list[str], price: str, gap: Column, touches: int = 1) -> DataFrame:
    """Price levels that lie within `gap` of the next one form a cluster: bounds, centre and number of touches."""
    w = Window.partitionBy(*keys).orderBy(price)
    fresh = F.coalesce((F.col(price) - F.lag(price).over(w) > gap).cast("int"), F.lit(0))
    marked = levels.withColumn("_new", fresh).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy(*keys, "cluster").agg(F.min(price).alias("lower"), F.max(price).alias("upper"), F.avg(price).alias("centre"), F.count("*").alias("touches")).where(F.col("touches") >= touches)
