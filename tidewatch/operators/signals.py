"""The signal row: all features of a bar that scores and gates read, from two time frames of bars, with the coarser one as of its last closed bar.

A row has the bar's own features under plain names and those of the coarser frame as s4_<name>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import quotient
from tidewatch.operators import features as W
from tidewatch.operators import setups as P
from tidewatch.operators.matching import as_of
from tidewatch.operators.zones import with_open_pivots

LAST_SWINGS, SWING_LOOKBACK = 6, 240
COARSE = ("ema_bear", "macro_bear", "lower_high", "lower_low", "zone_lower", "zone_upper", "zone_distance_atr", "swing_lows", "ema20", "ema50", "close", "atr")


def rejection(wick: float = 0.35, of_body: float = 0.8) -> Column:
    """A bearish candle whose upper wick is long against its range and its body."""
    upper, body = F.col("high") - F.greatest("open", "close"), F.abs(F.col("close") - F.col("open"))
    return (F.col("close") < F.col("open")) & (upper / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)) >= wick) & (upper >= of_body * body)


def with_frame(bars: DataFrame) -> DataFrame:
    """What both time frames need: structure, supply zone and the last swing lows."""
    out = P.with_supply_zone(W.with_structure(W.with_atr(bars)))
    lows = F.collect_list("swing_low").over(W.rows(1 - SWING_LOOKBACK, 0))
    return out.withColumn("swing_lows", F.slice(F.reverse(lows), 1, LAST_SWINGS))


def signal_rows(one: DataFrame, four: DataFrame, four_step: int, one_step: int, *, pivots: tuple[int, int] | None = None) -> DataFrame:
    """A row for each bar of `one`, which becomes known when the bar closes. `pivots` adds the open pivot lows of the last bars of either frame, as columns pivots and s4_pivots."""
    coarse_columns = COARSE
    if pivots:
        one, four, coarse_columns = with_open_pivots(one, pivots[0], one_step), with_open_pivots(four, pivots[1], four_step), (*COARSE, "pivots")
    w, zero = W.by_symbol(), F.lit(0.0)
    own = W.with_sweep(P.with_breakdown(with_frame(one)))
    full = lambda n: F.count("close").over(W.rows(1 - n, 0)) == n
    z = W.bollinger()
    upper = z["bb_mean"] + 2 * z["bb_sigma"]
    wide = (F.count("close").over(W.rows(-21, 0)) == 22) & (z["bb_sigma"] > 0)
    own = own.withColumns({f"ret{n}": F.coalesce(W.returns(n), zero) for n in (1, 3, 4, 12, 24)}).withColumns({
        "volume_ratio": W.volume_ratio(), "vwap": W.vwap(), "bb_z": F.when(wide, z["bb_z"]).otherwise(0.0), "bb_failed": F.coalesce(wide & (F.col("high") > upper) & (F.col("close") < upper), F.lit(False)),
        "rejection": rejection(), "sweep": F.col("sweep_bars_ago").isNotNull(), "close_before": F.lag("close").over(w), "high_before": F.lag("high").over(w), "low_before": F.lag("low").over(w), "close_3_ago": F.coalesce(F.lag("close", 3).over(w), F.col("close")),
        "prior_high20": F.coalesce(F.max("high").over(W.rows(-20, -1)), F.col("high")), "high12": F.max("high").over(W.rows(-11, 0)), "low12": F.min("low").over(W.rows(-11, 0)), "low24": F.min("low").over(W.rows(-23, 0)),
        "position24": F.when(full(10), F.coalesce(W.range_position(24), F.lit(0.5))), "position48": F.when(full(10), F.coalesce(W.range_position(48), F.lit(0.5))), "turnover": F.sum("amount").over(W.rows(-23, 0)), "low_spread12": F.max("low").over(W.rows(-11, 0)) - F.min("low").over(W.rows(-11, 0)),
        "bars_so_far": F.count("close").over(W.rows(-99, 0)), "bar_no": F.row_number().over(w),
    })
    own = own.withColumn("known_at", F.timestamp_seconds(F.unix_seconds("ts") + one_step))
    coarse = with_frame(four).select("symbol", F.timestamp_seconds(F.unix_seconds("ts") + four_step).alias("closed_at"), *(F.col(c).alias(f"s4_{c}") for c in coarse_columns))
    both = as_of(own, coarse, ["symbol"], "known_at", "closed_at", [f"s4_{c}" for c in coarse_columns])
    below = F.filter(F.concat("swing_lows", F.coalesce("s4_swing_lows", F.array().cast("array<double>"))), lambda x: x < F.col("close"))
    distances = F.least(*(F.col(c) for c in ("zone_distance_atr", "s4_zone_distance_here")))
    here = lambda lo, hi: F.when((F.col("close") >= F.col(lo)) & (F.col("close") <= F.col(hi)), 0.0).otherwise(quotient(F.least(F.abs(F.col("close") - F.col(lo)), F.abs(F.col("close") - F.col(hi))), F.col("atr")))
    return both.withColumn("s4_zone_distance_here", F.when(F.col("s4_zone_lower").isNotNull(), here("s4_zone_lower", "s4_zone_upper"))).withColumns({"nearest_support": F.array_max(below), "supply_distance": distances})


def with_market(rows: DataFrame, benchmarks: list[str]) -> DataFrame:
    """The mean returns of the benchmark symbols at the same time, whether all are above or below their mean, and the market's state: a window over the symbols of each time."""
    w, own_leg = Window.partitionBy("ts"), F.col("symbol").isin(*benchmarks)
    of_legs = lambda x: F.when(own_leg, x)
    whole = F.count(of_legs(F.lit(1))).over(w) == len(benchmarks)
    joined = rows.withColumn("_whole", whole).withColumns(
        {f"market_r{n}": F.when(F.col("_whole"), F.avg(of_legs(F.col(f"ret{n}"))).over(w)) for n in (1, 3, 4, 24)}
        | {"market_above": F.when(F.col("_whole"), F.bool_and(of_legs(F.col("close") > F.col("ema20"))).over(w)), "market_below": F.when(F.col("_whole"), F.bool_and(of_legs(F.col("close") < F.col("ema20"))).over(w)), "market_bear": F.when(F.col("_whole"), F.bool_and(of_legs(F.col("ema_bear"))).over(w))}
    ).drop("_whole")
    state = F.when(F.col("market_r4").isNull(), "UNKNOWN").when((F.col("market_r4") >= 1.2) & (F.col("market_r24") >= 2.5) & F.col("market_above"), "RISK_ON").when((F.col("market_r4") <= -0.8) & (F.col("market_r24") <= 0) & F.col("market_below"), "RISK_OFF").otherwise("NEUTRAL")
    trend = F.when(F.col("market_r4").isNull(), "UNKNOWN").when(F.col("market_above") & (F.col("market_r24") > 0), "BULL").when(F.col("market_below") & (F.col("market_r24") < 0), "BEAR").otherwise("RANGE")
    own = lambda n: F.col(f"ret{n}") - F.coalesce(f"market_r{n}", F.lit(0.0))
    return joined.withColumns({"market_state": state, "market_trend": trend, "relative1": own(1), "relative3": own(3), "relative4": own(4), "relative24": own(24)})
