"""Setups from per-bar features: breakdown with retest, supply zones, pressure, setup class, gates, trend phase, and the class of the path that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import quotient
from tidewatch.operators.features import by_symbol, rows
from tidewatch.operators.matching import forward_bars


def with_breakdown(bars: DataFrame, n: int = 20, keep: int = 12, below: float = 0.1, touch: float = 0.15, back: float = 0.1, near: float = 0.55) -> DataFrame:
    """The newest close below the lows of the n bars before it by `below` ATR, in the last `keep` bars, and whether it was retested since. The level is that of the break bar, the ATR the current bar's (column atr).

    The last `keep` bars travel as an array of bounded length, since which bar broke depends on the current ATR.
    """
    w = by_symbol()
    level = F.when(F.count("low").over(rows(-n, -1)) == n, F.min("low").over(rows(-n, -1)))
    packed = bars.withColumn("_bar", F.struct(F.row_number().over(w).alias("rn"), level.alias("level"), "high", "close")).withColumn("_recent", F.collect_list("_bar").over(rows(1 - keep, 0)))
    broke = F.filter("_recent", lambda b: b["close"] < b["level"] - below * F.col("atr"))
    found = packed.withColumn("_break", F.try_element_at(broke, F.lit(-1)))
    rn, at = F.col("_bar.rn"), F.col("_break.level")
    retest = F.exists("_recent", lambda b: (b["rn"] > F.col("_break.rn")) & (b["high"] >= at - touch * F.col("atr")) & (b["close"] <= at + back * F.col("atr")))
    close_by = F.abs(F.col("close") - at) <= near * F.col("atr")
    return found.withColumns({"break_level": at, "break_bars_ago": (rn - F.col("_break.rn")).cast("long"), "breakdown": F.col("_break").isNotNull(), "retest": F.col("_break").isNotNull() & (F.coalesce(retest, F.lit(False)) | close_by)}).drop("_bar", "_recent", "_break")


def with_supply_zone(bars: DataFrame, ahead: int = 4, lookback: int = 75, drop: float = 1.15, body: float = 0.45) -> DataFrame:
    """The nearest supply zone: a base-like candle whose next `ahead` bars fell by `drop` of its ATR, known only once these are closed. Zones not below the price go first; ties to the older."""
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    base = (F.col("close") >= F.col("open")) | (F.abs(F.col("close") - F.col("open")) / span <= body)
    fell = (F.count("low").over(rows(1, ahead)) == ahead) & (quotient(F.col("low") - F.min("low").over(rows(1, ahead)), F.col("atr")) >= drop)
    zone = F.when(base & fell & (F.col("atr") > 0), F.struct(F.unix_seconds("ts").alias("t"), F.least("open", "close").alias("lower"), F.col("high").alias("upper")))
    known = bars.withColumn("_zone", zone).withColumn("_zones", F.collect_list("_zone").over(rows(1 - lookback, -ahead)))
    price = F.col("close")
    distance = lambda z: F.when((z["lower"] <= price) & (price <= z["upper"]), 0.0).otherwise(F.least(F.abs(price - z["lower"]), F.abs(price - z["upper"])))
    ranked = F.transform("_zones", lambda z: F.struct((z["upper"] < price * 0.995).alias("under"), distance(z).alias("distance"), z["t"].alias("t"), z["lower"].alias("lower"), z["upper"].alias("upper")))
    best = known.withColumn("_best", F.array_min(ranked))
    return best.withColumns({"zone_lower": F.col("_best.lower"), "zone_upper": F.col("_best.upper"), "zone_distance_atr": F.col("_best.distance") / F.nullif(F.col("atr"), F.lit(0.0))}).drop("_zone", "_zones", "_best")


# fixed values
PUBLISHED = {"high_buffer": 0.05, "compression": 0.05, "near": 1.25, "lookback": 24}


def pressure(level: Column, atr: Column, relative: Column, *, high_buffer: float = 0.1, compression: float = 0.1, near: float = 1.0, lookback: int = 20) -> dict[str, Column]:
    """Five votes of pressure into a support level, from the last 8 bars against the 8 before; null until there are `lookback` bars. PUBLISHED has the thresholds of the execution study."""
    recent, prior = rows(-7, 0), rows(-15, -8)
    ready = F.count("close").over(rows(1 - lookback, 0)) == lookback
    mean8, mean20 = F.avg("close").over(recent), F.avg("close").over(rows(-19, 0))
    lower = F.max("high").over(recent) <= F.max("high").over(prior) - high_buffer * atr
    tighter = quotient(mean8 - level, atr) <= quotient(F.avg("close").over(prior) - level, atr) - compression
    close_by = quotient(F.col("close") - level, atr).between(-0.2, near)
    bearish = (F.col("close") <= mean8) & (mean8 <= mean20 + 0.05 * atr) & (F.sum((F.col("close") < F.col("open")).cast("int")).over(recent) >= 3)
    votes = {"lower_highs": lower, "close_compression": tighter, "near_support": close_by, "bearish_alignment": bearish, "relative_weakness": F.coalesce(relative, F.lit(0.0)) < 0}
    cast = {k: F.when(ready, F.coalesce(v, F.lit(False)).cast("long")) for k, v in votes.items()}
    score = sum(list(cast.values())[1:], list(cast.values())[0])
    return cast | {"pressure": score}


def setup_class(sweep: Column, breakdown: Column, retest: Column, rejection: Column, location_ok: Column, mtf_ok: Column, structure: Column, structure_1h: Column, supply_distance: Column, return_24h: Column) -> Column:
    """Which setup a bar shows; a reversal goes before a continuation and that before a fade. Null flags count as false, a null distance as far."""
    off = F.lit(False)
    sweep, breakdown, retest, rejection, location_ok, mtf_ok = (F.coalesce(c, off) for c in (sweep, breakdown, retest, rejection, location_ok, mtf_ok))
    near = lambda x: F.coalesce(supply_distance <= x, off)
    reversal = sweep & (rejection | near(1.0)) & (F.coalesce(return_24h, F.lit(0.0)) > 0)
    continuation = breakdown & (retest | location_ok) & mtf_ok & (structure >= 28)
    fade = near(0.75) & (rejection | (structure_1h >= 17)) & ~retest
    return F.when(reversal, "LIQUIDITY_REVERSAL").when(continuation, "TREND_CONTINUATION").when(fade, "SUPPLY_FADE").otherwise("UNCLASSIFIED")


def status_gate(score: Column, trigger: Column, structure_ok: Column, volatility_ok: Column, location_ok: Column, risk_ok: Column, *, ready: float, developing: float, watch: float) -> Column:
    """Status of a candidate from its score and its gates."""
    base = structure_ok & volatility_ok & risk_ok
    return F.when((score >= ready) & base & trigger & location_ok, "ENTRY_READY").when((score >= developing) & base, "DEVELOPING").when(score >= watch, "WATCH").otherwise("IGNORE")


def engine_status(candidates: DataFrame, thresholds: dict[str, float], watch: float = 50.0) -> DataFrame:
    """Status by the threshold of the candidate's engine (a small parameter, as a map literal), and the primary candidate of each symbol and ts."""
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in thresholds.items() for x in pair)), F.col("engine"))
    status = F.when(F.col("hard_ok") & F.col("risk_ok") & (F.col("score") >= limit), "ENTRY_READY").when(F.col("score") >= watch, "WATCH").otherwise("IGNORE")
    rank = F.when(F.col("status") == "ENTRY_READY", 0).when(F.col("status") == "WATCH", 1).otherwise(2)
    first = Window.partitionBy("symbol", "ts").orderBy(rank, F.col("score").desc_nulls_last(), "engine")
    return candidates.withColumn("status", status).withColumn("primary", F.row_number().over(first) == 1)


def trend_phase(structure: Column, exhaustion: Column, recovery: Column, fresh_break: Column) -> Column:
    """Phase of a downtrend from three scores."""
    return (
        F.when(recovery >= 4, "RECOVERY_RECLAIM").when(exhaustion >= 5, "EXHAUSTED_DOWNTREND").when((structure >= 4) & F.coalesce(fresh_break, F.lit(False)) & (exhaustion <= 2) & (recovery <= 2), "EARLY_DOWNTREND")
        .when((structure >= 5) & (exhaustion <= 4) & (recovery <= 2), "MATURE_DOWNTREND").otherwise("UNCONFIRMED")
    )


def consensus(direction: list[Column], context: list[Column], reversal: Column, *, power: float = 1.0, floor: float = 1e-4) -> Column:
    """Geometric means of two groups of probabilities, weighted 70 to 30, less the risk of a reversal."""

    def mean(group: list[Column]) -> Column:
        logs = [F.log(F.greatest(p, F.lit(floor))) for p in group]
        return sum(logs[1:], logs[0]) / len(logs)

    return F.exp(0.7 * mean(direction) + 0.3 * mean(context)) * F.pow(F.greatest(1 - reversal, F.lit(floor)), F.lit(power))


def path_class(signals: DataFrame, bars: DataFrame, step: int, early: int, late: int) -> DataFrame:
    """How the `late` bars after a short signal (entry, atr) went: moves in ATR after `early` and `late` bars, reclaim of the entry after the trough, class, and labels of persistence and reversal."""
    own = Window.partitionBy("symbol", "ts")
    t, n = F.unix_seconds("bar_ts"), ((F.unix_seconds("bar_ts") - F.unix_seconds("ts")) / step).cast("long")
    joined = forward_bars(signals.where("atr > 0"), bars, step * late).withColumn("_n", n).withColumn("_trough", F.min_by(t, F.struct("bar_low", t)).over(own))
    soon, after = F.col("_n") <= early, t > F.col("_trough")
    up, down, zero = (lambda c: F.col(c) - F.col("entry")), (lambda c: F.col("entry") - F.col(c)), F.lit(0.0)
    seen = joined.groupBy("symbol", "ts").agg(
        F.first("entry").alias("entry"), F.first("atr").alias("atr"), F.min(F.when(soon, F.col("bar_low"))).alias("_l1"), F.max(F.when(soon, F.col("bar_high"))).alias("_h1"), F.max_by("bar_close", F.when(soon, t)).alias("_c1"),
        F.min("bar_low").alias("_l2"), F.max_by("bar_close", t).alias("_c2"), F.first("_trough").alias("trough_t"), F.coalesce(F.bool_or(after & (F.col("bar_close") >= F.col("entry"))), F.lit(False)).alias("reclaimed"), F.max(F.when(after, F.col("bar_high"))).alias("_hr"),
    )
    atr = F.col("atr")
    moves = {"early_mfe_atr": F.greatest(zero, down("_l1")) / atr, "early_mae_atr": F.greatest(zero, up("_h1")) / atr, "late_mfe_atr": F.greatest(zero, down("_l2")) / atr, "rebound_atr": F.greatest(zero, F.coalesce(F.col("_hr") - F.col("_l2"), zero)) / atr, "early_lower": F.col("_c1") < F.col("entry"), "late_lower": F.col("_c2") < F.col("entry")}
    fast, slow, wrong = F.coalesce("early_mfe_atr", zero), F.coalesce("late_mfe_atr", zero), F.coalesce("early_mae_atr", zero)
    kind = (
        F.when((fast >= 0.5) & F.col("late_lower") & ~F.col("reclaimed"), "PERSISTENT_SHORT").when((fast >= 0.5) & (~F.col("late_lower") | F.col("reclaimed")), "SHORT_THEN_REVERSE")
        .when((fast < 0.5) & (slow >= 1) & F.col("late_lower"), "DELAYED_SHORT").when((wrong >= 0.5) & (fast < 0.5), "WRONG_WAY_EARLY").otherwise("MIXED")
    )
    return seen.withColumns(moves).withColumns({"path_class": kind, "persistent": F.col("early_lower") & F.col("late_lower"), "reversed": (slow >= 0.5) & F.col("reclaimed")}).drop("_l1", "_h1", "_c1", "_l2", "_c2", "_hr")


def reclaim_after(signals: DataFrame, bars: DataFrame, horizon: int, level: str, confirm: int) -> DataFrame:
    """When `confirm` later bars in a row close above the signal's level, the time of the last of them; signals without later bars have no row."""
    order = Window.partitionBy("symbol", "ts").orderBy("bar_ts")
    over = F.sum((F.col("bar_close") > F.col(level)).cast("int")).over(order.rowsBetween(1 - confirm, 0)) == confirm
    flagged = forward_bars(signals, bars, horizon).withColumn("_over", over)
    return flagged.groupBy("symbol", "ts").agg(F.min(F.when(F.col("_over"), F.unix_seconds("bar_ts"))).alias("reclaim_t"), F.max(F.greatest(F.lit(0.0), F.col("bar_close") - F.col(level))).alias("highest_above"))


def micro_trigger(ema20: Column, lower_high: Column, lower_low: Column, rejection: Column) -> Column:
    """Points (20 at most) of a short trigger on small bars: side of the mean, falling swings, a failed reclaim of the mean, a rejection, a break of the 8 lows and a sweep of the 12 highs before. Columns must exist on the bars."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    below = F.col("close") < ema20
    near = F.max((F.col("high") >= ema20 * 0.995).cast("int")).over(rows(-4, 0)) == 1
    rejected = F.max(rejection.cast("int")).over(rows(-3, 0)) == 1
    broke = F.col("close") < F.min("low").over(rows(-8, -1))
    top = F.max("high").over(rows(-12, -1))
    parts = [(4, below), (5, lower_high), (4, lower_low), (5, below & near), (3, rejected), (2, broke), (2, (F.col("high") > top * 1.0005) & (F.col("close") < top))]
    points = [F.when(yes(c), p).otherwise(0) for p, c in parts]
    return F.least(sum(points[1:], points[0]), F.lit(20)).cast("long")
