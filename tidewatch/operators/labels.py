"""Forward outcomes of short entries, as frames on the grid or as first hits over joined bars; no loop over trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.features import by_symbol, rows
from tidewatch.operators.matching import forward_bars


def horizon_labels(bars: DataFrame, step: int, horizons: tuple[int, ...]) -> DataFrame:
    """Entry at the next open; return, best and worst move within h bars, null where a bar is missing."""
    t, entry = F.unix_seconds("ts"), F.lead("open", 1).over(by_symbol())
    out = {"entry": entry}
    for h in horizons:
        whole = F.lead(t, h).over(by_symbol()) == t + h * step
        ahead = rows(1, h)
        out |= {f"short_{h}": F.when(whole, (entry - F.lead("close", h).over(by_symbol())) / entry * 100), f"mfe_{h}": F.when(whole, (entry - F.min("low").over(ahead)) / entry * 100), f"mae_{h}": F.when(whole, (F.max("high").over(ahead) - entry) / entry * 100)}
    return bars.withColumns(out)


def first_move(signals: DataFrame, bars: DataFrame, horizon: int, share: float) -> DataFrame:
    """Which of close * (1 -/+ share) is touched first: DOWN, UP, AMBIGUOUS in one bar, or NONE."""
    joined = forward_bars(signals, bars, horizon)
    hit = joined.groupBy("symbol", "ts").agg(F.min(F.when(F.col("bar_low") <= F.col("close") * (1 - share), F.unix_seconds("bar_ts"))).alias("down"), F.min(F.when(F.col("bar_high") >= F.col("close") * (1 + share), F.unix_seconds("bar_ts"))).alias("up"))
    first = F.when(F.col("down").isNull() & F.col("up").isNull(), "NONE").when(F.col("down") == F.col("up"), "AMBIGUOUS").when(F.coalesce("down", F.lit(2**62)) < F.coalesce("up", F.lit(2**62)), "DOWN").otherwise("UP")
    return hit.select("symbol", "ts", first.alias("first_move"))


def triple_barrier(signals: DataFrame, bars: DataFrame, horizon: int, *, reward: float = 2.0, cost_bps: float = 14.0) -> DataFrame:
    """Stop, target at `reward` risks, or time exit of a short with columns entry and stop; a bar that touches both counts as the stop.

    Gross and net result in risks, bars to the exit, best and worst move up to it. Signals without later bars are UNRESOLVED, without risk INVALID_RISK.
    """
    valid = signals.withColumn("risk", F.col("stop") - F.col("entry"))
    joined = forward_bars(valid.where("risk > 0"), bars, horizon)
    t = F.unix_seconds("bar_ts")
    keys = ["symbol", "ts"]
    target = F.col("entry") - reward * F.col("risk")
    hits = joined.groupBy(*keys).agg(F.min(F.when(F.col("bar_high") >= F.col("stop"), t)).alias("t_stop"), F.min(F.when(F.col("bar_low") <= target, t)).alias("t_target"), F.max(t).alias("t_last"))
    ended = hits.withColumn("t_exit", F.least(F.coalesce("t_stop", "t_last"), F.coalesce("t_target", "t_last")))
    path = joined.join(ended, keys).where(t <= F.col("t_exit")).groupBy(*keys).agg(F.first("t_stop").alias("t_stop"), F.first("t_target").alias("t_target"), F.count("*").alias("bars_to_exit"), F.min("bar_low").alias("lowest"), F.max("bar_high").alias("highest"), F.max_by("bar_close", t).alias("last_close"))
    out = valid.join(path, keys, "left")
    stopped = F.col("t_stop").isNotNull() & (F.coalesce("t_target", F.lit(2**62)) >= F.col("t_stop"))
    outcome = F.when(F.col("risk") <= 0, "INVALID_RISK").when(F.col("last_close").isNull(), "UNRESOLVED").when(stopped, "STOP").when(F.col("t_target").isNotNull(), "TARGET").otherwise("TIME")
    gross = F.when(outcome == "STOP", F.lit(-1.0)).when(outcome == "TARGET", F.lit(reward)).when(outcome == "TIME", (F.col("entry") - F.col("last_close")) / F.col("risk"))
    labelled = out.withColumns({"outcome": outcome, "gross_r": gross, "cost_r": F.when(F.col("risk") > 0, F.col("entry") * cost_bps / 1e4 / F.col("risk")), "mfe_r": (F.col("entry") - F.col("lowest")) / F.col("risk"), "mae_r": (F.col("highest") - F.col("entry")) / F.col("risk")})
    return labelled.withColumn("net_r", F.col("gross_r") - F.col("cost_r")).drop("t_stop", "t_target", "lowest", "highest", "last_close")


def target_grid(signals: DataFrame, bars: DataFrame, horizon: int, pairs: list[tuple[float, float]]) -> DataFrame:
    """Stop and target in percent for each pair of a small parameter list, in one pass over the joined bars."""
    grid = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("stop_pct"), F.lit(float(t)).alias("target_pct")) for s, t in pairs)))
    joined = forward_bars(signals, bars, horizon).withColumn("g", grid).select("*", "g.*").drop("g")
    t = F.unix_seconds("bar_ts")
    hits = joined.groupBy("symbol", "ts", "stop_pct", "target_pct").agg(F.min(F.when(F.col("bar_high") >= F.col("entry") * (1 + F.col("stop_pct") / 100), t)).alias("t_stop"), F.min(F.when(F.col("bar_low") <= F.col("entry") * (1 - F.col("target_pct") / 100), t)).alias("t_target"), F.first("entry").alias("entry"), F.max_by("bar_close", t).alias("last_close"))
    result = F.when(F.col("t_stop").isNotNull() & (F.coalesce("t_target", F.lit(2**62)) >= F.col("t_stop")), -F.col("stop_pct")).when(F.col("t_target").isNotNull(), F.col("target_pct")).otherwise((F.col("entry") - F.col("last_close")) / F.col("entry") * 100)
    return hits.withColumn("result_pct", result).drop("t_stop", "t_target", "last_close")


def hourly_path(signals: DataFrame, bars: DataFrame, step: int, points: int) -> DataFrame:
    """Close and running extremes at each of the next `points` bars."""
    joined = forward_bars(signals, bars, step * points)
    w = Window.partitionBy("symbol", "ts").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns({"point": ((F.unix_seconds("bar_ts") - F.unix_seconds("ts")) / step).cast("long"), "mfe": (F.col("entry") - F.min("bar_low").over(w)) / F.col("entry") * 100, "mae": (F.max("bar_high").over(w) - F.col("entry")) / F.col("entry") * 100})


def close_labels(bars: DataFrame, step: int, horizons: dict[str, int], n: int, cutoff: int) -> DataFrame:
    """Percent fall from this close to later closes, null unless the next `n` bars are all there and the last of them lies before the cutoff, so that nothing reaches into a holdout."""
    t, w = F.unix_seconds("ts"), by_symbol()
    whole = (F.lead(t, n).over(w) == t + n * step) & (t + n * step < cutoff)
    return bars.withColumns({f"fall_{k}": F.when(whole, (F.col("close") - F.lead("close", h).over(w)) / F.col("close") * 100) for k, h in horizons.items()})


def direction_labels(signals: DataFrame, bars: DataFrame, step: int, horizons: tuple[int, ...], first_bars: int, share: float = 0.5) -> DataFrame:
    """Moves in ATR (columns close, atr) within each horizon of bars, which of +/- share * ATR comes first, how many horizons closed lower, and the class of the direction. Signals without later bars have no row."""
    price, atr, zero = F.col("close"), F.col("atr"), F.lit(0.0)
    joined = forward_bars(signals.where("atr > 0"), bars, step * max(*horizons, first_bars)).withColumn("_n", (F.unix_seconds("bar_ts") - F.unix_seconds("ts")) / step)
    early = F.col("_n") <= first_bars
    out = [F.first("close").alias("close"), F.first("atr").alias("atr"), F.min(F.when(early & (F.col("bar_low") <= price - share * atr), F.col("_n"))).alias("_down"), F.min(F.when(early & (F.col("bar_high") >= price + share * atr), F.col("_n"))).alias("_up")]
    for h in horizons:
        within = F.col("_n") <= h
        out += [F.max_by("bar_close", F.when(within, F.col("_n"))).alias(f"_c{h}"), F.min(F.when(within, F.col("bar_low"))).alias(f"_l{h}"), F.max(F.when(within, F.col("bar_high"))).alias(f"_h{h}")]
    seen = joined.groupBy("symbol", "ts").agg(*out)
    moves = {}
    for h in horizons:
        moves |= {f"close_{h}_atr": (price - F.col(f"_c{h}")) / atr, f"mfe_{h}_atr": F.greatest(zero, price - F.col(f"_l{h}")) / atr, f"mae_{h}_atr": F.greatest(zero, F.col(f"_h{h}") - price) / atr, f"short_{h}": F.col(f"_c{h}") < price}
    never = F.lit(2**31)
    first = F.when(F.col("_down").isNull() & F.col("_up").isNull(), "NONE").when(F.col("_down") == F.col("_up"), "AMBIGUOUS").when(F.coalesce("_down", never) < F.coalesce("_up", never), "SHORT_FIRST").otherwise("ADVERSE_FIRST")
    votes = sum((F.coalesce(F.col(f"short_{h}"), F.lit(False)).cast("int") for h in horizons[1:]), F.coalesce(F.col(f"short_{horizons[0]}"), F.lit(False)).cast("int"))
    middle = F.coalesce(F.col(f"close_{horizons[len(horizons) // 2]}_atr"), zero)
    labelled = seen.withColumns(moves | {"first_move": first}).withColumn("votes", votes.cast("long"))
    label = F.when((F.col("first_move") == "SHORT_FIRST") & (F.col("votes") >= 2) & (middle > 0), "STRONG_SHORT_FOLLOWTHROUGH").when(F.col("votes") >= 2, "SHORT_FOLLOWTHROUGH").when(F.col("first_move") == "ADVERSE_FIRST", "BOTTOM_OR_WRONG_TIMING").otherwise("MIXED")
    return labelled.withColumn("direction", label).drop("_down", "_up", *(f"_{k}{h}" for k in "clh" for h in horizons))


def _numbered(signals: DataFrame, bars: DataFrame, step: int, n: int) -> DataFrame:
    """Each signal with its symbol's bars of the `n` slots from its ts on (that one included): slot (from 0 on) and place among the bars that are there. Where both agree, no bar before is missing."""
    from_entry = forward_bars(signals.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") - step)), bars, step * n)
    back = from_entry.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + step))
    place = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("bar_ts")) - 1
    return back.withColumns({"slot": ((F.unix_seconds("bar_ts") - F.unix_seconds("ts")) / step).cast("long"), "place": place.cast("long")})


def censored_barrier(signals: DataFrame, bars: DataFrame, step: int, hold: int, *, reward: float = 2.0, cost_bps: float = 14.0) -> DataFrame:
    """Stop, target at `reward` risks or time exit of a short (entry at the open of the bar at ts, stop) over `hold` bars that must follow each other without a gap.

    States: INVALID_PLAN, NO_NEXT_OPEN, GAP_BEYOND_STOP (the entry bar opens at the stop or above), SL_FIRST, SL_SAME_BAR (the stop wins over a target in one bar; a bar that opens above the
    stop exits at its open), TP2R_FIRST, TIME_EXIT, CENSORED_GAP and CENSORED_INCOMPLETE_HORIZON. A bar missing after the exit doesn't matter.
    """
    keys, risk = ["symbol", "ts"], F.col("stop") - F.col("entry")
    target = F.col("entry") - reward * risk
    valid = (F.col("entry") > 0) & (risk > 0) & (target > 0)
    joined = _numbered(signals.where(valid), bars, step, hold)
    own = (F.col("slot") == F.col("place"))
    hit_stop, hit_target = own & (F.col("bar_high") >= F.col("stop")), own & (F.col("bar_low") <= target)
    seen = joined.groupBy(*keys).agg(
        F.max(F.when(F.col("slot") == 0, F.col("bar_open"))).alias("_open"), F.min(F.when(hit_stop, F.col("slot"))).alias("_s"), F.min(F.when(hit_target, F.col("slot"))).alias("_p"), F.min_by("bar_open", F.when(hit_stop, F.col("slot"))).alias("_so"),
        F.count_if(own).alias("_whole"), F.count("*").alias("_bars"), F.max_by("bar_close", F.when(own, F.col("slot"))).alias("_last"),
    )
    out = signals.join(seen, keys, "left").withColumn("risk", risk)
    stopped = F.col("_s").isNotNull() & (F.coalesce("_p", F.col("_s")) >= F.col("_s"))
    state = (
        F.when(~F.coalesce(valid, F.lit(False)), "INVALID_PLAN").when(F.col("_open").isNull(), "NO_NEXT_OPEN").when(F.col("_open") >= F.col("stop"), "GAP_BEYOND_STOP").when(stopped & (F.col("_p") == F.col("_s")), "SL_SAME_BAR").when(stopped, "SL_FIRST")
        .when(F.col("_p").isNotNull(), "TP2R_FIRST").when(F.col("_whole") < F.col("_bars"), "CENSORED_GAP").when(F.col("_whole") < hold, "CENSORED_INCOMPLETE_HORIZON").otherwise("TIME_EXIT")
    )
    gross = F.when(F.col("state").isin("SL_FIRST", "SL_SAME_BAR"), (F.col("entry") - F.greatest("_so", "stop")) / F.col("risk")).when(F.col("state") == "TP2R_FIRST", F.lit(reward)).when(F.col("state") == "TIME_EXIT", (F.col("entry") - F.col("_last")) / F.col("risk"))
    held = F.when(F.col("state").isin("SL_FIRST", "SL_SAME_BAR"), F.col("_s") + 1).when(F.col("state") == "TP2R_FIRST", F.col("_p") + 1).when(F.col("state") == "TIME_EXIT", F.lit(hold).cast("long"))
    labelled = out.withColumn("state", state).withColumns({"gross_r": gross, "cost_r": cost_in_r(F.col("entry"), F.col("risk"), cost_bps), "hold_bars": held})
    return labelled.withColumn("net_r", F.col("gross_r") - F.col("cost_r")).drop("_open", "_s", "_p", "_so", "_whole", "_bars", "_last")


def cost_in_r(entry: Column, risk: Column, bps: float) -> Column:
    """Round-trip cost in risks; null without a risk."""
    return F.when(risk > 0, entry * bps / 1e4 / risk)


def cost_stress(trades: DataFrame, gross: str, entry: str, risk: str, levels: list[float]) -> DataFrame:
    """Net results at several cost levels, one row for each trade and level."""
    cells = F.array(*(F.struct(F.lit(float(b)).alias("cost_bps"), (F.col(gross) - cost_in_r(F.col(entry), F.col(risk), b)).alias("stressed_r")) for b in levels))
    return trades.select("*", F.inline(cells))


def path_study(signals: DataFrame, bars: DataFrame, step: int, horizons: tuple[int, ...], threshold: float) -> DataFrame:
    """Worst and best move in ATR (columns entry, atr; entry at the open of the bar at ts) and the bars to them for each horizon whose bars are all there, whether entry - threshold * ATR was reached within the longest one, when, and the worst move until then. One row for each signal and horizon."""
    keys, most = ["symbol", "ts"], max(horizons)
    joined = _numbered(signals.where("atr > 0"), bars, step, most).where(F.col("slot") == F.col("place"))
    grid = joined.withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in horizons)))).where(F.col("slot") < F.col("horizon"))
    entry, atr, zero, n = F.col("entry"), F.col("atr"), F.lit(0.0), F.col("slot") + 1
    seen = grid.groupBy(*keys, "horizon").agg(
        F.first("entry").alias("entry"), F.first("atr").alias("atr"), F.count("*").alias("_n"), F.max("bar_high").alias("_high"), F.min("bar_low").alias("_low"), F.max_by(n, F.struct("bar_high", -n)).alias("bars_to_mae"), F.min_by(n, F.struct("bar_low", n)).alias("bars_to_mfe"), F.max_by("bar_close", n).alias("_close"),
    ).where(F.col("_n") == F.col("horizon"))
    hit = joined.withColumn("_hit", F.min(F.when(F.col("bar_low") <= entry - threshold * atr, n)).over(Window.partitionBy(*keys))).groupBy(*keys).agg(F.count("*").alias("_all"), F.first("_hit").alias("_hit"), F.max(F.when(n <= F.col("_hit"), F.col("bar_high"))).alias("_upto"))
    both = seen.join(hit, keys)
    known = (F.col("_all") == most) | F.col("_hit").isNotNull()
    return both.select(*keys, F.col("horizon").cast("long").alias("horizon"), (F.greatest(zero, F.col("_high") - entry) / atr).alias("mae_atr"), (F.greatest(zero, entry - F.col("_low")) / atr).alias("mfe_atr"), "bars_to_mae", "bars_to_mfe", ((entry - F.col("_close")) / atr).alias("close_atr"),
                       F.when(known, F.col("_hit").isNotNull()).alias("hit"), F.col("_hit").alias("bars_to_hit"), (F.greatest(zero, F.col("_upto") - entry) / atr).alias("mae_before_hit_atr"))


def path_checkpoints(signals: DataFrame, bars: DataFrame, market: DataFrame, step: int, points: tuple[int, ...], block: int) -> DataFrame:
    """Where a short signal (close, atr) stands after each of the checkpoints: move and extremes in ATR, the market's return (market: ts, level) and the return against it; and the move within the block of bars that ends there, if one does. One row for each signal and checkpoint that has bars."""
    keys, price, atr, zero = ["symbol", "ts"], F.col("close"), F.col("atr"), F.lit(0.0)
    joined = forward_bars(signals.where("atr > 0"), bars, step * max(points)).withColumn("_n", ((F.unix_seconds("bar_ts") - F.unix_seconds("ts")) / step).cast("int"))
    grid = joined.withColumn("point", F.explode(F.array(*(F.lit(p) for p in points)))).where(F.col("_n") <= F.col("point"))
    inside = F.col("_n") > F.col("point") - block
    seen = grid.groupBy(*keys, "point").agg(
        F.first("close").alias("close"), F.first("atr").alias("atr"), F.max_by("bar_close", "_n").alias("_c"), F.min("bar_low").alias("_l"), F.max("bar_high").alias("_h"), F.max_by("bar_close", F.when(~inside, F.col("_n"))).alias("_before"), F.count_if(inside).alias("_in"),
    )
    level = lambda name, at: market.select(F.unix_seconds("ts").alias(at), F.col("level").alias(name))
    timed = seen.withColumns({"_a": F.unix_seconds("ts"), "_b": F.unix_seconds("ts") + F.col("point") * step}).join(level("_m0", "_a"), "_a", "left").join(level("_m1", "_b"), "_b", "left")
    own, of_market = (F.col("_c") / price - 1) * 100, (F.col("_m1") / F.col("_m0") - 1) * 100
    ends_block = (F.col("point") % block == 0) & (F.col("_in") > 0)
    return timed.select(*keys, F.col("point").cast("long").alias("point"), ((price - F.col("_c")) / atr).alias("close_atr"), (F.greatest(zero, price - F.col("_l")) / atr).alias("mfe_atr"), (F.greatest(zero, F.col("_h") - price) / atr).alias("mae_atr"), of_market.alias("market_pct"), (own - of_market).alias("relative_pct"), F.when(ends_block, (F.coalesce(F.col("_before"), price) - F.col("_c")) / atr).alias("block_atr"))
