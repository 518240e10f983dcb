"""Outcomes that hang on the order of several later bars: first-after joins, fills, ladders, delayed and slipped entries, what follows a stop.

Each takes signals (symbol, ts, entry, stop; one row for each symbol and ts), meets them with later bars through the bucketed equi-join and aggregates by the signal. First hits
are minima of conditional times, so one shuffle by signal serves all stages; no loop over trades or bars. A bar that touches both sides counts as the bad one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.matching import forward_bars

_NEVER = 2**62
_KEYS = ["symbol", "ts"]


def _t() -> Column:
    return F.unix_seconds("bar_ts")


def _before(a: str, b: str) -> Column:
    """a happened, and not after b."""
    return F.col(a).isNotNull() & (F.col(a) <= F.coalesce(b, F.lit(_NEVER)))


def first_after(signals: DataFrame, bars: DataFrame, horizon: int, wanted: Column, barred: Column | None = None) -> DataFrame:
    """hit_t, the time of the first later bar within the horizon that is `wanted`, unless a bar that is `barred` comes before or with it; all signals stay."""
    joined = forward_bars(signals, bars, horizon)
    times = joined.groupBy(*_KEYS).agg(F.min(F.when(wanted, _t())).alias("_hit"), F.min(F.when(F.lit(False) if barred is None else barred, _t())).alias("barred_t"))
    found = times.withColumn("hit_t", F.when(F.col("_hit") < F.coalesce("barred_t", F.lit(_NEVER)), F.col("_hit"))).drop("_hit")
    return signals.join(found, _KEYS, "left")


def limit_fill(signals: DataFrame, bars: DataFrame, step: int, wait: int, limit: str = "limit_price") -> DataFrame:
    """The first of the next `wait` bars that reaches a short's limit price from below; a bar that opens beyond it is marked as gapped."""
    joined = forward_bars(signals, bars, step * wait)
    first = joined.where(F.col("bar_high") >= F.col(limit)).groupBy(*_KEYS).agg(F.min(_t()).alias("fill_t"), F.min_by("bar_open", _t()).alias("_open"))
    out = signals.join(first, _KEYS, "left")
    state = F.when(F.col("fill_t").isNull(), "NO_FILL").when(F.col("_open") >= F.col(limit), "FILLED_GAP").otherwise("FILLED")
    return out.withColumns({"fill_state": state, "wait_bars": ((F.col("fill_t") - F.unix_seconds("ts")) / step).cast("long") - 1}).drop("_open")


def ladder(signals: DataFrame, bars: DataFrame, horizon: int, *, first: float = 1.0, second: float = 2.0, weight: float = 0.5, cost_bps: float = 14.0) -> DataFrame:
    """Two legs of a short: `weight` of it leaves at `first` risks, the rest at `second`, at the entry price from the next bar on, or at the end.

    A stop fills at the worse of its price and the bar's open. Signals without later bars are UNRESOLVED, without risk INVALID.
    """
    valid = signals.withColumn("risk", F.col("stop") - F.col("entry"))
    tp1, tp2 = F.col("entry") - first * F.col("risk"), F.col("entry") - second * F.col("risk")
    own = Window.partitionBy(*_KEYS)
    joined = forward_bars(valid.where("risk > 0"), bars, horizon).withColumn("_tp1", F.min(F.when(F.col("bar_low") <= tp1, _t())).over(own))
    stopped = F.col("bar_high") >= F.col("stop")
    hits = joined.groupBy(*_KEYS).agg(
        F.first("_tp1").alias("tp1_t"), F.min(F.when(stopped, _t())).alias("stop_t"), F.min_by("bar_open", F.when(stopped, _t())).alias("_stop_open"),
        F.min(F.when(F.col("bar_low") <= tp2, _t())).alias("tp2_t"), F.min(F.when((_t() > F.col("_tp1")) & (F.col("bar_high") >= F.col("entry")), _t())).alias("be_t"), F.max_by("bar_close", _t()).alias("_last"),
    )
    out = valid.join(hits, _KEYS, "left")
    state = (
        F.when(F.coalesce(F.col("risk") <= 0, F.lit(True)), "INVALID").when(F.col("_last").isNull(), "UNRESOLVED").when(_before("stop_t", "tp1_t"), "SL_FIRST")
        .when(F.col("tp1_t").isNull(), "TIME_EXIT").when(_before("be_t", "tp2_t"), "TP1_THEN_BE").when(F.col("tp2_t").isNotNull(), "TP2_FULL").otherwise("TP1_TIME_EXIT")
    )
    last_r = (F.col("entry") - F.col("_last")) / F.col("risk")
    kept = F.lit(weight * first)
    gross = (
        F.when(F.col("state") == "SL_FIRST", (F.col("entry") - F.greatest("_stop_open", "stop")) / F.col("risk")).when(F.col("state") == "TIME_EXIT", last_r)
        .when(F.col("state") == "TP1_THEN_BE", kept).when(F.col("state") == "TP2_FULL", kept + (1 - weight) * second).when(F.col("state") == "TP1_TIME_EXIT", kept + (1 - weight) * last_r)
    )
    exit_t = F.when(F.col("state") == "SL_FIRST", F.col("stop_t")).when(F.col("state") == "TP1_THEN_BE", F.col("be_t")).when(F.col("state") == "TP2_FULL", F.col("tp2_t"))
    labelled = out.withColumn("state", state).withColumns({"gross_r": gross, "exit_t": exit_t})
    return labelled.withColumn("net_r", F.col("gross_r") - F.col("entry") * cost_bps / 1e4 / F.col("risk")).drop("_last", "_stop_open")


def slipped_entries(signals: DataFrame, bars: DataFrame, step: int, hold: int, delays: list[int], slips: list[float], barriers: list[tuple[float, float]], fee_bps: float = 5.0) -> DataFrame:
    """Fixed event clock: a short enters at the open of bar `delay`, leaves at the close of bar `hold`, or by a barrier set from the slipped entry.

    One row for each signal, delay, slippage and (stop, target) in percent. Both legs pay the slippage and the fee; opens beyond the stop fill there. Signals whose
    next `hold` bars aren't all present give no row. The parameter lists are small; the barriers are aggregated in one shuffle.
    """
    n = ((_t() - F.unix_seconds("ts")) / step).cast("long")
    joined = forward_bars(signals.select(*_KEYS), bars, step * hold).withColumn("n", n)
    by_delay = joined.withColumn("delay", F.explode(F.array(*(F.lit(d) for d in delays)))).withColumn("_entry", F.max(F.when(F.col("n") == F.col("delay"), F.col("bar_open"))).over(Window.partitionBy(*_KEYS, "delay"))).withColumn("_bars", F.count("*").over(Window.partitionBy(*_KEYS, "delay")))
    path = by_delay.where((F.col("_bars") == hold) & (F.col("n") >= F.col("delay")))
    grid = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("slip_bps"), F.lit(float(s)).alias("stop_pct"), F.lit(float(p)).alias("target_pct")) for b in slips for s, p in barriers)))
    laid = path.withColumn("g", grid).select("*", "g.*").withColumn("_sold", F.col("_entry") * (1 - F.col("slip_bps") / 1e4))
    stop, target = F.col("_sold") * (1 + F.col("stop_pct") / 100), F.col("_sold") * (1 - F.col("target_pct") / 100)
    hit = F.col("bar_high") >= stop
    exits = laid.groupBy(*_KEYS, "delay", "slip_bps", "stop_pct", "target_pct").agg(
        F.first("_entry").alias("entry"), F.first("_sold").alias("_sold"), F.min(F.when(hit, F.col("n"))).alias("_s"), F.min_by(F.greatest("bar_open", stop), F.when(hit, F.col("n"))).alias("_at_stop"),
        F.min_by(F.col("bar_open") >= stop, F.when(hit, F.col("n"))).alias("_gap"), F.min(F.when(F.col("bar_low") <= target, F.col("n"))).alias("_p"), F.max_by("bar_close", "n").alias("_close"),
    )
    stopped = _before("_s", "_p")
    reason = F.when(stopped & F.col("_gap"), "GAP_STOP").when(stopped & (F.col("_s") == F.col("_p")), "SL_FIRST_SAME_BAR").when(stopped, "SL").when(F.col("_p").isNotNull(), "TP").otherwise("HORIZON_CLOSE")
    raw = F.when(stopped, F.col("_at_stop")).when(F.col("_p").isNotNull(), F.col("_sold") * (1 - F.col("target_pct") / 100)).otherwise(F.col("_close"))
    bought = raw * (1 + F.col("slip_bps") / 1e4)
    net = (F.col("_sold") - bought - (F.col("_sold") + bought) * fee_bps / 1e4) / F.col("_sold") * 100
    return exits.withColumns({"reason": reason, "net_pct": net}).drop("_sold", "_s", "_at_stop", "_gap", "_p", "_close")


def after_stop(signals: DataFrame, bars: DataFrame, horizon: int, watch: int, target: float = 2.0) -> DataFrame:
    """What the bars after a stop did, its own bar excluded: levels reached again, best move, further adverse move and a class; only stopped signals have rows."""
    risk = F.col("stop") - F.col("entry")
    valid = signals.where(risk > 0)
    own = Window.partitionBy(*_KEYS)
    joined = forward_bars(valid, bars, horizon + watch)
    in_time = _t() - F.unix_seconds("ts") <= horizon
    stopped = joined.withColumn("stop_t", F.min(F.when(in_time & (F.col("bar_high") >= F.col("stop")), _t())).over(own)).where(F.col("stop_t").isNotNull())
    later = (_t() > F.col("stop_t")) & (_t() <= F.col("stop_t") + watch)
    seen = stopped.groupBy(*_KEYS).agg(F.first("stop_t").alias("stop_t"), F.first("entry").alias("entry"), F.first("stop").alias("stop"), F.min(F.when(later, F.col("bar_low"))).alias("_low"), F.max(F.when(later, F.col("bar_high"))).alias("_high"), F.count_if(later).alias("bars_after"))
    reached = lambda k: F.col("_low") <= F.col("entry") - k * risk
    kind = F.when(F.col("_low").isNull(), "NO_DATA").when(reached(target), "FALSE_STOP_THEN_TARGET").when(reached(1.0), "FALSE_STOP_THEN_1R").when(reached(0.0), "STOP_THEN_RECLAIM_ENTRY").otherwise("VALID_STOP")
    zero = F.lit(0.0)
    return seen.withColumns({"post_stop_class": kind, "mfe_r": F.when(F.col("_low").isNotNull(), F.greatest(zero, F.col("entry") - F.col("_low")) / risk), "extra_adverse_r": F.when(F.col("_high").isNotNull(), F.greatest(zero, F.col("_high") - F.col("stop")) / risk)}).drop("_low", "_high")


def reentry(signals: DataFrame, bars: DataFrame, horizon: int, window: int) -> DataFrame:
    """After a stop, the first bar within `window` seconds that closes below the entry again sells anew at the next bar's open, with the same risk above it."""
    own = Window.partitionBy(*_KEYS)
    order = own.orderBy("bar_ts")
    joined = forward_bars(signals.where("stop > entry"), bars, horizon + window).withColumn("_next", F.struct(F.lead("bar_open").over(order).alias("entry"), F.lead(_t()).over(order).alias("t")))
    in_time = _t() - F.unix_seconds("ts") <= horizon
    stopped = joined.withColumn("stop_t", F.min(F.when(in_time & (F.col("bar_high") >= F.col("stop")), _t())).over(own))
    back = (_t() > F.col("stop_t")) & (_t() <= F.col("stop_t") + window) & (F.col("bar_close") < F.col("entry"))
    out = stopped.where(F.col("stop_t").isNotNull()).groupBy(*_KEYS).agg(F.first("stop_t").alias("stop_t"), F.first(F.col("stop") - F.col("entry")).alias("_risk"), F.min(F.when(back, _t())).alias("reclaim_t"), F.min_by("_next", F.when(back, _t())).alias("_n"))
    return out.select(*_KEYS, "stop_t", "reclaim_t", F.col("_n.t").alias("reentry_t"), F.col("_n.entry").alias("reentry"), (F.col("_n.entry") + F.col("_risk")).alias("reentry_stop"))


def reentry_sequence(primary: DataFrame, again: DataFrame, bars: DataFrame, horizon: int, *, reward: float = 2.0, cost_bps: float = 14.0) -> DataFrame:
    """Net result of a short and of its one re-entry after a stop (reentry's rows), and their sum; a signal without a re-entry keeps its own result. `primary` has symbol, ts, outcome and net_r."""
    from tidewatch.operators.labels import triple_barrier

    second = again.where("reentry_t IS NOT NULL AND reentry_stop > reentry").select("symbol", F.col("ts").alias("_ts"), F.timestamp_seconds("reentry_t").alias("ts"), F.col("reentry").alias("entry"), F.col("reentry_stop").alias("stop"))
    # several signals may sell anew at one bar: its outcome is labelled once for each plan
    plans = second.select("symbol", "ts", "entry", "stop").distinct().withColumn("_plan", F.concat_ws("|", "symbol", F.col("entry").cast("string"), F.col("stop").cast("string")))
    keyed = plans.select(F.col("_plan").alias("symbol"), "ts", "entry", "stop", F.col("symbol").alias("_symbol"))
    own_bars = bars.join(keyed.select(F.col("symbol").alias("_plan"), F.col("_symbol").alias("symbol")).distinct(), "symbol").withColumn("symbol", F.col("_plan")).drop("_plan")
    labelled = triple_barrier(keyed.drop("_symbol"), own_bars, horizon, reward=reward, cost_bps=cost_bps).select(F.col("symbol").alias("_plan"), "ts", F.col("net_r").alias("second_r"))
    named = second.withColumn("_plan", F.concat_ws("|", "symbol", F.col("entry").cast("string"), F.col("stop").cast("string"))).join(labelled, ["_plan", "ts"]).select("symbol", F.col("_ts").alias("ts"), "second_r")
    out = primary.join(named, _KEYS, "left")
    return out.withColumn("sequence_r", F.col("net_r") + F.coalesce("second_r", F.lit(0.0)))


def rebased_controls(matches: DataFrame, bars: DataFrame, lag: int, hold: int) -> DataFrame:
    """Controls stay as matched at the event; case and controls are both measured anew from `lag` to `hold` seconds later. matches: c_symbol, c_ts, p_symbol."""
    both = matches.select("c_symbol", "c_ts", F.explode(F.array(F.struct(F.col("c_symbol").alias("symbol"), F.lit(True).alias("is_case")), F.struct(F.col("p_symbol").alias("symbol"), F.lit(False).alias("is_case")))).alias("x")).select("c_symbol", "c_ts", "x.*").distinct()
    timed = both.withColumns({"_in": F.unix_seconds("c_ts") + lag, "_out": F.unix_seconds("c_ts") + hold})
    price = lambda name, at: bars.select("symbol", F.unix_seconds("ts").alias(at), F.col("close").alias(name))
    measured = timed.join(price("_a", "_in"), ["symbol", "_in"], "left").join(price("_b", "_out"), ["symbol", "_out"], "left").withColumn("outcome", (F.col("_a") - F.col("_b")) / F.col("_a") * 100)
    return measured.groupBy("c_symbol", "c_ts").agg(F.max(F.when(F.col("is_case"), F.col("outcome"))).alias("case_outcome"), F.avg(F.when(~F.col("is_case"), F.col("outcome"))).alias("control_mean"), F.count(F.when(~F.col("is_case"), F.col("outcome"))).alias("controls")).withColumn("edge", F.col("case_outcome") - F.col("control_mean"))


def plan_reason(entry: Column, stop: Column, atr: Column, *, max_stop_pct: float = 6.0, max_risk_atr: float = 1.8, max_cost_r: float = 0.25, cost_bps: float = 14.0) -> Column:
    """Why a short's plan is skipped; null if it holds."""
    risk = stop - entry
    bad = entry.isNull() | stop.isNull() | atr.isNull() | (entry <= 0) | (risk <= 0) | (atr <= 0)
    return F.when(bad, "INVALID_PLAN").when(100 * risk / entry > max_stop_pct, "SKIP_STOP_PCT").when(risk / atr > max_risk_atr, "SKIP_RISK_TOO_WIDE").when(cost_bps / 1e4 * entry / risk > max_cost_r, "SKIP_COST_R")


def fill_then_barrier(signals: DataFrame, bars: DataFrame, wait: int, horizon: int, limit: str = "limit_price", reward: float = 2.0, fill_bar: str = "none") -> DataFrame:
    """A short's limit order that must fill within `wait` seconds, then its stop or target within `horizon` seconds after the bar that filled it. All signals stay.

    `fill_bar` says what counts of the bar that filled it, whose path before and after the fill isn't known: "none" of it, "stop" only (the cautious reading: its low may have come before the fill), or "both".
    """
    if fill_bar not in ("none", "stop", "both"):
        raise ValueError(fill_bar)
    own = Window.partitionBy(*_KEYS)
    price, risk = F.col(limit), F.col("stop") - F.col(limit)
    due = (F.col("bar_high") >= price) & (_t() - F.unix_seconds("ts") <= wait)
    joined = forward_bars(signals.where(risk > 0), bars, wait + horizon).withColumn("fill_t", F.min(F.when(due, _t())).over(own))
    held = joined.where((_t() >= F.col("fill_t")) & (_t() <= F.col("fill_t") + horizon))
    later = _t() > F.col("fill_t")
    stops, wins = (F.lit(True) if fill_bar in allowed else later for allowed in (("stop", "both"), ("both",)))
    hits = held.groupBy(*_KEYS).agg(F.first("fill_t").alias("fill_t"), F.min(F.when(stops & (F.col("bar_high") >= F.col("stop")), _t())).alias("stop_t"), F.min(F.when(wins & (F.col("bar_low") <= price - reward * risk), _t())).alias("target_t"), F.max_by("bar_close", _t()).alias("_last"))
    out = signals.join(hits, _KEYS, "left")
    state = F.when(risk <= 0, "INVALID_RISK").when(F.col("fill_t").isNull(), "NO_FILL").when(_before("stop_t", "target_t"), "STOP").when(F.col("target_t").isNotNull(), "TARGET").otherwise("TIME")
    gross = F.when(state == "STOP", F.lit(-1.0)).when(state == "TARGET", F.lit(reward)).when(state == "TIME", (price - F.col("_last")) / risk)
    return out.withColumns({"state": state, "gross_r": gross}).drop("_last")


def three_stages(signals: DataFrame, bars: DataFrame, horizon: int, *, targets: tuple[float, float, float] = (1.0, 2.0, 4.0), weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Three legs of a short. After the first target the rest leaves at the entry, after the second at the first target, each from the next bar on; what is left at the end leaves at the last close.

    stages: how many targets were reached; state: how the last leg ended. Three chained first-hit times over one partitioning by signal.
    """
    own = Window.partitionBy(*_KEYS)
    risk = F.col("stop") - F.col("entry")
    level = lambda k: F.col("entry") - targets[k] * risk
    low = lambda k: F.col("bar_low") <= level(k)
    first = lambda c: F.min(F.when(c, _t())).over(own)
    joined = forward_bars(signals.where(risk > 0), bars, horizon).withColumns({"_s": first(F.col("bar_high") >= F.col("stop")), "_1": first(low(0)), "_2": first(low(1)), "_3": first(low(2))})
    one = joined.withColumn("_be", first((_t() > F.col("_1")) & (F.col("bar_high") >= F.col("entry")))).withColumn("_trail", first((_t() > F.col("_2")) & (F.col("bar_high") >= level(0))))
    hits = one.groupBy(*_KEYS).agg(*(F.first(c).alias(c) for c in ("_s", "_1", "_2", "_3", "_be", "_trail")), F.max_by("bar_close", _t()).alias("_last"))
    out = signals.join(hits, _KEYS, "left")
    sooner = lambda a, b: F.col(a).isNotNull() & (F.col(a) < F.coalesce(b, F.lit(_NEVER)))
    s1 = sooner("_1", "_s")
    s2 = s1 & sooner("_2", "_be")
    s3 = s2 & sooner("_3", "_trail")
    stages = F.when(F.col("_last").isNull(), F.lit(None)).when(s3, 3).when(s2, 2).when(s1, 1).otherwise(0).cast("long")
    n, at_end = F.col("stages"), (F.col("entry") - F.col("_last")) / risk
    state = (
        F.when(n.isNull(), "UNRESOLVED").when((n == 0) & F.col("_s").isNotNull(), "STOP").when((n == 1) & F.col("_be").isNotNull(), "BREAK_EVEN").when((n == 2) & F.col("_trail").isNotNull(), "TRAILED").when(n == 3, "RUNNER").otherwise("TIME")
    )
    a, b, c = weights
    r1, r2, r3 = targets
    rest = F.when(n == 0, 1.0).when(n == 1, b + c).when(n == 2, c).otherwise(0.0)
    banked = F.when(n == 0, 0.0).when(n == 1, a * r1).when(n == 2, a * r1 + b * r2).when(n == 3, a * r1 + b * r2 + c * r3)
    leaves = F.when(F.col("state") == "STOP", -1.0).when(F.col("state") == "BREAK_EVEN", 0.0).when(F.col("state") == "TRAILED", r1).when(F.col("state") == "RUNNER", 0.0).otherwise(at_end)
    return out.withColumn("stages", stages).withColumn("state", state).withColumn("gross_r", banked + rest * leaves).drop("_s", "_1", "_2", "_3", "_be", "_trail", "_last")


def level_freshness(levels: DataFrame, bars: DataFrame, step: int, age: int, max_touches: int) -> DataFrame:
    """Levels (symbol, ts, lower, upper; one for each symbol and ts) `age` seconds later: closed through, entered too often, or FRESH. The last bar may be the retest itself, so it counts as no touch."""
    order = Window.partitionBy(*_KEYS).orderBy("bar_ts")
    touch = (F.col("bar_high") >= F.col("lower")) & (F.col("bar_low") <= F.col("upper"))
    joined = forward_bars(levels, bars, age).withColumns({"_touch": touch, "_more": F.lead("bar_ts").over(order).isNotNull()}).withColumn("_enter", F.col("_touch") & ~F.coalesce(F.lag("_touch").over(order), F.lit(False)))
    seen = joined.groupBy(*_KEYS).agg(F.count("*").alias("age_bars"), F.count_if(F.col("_enter") & F.col("_more")).alias("touches"), F.min(F.when(F.col("bar_close") > F.col("upper"), _t())).alias("broken_t"))
    out = levels.join(seen, _KEYS, "left").fillna(0, ["age_bars", "touches"])
    return out.withColumn("freshness", F.when(F.col("broken_t").isNotNull(), "INVALIDATED_CLOSE_ABOVE").when(F.col("touches") > max_touches, "TOO_MANY_PRIOR_TOUCHES").otherwise("FRESH"))


def plan_ladder(entry: Column, anchor: Column, atr: Column, support: Column, *, buffer: float = 0.1, floor_atr: float = 1.0, targets: tuple[float, ...] = (2.0, 3.0, 5.0), cost_bps: float = 14.0, max_stop_pct: float = 6.0, min_room: float = 1.5, max_cost_r: float = 0.25) -> dict[str, Column]:
    """Stop above the anchor with a floor in ATR, targets in risks, room to the support (5 where none lies below), cost in risks and whether the plan holds."""
    risk = F.greatest(anchor + buffer * atr - entry, floor_atr * atr)
    ok = F.when(atr > 0, risk)
    room = F.when(support < entry, (entry - support) / ok).otherwise(F.when(ok.isNotNull(), 5.0))
    cost = entry * cost_bps / 1e4 / ok
    held = (100 * ok / entry <= max_stop_pct) & (room >= min_room) & (cost <= max_cost_r)
    return {"plan_stop": entry + ok, "plan_risk": ok, "room_r": room, "plan_cost_r": cost, "risk_ok": F.coalesce(held, F.lit(False))} | {f"tp{k}": entry - r * ok for k, r in enumerate(targets, 1)}
