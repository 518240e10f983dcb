"""Point scores, risks and gates over signal rows (signals.signal_rows), as plain Columns: Catalyst evaluates each in the stage that reads the row.

Every score is a sum of named parts, each a short table of bounds and points. The numbers are fixed values of the published rules.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import clamp, quotient

MIN_ATR_PCT, MAX_ATR_PCT, MAX_STOP_PCT, MIN_STOP_ATR, MAX_ENTRY_ATR = 0.25, 12.0, 8.0, 0.8, 0.65
READY, DEVELOPING, WATCH = 80.0, 70.0, 60.0
COST_BPS = 14.0
c = F.col


def yes(x: Column) -> Column:
    """Null flags count as false."""
    return F.coalesce(x, F.lit(False))


def first_of(*rules: tuple[Column, float], otherwise: float = 0.0) -> Column:
    """The points of the first rule that holds."""
    out = F.lit(float(otherwise))
    for holds, points in reversed(rules):
        out = F.when(yes(holds), F.lit(float(points))).otherwise(out)
    return out


def at_least(x: Column, *steps: tuple[float, float], otherwise: float = 0.0) -> Column:
    return first_of(*((x >= bound, points) for bound, points in steps), otherwise=otherwise)


def at_most(x: Column, *steps: tuple[float, float], otherwise: float = 0.0) -> Column:
    return first_of(*((x <= bound, points) for bound, points in steps), otherwise=otherwise)


def on(flag: Column, points: float) -> Column:
    return first_of((flag, points))


def total(parts: list[Column]) -> Column:
    return reduce(add, parts)


def reasons(named: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_join(F.filter(F.array(*(F.when(yes(p), F.lit(k)) for k, p in named.items())), lambda x: x.isNotNull()), ";")


def _atr() -> Column:
    return F.greatest(c("atr"), F.lit(1e-12))


def _below_ema() -> Column:
    return (c("ema20") - c("close")) / _atr()


def liquidity_points() -> Column:
    return at_least(c("turnover"), (50_000_000, 12), (10_000_000, 10), (2_000_000, 7), (500_000, 4))


def funding_points() -> Column:
    return first_of((c("funding_rate") >= 0.0008, 5), (c("funding_rate") >= 0.0002, 3), (c("funding_rate") <= -0.001, -8), (c("funding_rate") <= -0.0004, -4))


def spread_penalty() -> Column:
    return first_of((c("spread_bps") > 60, -20), (c("spread_bps") > 40, -12), (c("spread_bps") > 25, -6))


def fast_score() -> dict[str, Column]:
    """The fast score (0 to 100) and its parts. Needs spread_bps, funding_rate and change24 beside the signal row."""
    r4, r12, gap = c("ret4"), c("ret12"), F.abs(c("close") - c("ema20")) / _atr()
    under_high = F.greatest(F.lit(0.0), c("prior_high20") - c("close")) / _atr()
    structure = total([first_of((c("ema_bear"), 18), (c("close") < c("ema20"), 9)), on(c("lower_high"), 8), on(c("lower_low"), 8), on(c("macro_bear"), 5)])
    stretched = F.when(_below_ema() > 2.2, -F.floor(F.least(F.lit(20.0), (_below_ema() - 2.2) * 6)).cast("double")).otherwise(0.0)  # at most 20 first: a whole number of NaN would be 0
    parts = {
        "bear_structure": F.least(F.lit(34.0), structure),
        "momentum": total([first_of(((r4 >= -6) & (r4 <= -0.25), 8), ((r4 >= -10) & (r4 < -6), 4)), on((r12 >= -12) & (r12 <= -0.5), 6), on((r4 > 0) & (under_high <= 1), 5)]),
        "location": first_of((gap <= 0.45, 12), (gap <= 0.9, 8), (under_high <= 0.8, 7), (under_high <= 1.5, 4)),
        "volatility": first_of(((c("atr_pct") >= 0.35) & (c("atr_pct") <= 5), 10), ((c("atr_pct") >= MIN_ATR_PCT) & (c("atr_pct") <= MAX_ATR_PCT), 6)),
        "volume": at_least(c("volume_ratio"), (1.5, 8), (1.0, 5), otherwise=2),
        "liquidity": liquidity_points(),
        "funding": funding_points(),
        "spread_penalty": spread_penalty(),
        "chase_penalty": total([on(r4 < -8, -8), on(r12 < -18, -10), stretched, on(c("change24") < -30, -12), on(F.abs(c("change24")) > 80, -15)]),
    }
    return parts | {"fast_score": clamp(total(list(parts.values())), 0, 100)}


def plan(stop_anchor: Column, buffer: float, least_risk: float, *, atr: Column | None = None, entry: Column | None = None) -> dict[str, Column]:
    """Risk of a short from an anchor above it, and the stop."""
    entry = c("close") if entry is None else entry
    a = c("atr") if atr is None else atr
    risk = F.greatest(stop_anchor + buffer * a - entry, least_risk * a)
    return {"risk": risk, "stop": entry + risk, "stop_pct": quotient(risk, entry) * 100}


def room(entry: Column, risk: Column) -> Column:
    """Risks down to the nearest support; 5 where none is known."""
    return F.when(c("nearest_support") < entry, (entry - c("nearest_support")) / F.greatest(risk, F.lit(1e-12))).otherwise(5.0)


def with_deep_score(rows: DataFrame) -> DataFrame:
    """The deep score of two time frames with its plan (stop, room, targets), gates, status and reasons."""
    zone = lambda k: F.when(c(f"{k}zone_upper") >= c("close"), c(f"{k}zone_upper"))
    anchor = F.greatest(c("high12"), zone(""), zone("s4_"))
    laid = rows.withColumns(plan(anchor, 0.15, MIN_STOP_ATR)).withColumns({"pullback_atr": F.abs(c("close") - c("ema20")) / _atr(), "ema20_distance": _below_ema()})
    laid = laid.withColumn("room_r", F.greatest(room(c("close"), c("risk")), F.lit(0.0)))
    near, gap, r4, r12 = c("supply_distance"), c("pullback_atr"), c("ret4"), c("ret12")
    parts = {
        "structure_4h": F.least(F.lit(25.0), total([on(c("s4_ema_bear"), 11), on(c("s4_lower_high"), 6), on(c("s4_lower_low"), 5), on(c("s4_macro_bear"), 3)])),
        "structure_1h": F.least(F.lit(25.0), total([on(c("ema_bear"), 10), on(c("lower_high"), 7), on(c("lower_low"), 5), on(c("close") < c("ema20"), 3)])),
        "trigger": F.least(F.lit(20.0), total([on(c("breakdown"), 7), on(c("retest"), 5), on(c("sweep"), 6), on(c("rejection"), 4)])),
        "deep_location": first_of((near <= 0.35, 15), (near <= 0.75, 11), (gap <= 0.45, 9), (gap <= 0.9, 5)),
        "rr_room": at_least(c("room_r"), (3.0, 15), (2.2, 12), (1.7, 7), (1.2, 3), otherwise=-8),
        "participation": F.least(F.lit(10.0), F.least(F.lit(8.0), F.floor(liquidity_points() / 2) + F.greatest(F.lit(0.0), funding_points())) + on(c("volume_ratio") >= 1.2, 2)),
        "deep_spread": spread_penalty(),
        "deep_chase": total([on(r4 < -8, -8), on(r12 < -18, -8), on(c("ema20_distance") > 2.2, -12), on(c("stop_pct") > MAX_STOP_PCT, -15)]),
        "manipulation": total([on(F.abs(c("change24")) > 55, -8), on((c("high") - c("low")) / _atr() > 4, -8)]),
    }
    scored = laid.withColumns(parts).withColumn("deep_score", clamp(total([c(k) for k in parts]), 0, 100))
    gates = {
        "trigger_present": yes(c("sweep")) | yes(c("rejection")) | yes(c("retest")) | (yes(c("breakdown")) & yes(gap <= 0.8)),
        "mtf_ok": (c("structure_4h") >= 14) & (c("structure_1h") >= 14),
        "volatility_ok": yes((c("atr_pct") >= MIN_ATR_PCT) & (c("atr_pct") <= MAX_ATR_PCT)),
        "location_ok": yes(near <= MAX_ENTRY_ATR) | yes(gap <= MAX_ENTRY_ATR) | yes(c("retest")),
        "risk_ok": yes((c("stop_pct") <= MAX_STOP_PCT) & (c("room_r") >= 1.7)),
    }
    base = c("mtf_ok") & c("volatility_ok") & c("risk_ok")
    status = F.when((c("deep_score") >= READY) & base & c("trigger_present") & c("location_ok"), "ENTRY_READY").when((c("deep_score") >= DEVELOPING) & base, "DEVELOPING").when(c("deep_score") >= WATCH, "WATCH").otherwise("IGNORE")
    why = reasons({
        "4H bearish EMA structure": c("s4_ema_bear"), "4H lower-high/lower-low": c("s4_lower_high") & c("s4_lower_low"), "1H lower-high": c("lower_high"), "upper liquidity sweep": c("sweep"), "breakdown + retest": c("retest"),
        "fresh breakdown": c("breakdown") & ~yes(c("retest")), "bearish rejection candle": c("rejection"), "near 1H supply": c("zone_distance_atr") <= 0.75, "short-chase penalty active": c("deep_chase") < 0,
    })
    return scored.withColumns(gates).withColumns({"status": status, "reasons": why, "tp1": c("close") - 2 * c("risk"), "tp2": c("close") - 3 * c("risk"), "runner": c("close") - 5 * c("risk")})


def with_prefilter(rows: DataFrame, look: int = 16, support: int = 24) -> DataFrame:
    """The prefilter score: structure, a support broken in the last `look` bars or close by, persistence of closes below it, compression, momentum, participation and guards. Needs market_state. Ages count bars by bar_no if it is given, so that bars left out (without range) count too.

    Which bar broke depends on the current ATR, so the last `look` bars travel as an array of bounded length.
    """
    from tidewatch.operators.features import by_symbol, rows as frame

    prior = F.when(F.count("low").over(frame(-support, -1)) >= 12, F.min("low").over(frame(-support, -1)))
    number = c("bar_no") if "bar_no" in rows.columns else F.row_number().over(by_symbol())
    packed = rows.withColumn("_bar", F.struct(number.alias("rn"), prior.alias("level"), "close"))
    recent = packed.withColumns({"_recent": F.collect_list("_bar").over(frame(1 - look, 0)), "_n": F.count("close").over(frame(-35, 0)), "_low24": F.min("low").over(frame(-24, -1)), "_last8": F.collect_list("close").over(frame(-7, 0)), "_span12": F.max("high").over(frame(-11, 0)) - F.min("low").over(frame(-11, 0))})
    broken = F.try_element_at(F.filter("_recent", lambda b: (b["rn"] > c("_bar.rn") - look) & (b["close"] < b["level"] - 0.05 * _atr())), F.lit(-1))
    found = recent.withColumn("_broke", F.when(c("_n") >= 36, broken))
    whole = c("_n") >= 36
    level = F.when(c("_broke").isNotNull(), c("_broke.level")).when(whole, c("_low24"))
    below = F.when(c("_broke").isNotNull(), F.size(F.filter("_recent", lambda b: (b["rn"] >= c("_broke.rn")) & (b["close"] < c("_broke.level"))))).when(whole, F.size(F.filter("_last8", lambda x: x < c("_low24")))).otherwise(0)
    found = found.withColumns({"proxy_broken": c("_broke").isNotNull(), "proxy_bars_ago": (c("_bar.rn") - c("_broke.rn")).cast("long"), "proxy_level": level, "proxy_closes_below": below.cast("long"), "proxy_near_atr": F.when(whole, F.abs(c("close") - level) / _atr()).otherwise(99.0)})
    near, ago, n, r4, r12, out = c("proxy_near_atr"), c("proxy_bars_ago"), c("proxy_closes_below"), c("ret4"), c("ret12"), _below_ema()
    parts = [
        on(c("macro_bear"), 16), first_of((c("ema_bear"), 14), (c("close") < c("ema20"), 7)), on(c("lower_high"), 9), on(c("lower_low"), 8),
        F.when(c("proxy_broken"), 20 + first_of((ago <= 8, 8), (ago <= 16, 4))).otherwise(at_most(near, (0.40, 13), (0.80, 8), (1.25, 4))), at_least(n, (5, 10), (3, 6), (1, 2)),
        on(c("low_spread12") / _atr() <= 1.2, 6), on(c("_span12") / _atr() <= 4, 3), first_of(((r4 >= -6) & (r4 <= -0.2), 8), (r4 < -6, 3)), on((r12 >= -12) & (r12 <= -0.5), 6), first_of(((out >= 0.4) & (out <= 2.5), 6), (out > 3.5, -10)),
        at_least(c("volume_ratio"), (1.5, 5), (1.0, 3)), on(c("market_state") == "RISK_OFF", 8), on(r4 < -10, -10), on(r12 < -20, -10), on(c("ret24") < -35, -8), first_of((c("turnover") >= 2_000_000, 3), (c("turnover") < 250_000, -5)),
    ]
    return found.withColumn("prefilter_score", clamp(total(parts), 0, 100)).drop("_bar", "_recent", "_n", "_low24", "_last8", "_span12", "_broke")


def reversal_score() -> dict[str, Column]:
    """The reversal score with its parts, gates and status. Needs micro (points), micro_confirmed, entry15, atr15 and high15 (16 bars) of the small bars, and the benchmark's btc_r4, btc_r24, btc_above."""
    extension, above_vwap = F.greatest(F.lit(0.0), -_below_ema()), F.greatest(F.lit(0.0), (c("close") - c("vwap")) / _atr())
    exhausted = yes(c("rejection")) | c("bb_failed")
    risk_on = yes((c("btc_r4") >= 2) & (c("btc_r24") >= 4) & c("btc_above"))
    market = F.when(risk_on, -10.0).when(yes(c("btc_r4") <= 0.5) | ~yes(c("btc_above")), 6.0).otherwise(0.0)
    parts = {
        "pump": F.least(F.lit(25.0), total([first_of((c("ret24") >= 15, 12), (c("ret24") >= 8, 10), (c("ret24") >= 5, 8), (c("ret24") > 0, 4)), at_least(extension, (3, 8), (2, 6), (1.2, 3)), on(c("bb_z") >= 2, 4), on(above_vwap >= 2, 3)])),
        "liquidity_location": F.least(F.lit(25.0), total([on(c("sweep"), 15), on(c("sweep") & (c("sweep_bars_ago") <= 2), 4), at_most(c("supply_distance"), (0.35, 8), (0.75, 6), (1.0, 3))])),
        "exhaustion": F.least(F.lit(20.0), total([on(c("rejection"), 7), on(c("bb_failed"), 6), at_least(c("volume_ratio"), (2.0, 5), (1.4, 3)), on((c("ret24") >= 5) & exhausted, 2)])),
        "micro_points": c("micro").cast("double"),
        "market_points": clamp(5 + market, -5, 10),
    }
    laid = plan(c("high15"), 0.10, 0.9, atr=c("atr15"), entry=c("entry15"))
    roomy = room(c("entry15"), laid["risk"])
    risk_ok = yes((laid["stop_pct"] <= 5.5) & (roomy >= 1.7))
    context, location = yes(c("sweep")) & (c("ret24") > 0), yes(c("supply_distance") <= 1.0) | exhausted
    score = clamp(total(list(parts.values())), 0, 100)
    ready = (score >= 70) & context & yes(c("micro_confirmed")) & location & risk_ok & ~risk_on
    status = F.when(ready, "ENTRY_READY").when((score >= 58) & context & location & risk_ok, "DEVELOPING").otherwise("IGNORE")
    return parts | {"reversal_score": score, "reversal_status": status, "reversal_priority": F.when(ready & (c("ret24") >= 5), "HIGH").otherwise("NORMAL"), "gate_context": context, "gate_confirmation": yes(c("micro_confirmed")), "gate_location": location, "gate_risk": risk_ok, "gate_risk_on_block": risk_on}


def hard_gate() -> Column:
    """All gates of the reversal score at once."""
    return c("gate_context") & c("gate_confirmation") & c("gate_location") & c("gate_risk") & ~c("gate_risk_on_block")


#: engine -> the score that makes a candidate ready
ENGINES = {"EXTREME_PUMP_REVERSAL": 68.0, "EXHAUSTION_REVERSAL": 66.0, "BREAKDOWN_RETEST": 65.0, "RELATIVE_WEAKNESS": 64.0, "FAILED_BREAKOUT_SUPPLY_FADE": 65.0}


def engine_candidates(rows: DataFrame) -> DataFrame:
    """A row for each bar and engine: engine, score, hard_ok, risk_ok; setups.engine_status adds the status and the primary one.

    Needs the market's state and relative returns, and of the small bars micro (points), micro_failed_reclaim, micro_lower_high, micro_lower_low, micro_rejection, entry15, atr15 and high15 (12 bars).
    """
    ext, z, above = F.greatest(F.lit(0.0), -_below_ema()), c("bb_z"), F.greatest(F.lit(0.0), (c("close") - c("vwap")) / _atr())
    ret24, r12, micro, state, near = c("ret24"), c("ret12"), c("micro").cast("double"), c("market_state"), c("supply_distance")
    not_on, exhausted = state != "RISK_ON", yes(c("rejection")) | c("bb_failed")
    manipulated = on(((c("high") - c("low")) / _atr() >= 4) & (c("volume_ratio") >= 3), 8)
    reclaim, m_high, m_low, m_rej = (yes(c(f"micro_{k}")) for k in ("failed_reclaim", "lower_high", "lower_low", "rejection"))
    up = lambda x: F.greatest(F.lit(0.0), x)
    cap = lambda x, most: F.least(F.lit(float(most)), x)
    flags = total([on(c("rejection"), 1), on(c("bb_failed"), 1), on(c("volume_ratio") >= 1.4, 1), on(above >= 1.2, 1)])
    fresh = yes(c("sweep")) & yes(c("sweep_bars_ago") <= 2) & (c("sweep_bars_ago") > 0)  # an age of 0 reads as unknown
    located = yes(near <= 0.75) | c("bb_failed")
    under = c("close") < c("ema20")
    engines = {
        "EXTREME_PUMP_REVERSAL": (
            cap(up((ret24 - 8) * 1.8), 28) + cap(ext * 4 + up(z - 1) * 3 + above * 2, 16) + on(c("sweep"), 18) + micro + on(state.isin("RISK_OFF", "NEUTRAL"), 8) + on(exhausted, 8) - manipulated,
            (ret24 >= 10) & yes(c("sweep")) & ((ext >= 1.5) | (z >= 1.5) | (above >= 1.5)) & reclaim & (m_high | m_low | m_rej) & (not_on | ((ret24 >= 15) & (micro >= 12))),
        ),
        "EXHAUSTION_REVERSAL": (
            cap(up(ret24) * 1.5, 18) + flags * 10 + micro + on(not_on, 10) + on(near <= 0.75, 8) - manipulated,
            (ret24 >= 4) & (ret24 < 18) & (flags >= 2) & reclaim & (m_high | m_rej) & not_on,
        ),
        "BREAKDOWN_RETEST": (
            on(c("s4_ema_bear"), 12) + on(c("s4_lower_high"), 8) + on(c("s4_lower_low"), 7) + on(c("ema_bear"), 10) + on(c("lower_high"), 6) + first_of((c("retest"), 24), (c("breakdown"), 10)) + cap(micro, 18) + on(state == "RISK_OFF", 12) - on(r12 < -18, 6),
            (state == "RISK_OFF") & yes(c("breakdown")) & yes(c("retest")) & (yes(c("s4_ema_bear")) | (yes(c("s4_lower_high")) & yes(c("s4_lower_low")))) & (reclaim | m_high) & (r12 > -22),
        ),
        "RELATIVE_WEAKNESS": (
            cap(up(-c("relative24")) * 3, 30) + cap(up(-c("relative4")) * 4, 15) + on(c("lower_high"), 10) + on(under, 8) + on(c("s4_lower_high"), 6) + cap(micro, 18) + on(not_on, 8) - on(ret24 <= -15, 10),
            (c("relative4") <= -1) & (c("relative24") <= -3) & (ret24 > -15) & (yes(c("lower_high")) | yes(under)) & (reclaim | m_high) & (not_on | (c("relative24") <= -7)),
        ),
        "FAILED_BREAKOUT_SUPPLY_FADE": (
            on(fresh, 22) + on(located, 18) + cap(micro, 20) + on(exhausted, 12) + on(not_on, 10) + cap(up(ret24), 10) - manipulated,
            (ret24 >= -2) & (ret24 < 10) & fresh & located & reclaim & not_on,
        ),
    }
    laid = plan(c("high15"), 0.10, 1.0, atr=c("atr15"), entry=c("entry15"))
    cost = c("entry15") * COST_BPS / 1e4 / laid["risk"]
    planned = rows.where(c("atr15") > 0).withColumns(laid).withColumns({"room_r": room(c("entry15"), laid["risk"]), "projected_cost_r": cost})
    risk_ok = yes((c("stop_pct") <= 6) & (c("room_r") >= 2) & (c("projected_cost_r") <= 0.10))
    cells = F.array(*(F.struct(F.lit(k).alias("engine"), clamp(score, 0, 100).alias("score"), yes(hard).alias("hard_ok")) for k, (score, hard) in engines.items()))
    return planned.withColumn("risk_ok", risk_ok).withColumn("_engine", F.explode(cells)).select("*", "_engine.*").drop("_engine")


def bollinger_signal() -> dict[str, Column]:
    """The plain baseline: a rise over 24 bars, a high above the upper band and a close back below it, with its plan; null where there is none."""
    laid = plan(c("high"), 0.15, MIN_STOP_ATR)
    holds = (c("bars_so_far") >= 35) & (c("ret24") > 0) & c("bb_failed") & (c("atr") > 0) & (laid["stop_pct"] <= MAX_STOP_PCT)
    return {"baseline": yes(holds), "baseline_stop": F.when(yes(holds), laid["stop"]), "baseline_tp1": F.when(yes(holds), c("close") - 2 * laid["risk"]), "top_gainer": yes(holds) & (c("ret24") >= 5)}


def model_gate(setup: Column) -> dict[str, Column]:
    """Status and priority of a setup class by its own gate: only a reversal can be ready. Reads the deep score's parts."""
    confirmed = yes(c("rejection")) | yes(c("retest")) | (c("structure_1h") >= 10) | yes(c("ema20_distance") >= 0)
    located = yes(c("supply_distance") <= 1.0) | yes(c("rejection"))
    risk = yes((c("stop_pct") <= 8) & (c("room_r") >= 1.7))
    ready = (setup == "LIQUIDITY_REVERSAL") & yes(c("sweep")) & (c("ret24") > 0) & confirmed & located & c("volatility_ok") & risk
    status = F.when(ready, "ENTRY_READY").when(setup == "LIQUIDITY_REVERSAL", "DEVELOPING").when(setup.isin("TREND_CONTINUATION", "SUPPLY_FADE"), "WATCH").otherwise("IGNORE")
    return {"model_status": status, "model_priority": F.when(ready & (c("ret24") >= 5), "HIGH").otherwise("NORMAL")}


def setup_router() -> dict[str, Column]:
    """At most one setup of a bar with its subtype and quality: a reversal at a location or a continuation after a retest, whichever has the better quality."""
    near, ret24 = yes(c("supply_distance") <= 0.85), c("ret24")
    sweep = yes(c("sweep") & (c("sweep_bars_ago") <= 3) & (c("sweep_bars_ago") > 0))
    broke = yes(c("breakdown") & (c("break_bars_ago") <= 12) & (c("break_bars_ago") > 0) & c("break_level").isNotNull())
    pump = yes((ret24 >= 10) & (sweep | (ret24 >= 18)))
    tired = yes(c("rejection")) | yes((ret24 >= 4) & (c("volume_ratio") >= 1.4))
    weak = yes((c("relative4") <= -1) | (c("relative24") <= -3))
    bull = (c("market_state") == "RISK_ON") & (c("market_trend") == "BULL")
    htf = yes(c("s4_ema_bear")) | (yes(c("s4_lower_high")) & yes(c("s4_lower_low")))
    local = yes(c("ema_bear")) | (yes(c("lower_high")) & yes(c("close") < c("ema20")))
    reversal = (near | sweep) & (sweep | yes(c("rejection"))) & (~bull | (pump & sweep))
    further = broke & htf & local & (c("market_trend") != "BULL") & (ret24 > -18)
    q_reversal = total([on(near, 30), on(sweep, 30), on(c("rejection"), 12), on(pump, 10), on(tired, 6), on(weak, 8), on(bull, -20)])
    q_further = total([on(broke, 35), on(htf, 25), on(local, 15), on(c("market_state") == "RISK_OFF", 12), on(weak, 8), on(ret24 <= -12, -10)])
    first = reversal & (~further | (q_reversal > q_further))
    setup = F.when(first, "REVERSAL_AT_LOCATION").when(further, "BEAR_CONTINUATION_RETEST")
    subtype = F.when(first & pump, "EXTREME_PUMP_REVERSAL").when(first & tired, "FAILED_AUCTION_EXHAUSTION").when(~first & further & weak, "RELATIVE_WEAK_CONTINUATION").when(first | further, "STANDARD")
    return {"setup": setup, "subtype": subtype, "setup_quality": F.when(first, clamp(q_reversal, 0, 100)).when(further, clamp(q_further, 0, 100))}


def directional_scores() -> dict[str, Column]:
    """Directional bias in its three forms, each with its own weights and cap."""
    flags = [c("s4_ema_bear"), c("s4_lower_high"), c("s4_lower_low"), c("ema_bear"), c("lower_high"), c("lower_low"), c("relative4") <= -1, c("relative24") <= -3, c("relative24") <= -7, c("market_state") == "RISK_OFF", c("market_trend") == "BEAR", c("market_trend") == "BULL"]
    forms = {"direction_a": ((8, 5, 4, 5, 3, 2, 2, 2, 0, 3, 3, -5), 30), "direction_b": ((4, 3, 2, 3, 2, 1, 2, 2, 1, 2, 2, -4), 22), "direction_c": ((4, 3, 2, 2, 2, 0, 2, 2, 0, 2, 1, 0), 20)}
    return {k: clamp(total([on(f, p) for f, p in zip(flags, points) if p]), 0, most) for k, (points, most) in forms.items()}


def support_distance() -> Column:
    return F.when(c("nearest_support") < c("close"), (c("close") - c("nearest_support")) / _atr())


def bottom_and_chase() -> dict[str, Column]:
    """Risk of selling the bottom and of chasing, with the rules that hold."""
    r4, r12, r24, down, near = c("ret4"), c("ret12"), c("ret24"), F.greatest(F.lit(0.0), _below_ema()), support_distance()
    rules = {
        "4H_DROP_EXTREME": (r4 <= -8, 8), "4H_DROP_LARGE": ((r4 <= -5) & (r4 > -8), 4), "12H_DROP_EXTREME": (r12 <= -18, 8), "12H_DROP_LARGE": ((r12 <= -12) & (r12 > -18), 4), "24H_COLLAPSE": (r24 <= -25, 6),
        "VERY_FAR_BELOW_EMA20": (down >= 2.5, 8), "FAR_BELOW_EMA20": ((down >= 1.8) & (down < 2.5), 4), "NEAR_48H_RANGE_LOW": (c("position48") <= 0.18, 6), "SUPPORT_VERY_CLOSE": (near < 0.8, 9), "SUPPORT_CLOSE": ((near >= 0.8) & (near < 1.25), 4),
        "SUPPORT_UNKNOWN": (near.isNull(), 3), "POSSIBLE_CAPITULATION": ((r24 <= -8) & ((c("high") - c("low")) / _atr() >= 2) & (c("volume_ratio") >= 2), 5),
    }
    chase = F.when(down >= 1.2, F.least(F.lit(8.0), (down - 1.2) * 4)).otherwise(0.0) + on(r4 <= -6, 3)
    return {"bottom_risk": total([on(p, n) for p, n in rules.values()]), "chase_risk": chase, "bottom_reasons": reasons({k: p for k, (p, _) in rules.items()})}


def rebound_risk() -> dict[str, Column]:
    """Risk of a rebound from a low, in its stricter form: bottom and rebound points with the rules that hold."""
    r4, down, near = c("ret4"), F.greatest(F.lit(0.0), _below_ema()), support_distance()
    span = F.greatest(c("high") - c("low"), F.lit(1e-12))
    low12, low24 = (c("close") - c("low12")) / _atr(), (c("close") - c("low24")) / _atr()
    bottom = {"AT_12H_LOW": (low12 <= 0.35, 6), "NEAR_12H_LOW": ((low12 > 0.35) & (low12 <= 0.65), 3), "AT_24H_LOW": (low24 <= 0.35, 4), "EXTENDED_BELOW_EMA20": (down >= 1.8, 4), "SUPPORT_TOO_CLOSE": (near < 0.8, 6), "SUPPORT_UNKNOWN": (near.isNull(), 2), "BOTTOM_15PCT_OF_24H_RANGE": (c("position24") <= 0.15, 4)}
    rebound = {
        "LARGE_DOWNSIDE_LEG": ((c("high12") - c("close")) / _atr() >= 3, 4), "FAST_3H_DROP": ((c("close_3_ago") - c("close")) / _atr() >= 2, 4), "CAPITULATION_REJECTION": ((span / _atr() >= 1.5) & (c("volume_ratio") >= 1.5) & ((F.least("open", "close") - c("low")) / span >= 0.35), 5),
        "4H_DROP_EXTREME": (r4 <= -8, 4), "4H_DROP_LARGE": ((r4 <= -5) & (r4 > -8), 2), "12H_DROP_EXTREME": (c("ret12") <= -15, 3),
    }
    points = lambda rules: total([on(p, n) for p, n in rules.values()])
    return {"low_risk": points(bottom), "rebound_points": points(rebound), "anti_bottom": points(bottom) + points(rebound), "anti_bottom_reasons": reasons({k: p for k, (p, _) in (bottom | rebound).items()})}


def continuation(rows: DataFrame, keep: int = 12) -> DataFrame:
    """Quality of a fresh break of support: its departure and body, whether the level was retested, rejected, reclaimed or accepted since, and why it isn't ready. The bars since the break travel as an array of bounded length."""
    from tidewatch.operators.features import by_symbol, rows as frame

    bar = F.struct(F.row_number().over(by_symbol()).alias("rn"), "open", "high", "low", "close")
    packed = rows.withColumn("_bar", bar).withColumn("_recent", F.collect_list("_bar").over(frame(-keep, 0)))
    level, a, ago = c("break_level"), _atr(), c("break_bars_ago")
    eligible = yes(c("breakdown")) & level.isNotNull() & (ago > 0) & (ago <= keep)  # an age of 0 reads as unknown
    of_break = F.try_element_at(F.filter("_recent", lambda b: b["rn"] == c("_bar.rn") - ago), F.lit(1))
    later = F.filter("_recent", lambda b: b["rn"] > c("_bar.rn") - ago)
    laid = packed.withColumns({"_break": F.when(eligible, of_break), "_later": F.when(eligible, later)})
    span = F.greatest(c("high") - c("low"), F.lit(1e-12))
    bearish = c("close") < c("open")
    facts = {
        "departure_atr": F.greatest(F.lit(0.0), (level - c("_break.close")) / a), "break_body_atr": F.abs(c("_break.close") - c("_break.open")) / a, "retouched": F.exists("_later", lambda b: b["high"] >= level - 0.20 * a), "reclaimed": F.exists("_later", lambda b: b["close"] > level + 0.12 * a),
        "acceptance_bars": F.size(F.filter("_later", lambda b: (b["close"] >= level - 0.20 * a) & (b["close"] <= level + 0.12 * a))).cast("long"), "rebound_atr": (c("close") - F.array_min(F.transform("_later", lambda b: b["low"]))) / a,
        "_touches": c("high") >= level - 0.20 * a, "_below": c("close") <= level - 0.03 * a, "_rejected": bearish & (((c("high") - F.greatest("open", "close")) / span >= 0.20) | ((c("close") - c("low")) / span <= 0.40)), "_bullish": ~bearish & (F.abs(c("close") - c("open")) / a >= 0.45),
    }
    known = laid.withColumns({k: F.when(c("_break").isNotNull(), v) for k, v in facts.items()})
    departed = (c("departure_atr") >= 0.35) & (c("break_body_atr") >= 0.30)
    rejected = c("_touches") & c("_below") & c("_rejected") & ~c("_bullish")
    accepted = c("acceptance_bars") <= 3
    quality = F.least(F.lit(25.0), c("departure_atr") * 20) + F.least(F.lit(15.0), c("break_body_atr") * 15) + on(c("retouched"), 15) + on(rejected, 25) + on(~c("reclaimed"), 10) + on(accepted, 10)
    reason = (
        F.when(c("_break").isNull(), "NO_FRESH_BREAKDOWN").when(c("reclaimed"), "BROKEN_SUPPORT_RECLAIMED").when(~departed, "WEAK_BREAKDOWN_DEPARTURE").when(~c("retouched"), "WAIT_PULLBACK_TO_BROKEN_SUPPORT").when(~c("_touches"), "RETEST_WAS_NOT_CURRENT")
        .when(~c("_below"), "RETEST_FAILED_TO_CLOSE_BELOW").when(~c("_rejected"), "NO_CLEAR_BEARISH_REJECTION").when(~accepted, "TOO_MUCH_ACCEPTANCE_AT_LEVEL").otherwise("CONTINUATION_RETEST_CONFIRMED")
    )
    ready = yes(departed & c("retouched") & rejected & ~c("reclaimed") & accepted)
    return known.withColumns({"continuation_quality": F.when(c("_break").isNotNull(), clamp(quality, 0, 100)).otherwise(0.0), "continuation_ready": ready, "continuation_reason": reason}).drop("_bar", "_recent", "_break", "_later", "_touches", "_below", "_rejected", "_bullish")


def squeeze_risk() -> dict[str, Column]:
    """Risk of a squeeze against a short, from the market, the recovery against it and the rebound from the break."""
    rules = {
        "MARKET_4H_BOUNCE": (c("market_r4") >= 1.25, 3), "MARKET_RISK_ON": (c("market_state") == "RISK_ON", 4), "MARKET_BULL_TREND": (c("market_trend") == "BULL", 3), "COIN_RELATIVE_RECOVERY_1H": (c("relative1") >= 1.0, 3), "COIN_RELATIVE_RECOVERY_3H": (c("relative3") >= 1.75, 3),
        "FAST_REBOUND_FROM_BREAK_LOW": (c("rebound_atr") >= 1.5, 3), "BROKEN_LEVEL_RECLAIM": (c("reclaimed"), 6),
    }
    return {"squeeze_risk": total([on(p, n) for p, n in rules.values()]), "squeeze_reasons": reasons({k: p for k, (p, _) in rules.items()})}


#: zone source -> points of the two forms of the location score
SOURCES = {"SUPPLY_1H": (8, 10), "SWEEP_RETEST": (8, 10), "BROKEN_SUPPORT_RETEST": (8, 8), "SUPPLY_4H": (7, 8), "EMA20_PULLBACK_REFERENCE": (3, 2)}


def zone_distance(lower: Column, upper: Column) -> Column:
    return F.when(lower.isNull() | upper.isNull(), F.lit(None).cast("double")).when(c("close") < lower, (lower - c("close")) / _atr()).when(c("close") > upper, (c("close") - upper) / _atr()).otherwise(0.0)


def location_and_trigger() -> dict[str, Column]:
    """Location and trigger points in two forms, from preferred_lower, preferred_upper and preferred_source, setup and continuation_ready."""
    lower, upper, source = c("preferred_lower"), c("preferred_upper"), c("preferred_source")
    d, inside, under = zone_distance(lower, upper), (c("close") >= lower) & (c("close") <= upper), c("close") < lower
    by_source = lambda k: first_of(*((source == name, points[k]) for name, points in SOURCES.items()))
    place = lambda own, steps, over, bound: first_of((inside, own), *((under & (d <= b), p) for b, p in steps), (~under & (d <= bound), over))
    fresh = c("sweep") & (c("sweep_bars_ago") <= 3) & (c("sweep_bars_ago") > 0)
    sweep, setup = on(fresh, 6), c("setup")
    a = total([place(14, ((0.4, 12), (0.8, 8), (1.5, 4)), 8, 0.25), by_source(0), at_least(support_distance(), (2.0, 8), (1.25, 5), (0.8, 2))])
    b = total([place(16, ((0.35, 13), (0.75, 8), (1.25, 4)), 8, 0.20), by_source(1)])
    t_a = total([sweep, on(c("rejection"), 4), on(c("breakdown"), 4), on(c("retest"), 3), on(c("volume_ratio") >= 1.2, 2), on(setup.isNotNull(), 3)])
    t_b = total([on(fresh, 7), on(c("rejection"), 5), F.when(yes(setup == "BEAR_CONTINUATION_RETEST"), first_of((c("continuation_ready"), 12), (c("breakdown"), 1))).otherwise(on(setup.isNotNull(), 3))])
    return {"location_a": clamp(a, 0, 30), "location_b": clamp(b, 0, 30), "trigger_a": clamp(t_a, 0, 20), "trigger_b": clamp(t_b, 0, 20), "preferred_distance": d}


def filter_actions() -> dict[str, Column]:
    """What to do with a bar in three forms, each with its reason or status: from the directional, location, trigger and risk columns."""
    d, setup = c("preferred_distance"), c("setup")
    score_a = clamp(c("direction_a") + c("location_a") + c("trigger_a") - c("bottom_risk") - c("chase_risk"), 0, 100)
    status_a = F.when(c("bottom_risk") >= 15, "AVOID_BOTTOM_SHORT").when((score_a >= 68) & yes(d <= 0.40) & (c("trigger_a") >= 6), "SHORT_CANDIDATE").when(score_a >= 48, "WAIT_FOR_PULLBACK").otherwise("FILTERED")
    score_b = clamp(c("direction_b") + c("location_b") + c("trigger_b") - c("anti_bottom"), 0, 100)
    located, further = yes(d <= 0.45), yes(setup == "BEAR_CONTINUATION_RETEST")
    ready_b = F.when(further, yes(c("continuation_ready"))).otherwise(setup.isNotNull() & (c("trigger_b") >= 5) & located)
    action_b = F.when(c("anti_bottom") >= 12, "AVOID_BOTTOM_SHORT").when((score_b >= 56) & located & ready_b, "SHORT_NOW").when(c("direction_b") >= 9, "WAIT_PULLBACK").otherwise("WATCH_ONLY")
    blocked = (c("anti_bottom") > 10) | yes((c("close") - c("low12")) / _atr() <= 0.30) | yes(support_distance() < 0.70)
    score_c = clamp(c("direction_c") + c("location_b") + c("continuation_quality") * 0.3 - c("anti_bottom") - c("squeeze_risk"), 0, 100)
    now = further & yes(c("continuation_ready")) & ~blocked & (c("squeeze_risk") <= 6) & (score_c >= 38) & (c("market_state") != "RISK_ON")
    action_c = F.when(now, "SHORT_NOW").when(blocked, "AVOID_BOTTOM_SHORT").when(yes(setup == "REVERSAL_AT_LOCATION"), "WAIT_REVERSAL").when(further | (c("direction_c") >= 8), "WAIT_PULLBACK").otherwise("WATCH_ONLY")
    reason_c = F.when(now, "CONTINUATION_RETEST_CONFIRMED").when(blocked, "ANTI_BOTTOM_BLOCK").when(yes(setup == "REVERSAL_AT_LOCATION"), "REVERSAL_NOT_PROMOTED_TO_SHORT_NOW").when(further, c("continuation_reason")).when(c("direction_c") >= 8, "BEARISH_BIAS_NEEDS_LOCATION").otherwise("WEAK_BIAS")
    return {"filter_status": status_a, "action_b": action_b, "action_c": action_c, "action_reason": reason_c}


def scanner_status(rows: DataFrame, keys: list[str], probability: str, persistence: str | None = None, *, priority: tuple[float, float] = (0.15, 0.52), wait: tuple[float, float] = (0.30, 0.50), swing: float = 0.52) -> DataFrame:
    """Status of each row of a cross-section by its rank share, its probability, whether its zone is ready (zone_ready) and the rule that forbids it (severe). With a persistence, a ready row is a swing or a scalp."""
    w = Window.partitionBy(*keys)
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy(c(probability).desc_nulls_last(), "symbol")) - 1
    share = rank / F.greatest(n - 1, F.lit(1)) if persistence is None else rank / n
    within = (lambda x: c("rank_share") <= x) if persistence is None else (lambda x: c("rank_share") < x)
    ready = F.lit("PRIORITY_SHORT") if persistence is None else F.when(c(persistence) >= swing, "PRIORITY_SHORT_SWING").otherwise("PRIORITY_SHORT_SCALP")
    status = F.when(yes(c("severe")), "AVOID_SHORT").when(within(priority[0]) & (c(probability) >= priority[1]), F.when(yes(c("zone_ready")), ready).otherwise("WAIT_PULLBACK")).when(within(wait[0]) & (c(probability) >= wait[1]), "WAIT_PULLBACK").otherwise("WATCH")
    return rows.withColumns({"cross_rank": (rank + 1).cast("long"), "rank_share": share}).withColumn("scanner_status", status)


def zone_confirmation(rows: DataFrame, lower: str, upper: str, keep: int = 3) -> DataFrame:
    """Confirmation of an entry at a zone: touched in the last bars, not reclaimed since, a rejection and a turn down now, with the reference plan and its room."""
    from tidewatch.operators.features import rows as frame

    a, lo, hi = c("atr"), c(lower), c(upper)
    recent = rows.withColumn("_recent", F.collect_list(F.struct("high", "low", "close")).over(frame(1 - keep, 0)))
    ages = F.transform("_recent", lambda b, i: F.when((b["high"] >= lo - 0.12 * a) & (b["low"] <= hi + 0.12 * a), F.size("_recent") - 1 - i))
    aged = recent.withColumn("touch_age", F.array_min(F.filter(ages, lambda x: x.isNotNull())))
    since = F.slice("_recent", F.size("_recent") - c("touch_age"), c("touch_age") + 1)
    span = F.greatest(c("high") - c("low"), F.lit(1e-12))
    rejected = (c("close") < c("open")) & (((c("high") - F.greatest("open", "close")) / span >= 0.25) | ((c("close") - c("low")) / span <= 0.45))
    turned = (c("close") < c("close_before")) & ((c("high") < c("high_before")) | (c("low") < c("low_before")))
    touched = c("touch_age").isNotNull()
    facts = aged.withColumns({"touched": touched, "zone_reclaimed": F.when(touched, F.exists(since, lambda b: b["close"] > hi + 0.12 * a)).otherwise(False), "touch_high": F.when(touched, F.array_max(F.transform(since, lambda b: b["high"]))), "rejected_now": yes(rejected), "turned_down": yes(turned), "below_mid": yes(c("close") <= (lo + hi) / 2), "below_zone_atr": F.greatest(F.lit(0.0), lo - c("close")) / _atr()})
    score = total([on(c("touched"), 1), on(c("touched") & ~c("zone_reclaimed"), 1), on(c("rejected_now"), 1), on(c("turned_down"), 1), on(c("below_mid"), 1)])
    stop = F.greatest(hi, F.coalesce("touch_high", hi)) + 0.18 * a
    planned = facts.withColumns({"confirm_score": score, "confirm_risk": F.when(stop - c("close") > 0, stop - c("close"))})
    roomy = F.when(support_distance().isNotNull(), support_distance() * a / c("confirm_risk"))
    confirmed = c("touched") & ~c("zone_reclaimed") & c("rejected_now") & c("turned_down") & (c("confirm_score") >= 4) & (c("below_zone_atr") <= 0.65)
    return planned.withColumns({"confirm_room_r": roomy, "confirmed": yes(confirmed), "confirm_tp": c("close") - 2 * c("confirm_risk"), "room_ok": yes(roomy >= 2.2)}).drop("_recent")


def retest_quality() -> dict[str, Column]:
    """Points of a failed retest from the retest bar (r_), the displacement bar (d_), the broken level, the ATR and the high of the bars before the displacement (prior_high): columns must exist."""
    a, span = F.greatest(c("atr"), F.lit(1e-12)), F.greatest(c("r_high") - c("r_low"), F.lit(1e-12))
    facts = {"penetration_atr": F.greatest(F.lit(0.0), c("r_high") - c("level")) / a, "close_below_atr": F.greatest(F.lit(0.0), c("level") - c("r_close")) / a, "retest_wick": (c("r_high") - F.greatest("r_open", "r_close")) / span, "retest_volume_ratio": F.when(c("d_volume") > 0, c("r_volume") / c("d_volume"))}
    body = F.abs(c("d_close") - c("d_open")) / a
    points = total([on(body >= 0.70, 1), on(facts["penetration_atr"] <= 0.25, 1), on(facts["close_below_atr"] >= 0.05, 1), on(facts["retest_wick"] >= 0.25, 1), on(c("r_high") < c("prior_high"), 1), on(facts["retest_volume_ratio"] <= 1.0, 1)])
    return facts | {"retest_quality": points.cast("long")}


def rule_quality(*, structure: Column, fresh_break: Column, strong_zone: Column, confirm_score: Column, room_r: Column, weakness: Column, early: Column, severe: Column, reclaimed: Column) -> Column:
    """Weighted quality (0 to 1) of the rules; a severe bottom or a reclaim leaves 35 % of it."""
    unit = lambda x: clamp(x, 0, 1)
    sum_of = 0.24 * unit(structure / 7.5) + on(fresh_break, 0.16) + on(strong_zone, 0.14) + 0.18 * unit(confirm_score / 5) + 0.14 * F.coalesce(unit(room_r / 4), F.lit(0.0)) + 0.08 * unit(F.coalesce(weakness, F.lit(0.5))) + on(early, 0.06)
    return unit(sum_of * F.when(yes(severe), 0.35).otherwise(1.0) * F.when(yes(reclaimed), 0.35).otherwise(1.0))


def blended_rank(quality: Column, probabilities: list[Column], *, rule: float = 0.75, model: float = 0.25, floor: float = 1e-4) -> Column:
    """Rule quality and the geometric mean of the heads' probabilities, blended."""
    logs = [F.log(clamp(F.coalesce(p, F.lit(0.5)), floor, 1)) for p in probabilities]
    return rule * quality + model * F.exp(total(logs) / len(logs))


def quality_cohorts() -> dict[str, Column]:
    """Named cohorts of trades by their own marks. Columns: phase, terminal, context_ok, score, failed_auction, micro_bos, rejected, cost_r, room_r, controlled_break, retest_touched, retest_rejected, acceptance_bars, entry_below_atr, break_body_atr."""
    trend = yes(c("phase").isin("EARLY_DOWNTREND", "MATURE_DOWNTREND")) & c("terminal")
    within = lambda cost, roomy: yes((c("cost_r") <= cost) & (c("room_r") >= roomy))
    broke = yes(c("controlled_break"))
    return {
        "M1A": c("terminal") & yes(c("context_ok")),
        "M1B": trend & (c("score") >= 4) & yes(c("failed_auction")) & (yes(c("micro_bos")) | yes(c("rejected"))) & within(0.20, 2.5),
        "M1B_PLUS": trend & (c("score") >= 4) & yes(c("failed_auction")) & yes(c("micro_bos")) & yes(c("rejected")) & within(0.18, 3.0),
        "M2": trend & (c("score") >= 4) & broke & yes(c("retest_touched")) & yes(c("retest_rejected")) & yes((c("entry_below_atr") <= 0.65) & (c("break_body_atr") <= 1.10)) & within(0.20, 2.5),
        "M2_BALANCED": trend & (c("score") >= 3) & broke & (yes(c("retest_rejected")) | yes(c("acceptance_bars") >= 2)) & yes((c("entry_below_atr") <= 0.90) & (c("break_body_atr") <= 1.30)) & within(0.22, 2.5),
    }


def gate_tier(risk_off: Column, macro_bear: Column, ema_distance: Column, anti_bottom: Column) -> Column:
    """A+ with both gates, A or B with one, C with none; null outside a falling market."""
    far, deep = yes(ema_distance >= 1.36), yes(anti_bottom >= 17.0)
    return F.when(~(yes(risk_off) & yes(macro_bear)), F.lit(None).cast("string")).when(far & deep, "A+").when(deep, "A").when(far, "B").otherwise("C")


def vote_tier(votes: Column, confirmed: Column, risk_on: Column) -> Column:
    return F.when((votes >= 3) & yes(confirmed) & ~yes(risk_on), "A").when((votes >= 2) & yes(confirmed), "B").otherwise("C")


def preferred_zone(ema_buffer: float = 0.20) -> dict[str, Column]:
    """The zone to wait for: the setup's own (broken support or sweep), else the nearest supply of the finer frame before that of the coarser, else a band around the mean."""
    a, close = c("atr"), c("close")
    far = lambda lo, hi: F.when((close >= lo) & (close <= hi), 0.0).otherwise(F.greatest(F.lit(0.0), lo - close) / _atr())
    zone = lambda rank, source, lo, hi, holds: F.when(yes(holds), F.struct(F.lit(rank).alias("rank"), far(lo, hi).alias("distance"), F.lit(source).alias("source"), lo.alias("lower"), hi.alias("upper")))
    level, swept = c("break_level"), c("sweep_level")
    zones = F.array(
        zone(0, "BROKEN_SUPPORT_RETEST", level - 0.10 * a, level + 0.25 * a, c("setup") == "BEAR_CONTINUATION_RETEST"),
        zone(0, "SWEEP_RETEST", swept - 0.08 * a, swept + 0.30 * a, (c("setup") == "REVERSAL_AT_LOCATION") & swept.isNotNull()),
        zone(1, "SUPPLY_1H", c("zone_lower"), c("zone_upper"), c("zone_upper") >= close - 0.20 * a),
        zone(2, "SUPPLY_4H", c("s4_zone_lower"), c("s4_zone_upper"), c("s4_zone_upper") >= close - 0.20 * a),
        zone(9, "EMA20_PULLBACK_REFERENCE", c("ema20") - ema_buffer * a, c("ema20") + ema_buffer * a, a.isNotNull()),
    )
    best = F.array_min(F.filter(zones, lambda z: z.isNotNull()))
    return {"preferred_source": best["source"], "preferred_lower": best["lower"], "preferred_upper": best["upper"]}
