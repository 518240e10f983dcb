"""Zones below and above the price, and the events that start there: demand zones, liquidity pools, support tiers, impulse and pullback, breaks of support and what follows them, failed auctions.

Signals are rows of symbol, ts (a bar's open; the bar counts as closed), entry and atr. What a signal may know are bars up to its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.features import by_symbol, rows, with_strict_pivots
from tidewatch.operators.matching import forward_bars

c = F.col


_PIVOT = "struct<t:bigint,low:double,top:double,lowest:double>"


def with_open_pivots(bars: DataFrame, lookback: int, step: int, name: str = "pivots") -> DataFrame:
    """For each bar the pivot lows of the last `lookback` bars that are confirmed by now, with the lowest close since their confirmation: an array of (t, low, top of the body, lowest).

    Pivots and closes travel as two arrays of bounded length, so there is no join and no exchange beyond the bars' own; a bar without a close isn't allowed.
    """
    w = by_symbol()
    marked = with_strict_pivots(bars).withColumn("_rn", F.row_number().over(w))
    pivot = F.when(F.lead("pivot_low", 2).over(w).isNotNull(), F.struct(F.unix_seconds("ts").alias("t"), "low", F.greatest("open", "close").alias("top"), c("_rn").alias("rn")))
    laid = marked.withColumn("_pivot", pivot).withColumns({"_known": F.collect_list("_pivot").over(rows(-lookback, -2)), "_closes": F.collect_list("close").over(rows(-lookback, 0))})

    def seen(p: Column) -> Column:
        since = c("_rn") - p["rn"] - 2
        return F.struct(p["t"].alias("t"), p["low"].alias("low"), p["top"].alias("top"), F.array_min(F.slice("_closes", F.size("_closes") - since + 1, since)).alias("lowest"))

    near = F.filter("_known", lambda p: p["t"] >= F.unix_seconds("ts") - step * lookback)
    return laid.withColumn(name, F.transform(near, seen)).drop("_rn", "_pivot", "_known", "_closes", "pivot_low", "pivot_high")


def unbroken(pivots: Column, entry: Column, atr: Column, broken: float = 0.20) -> Column:
    """The pivots below the entry that no close since fell through by `broken` ATR."""
    return F.filter(F.coalesce(pivots, F.array().cast(f"array<{_PIVOT}>")), lambda p: (p["low"] < entry) & (p["lowest"].isNull() | (p["lowest"] >= p["low"] - broken * atr)))


def clustered(points: Column, kind: str, gap: Column) -> Column:
    """An array of structs, sorted by their field v, as an array of clusters: a new one begins where the next v lies more than `gap` higher. `kind` is the type of the structs."""
    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("now"))

    def step(acc: Column, x: Column) -> Column:
        joins = (F.size(acc["now"]) == 0) | (x["v"] - F.element_at(acc["now"], -1)["v"] <= gap)
        return F.struct(F.when(joins, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"), F.when(joins, F.concat(acc["now"], F.array(x))).otherwise(F.array(x)).alias("now"))

    return F.aggregate(points, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def _mean(cluster: Column) -> Column:
    return F.aggregate(cluster, F.lit(0.0), lambda total, x: total + x["v"]) / F.size(cluster)


def _fine_clusters(gap: float) -> Column:
    """Clusters of the fine frame's pivots, in order of price, as (n, lower, highest, mean, top)."""
    points = F.array_sort(F.transform(unbroken(c("pivots"), c("entry"), c("atr")), lambda p: F.struct(p["low"].alias("v"), p["t"].alias("t"), p["top"].alias("top"))))
    groups = clustered(points, "struct<v:double,t:bigint,top:double>", gap * c("atr"))
    return F.transform(groups, lambda g: F.struct(F.size(g).alias("n"), F.element_at(g, 1)["v"].alias("lower"), F.element_at(g, -1)["v"].alias("highest"), _mean(g).alias("mean"), F.array_max(F.transform(g, lambda p: p["top"])).alias("top")))


def demand_zones(signals: DataFrame) -> DataFrame:
    """The nearest demand zone below each signal's entry: a pivot of the coarse frame (s4_pivots) alone, or two and more of the fine one (pivots) that lie together. Signals (entry, atr) without any have no row. All is within the row."""
    zone = lambda low, top, width, least: F.greatest(F.least(top, low + width * c("atr")), low + least * c("atr"))
    made = lambda upper, source, lower: F.struct(upper.alias("upper"), F.lit(source).alias("source"), lower.alias("lower"))
    coarse = F.transform(unbroken(c("s4_pivots"), c("entry"), c("atr")), lambda p: made(zone(p["low"], p["top"], 0.60, 0.10), "DEMAND_4H", p["low"]))
    fine = F.transform(F.filter(_fine_clusters(0.35), lambda g: g["n"] >= 2), lambda g: made(zone(g["lower"], g["top"], 0.45, 0.08), "DEMAND_1H_CLUSTER", g["lower"]))
    best = F.array_max(F.filter(F.concat(coarse, fine), lambda z: z["upper"] < c("entry")))
    return signals.where("atr > 0").withColumn("_z", best).where("_z IS NOT NULL").select("symbol", "ts", "entry", "_z.source", "_z.lower", "_z.upper")


def support_tiers(signals: DataFrame, *, room: float = 2.0) -> DataFrame:
    """The tier of the support below each signal (entry, atr, risk, pivots, s4_pivots): STRUCTURAL for a pivot of the coarse frame, INTERMEDIATE for two reactions of the fine one close together, MINOR for one, else UNKNOWN, with the room down to each in risks."""
    groups = c("_groups")
    laid = signals.withColumn("_groups", F.when(c("atr") > 0, _fine_clusters(0.35)))
    out = laid.withColumns({
        "structural": F.when(c("atr") > 0, F.array_max(F.transform(unbroken(c("s4_pivots"), c("entry"), c("atr")), lambda p: p["low"]))),
        "intermediate": F.array_max(F.transform(F.filter(groups, lambda g: g["n"] >= 2), lambda g: g["mean"])), "minor": F.array_max(F.transform(groups, lambda g: g["highest"])),
    }).drop("_groups")
    tier = F.when(c("structural").isNotNull(), "STRUCTURAL").when(c("intermediate").isNotNull(), "INTERMEDIATE").when(c("minor").isNotNull(), "MINOR").otherwise("UNKNOWN")
    rooms = {f"{k}_room_r": (c("entry") - c(k)) / c("risk") for k in ("structural", "minor")}
    return out.withColumns(rooms | {"tier": tier}).withColumn("support_ok", F.coalesce(c("structural_room_r") >= room, F.lit(False)))


def with_liquidity_pool(bars: DataFrame, lower: Column, upper: Column, *, look: int = 24, gap: float = 0.12, touches: int = 2, apart: int = 2, below: float = 0.20, above: float = 0.45) -> DataFrame:
    """The pool of repeated highs near the zone [lower, upper] among the `look` bars before each bar (column atr): pool_level and pool_touches, the one with the most touches and of these the newest; nulls without one. The highs are one array of bounded length."""
    laid = bars.withColumn("_highs", F.collect_list("high").over(rows(-look, -1)))
    points = F.array_sort(F.transform("_highs", lambda h, i: F.struct(h.alias("v"), i.alias("i"))))
    groups = clustered(points, "struct<v:double,i:int>", gap * c("atr"))
    at = lambda g: F.transform(g, lambda p: p["i"])
    pools = F.transform(groups, lambda g: F.struct(F.size(g).cast("long").alias("n"), F.array_max(at(g)).alias("newest"), _mean(g).alias("level"), F.array_min(at(g)).alias("oldest")))
    good = F.filter(pools, lambda p: (p["n"] >= touches) & (p["newest"] - p["oldest"] >= apart) & p["level"].between(lower - below * c("atr"), upper + above * c("atr")))
    found = laid.withColumn("_pool", F.when(c("atr") > 0, F.array_max(good)))
    return found.withColumns({"pool_level": c("_pool.level"), "pool_touches": c("_pool.n")}).drop("_highs", "_pool")


def impulse_pullback(bars: DataFrame, *, look: int = 14, least_atr: float = 1.20, retrace: tuple[float, float] = (0.18, 0.72)) -> DataFrame:
    """The largest fall of the last bars (column atr) that a pullback of the given share follows: impulse_atr, retrace, bars since the trough, peak, trough and the support broken on the way; nulls without one.

    The trough lies 1 to 5 bars back and the peak within the 8 bars before it. The `look` bars travel as an array of bounded length.
    """
    packed = bars.withColumn("_view", F.collect_list(F.struct("high", "low", "close")).over(rows(1 - look, 0)))
    n = F.size("_view")

    def candidate(at: Column) -> Column:
        # positions count from 1; the trough stands at `at`
        start = F.greatest(at - 8, F.lit(1))
        span = F.slice("_view", start, at - start)
        peak = F.array_max(F.transform(span, lambda b: b["high"]))
        peak_at = start + F.array_position(F.transform(span, lambda b: b["high"]), peak).cast("int") - 1
        trough = F.element_at("_view", at)["low"]
        before = F.greatest(peak_at - 6, F.lit(1))
        support = F.array_min(F.transform(F.slice("_view", before, at - before), lambda b: b["low"]))
        return F.struct(((peak - trough) / c("atr")).alias("impulse_atr"), (-at).alias("order"), ((c("close") - trough) / F.greatest(peak - trough, F.lit(1e-12))).alias("retrace"), (n - at).cast("long").alias("pullback_bars"), peak.alias("peak"), trough.alias("trough"), support.alias("broken_support"))

    tried = F.transform(F.sequence(F.greatest(n - 5, F.lit(4)), n - 1), candidate)
    good = F.filter(tried, lambda x: (x["impulse_atr"] >= least_atr) & x["retrace"].between(*retrace))
    found = packed.withColumn("_best", F.when((n == look) & (c("atr") > 0), F.array_max(good)))
    names = ("impulse_atr", "retrace", "pullback_bars", "peak", "trough", "broken_support")
    return found.withColumns({k: c(f"_best.{k}") for k in names}).drop("_view", "_best")


def pullback_events(rows_: DataFrame, *, least_score: int = 2, near: float = 0.65, far_below: float = 2.5) -> DataFrame:
    """State of a pullback into resistance: from the coarse frame's bear score, the impulse and the rejection at the nearer of the mean and the broken support. Needs a signal row with impulse_pullback."""
    a = c("atr")
    score = sum((F.coalesce(p, F.lit(False)).cast("int") for p in (c("s4_ema20") < c("s4_ema50"), c("s4_lower_high") | c("s4_lower_low"))), F.coalesce(c("s4_close") < c("s4_ema20"), F.lit(False)).cast("int"))
    d_mean, d_support = F.abs(c("close") - c("ema20")) / a, F.abs(c("close") - c("broken_support")) / a
    mean_first = d_mean <= d_support
    laid = rows_.withColumns({"bear_score": score.cast("long"), "resistance": F.when(mean_first, c("ema20")).otherwise(c("broken_support")), "resistance_source": F.when(mean_first, "EMA20_1H").otherwise("BROKEN_SUPPORT_1H"), "resistance_atr": F.least(d_mean, d_support)})
    failed = (c("high") >= c("resistance") - 0.25 * a) & (c("close") <= c("resistance") + 0.10 * a) & (c("close") < c("open"))
    rejects = F.coalesce(failed, F.lit(False)) | F.coalesce(c("rejection"), F.lit(False)) | F.coalesce(c("lower_high"), F.lit(False))
    state = (
        F.when(c("s4_close").isNull(), "NO_4H_CONTEXT").when(c("bear_score") < least_score, "FAIL_4H_BEAR").when(c("impulse_atr").isNull(), "NO_IMPULSE_PULLBACK").when((c("ema20") - c("close")) / a > far_below, "OVEREXTENDED_BELOW_EMA20")
        .when(c("resistance_atr") > near, "TOO_FAR_FROM_RESISTANCE").when(rejects, "CANDIDATE").otherwise("NO_REJECTION")
    )
    return laid.withColumn("event_state", state)


def confirmed_entries(candidates: DataFrame, small: DataFrame, step: int, window: int, *, buffer: float = 0.20, least: float = 0.60, most: float = 2.50) -> DataFrame:
    """Entry of each candidate (known_at, atr, trough, resistance, swing_high) on small bars: the first bearish close below the one before within `window` seconds, then the next open; tier A if it also falls below the low before. Stop above the swing, at least `least` and at most `most` ATR away."""
    keys = ["symbol", "ts"]
    from_known = candidates.select("symbol", F.timestamp_seconds(F.unix_seconds("known_at") - step).alias("ts"), c("ts").alias("_signal"), F.unix_seconds("known_at").alias("_known"))
    path = forward_bars(from_known, small, window + 2 * step).withColumn("ts", c("_signal"))
    w = Window.partitionBy(*keys).orderBy("bar_ts")
    seen = path.withColumns({"_c": F.lag("bar_close").over(w), "_l": F.lag("bar_low").over(w), "_next": F.lead("bar_open").over(w), "_next_ts": F.lead("bar_ts").over(w)})
    bearish = (c("bar_close") < c("bar_open")) & (c("bar_close") < c("_c")) & c("_next").isNotNull()
    inside = F.unix_seconds("bar_ts") + step <= c("_known") + window
    first = seen.where(bearish & inside).groupBy(*keys).agg(F.min(F.struct("bar_ts", (c("bar_close") < c("_l")).alias("strong"), c("bar_high").alias("high"), c("_next").alias("entry"), c("_next_ts").alias("entry_ts"))).alias("_e"))
    out = candidates.join(first, keys, "left")
    stop = F.greatest(F.greatest("swing_high", "resistance", c("_e.high")) + buffer * c("atr"), c("_e.entry") + least * c("atr"))
    risk = (stop - c("_e.entry")) / c("atr")
    state = F.when(c("_e").isNull(), "NO_CONFIRMATION").when(risk > most, "SKIP_RISK_TOO_WIDE").otherwise("ENTRY")
    return out.withColumns({"entry_state": state, "entry_tier": F.when(c("_e").isNull(), "C").when(c("_e.strong"), "A").otherwise("B"), "entry_t": F.unix_seconds(c("_e.entry_ts")), "entry_price": c("_e.entry"), "entry_stop": F.when(c("_e").isNotNull(), stop), "risk_atr": risk}).drop("_e")


def break_watch(signals: DataFrame, bars: DataFrame, step: int, *, detect_bars: int = 2, watch_bars: int = 42, break_by: float = 0.05, reclaim_by: float = 0.10, confirm: int = 2, touch: float = 0.20, wick: float = 0.20, persist: int = 6, persist_below: int = 5, lower_high_by: float = 0.05) -> DataFrame:
    """A support zone (lower, upper, atr) is watched: the first close below it within `detect_bars`, then, bar by bar, RECLAIMED after `confirm` closes above it, SHORT_READY at a failed reclaim, or once closes stay below it under a lower high, else EXPIRED. Signals without a break are NO_BREAK.

    Everything is a window over the bars that follow one break, and the earliest state wins.
    """
    keys = ["symbol", "ts"]
    ahead = forward_bars(signals.where("atr > 0"), bars, step * (detect_bars + watch_bars)).withColumn("_n", ((F.unix_seconds("bar_ts") - F.unix_seconds("ts")) / step).cast("long"))
    own = Window.partitionBy(*keys)
    broke = F.min(F.when((c("_n") <= detect_bars) & (c("bar_close") < c("lower") - break_by * c("atr")), c("_n"))).over(own)
    after = ahead.withColumn("_break", broke).where((c("_n") >= c("_break")) & (c("_n") <= c("_break") + watch_bars))
    at_break = after.where(c("_n") == c("_break")).select(*keys, F.unix_seconds("bar_ts").alias("break_t"), c("bar_high").alias("_break_high"), (F.abs(c("bar_open") - c("bar_close")) / c("atr")).alias("break_body_atr"))
    watched = after.where(c("_n") > c("_break"))
    w = own.orderBy("bar_ts")
    last = lambda k: w.rowsBetween(1 - k, 0)
    span = F.greatest(c("bar_high") - c("bar_low"), F.lit(1e-12))
    above = (c("bar_close") > c("upper") + reclaim_by * c("atr")).cast("int")
    half = persist // 2
    flags = watched.withColumns({
        "_i": F.row_number().over(w), "_above": above, "_over": F.sum(above).over(last(confirm)), "_touched": c("bar_high") >= c("lower") - touch * c("atr"), "_before": F.lag("bar_close").over(w), "_below": F.sum((c("bar_close") < c("lower")).cast("int")).over(last(persist)),
        "_old": F.max("bar_high").over(w.rowsBetween(1 - persist, half - persist)), "_new": F.max("bar_high").over(w.rowsBetween(1 - (persist - half), 0)),
    })
    failed = c("_touched") & (c("bar_close") < c("lower")) & (c("bar_close") < c("bar_open")) & (((c("bar_high") - F.greatest("bar_open", "bar_close")) / span >= wick) | F.coalesce(c("bar_close") < c("_before"), F.lit(False)))
    stays = (c("_i") >= persist) & (c("_below") >= persist_below) & (c("_new") <= c("_old") - lower_high_by * c("atr")) & (c("_above") == 0)
    state = F.when((c("_over") == confirm) & (c("_i") >= confirm), "RECLAIMED").when(failed, "FAILED_RECLAIM_TOUCH").when(stays, "PERSISTENT_NO_RECLAIM_LOWER_HIGH")
    judged = flags.withColumn("_state", state).withColumn("_end", F.min(F.when(c("_state").isNotNull(), c("_i"))).over(own))
    upto = judged.where(c("_end").isNull() | (c("_i") <= c("_end")))
    seen = upto.groupBy(*keys).agg(F.max(F.when(c("_i") == c("_end"), c("_state"))).alias("_s"), F.max(F.when(c("_i") == c("_end"), F.unix_seconds("bar_ts"))).alias("_t"), F.count("*").alias("watch_bars"), F.count_if("_touched").alias("retest_attempts"), F.count_if(c("bar_close") < c("lower")).alias("bars_below"), F.max("bar_high").alias("_highest"))
    out = signals.join(at_break, keys, "left").join(seen, keys, "left")
    status = F.when(c("break_t").isNull(), "NO_BREAK").when(c("watch_bars").isNull(), "CENSORED_NO_WATCH").when(c("_s").isNull(), "EXPIRED_NO_SHORT_READY").when(c("_s") == "RECLAIMED", "RECLAIMED").otherwise("SHORT_READY")
    return out.withColumns({"watch_state": status, "ready_reason": F.when(c("_s") != "RECLAIMED", c("_s")), "decided_t": c("_t"), "max_reclaim_high": F.greatest("_break_high", "_highest")}).drop("_s", "_t", "_break_high", "_highest")


_FOUND = "struct<free:bigint,at:bigint,pool:double,bos:bigint>"


def sweep_events(signals: DataFrame, small: DataFrame, step: int, wait_bars: int, *, bos_bars: int = 4, sweep_by: float = 0.03, wick: float = 0.20, reclaim_by: float = 0.12, break_by: float = 0.03, body: tuple[float, float] = (0.70, 1.00)) -> DataFrame:
    """For each signal (zone_lower, zone_upper, atr): the first of the small bars (with pool_level) among the next `wait_bars` that sweeps a pool of highs in the zone and closes back below it, and the controlled break of the lows before the sweep within `bos_bars`.

    A sweep fails when a close gets above its high or the wait is over, and only then the next one counts. Sweeps of a signal are few and are taken in turn by a fold over an array of at most `wait_bars` of them. State: SWEEP_AND_BREAK, NO_CONTROLLED_BREAK or NO_SWEEP.
    """
    keys, a = ["symbol", "ts"], c("atr")
    shaped = small.withColumn("_micro", F.min("low").over(rows(-bos_bars, -1)))
    ahead = forward_bars(signals.where("atr > 0"), shaped, step * (wait_bars + bos_bars), ("pool_level", "_micro")).withColumn("_n", ((F.unix_seconds("bar_ts") - F.unix_seconds("ts")) / step).cast("long"))
    span = c("bar_high") - c("bar_low")
    near = (c("bar_high") >= c("zone_lower") - 0.12 * a) & (c("bar_low") <= c("zone_upper") + 0.12 * a)
    auction = (span > 0) & (c("bar_close") < c("bar_open")) & (c("bar_high") >= c("pool_level") + sweep_by * a) & (c("bar_close") < c("pool_level")) & ((c("bar_high") - F.greatest("bar_open", "bar_close")) / span >= wick)
    sweeps = ahead.where((c("_n") <= wait_bars) & near & auction).select(*keys, c("_n").alias("_at"), c("bar_high").alias("_top"), "pool_level", c("_micro").alias("_floor"))
    later = ahead.select(*keys, "_n", "bar_open", "bar_close", a.alias("_a"))
    met = sweeps.join(later, keys).where((c("_n") > c("_at")) & (c("_n") <= c("_at") + bos_bars))
    dropped = (c("bar_open") - c("bar_close")) / c("_a")
    bos = (c("bar_close") < c("_floor") - break_by * c("_a")) & (c("bar_close") < c("bar_open")) & dropped.between(*body)
    ended = met.groupBy(*keys, "_at", "pool_level").agg(F.min(F.when(c("bar_close") > c("_top") + reclaim_by * c("_a"), c("_n"))).alias("_gone"), F.min(F.when(bos, c("_n"))).alias("_bos"))
    won = c("_bos").isNotNull() & (c("_bos") < F.coalesce("_gone", F.lit(2**31)))
    tries = ended.select(*keys, F.struct("_at", F.when(won, c("_bos")).alias("bos"), F.when(won, F.lit(2**31)).otherwise(F.least(c("_gone"), c("_at") + bos_bars + 1)).alias("free"), c("pool_level").alias("pool")).alias("_try"))
    listed = tries.groupBy(*keys).agg(F.array_sort(F.collect_list("_try")).alias("_tries"))
    start = F.lit(None).cast(_FOUND)
    step_of = lambda acc, x: F.when(acc.isNull() | (x["_at"] > acc["free"]), F.struct(x["free"].cast("long").alias("free"), x["_at"].alias("at"), x["pool"].alias("pool"), x["bos"].alias("bos"))).otherwise(acc)
    found = listed.withColumn("_last", F.aggregate("_tries", start, step_of))
    out = signals.join(found, keys, "left")
    state = F.when(c("_last").isNull(), "NO_SWEEP").when(c("_last.bos").isNull(), "NO_CONTROLLED_BREAK").otherwise("SWEEP_AND_BREAK")
    return out.withColumns({"sweep_state": state, "sweep_bar": c("_last.at"), "sweep_pool": c("_last.pool"), "break_bar": c("_last.bos")}).drop("_tries", "_last")
