"""Registered queries of zones and the events that start there, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import features as W
from tidewatch.operators import scores as E
from tidewatch.operators import zones as Z
from tidewatch.plans.catalog import DAY, STEP, TRADES, _out, query, trades
from tidewatch.plans.scores import _DEEP, _SIG, _SMALL, HOUR, c, frames, signal, walk
from tidewatch.sources.candles import kept, shared_folder

_PIVOT = "SELECT symbol, rn, t, low, greatest(open, close) AS top, count(*) OVER a = 2 AND count(*) OVER b = 2 AND low < min(low) OVER a AND low <= min(low) OVER b AS ok FROM {src} WINDOW a AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)"
_UNBROKEN = "SELECT s.symbol, s.rn, s.t, s.entry, s.atr, s.risk, p.rn AS prn, p.low AS plow, p.top AS ptop FROM sg s JOIN {piv} p ON p.symbol = s.symbol AND p.ok AND p.rn + 2 <= s.{rn} AND s.{t} > p.t AND s.{t} - p.t <= {reach} AND p.low < s.entry WHERE NOT EXISTS (SELECT 1 FROM {src} b WHERE b.symbol = s.symbol AND b.rn >= p.rn + 3 AND b.rn <= s.{rn} AND b.close < p.low - 0.2 * s.atr)"
_ZONES = (
    _SIG
    + ", sg AS (SELECT s.symbol, s.rn, s.t, s.close AS entry, s.atr, 0.8 * s.atr AS risk, d.rn AS drn, d.t AS dt FROM s JOIN day d ON d.symbol = s.symbol AND d.t + 86400 <= s.t + 14400 AND d.t + 172800 > s.t + 14400 WHERE s.close < s.ema20)"
    + f", p1 AS ({_PIVOT.format(src='one')}), p4 AS ({_PIVOT.format(src='day')}), u1 AS ({_UNBROKEN.format(piv='p1', rn='rn', t='t', reach=STEP * 160, src='one')}), u4 AS ({_UNBROKEN.format(piv='p4', rn='drn', t='dt', reach=DAY * 90, src='day')})"
    + ", q0 AS (SELECT *, CASE WHEN plow - lag(plow) OVER (PARTITION BY symbol, t ORDER BY plow, prn) > 0.35 * atr THEN 1 ELSE 0 END AS nw FROM u1), q1 AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, t ORDER BY plow, prn ROWS UNBOUNDED PRECEDING) AS k FROM q0), q2 AS (SELECT symbol, t, k, any_value(entry) AS entry, any_value(atr) AS atr, any_value(risk) AS risk, count(*) AS n, min(plow) AS lo, max(plow) AS hi, avg(plow) AS mean, max(ptop) AS top FROM q1 GROUP BY 1, 2, 3)"
)


def _zone_signals(spark, d):
    rows = signal(spark, d, pivots=(160, 90)).where("close < ema20 AND as_of_ts IS NOT NULL")
    known = rows.where(F.unix_seconds("as_of_ts") + DAY > F.unix_seconds("ts") + STEP)
    return known.select("symbol", "ts", c("close").alias("entry"), "atr", (0.8 * c("atr")).alias("risk"), "pivots", "s4_pivots")


@query(_ZONES + ", z AS (SELECT symbol, t, entry, 'DEMAND_4H' AS source, plow AS lower, greatest(least(ptop, plow + 0.6 * atr), plow + 0.1 * atr) AS upper FROM u4 UNION ALL SELECT symbol, t, entry, 'DEMAND_1H_CLUSTER', lo, greatest(least(top, lo + 0.45 * atr), lo + 0.08 * atr) FROM q2 WHERE n >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY upper DESC, source DESC, lower DESC) AS k FROM z WHERE upper < entry) SELECT symbol, t, source, round(lower, 6) AS lower, round(upper, 6) AS upper FROM r WHERE k = 1")
def w18_demand_zones(spark, d):
    return _out(Z.demand_zones(_zone_signals(spark, d)), "symbol", "ts", "source", "lower", "upper")


@query(_ZONES + ", a AS (SELECT symbol, t, max(plow) AS st FROM u4 GROUP BY 1, 2), b AS (SELECT symbol, t, max(mean) FILTER (n >= 2) AS im, max(hi) AS mi FROM q2 GROUP BY 1, 2) SELECT sg.symbol, sg.t, CASE WHEN st IS NOT NULL THEN 'STRUCTURAL' WHEN im IS NOT NULL THEN 'INTERMEDIATE' WHEN mi IS NOT NULL THEN 'MINOR' ELSE 'UNKNOWN' END AS tier, round((entry - st) / risk, 6) AS structural_room_r, round((entry - mi) / risk, 6) AS minor_room_r, coalesce((entry - st) / risk >= 2, false) AS support_ok FROM sg LEFT JOIN a USING (symbol, t) LEFT JOIN b USING (symbol, t)")
def p20_support_tiers(spark, d):
    return _out(Z.support_tiers(_zone_signals(spark, d)), "symbol", "ts", "tier", "structural_room_r", "minor_room_r", "support_ok")


_POOL = ", l0 AS (SELECT symbol, t, atr, close, list(high) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS hs FROM {src}), l1 AS (SELECT symbol, t, atr, {lo} AS lo, {hi} AS hi, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM l0 WHERE atr > 0), l2 AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY symbol, t ORDER BY h, i) > {gap} * atr THEN 1 ELSE 0 END AS nw FROM l1), l3 AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, t ORDER BY h, i ROWS UNBOUNDED PRECEDING) AS k FROM l2), l4 AS (SELECT symbol, t, k, avg(h) AS level, count(*) AS n, min(i) AS a, max(i) AS b, any_value(lo) AS lo, any_value(hi) AS hi FROM l3 GROUP BY 1, 2, 3), l AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY n DESC, b DESC, level DESC) AS r FROM l4 WHERE n >= 2 AND b - a >= 2 AND level BETWEEN lo AND hi)"


@query(_SIG + _POOL.format(src="one", lo="close - atr - 0.2 * atr", hi="close + atr + 0.45 * atr", gap=0.12) + " SELECT symbol, t, round(level, 6) AS pool_level, n AS pool_touches FROM l WHERE r = 1")
def w19_liquidity_pools(spark, d):
    b = W.with_atr(walk(spark, d, STEP))
    return _out(Z.with_liquidity_pool(b, c("close") - c("atr"), c("close") + c("atr")).where("pool_level IS NOT NULL"), "symbol", "ts", "pool_level", "pool_touches")


_IMP = ", i0 AS (SELECT c.symbol, c.rn, c.t, c.close, c.atr, tr.rn AS trn, tr.low AS trough FROM one c JOIN one tr ON tr.symbol = c.symbol AND tr.rn BETWEEN c.rn - 5 AND c.rn - 1 WHERE c.rn >= 14 AND c.atr > 0), i1 AS (SELECT i0.*, max(p.high) AS peak, arg_min(p.rn, struct_pack(a := -p.high, b := p.rn)) AS prn FROM i0 JOIN one p ON p.symbol = i0.symbol AND p.rn BETWEEN i0.trn - 8 AND i0.trn - 1 GROUP BY ALL), i2 AS (SELECT i1.*, min(b.low) AS sup FROM i1 JOIN one b ON b.symbol = i1.symbol AND b.rn BETWEEN greatest(i1.prn - 6, i1.rn - 13) AND i1.trn - 1 GROUP BY ALL), i3 AS (SELECT *, (peak - trough) / atr AS imp, (close - trough) / greatest(peak - trough, 1e-12) AS ret FROM i2), i4 AS (SELECT *, row_number() OVER (PARTITION BY symbol, rn ORDER BY imp DESC, trn) AS k FROM i3 WHERE imp >= {least} AND ret BETWEEN 0.18 AND 0.72), i AS (SELECT symbol, rn, imp, ret, rn - trn AS pb, peak, trough, sup FROM i4 WHERE k = 1)"


@query(_SIG + _IMP.format(least=1.2) + " SELECT o.symbol, o.t, round(imp, 6) AS impulse_atr, round(ret, 6) AS retrace, CAST(pb AS BIGINT) AS pullback_bars, round(peak, 6) AS peak, round(trough, 6) AS trough, round(sup, 6) AS broken_support FROM one o LEFT JOIN i USING (symbol, rn)")
def w32_impulse_pullback(spark, d):
    return _out(Z.impulse_pullback(W.with_atr(walk(spark, d, STEP))), "symbol", "ts", "impulse_atr", "retrace", "pullback_bars", "peak", "trough", "broken_support")


_E12 = _SIG + _IMP.format(least=1.2) + ", k AS (SELECT s.*, i.imp, i.ret, i.trough, i.sup, coalesce(s4_ema20 < s4_ema50, false)::INT + coalesce(s4_lower_high OR s4_lower_low, false)::INT + coalesce(s4_close < s4_ema20, false)::INT AS bear_n, abs(close - ema20) / atr AS d1, abs(close - i.sup) / atr AS d2 FROM s LEFT JOIN i USING (symbol, rn)), m2 AS (SELECT *, CASE WHEN d1 <= d2 THEN ema20 ELSE sup END AS res, CASE WHEN d1 <= d2 THEN 'EMA20_1H' ELSE 'BROKEN_SUPPORT_1H' END AS src, least(d1, d2) AS dd FROM k), n AS (SELECT *, coalesce(high >= res - 0.25 * atr AND close <= res + 0.1 * atr AND close < open, false) AS failed FROM m2), e AS (SELECT *, CASE WHEN s4_close IS NULL THEN 'NO_4H_CONTEXT' WHEN bear_n < 2 THEN 'FAIL_4H_BEAR' WHEN imp IS NULL THEN 'NO_IMPULSE_PULLBACK' WHEN (ema20 - close) / atr > 2.5 THEN 'OVEREXTENDED_BELOW_EMA20' WHEN dd > 0.65 THEN 'TOO_FAR_FROM_RESISTANCE' WHEN failed OR rejection OR lower_high THEN 'CANDIDATE' ELSE 'NO_REJECTION' END AS event_state FROM n)"


def _pullback(spark, d, bars=None):
    return Z.pullback_events(signal(spark, d, Z.impulse_pullback, bars))


@query(_E12 + " SELECT symbol, t, CAST(bear_n AS BIGINT) AS bear_score, round(res, 6) AS resistance, round(dd, 6) AS resistance_atr, event_state FROM e")
def e12_pullback_events(spark, d):
    return _out(_pullback(spark, d), "symbol", "ts", "bear_score", "resistance", "resistance_atr", "event_state")


_E12B = _E12 + _SMALL + f", ca AS (SELECT *, t + {STEP} AS known, coalesce(res, close) AS r0 FROM e WHERE imp IS NOT NULL), f0 AS (SELECT ca.symbol, ca.t, ca.known, b.t AS bt, b.open AS bo, b.high AS bh, b.close AS bc, lag(b.close) OVER w AS pc, lag(b.low) OVER w AS pl, lead(b.open) OVER w AS no, lead(b.t) OVER w AS nt FROM ca JOIN raw1 b ON b.symbol = ca.symbol AND b.t >= ca.known AND b.t <= ca.known + 28800 + {HOUR} WINDOW w AS (PARTITION BY ca.symbol, ca.t ORDER BY b.t)), f1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY bt) AS k FROM f0 WHERE bc < bo AND bc < pc AND no IS NOT NULL AND bt + {HOUR} <= known + 28800), f2 AS (SELECT ca.symbol, ca.t, ca.atr, no, nt, bc < pl AS strong, greatest(greatest(ca.high12, ca.r0, bh) + 0.2 * ca.atr, no + 0.6 * ca.atr) AS stop FROM ca LEFT JOIN f1 ON f1.symbol = ca.symbol AND f1.t = ca.t AND f1.k = 1)"


@query(_E12B + " SELECT symbol, t, CASE WHEN no IS NULL THEN 'NO_CONFIRMATION' WHEN (stop - no) / atr > 2.5 THEN 'SKIP_RISK_TOO_WIDE' ELSE 'ENTRY' END AS entry_state, CASE WHEN no IS NULL THEN 'C' WHEN strong THEN 'A' ELSE 'B' END AS entry_tier, nt AS entry_t, round(CASE WHEN no IS NOT NULL THEN stop END, 6) AS entry_stop FROM f2")
def e12_confirmed_entries(spark, d):
    hours, *bars = frames(spark, d, HOUR, STEP, DAY)
    rows = _pullback(spark, d, bars).where("impulse_atr IS NOT NULL").select("symbol", "ts", "known_at", "atr", F.coalesce("resistance", "close").alias("resistance"), c("high12").alias("swing_high"))
    return _out(Z.confirmed_entries(rows, hours, HOUR, 28_800), "symbol", "ts", "entry_state", "entry_tier", "entry_t", "entry_stop")


_E11 = _SIG + ", sp AS (SELECT symbol, t, nearest_support AS lower, nearest_support + 0.5 * atr AS upper, atr FROM s WHERE nearest_support IS NOT NULL), j AS (SELECT sp.*, (b.t - sp.t) // 14400 AS n, b.t AS bt, b.open AS bo, b.high AS bh, b.low AS bl, b.close AS bc FROM sp JOIN one b ON b.symbol = sp.symbol AND b.t > sp.t AND b.t <= sp.t + 14400 * 44), b0 AS (SELECT symbol, t, min(n) AS brk FROM j WHERE n <= 2 AND bc < lower - 0.05 * atr GROUP BY 1, 2), b1 AS (SELECT j.*, brk FROM j JOIN b0 USING (symbol, t)), b2 AS (SELECT symbol, t, bt AS break_t, bh AS break_high FROM b1 WHERE n = brk), w0 AS (SELECT *, row_number() OVER w AS i, CASE WHEN bc > upper + 0.1 * atr THEN 1 ELSE 0 END AS ab, bh >= lower - 0.2 * atr AS tch, lag(bc) OVER w AS pc, sum(CASE WHEN bc < lower THEN 1 ELSE 0 END) OVER (w ROWS 5 PRECEDING) AS bel, max(bh) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS old, max(bh) OVER (w ROWS 2 PRECEDING) AS nw FROM b1 WHERE n > brk AND n <= brk + 42 WINDOW w AS (PARTITION BY symbol, t ORDER BY bt)), w1 AS (SELECT *, sum(ab) OVER (PARTITION BY symbol, t ORDER BY bt ROWS 1 PRECEDING) AS ov FROM w0), w2 AS (SELECT *, CASE WHEN ov = 2 AND i >= 2 THEN 'RECLAIMED' WHEN tch AND bc < lower AND bc < bo AND ((bh - greatest(bo, bc)) / greatest(bh - bl, 1e-12) >= 0.2 OR coalesce(bc < pc, false)) THEN 'FAILED_RECLAIM_TOUCH' WHEN i >= 6 AND bel >= 5 AND nw <= old - 0.05 * atr AND ab = 0 THEN 'PERSISTENT_NO_RECLAIM_LOWER_HIGH' END AS st FROM w1), w3 AS (SELECT *, min(CASE WHEN st IS NOT NULL THEN i END) OVER (PARTITION BY symbol, t) AS fin FROM w2), w4 AS (SELECT symbol, t, max(CASE WHEN i = fin THEN st END) AS st, max(CASE WHEN i = fin THEN bt END) AS dt, count(*) AS wb, count(*) FILTER (tch) AS ra, count(*) FILTER (bc < lower) AS bb, max(bh) AS mh FROM w3 WHERE fin IS NULL OR i <= fin GROUP BY 1, 2)"


@query(_E11 + " SELECT sp.symbol, sp.t, break_t, CASE WHEN break_t IS NULL THEN 'NO_BREAK' WHEN wb IS NULL THEN 'CENSORED_NO_WATCH' WHEN st IS NULL THEN 'EXPIRED_NO_SHORT_READY' WHEN st = 'RECLAIMED' THEN st ELSE 'SHORT_READY' END AS watch_state, CASE WHEN st <> 'RECLAIMED' THEN st END AS ready_reason, dt AS decided_t, wb AS watch_bars, ra AS retest_attempts, bb AS bars_below, round(greatest(break_high, mh), 6) AS max_reclaim_high FROM sp LEFT JOIN b2 USING (symbol, t) LEFT JOIN w4 USING (symbol, t)")
def e11_break_watch(spark, d):
    bars = frames(spark, d, STEP, DAY)
    s = kept(signal(spark, d, bars=bars).where("nearest_support IS NOT NULL").select("symbol", "ts", c("nearest_support").alias("lower"), (c("nearest_support") + 0.5 * c("atr")).alias("upper"), "atr"), shared_folder(spark, "signals"))
    return _out(Z.break_watch(s, bars[0], STEP), "symbol", "ts", "break_t", "watch_state", "ready_reason", "decided_t", "watch_bars", "retest_attempts", "bars_below", "max_reclaim_high")


_E13 = (
    _SIG + f", raw1 AS (SELECT symbol, (epoch_us(ts) // {HOUR}000000) * {HOUR} AS t, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close FROM ticks GROUP BY 1, 2), sm0 AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY t)), 0), coalesce(abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY t)), 0)) AS tr FROM raw1), sm AS (SELECT *, CASE WHEN count(tr) OVER w >= 7 THEN avg(tr) OVER w END AS atr, min(low) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS micro FROM sm0 WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 13 PRECEDING))"
    + _POOL.format(src="sm", lo="close - 3 * atr - 0.2 * atr", hi="close + 3 * atr + 0.45 * atr", gap=0.12)
    + ", g9 AS (SELECT symbol, t, t + 10800 AS t0, close - atr AS zl, close + atr AS zu, atr * 0.4 AS a FROM s), j AS (SELECT g9.symbol, g9.t, zl, zu, g9.a, (b.t - t0) // 3600 AS n, b.open AS bo, b.high AS bh, b.low AS bl, b.close AS bc, b.micro, l.level FROM g9 JOIN sm b ON b.symbol = g9.symbol AND b.t > t0 AND b.t <= t0 + 28 * 3600 LEFT JOIN l ON l.symbol = b.symbol AND l.t = b.t AND l.r = 1), x AS (SELECT *, n AS sa FROM j WHERE n <= 24 AND bh >= zl - 0.12 * a AND bl <= zu + 0.12 * a AND bh > bl AND bc < bo AND bh >= level + 0.03 * a AND bc < level AND (bh - greatest(bo, bc)) / (bh - bl) >= 0.2), y AS (SELECT x.symbol, x.t, x.sa, x.level, min(CASE WHEN q.bc > x.bh + 0.12 * q.a THEN q.n END) AS gone, min(CASE WHEN q.bc < x.micro - 0.03 * q.a AND q.bc < q.bo AND (q.bo - q.bc) / q.a BETWEEN 0.1 AND 3 THEN q.n END) AS bos FROM x JOIN j q ON q.symbol = x.symbol AND q.t = x.t AND q.n > x.sa AND q.n <= x.sa + 4 GROUP BY 1, 2, 3, 4), z AS (SELECT *, bos IS NOT NULL AND bos < coalesce(gone, 999999) AS won FROM y), v AS (SELECT symbol, t, list_reduce(list_sort(list(struct_pack(sa := sa, bos := CASE WHEN won THEN bos END, free := CASE WHEN won THEN 999999 ELSE least(gone, sa + 5) END, pool := level))), lambda p, q: CASE WHEN q.sa > p.free THEN q ELSE p END) AS e FROM z GROUP BY 1, 2)"
)


@query(_E13 + " SELECT g9.symbol, g9.t, CASE WHEN e IS NULL THEN 'NO_SWEEP' WHEN e.bos IS NULL THEN 'NO_CONTROLLED_BREAK' ELSE 'SWEEP_AND_BREAK' END AS sweep_state, e.sa AS sweep_bar, round(e.pool, 6) AS sweep_pool, e.bos AS break_bar FROM g9 LEFT JOIN v USING (symbol, t)")
def e13_sweep_events(spark, d):
    hours, *bars = frames(spark, d, HOUR, STEP, DAY)
    small = Z.with_liquidity_pool(W.with_atr(hours), c("close") - 3 * c("atr"), c("close") + 3 * c("atr"))
    rows = signal(spark, d, bars=bars).select("symbol", c("ts").alias("signal_ts"), F.timestamp_seconds(F.unix_seconds("ts") + STEP - HOUR).alias("ts"), (c("close") - c("atr")).alias("zone_lower"), (c("close") + c("atr")).alias("zone_upper"), (c("atr") * 0.4).alias("atr"))
    out = Z.sweep_events(rows, small, HOUR, 24, body=(0.1, 3.0))
    return _out(out.withColumn("ts", c("signal_ts")), "symbol", "ts", "sweep_state", "sweep_bar", "sweep_pool", "break_bar")


@query(_DEEP + " SELECT symbol, t, round(nearest_support, 6) AS nearest_support, round(room_r, 6) AS room_r FROM d")
def w15_support_room_two_frames(spark, d):
    return _out(E.with_deep_score(signal(spark, d)), "symbol", "ts", "nearest_support", "room_r")


_LAG = lambda k, n: f"lag({k}, {n}) OVER w"


@query(_SIG + f", k AS (SELECT symbol, t, atr, open AS r_open, high AS r_high, low AS r_low, close AS r_close, volume AS r_volume, {_LAG('open', 2)} AS d_open, {_LAG('close', 2)} AS d_close, {_LAG('volume', 2)} AS d_volume, {_LAG('low', 3)} AS level, max(high) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 6 PRECEDING AND 3 PRECEDING) AS ph FROM one WHERE atr > 0 WINDOW w AS (PARTITION BY symbol ORDER BY t)), q AS (SELECT *, greatest(CASE WHEN level IS NOT NULL THEN 0 END, r_high - level) / atr AS pen, greatest(CASE WHEN level IS NOT NULL THEN 0 END, level - r_close) / atr AS bel, (r_high - greatest(r_open, r_close)) / greatest(r_high - r_low, 1e-12) AS wick, CASE WHEN d_volume > 0 THEN r_volume / d_volume END AS vr FROM k WHERE level IS NOT NULL) SELECT symbol, t, round(pen, 6) AS penetration_atr, round(bel, 6) AS close_below_atr, round(vr, 6) AS retest_volume_ratio, CAST((abs(d_close - d_open) / atr >= 0.7)::INT + (pen <= 0.25)::INT + (bel >= 0.05)::INT + (wick >= 0.25)::INT + coalesce(r_high < ph, false)::INT + coalesce(vr <= 1, false)::INT AS BIGINT) AS retest_quality FROM q")
def w33_retest_quality(spark, d):
    w, b = W.by_symbol(), W.with_atr(walk(spark, d, STEP)).where("atr > 0")
    named = {f"r_{k}": c(k) for k in ("open", "high", "low", "close", "volume")} | {f"d_{k}": F.lag(k, 2).over(w) for k in ("open", "close", "volume")} | {"level": F.lag("low", 3).over(w), "prior_high": F.max("high").over(W.rows(-6, -3))}
    return _out(b.withColumns(named).where("level IS NOT NULL").withColumns(E.retest_quality()), "symbol", "ts", "penetration_atr", "close_below_atr", "retest_volume_ratio", "retest_quality")


_MARKS = "SELECT id, CASE regime WHEN 0 THEN 'EARLY_DOWNTREND' WHEN 1 THEN 'MATURE_DOWNTREND' ELSE 'UNCONFIRMED' END AS phase, id % 11 <> 0 AS terminal, id % 2 = 0 AS context_ok, CAST(floor(score / 20) AS BIGINT) AS score, id % 3 <> 0 AS failed_auction, id % 5 <> 0 AS micro_bos, id % 7 <> 0 AS rejected, (id % 25) / 100.0 AS cost_r, 2 + (id % 9) / 4.0 AS room_r, id % 4 <> 1 AS controlled_break, id % 6 <> 5 AS retest_touched, id % 7 <> 0 AS retest_rejected, id % 4 AS acceptance_bars, (id % 13) / 12.0 AS entry_below_atr, (id % 17) / 11.0 AS break_body_atr, r FROM trades"
_TREND = "phase IN ('EARLY_DOWNTREND', 'MATURE_DOWNTREND') AND terminal"
_COHORTS = {
    "M1A": "terminal AND context_ok", "M1B": f"{_TREND} AND score >= 4 AND failed_auction AND (micro_bos OR rejected) AND cost_r <= 0.20 AND room_r >= 2.5", "M1B_PLUS": f"{_TREND} AND score >= 4 AND failed_auction AND micro_bos AND rejected AND cost_r <= 0.18 AND room_r >= 3",
    "M2": f"{_TREND} AND score >= 4 AND controlled_break AND retest_touched AND retest_rejected AND entry_below_atr <= 0.65 AND break_body_atr <= 1.1 AND cost_r <= 0.20 AND room_r >= 2.5", "M2_BALANCED": f"{_TREND} AND score >= 3 AND controlled_break AND (retest_rejected OR acceptance_bars >= 2) AND entry_below_atr <= 0.90 AND break_body_atr <= 1.3 AND cost_r <= 0.22 AND room_r >= 2.5",
}


@query(TRADES + f", m AS ({_MARKS}) SELECT unnest([{', '.join(repr(k) for k in _COHORTS)}]) AS cohort, unnest([{', '.join(f'count(*) FILTER ({p})' for p in _COHORTS.values())}]) AS n, round(unnest([{', '.join(f'avg(r) FILTER ({p})' for p in _COHORTS.values())}]), 6) AS mean_r FROM m")
def p14_quality_cohorts(spark, d):
    i = c("id")
    m = trades(spark, d).withColumns({
        "phase": F.when(c("regime") == 0, "EARLY_DOWNTREND").when(c("regime") == 1, "MATURE_DOWNTREND").otherwise("UNCONFIRMED"), "terminal": i % 11 != 0, "context_ok": i % 2 == 0, "score": F.floor(c("score") / 20), "failed_auction": i % 3 != 0, "micro_bos": i % 5 != 0, "rejected": i % 7 != 0, "cost_r": (i % 25) / 100, "room_r": 2 + (i % 9) / 4,
        "controlled_break": i % 4 != 1, "retest_touched": i % 6 != 5, "retest_rejected": i % 7 != 0, "acceptance_bars": i % 4, "entry_below_atr": (i % 13) / 12, "break_body_atr": (i % 17) / 11,
    })
    cells = F.array(*(F.struct(F.lit(k).alias("cohort"), p.alias("_in")) for k, p in E.quality_cohorts().items()))
    long = m.select("r", F.inline(cells)).where("_in")
    return long.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_r"))
