"""Registered queries of signal rows, scores, risks and gates, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.columns import quotient, rounded
from tidewatch.operators import bars as B
from tidewatch.operators import features as W
from tidewatch.operators import scores as E
from tidewatch.operators import setups as P
from tidewatch.operators import signals as G
from tidewatch.operators.matching import as_of
from tidewatch.operators.scans import running
from tidewatch.plans.catalog import DAY, STEP, _out, query
from tidewatch.sources.candles import kept, shared_folder

HOUR, MARKET = 3600, ["purchase", "view"]
c = F.col

# The SQL side: a price walk of the events, bars of three steps, and the frame of features that each needs.
_TICKS = "ticks AS (SELECT event_type AS symbol, ts, round(100 * exp(sum(value - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 4000), 4) AS price FROM events)"


def _bars_sql(name: str, step: int) -> str:
    return f"{name} AS (SELECT symbol, (epoch_us(ts) // {step}000000) * {step} AS t, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, 1000 * sum(price) AS amount FROM ticks GROUP BY 1, 2)"


_W = "PARTITION BY symbol ORDER BY t"


def _frame_sql(src: str, out: str) -> str:
    ema = lambda n: f"list_reduce(closes, lambda s, x: x * (2.0 / {n + 1}) + s * (1 - 2.0 / {n + 1}))"
    return f"""{out}0 AS (SELECT *, row_number() OVER w AS rn, list(close) OVER (w ROWS UNBOUNDED PRECEDING) AS closes, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr, count(*) OVER m = 5 AND high >= max(high) OVER m AS sh, count(*) OVER m = 5 AND low <= min(low) OVER m AS sl FROM {src} WINDOW w AS ({_W}), m AS ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
{out}1 AS (SELECT *, CASE WHEN count(tr) OVER (w ROWS 13 PRECEDING) >= 7 THEN avg(tr) OVER (w ROWS 13 PRECEDING) END AS atr, {ema(20)} AS ema20, {ema(50)} AS ema50, {ema(100)} AS e100, CASE WHEN lag(sh, 2) OVER w THEN lag(high, 2) OVER w END AS swing_high, CASE WHEN lag(sl, 2) OVER w THEN lag(low, 2) OVER w END AS swing_low FROM {out}0 WINDOW w AS ({_W})),
{out}2 AS (SELECT *, CASE WHEN rn >= 100 THEN e100 ELSE ema50 END AS ema100, atr / close * 100 AS atr_pct, list(swing_high) FILTER (swing_high IS NOT NULL) OVER (w ROWS UNBOUNDED PRECEDING) AS hs, list(swing_low) FILTER (swing_low IS NOT NULL) OVER (w ROWS UNBOUNDED PRECEDING) AS ls, list(swing_low) FILTER (swing_low IS NOT NULL) OVER (w ROWS 239 PRECEDING) AS l240 FROM {out}1 WINDOW w AS ({_W})),
{out}3 AS (SELECT *, coalesce(hs[-1] < hs[-2], false) AS lower_high, coalesce(ls[-1] < ls[-2], false) AS lower_low, close < ema20 AND ema20 < ema50 AS ema_bear, ema50 <= ema100 OR close < ema100 AS macro_bear, coalesce(l240[-6:], []) AS swing_lows FROM {out}2),
{out}4 AS (SELECT symbol, rn AS zrn, t AS zt, least(open, close) AS zlo, high AS zhi, count(low) OVER n = 4 AND (low - min(low) OVER n) / atr >= 1.15 AND atr > 0 AND (close >= open OR abs(close - open) / greatest(high - low, 1e-12) <= 0.45) AS ok FROM {out}3 WINDOW n AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
{out}5 AS (SELECT a.symbol, a.rn, zlo, zhi, CASE WHEN zlo <= close AND close <= zhi THEN 0.0 ELSE least(abs(close - zlo), abs(close - zhi)) END AS dist, row_number() OVER (PARTITION BY a.symbol, a.rn ORDER BY zhi < close * 0.995, CASE WHEN zlo <= close AND close <= zhi THEN 0.0 ELSE least(abs(close - zlo), abs(close - zhi)) END, zt) AS k FROM {out}3 a JOIN {out}4 z ON z.symbol = a.symbol AND z.ok AND z.zrn BETWEEN a.rn - 74 AND a.rn - 4),
{out} AS (SELECT a.*, zlo AS zone_lower, zhi AS zone_upper, dist / nullif(atr, 0) AS zone_distance_atr FROM {out}3 a LEFT JOIN {out}5 z ON z.symbol = a.symbol AND z.rn = a.rn AND z.k = 1)"""


_FAR = "least(abs(g.close - d.zone_lower), abs(g.close - d.zone_upper))"
_SIG = f"""WITH {_TICKS}, {_bars_sql("raw4", STEP)}, {_bars_sql("raw24", DAY)}, {_frame_sql("raw4", "one")}, {_frame_sql("raw24", "day")},
g0 AS (SELECT *, max(high) OVER p AS lv20, CASE WHEN count(low) OVER p = 20 THEN min(low) OVER p END AS level, count(*) OVER p = 20 AND high > 1.001 * max(high) OVER p AND close < max(high) OVER p AS hit, avg(close) OVER b AS bm, stddev_pop(close) OVER b AS bs, count(*) OVER ({_W} ROWS 21 PRECEDING) = 22 AS b22 FROM one WINDOW p AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS ({_W} ROWS 19 PRECEDING)),
g1 AS (SELECT *, rn - max(CASE WHEN hit THEN rn END) OVER s AS sweep_bars_ago, arg_max(lv20, rn) FILTER (hit) OVER s AS sweep_level FROM g0 WINDOW s AS ({_W} ROWS 7 PRECEDING)),
k0 AS (SELECT a.symbol, a.rn, max(b.rn) AS brk FROM g1 a JOIN g1 b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 11 AND a.rn AND b.close < b.level - 0.1 * a.atr GROUP BY 1, 2),
k1 AS (SELECT k0.symbol, k0.rn, k0.brk, l.level AS lv, a.atr, a.close FROM k0 JOIN g1 l ON l.symbol = k0.symbol AND l.rn = k0.brk JOIN g1 a ON a.symbol = k0.symbol AND a.rn = k0.rn),
k2 AS (SELECT DISTINCT k1.symbol, k1.rn FROM k1 JOIN g1 b ON b.symbol = k1.symbol AND b.rn > k1.brk AND b.rn <= k1.rn AND b.high >= lv - 0.15 * k1.atr AND b.close <= lv + 0.1 * k1.atr),
g2 AS (SELECT g1.*, k1.brk IS NOT NULL AS breakdown, g1.rn - k1.brk AS break_bars_ago, k1.lv AS break_level, k1.brk IS NOT NULL AND (k2.rn IS NOT NULL OR abs(g1.close - k1.lv) <= 0.55 * g1.atr) AS retest FROM g1 LEFT JOIN k1 ON k1.symbol = g1.symbol AND k1.rn = g1.rn LEFT JOIN k2 ON k2.symbol = g1.symbol AND k2.rn = g1.rn),
g AS (SELECT *, {", ".join(f"coalesce((close / lag(close, {n}) OVER w - 1) * 100, 0) AS ret{n}" for n in (1, 3, 4, 12, 24))},
  CASE WHEN count(*) OVER p = 20 AND quantile_cont(volume, 0.5) OVER p > 0 THEN volume / quantile_cont(volume, 0.5) OVER p ELSE 1.0 END AS volume_ratio, coalesce(sum((high + low + close) / 3 * volume) OVER d / nullif(sum(volume) OVER d, 0), close) AS vwap, CASE WHEN b22 AND bs > 0 THEN (close - bm) / bs ELSE 0.0 END AS bb_z, coalesce(b22 AND bs > 0 AND high > bm + 2 * bs AND close < bm + 2 * bs, false) AS bb_failed,
  close < open AND (high - greatest(open, close)) / greatest(high - low, 1e-12) >= 0.35 AND high - greatest(open, close) >= 0.8 * abs(close - open) AS rejection, sweep_bars_ago IS NOT NULL AS sweep, lag(close) OVER w AS close_before, lag(high) OVER w AS high_before, lag(low) OVER w AS low_before, coalesce(lag(close, 3) OVER w, close) AS close_3_ago,
  coalesce(max(high) OVER p, high) AS prior_high20, max(high) OVER h AS high12, min(low) OVER h AS low12, min(low) OVER d AS low24, max(low) OVER h - min(low) OVER h AS low_spread12, sum(amount) OVER d AS turnover, least(count(*) OVER (w ROWS UNBOUNDED PRECEDING), 100) AS bars_so_far,
  CASE WHEN count(*) OVER (w ROWS 9 PRECEDING) = 10 THEN coalesce((close - min(low) OVER d) / nullif(max(high) OVER d - min(low) OVER d, 0), 0.5) END AS position24, CASE WHEN count(*) OVER (w ROWS 9 PRECEDING) = 10 THEN coalesce((close - min(low) OVER e) / nullif(max(high) OVER e - min(low) OVER e, 0), 0.5) END AS position48
  FROM g2 WINDOW w AS ({_W}), p AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), d AS ({_W} ROWS 23 PRECEDING), e AS ({_W} ROWS 47 PRECEDING), h AS ({_W} ROWS 11 PRECEDING)),
s0 AS (SELECT g.*, {", ".join(f"d.{k} AS s4_{k}" for k in G.COARSE)}, CASE WHEN d.zone_lower IS NULL THEN NULL WHEN g.close >= d.zone_lower AND g.close <= d.zone_upper THEN 0.0 ELSE {_FAR} / g.atr END AS s4_here FROM g ASOF LEFT JOIN (SELECT *, t + {DAY} AS closed_at FROM day) d ON d.symbol = g.symbol AND g.t + {STEP} >= d.closed_at),
s1 AS (SELECT *, list_max(list_filter(list_concat(swing_lows, coalesce(s4_swing_lows, [])), lambda x: x < close)) AS nearest_support, least(zone_distance_atr, s4_here) AS supply_distance, volume * 4 AS spread_bps, (close - open) / close / 20 AS funding_rate, ret24 * 1.5 AS change24 FROM s0 WHERE atr > 0),
m AS (SELECT t, {", ".join(f"avg(ret{n}) AS market_r{n}" for n in (1, 3, 4, 24))}, bool_and(close > ema20) AS above, bool_and(close < ema20) AS below FROM s1 WHERE symbol IN ('purchase', 'view') GROUP BY 1 HAVING count(*) = 2),
s AS (SELECT s1.*, market_r4, market_r24, {", ".join(f"ret{n} - coalesce(market_r{n}, 0) AS relative{n}" for n in (1, 3, 4, 24))},
  CASE WHEN market_r4 IS NULL THEN 'UNKNOWN' WHEN market_r4 >= 1.2 AND market_r24 >= 2.5 AND above THEN 'RISK_ON' WHEN market_r4 <= -0.8 AND market_r24 <= 0 AND below THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS market_state, CASE WHEN market_r4 IS NULL THEN 'UNKNOWN' WHEN above AND market_r24 > 0 THEN 'BULL' WHEN below AND market_r24 < 0 THEN 'BEAR' ELSE 'RANGE' END AS market_trend,
  (ema20 - close) / atr AS under, CASE WHEN nearest_support < close THEN (close - nearest_support) / atr END AS near FROM s1 LEFT JOIN m ON m.t = s1.t)"""


def pts(*rules: tuple[str, float], other: float = 0) -> str:
    """Points of the first rule that holds, as SQL."""
    return "(CASE " + " ".join(f"WHEN {p} THEN {n}" for p, n in rules) + f" ELSE {other} END)"


def plus(*terms: str) -> str:
    return "(" + " + ".join(terms) + ")"


def flag(p: str, n: float) -> str:
    return pts((p, n))


def _clamped(x: str, lo: float = 0, hi: float = 100) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def walk(spark, d, step, scale=4000):
    """Bars of a price walk: the running sum of the events' values; a larger scale is quieter."""
    e = B.with_utc(spark.read.parquet(f"{d}/events.parquet")).where("ts IS NOT NULL AND value IS NOT NULL").select(c("event_type").alias("symbol"), "ts", "event_id", (c("value") - 50).alias("move"))
    summed = running(e, ["symbol"], ["ts", "event_id"], "move", span_of=F.floor(F.unix_seconds("ts") / DAY))
    ticks = summed.select("symbol", "ts", "event_id", rounded(100 * F.exp(c("equity") / scale), 4).alias("price"))
    return B.from_ticks(ticks, step, "event_id").withColumn("amount", c("amount") * 1000)


def frames(spark, d, *steps):
    """Bars of the price walk at several steps, the finest first: made once from the ticks and written, the coarser ones from the finer."""
    finest = kept(walk(spark, d, steps[0]), shared_folder(spark, "bars"))
    return [finest, *(B.resample(finest, s) for s in steps[1:])]


def signal(spark, d, before=lambda rows: rows, bars=None, pivots=None):
    one, four = bars or frames(spark, d, STEP, DAY)
    rows = before(G.signal_rows(one, four, DAY, STEP, pivots=pivots)).where("atr > 0")
    marked = rows.withColumns({"spread_bps": c("volume") * 4, "funding_rate": quotient(c("close") - c("open"), c("close")) / 20, "change24": c("ret24") * 1.5})
    return G.with_market(marked, MARKET)


_ROW = ("close", "atr_pct", "ema20", "ema100", "ret1", "ret24", "volume_ratio", "vwap", "bb_z", "prior_high20", "high12", "low24", "position24", "position48", "turnover", "nearest_support", "supply_distance", "break_level", "sweep_level", "relative4", "s4_ema20", "zone_lower")
_FLAGS = ("ema_bear", "macro_bear", "lower_high", "lower_low", "breakdown", "retest", "sweep", "rejection", "bb_failed", "s4_ema_bear", "s4_macro_bear", "s4_lower_high", "market_state", "market_trend", "break_bars_ago", "sweep_bars_ago")


@query(_SIG + " SELECT symbol, t, " + ", ".join(f"round({k}, 6) AS {k}" for k in _ROW) + ", " + ", ".join(_FLAGS) + " FROM s")
def w34_signal_row(spark, d):
    return _out(signal(spark, d), "symbol", "ts", *_ROW, *_FLAGS)


@query(_SIG + " SELECT symbol, t, round(atr_pct, 6) AS atr_pct, round(ema20, 6) AS ema20, round(ema50, 6) AS ema50, round(ema100, 6) AS ema100, ema_bear, macro_bear, lower_high, lower_low FROM one WHERE atr > 0")
def w7_structure(spark, d):
    return _out(W.with_structure(W.with_atr(walk(spark, d, STEP))).where("atr > 0"), "symbol", "ts", "atr_pct", "ema20", "ema50", "ema100", "ema_bear", "macro_bear", "lower_high", "lower_low")


_GAP, _HIGH = "abs(close - ema20) / atr", "greatest(0, prior_high20 - close) / atr"
_LIQ = pts(("turnover >= 50000000", 12), ("turnover >= 10000000", 10), ("turnover >= 2000000", 7), ("turnover >= 500000", 4))
_FUND = pts(("funding_rate >= 0.0008", 5), ("funding_rate >= 0.0002", 3), ("funding_rate <= -0.001", -8), ("funding_rate <= -0.0004", -4))
_SPREAD = pts(("spread_bps > 60", -20), ("spread_bps > 40", -12), ("spread_bps > 25", -6))
_FAST = {
    "bear_structure": "least(34, " + plus(pts(("ema_bear", 18), ("close < ema20", 9)), flag("lower_high", 8), flag("lower_low", 8), flag("macro_bear", 5)) + ")",
    "momentum": plus(pts(("ret4 BETWEEN -6 AND -0.25", 8), ("ret4 >= -10 AND ret4 < -6", 4)), flag("ret12 BETWEEN -12 AND -0.5", 6), flag(f"ret4 > 0 AND {_HIGH} <= 1", 5)),
    "location": pts((f"{_GAP} <= 0.45", 12), (f"{_GAP} <= 0.9", 8), (f"{_HIGH} <= 0.8", 7), (f"{_HIGH} <= 1.5", 4)),
    "volatility": pts(("atr_pct BETWEEN 0.35 AND 5", 10), ("atr_pct BETWEEN 0.25 AND 12", 6)),
    "volume": pts(("volume_ratio >= 1.5", 8), ("volume_ratio >= 1", 5), other=2),
    "liquidity": _LIQ, "funding": _FUND, "spread_penalty": _SPREAD,
    "chase_penalty": plus(flag("ret4 < -8", -8), flag("ret12 < -18", -10), "(CASE WHEN under > 2.2 THEN -least(20, floor((under - 2.2) * 6)) ELSE 0 END)", flag("change24 < -30", -12), flag("abs(change24) > 80", -15)),
}


@query(_SIG + ", p AS (SELECT symbol, t, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _FAST.items()) + f" FROM s) SELECT *, {_clamped(plus(*_FAST))} AS fast_score FROM p")
def e1_fast_score(spark, d):
    return _out(signal(spark, d).withColumns(E.fast_score()), "symbol", "ts", *_FAST, "fast_score")


_DEEP_PARTS = {
    "structure_4h": "least(25, " + plus(flag("s4_ema_bear", 11), flag("s4_lower_high", 6), flag("s4_lower_low", 5), flag("s4_macro_bear", 3)) + ")",
    "structure_1h": "least(25, " + plus(flag("ema_bear", 10), flag("lower_high", 7), flag("lower_low", 5), flag("close < ema20", 3)) + ")",
    "trigger": "least(20, " + plus(flag("breakdown", 7), flag("retest", 5), flag("sweep", 6), flag("rejection", 4)) + ")",
    "deep_location": pts(("supply_distance <= 0.35", 15), ("supply_distance <= 0.75", 11), (f"{_GAP} <= 0.45", 9), (f"{_GAP} <= 0.9", 5)),
    "rr_room": pts(("room_r >= 3", 15), ("room_r >= 2.2", 12), ("room_r >= 1.7", 7), ("room_r >= 1.2", 3), other=-8),
    "participation": f"least(10, least(8, floor({_LIQ} / 2) + greatest(0, {_FUND})) + {flag('volume_ratio >= 1.2', 2)})",
    "deep_spread": _SPREAD, "deep_chase": plus(flag("ret4 < -8", -8), flag("ret12 < -18", -8), flag("under > 2.2", -12), flag("stop_pct > 8", -15)),
    "manipulation": plus(flag("abs(change24) > 55", -8), flag("(high - low) / atr > 4", -8)),
}
_DEEP = _SIG + f""", d0 AS (SELECT *, greatest(greatest(high12, CASE WHEN zone_upper >= close THEN zone_upper END, CASE WHEN s4_zone_upper >= close THEN s4_zone_upper END) + 0.15 * atr - close, 0.8 * atr) AS risk FROM s),
d1 AS (SELECT *, risk / close * 100 AS stop_pct, CASE WHEN nearest_support < close THEN (close - nearest_support) / risk ELSE 5.0 END AS room_r FROM d0),
d2 AS (SELECT *, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _DEEP_PARTS.items())} FROM d1),
d3 AS (SELECT *, {_clamped(plus(*_DEEP_PARTS))} AS deep_score, coalesce(sweep OR rejection OR retest OR (breakdown AND {_GAP} <= 0.8), false) AS trigger_present, structure_4h >= 14 AND structure_1h >= 14 AS mtf_ok, atr_pct BETWEEN 0.25 AND 12 AS volatility_ok, coalesce(supply_distance <= 0.65, false) OR {_GAP} <= 0.65 OR retest AS location_ok, stop_pct <= 8 AND room_r >= 1.7 AS risk_ok FROM d2),
d AS (SELECT *, CASE WHEN deep_score >= 80 AND trigger_present AND mtf_ok AND volatility_ok AND location_ok AND risk_ok THEN 'ENTRY_READY' WHEN deep_score >= 70 AND mtf_ok AND volatility_ok AND risk_ok THEN 'DEVELOPING' WHEN deep_score >= 60 THEN 'WATCH' ELSE 'IGNORE' END AS status,
  array_to_string(list_filter([CASE WHEN s4_ema_bear THEN '4H bearish EMA structure' END, CASE WHEN s4_lower_high AND s4_lower_low THEN '4H lower-high/lower-low' END, CASE WHEN lower_high THEN '1H lower-high' END, CASE WHEN sweep THEN 'upper liquidity sweep' END, CASE WHEN retest THEN 'breakdown + retest' END, CASE WHEN breakdown AND NOT retest THEN 'fresh breakdown' END, CASE WHEN rejection THEN 'bearish rejection candle' END, CASE WHEN zone_distance_atr <= 0.75 THEN 'near 1H supply' END, CASE WHEN deep_chase < 0 THEN 'short-chase penalty active' END], lambda x: x IS NOT NULL), ';') AS reasons FROM d3)"""
_GATES = ("trigger_present", "mtf_ok", "volatility_ok", "location_ok", "risk_ok")


@query(_DEEP + " SELECT symbol, t, " + ", ".join(_DEEP_PARTS) + ", deep_score, " + ", ".join(_GATES) + ", status, reasons, round(stop_pct, 6) AS stop_pct, round(room_r, 6) AS room_r, round(close - 2 * risk, 6) AS tp1 FROM d")
def e2_deep_score(spark, d):
    return _out(E.with_deep_score(signal(spark, d)), "symbol", "ts", *_DEEP_PARTS, "deep_score", *_GATES, "status", "reasons", "stop_pct", "room_r", "tp1")


_PRE = _SIG + f""", p0 AS (SELECT s.*, q.plv, q.low24b, q.n36, q.last8, q.span12 FROM s JOIN (SELECT symbol, rn, CASE WHEN count(low) OVER p >= 12 THEN min(low) OVER p END AS plv, min(low) OVER p AS low24b, count(*) OVER ({_W} ROWS 35 PRECEDING) AS n36, list(close) OVER ({_W} ROWS 7 PRECEDING) AS last8, max(high) OVER h - min(low) OVER h AS span12 FROM one WHERE atr > 0 WINDOW p AS ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), h AS ({_W} ROWS 11 PRECEDING)) q ON q.symbol = s.symbol AND q.rn = s.rn),
p1 AS (SELECT a.symbol, a.rn, max(b.rn) AS brk FROM p0 a JOIN p0 b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 15 AND a.rn AND b.close < b.plv - 0.05 * a.atr WHERE a.n36 >= 36 GROUP BY 1, 2),
p2 AS (SELECT p1.symbol, p1.rn, p1.brk, any_value(l.plv) AS lv, count(*) FILTER (b.close < l.plv) AS below FROM p1 JOIN p0 l ON l.symbol = p1.symbol AND l.rn = p1.brk JOIN p0 b ON b.symbol = p1.symbol AND b.rn BETWEEN p1.brk AND p1.rn GROUP BY 1, 2, 3),
p3 AS (SELECT p0.*, brk IS NOT NULL AS proxy_broken, p0.rn - brk AS ago, CASE WHEN brk IS NOT NULL THEN lv WHEN n36 >= 36 THEN low24b END AS plevel, CASE WHEN brk IS NOT NULL THEN below WHEN n36 >= 36 THEN len(list_filter(last8, lambda x: x < low24b)) ELSE 0 END AS n_below FROM p0 LEFT JOIN p2 ON p2.symbol = p0.symbol AND p2.rn = p0.rn),
p4 AS (SELECT *, CASE WHEN n36 >= 36 THEN abs(close - plevel) / atr ELSE 99.0 END AS pnear FROM p3)"""
_PRE_PARTS = (
    flag("macro_bear", 16), pts(("ema_bear", 14), ("close < ema20", 7)), flag("lower_high", 9), flag("lower_low", 8), f"(CASE WHEN proxy_broken THEN 20 + {pts(('ago <= 8', 8), ('ago <= 16', 4))} ELSE {pts(('pnear <= 0.40', 13), ('pnear <= 0.80', 8), ('pnear <= 1.25', 4))} END)", pts(("n_below >= 5", 10), ("n_below >= 3", 6), ("n_below >= 1", 2)),
    flag("low_spread12 / atr <= 1.2", 6), flag("span12 / atr <= 4", 3), pts(("ret4 BETWEEN -6 AND -0.2", 8), ("ret4 < -6", 3)), flag("ret12 BETWEEN -12 AND -0.5", 6), pts(("under BETWEEN 0.4 AND 2.5", 6), ("under > 3.5", -10)),
    pts(("volume_ratio >= 1.5", 5), ("volume_ratio >= 1", 3)), flag("market_state = 'RISK_OFF'", 8), flag("ret4 < -10", -10), flag("ret12 < -20", -10), flag("ret24 < -35", -8), pts(("turnover >= 2000000", 3), ("turnover < 250000", -5)),
)


@query(_PRE + f" SELECT symbol, t, proxy_broken, CAST(ago AS BIGINT) AS proxy_bars_ago, round(plevel, 6) AS proxy_level, CAST(n_below AS BIGINT) AS proxy_closes_below, round(pnear, 6) AS proxy_near_atr, CAST({_clamped(plus(*_PRE_PARTS))} AS DOUBLE) AS prefilter_score FROM p4")
def e3_prefilter(spark, d):
    return _out(E.with_prefilter(signal(spark, d)), "symbol", "ts", "proxy_broken", "proxy_bars_ago", "proxy_level", "proxy_closes_below", "proxy_near_atr", "prefilter_score")


# small bars: trigger points and the plan's anchors, as of the signal bar's close
_SMALL = f""", {_bars_sql("raw1", HOUR)}, {_frame_sql("raw1", "hr")},
h0 AS (SELECT *, close < ema20 AND max(CASE WHEN high >= ema20 * 0.995 THEN 1 ELSE 0 END) OVER ({_W} ROWS 4 PRECEDING) = 1 AS fr, close < open AND (high - greatest(open, close)) / greatest(high - low, 1e-12) >= 0.35 AND high - greatest(open, close) >= 0.8 * abs(close - open) AS rej, coalesce(close < min(low) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), false) AS br, max(high) OVER ({_W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS top, max(high) OVER ({_W} ROWS 11 PRECEDING) AS high12h, max(high) OVER ({_W} ROWS 15 PRECEDING) AS high16h FROM hr),
h1 AS (SELECT *, max(CASE WHEN rej THEN 1 ELSE 0 END) OVER ({_W} ROWS 3 PRECEDING) = 1 AS rej4 FROM h0),
h2 AS (SELECT symbol, t + {HOUR} AS closed_at, close AS entry15, atr AS atr15, high12h, high16h, fr AS micro_fr, lower_high AS micro_lh, lower_low AS micro_ll, rej4 AS micro_rej, least(20, {plus(flag("close < ema20", 4), flag("lower_high", 5), flag("lower_low", 4), flag("fr", 5), flag("rej4", 3), flag("br", 2), flag("high > top * 1.0005 AND close < top", 2))}) AS micro FROM h1),
x AS (SELECT s.*, h.entry15, h.atr15, h.high12h, h.high16h, h.micro_fr, h.micro_lh, h.micro_ll, h.micro_rej, h.micro FROM s ASOF LEFT JOIN h2 h ON h.symbol = s.symbol AND s.t + {STEP} >= h.closed_at)"""
_MICRO = ("micro", "micro_failed_reclaim", "micro_lower_high", "micro_lower_low", "micro_rejection", "entry15", "atr15", "high12h", "high16h")


def small_signal(spark, d):
    """Signal rows with the trigger of the last closed small bar."""
    small = W.with_structure(W.with_atr(walk(spark, d, HOUR))).withColumn("rejected", G.rejection())
    near = F.max((c("high") >= c("ema20") * 0.995).cast("int")).over(W.rows(-4, 0)) == 1
    own = small.withColumns({
        "micro": P.micro_trigger(c("ema20"), c("lower_high"), c("lower_low"), c("rejected")), "micro_failed_reclaim": (c("close") < c("ema20")) & near, "micro_lower_high": c("lower_high"), "micro_lower_low": c("lower_low"), "micro_rejection": F.max(c("rejected").cast("int")).over(W.rows(-3, 0)) == 1,
        "entry15": c("close"), "atr15": c("atr"), "high12h": F.max("high").over(W.rows(-11, 0)), "high16h": F.max("high").over(W.rows(-15, 0)), "closed_at": F.timestamp_seconds(F.unix_seconds("ts") + HOUR),
    })
    rows = signal(spark, d)
    return as_of(rows.drop("as_of_ts"), own.select("symbol", "closed_at", *_MICRO), ["symbol"], "known_at", "closed_at", list(_MICRO))


_EXT, _ABOVE = "greatest(0, -under)", "greatest(0, (close - vwap) / atr)"
_EXH = "(coalesce(rejection, false) OR bb_failed)"
_REV_PARTS = {
    "pump": "least(25, " + plus(pts(("ret24 >= 15", 12), ("ret24 >= 8", 10), ("ret24 >= 5", 8), ("ret24 > 0", 4)), pts((f"{_EXT} >= 3", 8), (f"{_EXT} >= 2", 6), (f"{_EXT} >= 1.2", 3)), flag("bb_z >= 2", 4), flag(f"{_ABOVE} >= 2", 3)) + ")",
    "liquidity_location": "least(25, " + plus(flag("sweep", 15), flag("sweep AND sweep_bars_ago <= 2", 4), pts(("supply_distance <= 0.35", 8), ("supply_distance <= 0.75", 6), ("supply_distance <= 1", 3))) + ")",
    "exhaustion": "least(20, " + plus(flag("rejection", 7), flag("bb_failed", 6), pts(("volume_ratio >= 2", 5), ("volume_ratio >= 1.4", 3)), flag(f"ret24 >= 5 AND {_EXH}", 2)) + ")",
    "micro_points": "micro", "market_points": _clamped(f"5 + CASE WHEN risk_on THEN -10 WHEN coalesce(btc_r4 <= 0.5, false) OR NOT btc_above THEN 6 ELSE 0 END", -5, 10),
}
_REV = _SIG + _SMALL + f""", b AS (SELECT t, ret4 AS btc_r4, ret24 AS btc_r24, close > ema20 AS btc_above FROM s1 WHERE symbol = 'purchase'),
y0 AS (SELECT x.*, btc_r4, coalesce(btc_above, false) AS btc_above, coalesce(btc_r4 >= 2 AND btc_r24 >= 4 AND btc_above, false) AS risk_on, greatest(high16h + 0.10 * atr15 - entry15, 0.9 * atr15) AS risk15 FROM x LEFT JOIN b ON b.t = x.t),
y1 AS (SELECT *, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _REV_PARTS.items())}, coalesce(micro >= 12, false) AS gate_confirmation, coalesce(risk15 / entry15 * 100 <= 5.5 AND CASE WHEN nearest_support < entry15 THEN (entry15 - nearest_support) / risk15 ELSE 5.0 END >= 1.7, false) AS gate_risk, sweep AND ret24 > 0 AS gate_context, coalesce(supply_distance <= 1, false) OR {_EXH} AS gate_location, risk_on AS gate_risk_on_block FROM y0),
y AS (SELECT *, {_clamped(plus(*_REV_PARTS))} AS reversal_score FROM y1)"""
_REV_GATES = ("gate_context", "gate_confirmation", "gate_location", "gate_risk", "gate_risk_on_block")


def _reversal(spark, d):
    rows = small_signal(spark, d)
    btc = rows.where(c("symbol") == "purchase").select("ts", c("ret4").alias("btc_r4"), c("ret24").alias("btc_r24"), (c("close") > c("ema20")).alias("btc_above"))
    return rows.join(btc, "ts", "left").withColumns({"micro_confirmed": c("micro") >= 12, "high15": c("high16h")}).withColumns(E.reversal_score())


@query(_REV + " SELECT symbol, t, " + ", ".join(_REV_PARTS) + ", reversal_score, " + ", ".join(_REV_GATES) + ", CASE WHEN reversal_score >= 70 AND gate_context AND gate_confirmation AND gate_location AND gate_risk AND NOT risk_on THEN 'ENTRY_READY' WHEN reversal_score >= 58 AND gate_context AND gate_location AND gate_risk THEN 'DEVELOPING' ELSE 'IGNORE' END AS reversal_status FROM y")
def e4_reversal_score(spark, d):
    return _out(_reversal(spark, d), "symbol", "ts", *_REV_PARTS, "reversal_score", *_REV_GATES, "reversal_status")


@query(_REV + ", h AS (SELECT *, gate_context AND gate_confirmation AND gate_location AND gate_risk AND NOT gate_risk_on_block AS passed FROM y) SELECT symbol, passed, count(*) AS n, round(avg(reversal_score), 6) AS mean_score FROM h GROUP BY 1, 2")
def p7_hard_gate(spark, d):
    out = _reversal(spark, d).withColumn("passed", E.hard_gate()).groupBy("symbol", "passed").agg(F.count("*").alias("n"), F.avg("reversal_score").alias("mean_score"))
    return _out(out, *out.columns)


_MAN = flag("(high - low) / atr >= 4 AND volume_ratio >= 3", 8)
_NOT_ON = "market_state <> 'RISK_ON'"
_FLAGS4 = plus(flag("rejection", 1), flag("bb_failed", 1), flag("volume_ratio >= 1.4", 1), flag(f"{_ABOVE} >= 1.2", 1))
_FRESH = "coalesce(sweep AND sweep_bars_ago <= 2 AND sweep_bars_ago > 0, false)"
_LOCATED = "(coalesce(supply_distance <= 0.75, false) OR bb_failed)"
_ENGINES = {
    "EXTREME_PUMP_REVERSAL": (f"least(28, greatest(0, (ret24 - 8) * 1.8)) + least(16, {_EXT} * 4 + greatest(0, bb_z - 1) * 3 + {_ABOVE} * 2) + {flag('sweep', 18)} + micro + {flag(chr(39).join(('market_state IN (', 'RISK_OFF', ', ', 'NEUTRAL', ')')), 8)} + {flag(_EXH, 8)} - {_MAN}", f"ret24 >= 10 AND sweep AND ({_EXT} >= 1.5 OR bb_z >= 1.5 OR {_ABOVE} >= 1.5) AND micro_fr AND (micro_lh OR micro_ll OR micro_rej) AND ({_NOT_ON} OR (ret24 >= 15 AND micro >= 12))", 68),
    "EXHAUSTION_REVERSAL": (f"least(18, greatest(0, ret24) * 1.5) + {_FLAGS4} * 10 + micro + {flag(_NOT_ON, 10)} + {flag('supply_distance <= 0.75', 8)} - {_MAN}", f"ret24 >= 4 AND ret24 < 18 AND {_FLAGS4} >= 2 AND micro_fr AND (micro_lh OR micro_rej) AND {_NOT_ON}", 66),
    "BREAKDOWN_RETEST": (f"{plus(flag('s4_ema_bear', 12), flag('s4_lower_high', 8), flag('s4_lower_low', 7), flag('ema_bear', 10), flag('lower_high', 6), pts(('retest', 24), ('breakdown', 10)))} + least(18, micro) + {flag(chr(39).join(('market_state = ', 'RISK_OFF', '')), 12)} - {flag('ret12 < -18', 6)}", "market_state = 'RISK_OFF' AND breakdown AND retest AND (s4_ema_bear OR (s4_lower_high AND s4_lower_low)) AND (micro_fr OR micro_lh) AND ret12 > -22", 65),
    "RELATIVE_WEAKNESS": (f"least(30, greatest(0, -relative24) * 3) + least(15, greatest(0, -relative4) * 4) + {plus(flag('lower_high', 10), flag('close < ema20', 8), flag('s4_lower_high', 6))} + least(18, micro) + {flag(_NOT_ON, 8)} - {flag('ret24 <= -15', 10)}", f"relative4 <= -1 AND relative24 <= -3 AND ret24 > -15 AND (lower_high OR close < ema20) AND (micro_fr OR micro_lh) AND ({_NOT_ON} OR relative24 <= -7)", 64),
    "FAILED_BREAKOUT_SUPPLY_FADE": (f"{flag(_FRESH, 22)} + {flag(_LOCATED, 18)} + least(20, micro) + {flag(_EXH, 12)} + {flag(_NOT_ON, 10)} + least(10, greatest(0, ret24)) - {_MAN}", f"ret24 >= -2 AND ret24 < 10 AND {_FRESH} AND {_LOCATED} AND micro_fr AND {_NOT_ON}", 65),
}
_CAND = _SIG + _SMALL + """, z0 AS (SELECT *, greatest(high12h + 0.10 * atr15 - entry15, atr15) AS risk15 FROM x WHERE atr15 > 0), z1 AS (SELECT *, coalesce(risk15 / entry15 * 100 <= 6 AND CASE WHEN nearest_support < entry15 THEN (entry15 - nearest_support) / risk15 ELSE 5.0 END >= 2 AND entry15 * 14 / 1e4 / risk15 <= 0.10, false) AS risk_ok FROM z0), z AS (""" + " UNION ALL ".join(f"SELECT symbol, t, '{k}' AS engine, {_clamped(score)} AS score, coalesce({hard}, false) AS hard_ok, risk_ok, {least} AS least FROM z1" for k, (score, hard, least) in _ENGINES.items()) + "), v AS (SELECT *, CASE WHEN hard_ok AND risk_ok AND score >= least THEN 'ENTRY_READY' WHEN score >= 50 THEN 'WATCH' ELSE 'IGNORE' END AS status FROM z)"


@query(_CAND + " SELECT symbol, t, engine, round(score, 6) AS score, hard_ok, risk_ok, status, row_number() OVER (PARTITION BY symbol, t ORDER BY CASE status WHEN 'ENTRY_READY' THEN 0 WHEN 'WATCH' THEN 1 ELSE 2 END, round(score, 6) DESC, engine) = 1 AS primary_one FROM v")
def e5_engine_candidates(spark, d):
    rows = E.engine_candidates(small_signal(spark, d).withColumn("high15", c("high12h"))).withColumn("score", F.round("score", 6))
    return _out(P.engine_status(rows, E.ENGINES).withColumnRenamed("primary", "primary_one"), "symbol", "ts", "engine", "score", "hard_ok", "risk_ok", "status", "primary_one")


_BB = "bars_so_far >= 35 AND ret24 > 0 AND bb_failed AND (greatest(high + 0.15 * atr - close, 0.8 * atr)) / close * 100 <= 8"


@query(_SIG + f" SELECT symbol, t, {_BB} AS baseline, CASE WHEN {_BB} THEN round(close + greatest(high + 0.15 * atr - close, 0.8 * atr), 6) END AS baseline_stop, CASE WHEN {_BB} THEN round(close - 2 * greatest(high + 0.15 * atr - close, 0.8 * atr), 6) END AS baseline_tp1, {_BB} AND ret24 >= 5 AS top_gainer FROM s")
def e10_bollinger_signal(spark, d):
    return _out(signal(spark, d).withColumns(E.bollinger_signal()), "symbol", "ts", "baseline", "baseline_stop", "baseline_tp1", "top_gainer")


_CLASS = "CASE WHEN sweep AND (rejection OR coalesce(supply_distance <= 1, false)) AND ret24 > 0 THEN 'LIQUIDITY_REVERSAL' WHEN breakdown AND (retest OR location_ok) AND mtf_ok AND structure_4h + structure_1h >= 28 THEN 'TREND_CONTINUATION' WHEN coalesce(supply_distance <= 0.75, false) AND (rejection OR structure_1h >= 17) AND NOT retest THEN 'SUPPLY_FADE' ELSE 'UNCLASSIFIED' END"


@query(_DEEP + f", q AS (SELECT *, {_CLASS} AS setup FROM d), r AS (SELECT *, setup = 'LIQUIDITY_REVERSAL' AND sweep AND ret24 > 0 AND (rejection OR retest OR structure_1h >= 10 OR under >= 0) AND (coalesce(supply_distance <= 1, false) OR rejection) AND volatility_ok AND stop_pct <= 8 AND room_r >= 1.7 AS ready FROM q) SELECT symbol, t, setup, CASE WHEN ready THEN 'ENTRY_READY' WHEN setup = 'LIQUIDITY_REVERSAL' THEN 'DEVELOPING' WHEN setup IN ('TREND_CONTINUATION', 'SUPPLY_FADE') THEN 'WATCH' ELSE 'IGNORE' END AS model_status, CASE WHEN ready AND ret24 >= 5 THEN 'HIGH' ELSE 'NORMAL' END AS model_priority FROM r")
def p6_model_gate(spark, d):
    rows = E.with_deep_score(signal(spark, d))
    setup = P.setup_class(c("sweep"), c("breakdown"), c("retest"), c("rejection"), c("location_ok"), c("mtf_ok"), c("structure_4h") + c("structure_1h"), c("structure_1h"), c("supply_distance"), c("ret24"))
    return _out(rows.withColumn("setup", setup).withColumns(E.model_gate(c("setup"))), "symbol", "ts", "setup", "model_status", "model_priority")


_ROUTE = """, u0 AS (SELECT *, coalesce(supply_distance <= 0.85, false) AS near_supply, coalesce(sweep AND sweep_bars_ago <= 3 AND sweep_bars_ago > 0, false) AS fsweep, coalesce(breakdown AND break_bars_ago <= 12 AND break_bars_ago > 0, false) AS fbreak, coalesce(rejection, false) OR (ret24 >= 4 AND volume_ratio >= 1.4) AS tired, relative4 <= -1 OR relative24 <= -3 AS weak, market_state = 'RISK_ON' AND market_trend = 'BULL' AS bull, coalesce(s4_ema_bear, false) OR coalesce(s4_lower_high AND s4_lower_low, false) AS htf, ema_bear OR (lower_high AND close < ema20) AS local_bear FROM s),
u1 AS (SELECT *, ret24 >= 10 AND (fsweep OR ret24 >= 18) AS pump FROM u0),
u2 AS (SELECT *, (near_supply OR fsweep) AND (fsweep OR rejection) AND (NOT bull OR (pump AND fsweep)) AS rev, fbreak AND htf AND local_bear AND market_trend <> 'BULL' AND ret24 > -18 AS cont, """ + plus(flag("near_supply", 30), flag("fsweep", 30), flag("rejection", 12), flag("pump", 10), flag("tired", 6), flag("weak", 8), flag("bull", -20)) + " AS qr, " + plus(flag("fbreak", 35), flag("htf", 25), flag("local_bear", 15), flag("market_state = 'RISK_OFF'", 12), flag("weak", 8), flag("ret24 <= -12", -10)) + """ AS qc FROM u1),
u AS (SELECT *, rev AND (NOT cont OR qr > qc) AS isrev, CASE WHEN rev AND (NOT cont OR qr > qc) THEN 'REVERSAL_AT_LOCATION' WHEN cont THEN 'BEAR_CONTINUATION_RETEST' END AS setup FROM u2)"""


@query(_SIG + _ROUTE + f" SELECT symbol, t, setup, CASE WHEN isrev AND pump THEN 'EXTREME_PUMP_REVERSAL' WHEN isrev AND tired THEN 'FAILED_AUCTION_EXHAUSTION' WHEN NOT isrev AND cont AND weak THEN 'RELATIVE_WEAK_CONTINUATION' WHEN setup IS NOT NULL THEN 'STANDARD' END AS subtype, CAST(CASE WHEN isrev THEN {_clamped('qr')} WHEN cont THEN {_clamped('qc')} END AS DOUBLE) AS setup_quality FROM u")
def p9_setup_router(spark, d):
    return _out(signal(spark, d).withColumns(E.setup_router()), "symbol", "ts", "setup", "subtype", "setup_quality")


_ZONE = """, v0 AS (SELECT *, list_min(list_filter([
  CASE WHEN setup = 'BEAR_CONTINUATION_RETEST' THEN {'rank': 0, 'distance': CASE WHEN close >= break_level - 0.10 * atr AND close <= break_level + 0.25 * atr THEN 0.0 ELSE greatest(0, break_level - 0.10 * atr - close) / atr END, 'source': 'BROKEN_SUPPORT_RETEST', 'lower': break_level - 0.10 * atr, 'upper': break_level + 0.25 * atr} END,
  CASE WHEN setup = 'REVERSAL_AT_LOCATION' AND sweep_level IS NOT NULL THEN {'rank': 0, 'distance': CASE WHEN close >= sweep_level - 0.08 * atr AND close <= sweep_level + 0.30 * atr THEN 0.0 ELSE greatest(0, sweep_level - 0.08 * atr - close) / atr END, 'source': 'SWEEP_RETEST', 'lower': sweep_level - 0.08 * atr, 'upper': sweep_level + 0.30 * atr} END,
  CASE WHEN zone_upper >= close - 0.20 * atr THEN {'rank': 1, 'distance': CASE WHEN close >= zone_lower AND close <= zone_upper THEN 0.0 ELSE greatest(0, zone_lower - close) / atr END, 'source': 'SUPPLY_1H', 'lower': zone_lower, 'upper': zone_upper} END,
  CASE WHEN s4_zone_upper >= close - 0.20 * atr THEN {'rank': 2, 'distance': CASE WHEN close >= s4_zone_lower AND close <= s4_zone_upper THEN 0.0 ELSE greatest(0, s4_zone_lower - close) / atr END, 'source': 'SUPPLY_4H', 'lower': s4_zone_lower, 'upper': s4_zone_upper} END,
  {'rank': 9, 'distance': CASE WHEN close >= ema20 - 0.2 * atr AND close <= ema20 + 0.2 * atr THEN 0.0 ELSE greatest(0, ema20 - 0.2 * atr - close) / atr END, 'source': 'EMA20_PULLBACK_REFERENCE', 'lower': ema20 - 0.2 * atr, 'upper': ema20 + 0.2 * atr}], lambda z: z IS NOT NULL)) AS best FROM u),
v1 AS (SELECT *, best.source AS psource, best.lower AS plo, best.upper AS phi FROM v0), v AS (SELECT *, CASE WHEN close < plo THEN (plo - close) / atr WHEN close > phi THEN (close - phi) / atr ELSE 0.0 END AS pd FROM v1)"""


@query(_SIG + _ROUTE + _ZONE + " SELECT symbol, t, psource AS preferred_source, round(plo, 6) AS preferred_lower, round(phi, 6) AS preferred_upper FROM v")
def p21_preferred_zone(spark, d):
    return _out(signal(spark, d).withColumns(E.setup_router()).withColumns(E.preferred_zone()), "symbol", "ts", "preferred_source", "preferred_lower", "preferred_upper")


_CONT = """, c0 AS (SELECT v.*, b.close AS bc, b.open AS bo FROM v LEFT JOIN one b ON b.symbol = v.symbol AND b.rn = v.rn - v.break_bars_ago AND v.break_bars_ago > 0 AND v.break_bars_ago <= 12 AND b.atr > 0),
c1 AS (SELECT c0.symbol, c0.rn, bool_or(l.high >= break_level - 0.20 * c0.atr) AS retouched, bool_or(l.close > break_level + 0.12 * c0.atr) AS reclaimed, count(*) FILTER (l.close >= break_level - 0.20 * c0.atr AND l.close <= break_level + 0.12 * c0.atr) AS accepted, (any_value(c0.close) - min(l.low)) / any_value(c0.atr) AS rebound FROM c0 JOIN one l ON l.symbol = c0.symbol AND l.rn > c0.rn - c0.break_bars_ago AND l.rn <= c0.rn WHERE bc IS NOT NULL GROUP BY 1, 2),
c2 AS (SELECT c0.*, c1.retouched, c1.reclaimed, c1.accepted, c1.rebound, bc IS NOT NULL AS has, greatest(0, (break_level - bc) / atr) AS dep, abs(bc - bo) / atr AS body, high >= break_level - 0.20 * atr AS tch, close <= break_level - 0.03 * atr AS blw, close < open AND ((high - greatest(open, close)) / greatest(high - low, 1e-12) >= 0.20 OR (close - low) / greatest(high - low, 1e-12) <= 0.40) AS rjc, close >= open AND abs(close - open) / atr >= 0.45 AS bll FROM c0 LEFT JOIN c1 ON c1.symbol = c0.symbol AND c1.rn = c0.rn),
c3 AS (SELECT *, has AND dep >= 0.35 AND body >= 0.30 AS departed, has AND tch AND blw AND rjc AND NOT bll AS rejd FROM c2),
c4 AS (SELECT *, CASE WHEN has THEN """ + _clamped("least(25, dep * 20) + least(15, body * 15) + " + plus(flag("retouched", 15), flag("rejd", 25), flag("NOT reclaimed", 10), flag("accepted <= 3", 10))) + """ ELSE 0.0 END AS cq, coalesce(departed AND retouched AND rejd AND NOT reclaimed AND accepted <= 3, false) AS cready, CASE WHEN NOT has THEN 'NO_FRESH_BREAKDOWN' WHEN reclaimed THEN 'BROKEN_SUPPORT_RECLAIMED' WHEN NOT departed THEN 'WEAK_BREAKDOWN_DEPARTURE' WHEN NOT retouched THEN 'WAIT_PULLBACK_TO_BROKEN_SUPPORT' WHEN NOT tch THEN 'RETEST_WAS_NOT_CURRENT' WHEN NOT blw THEN 'RETEST_FAILED_TO_CLOSE_BELOW' WHEN NOT rjc THEN 'NO_CLEAR_BEARISH_REJECTION' WHEN accepted > 3 THEN 'TOO_MUCH_ACCEPTANCE_AT_LEVEL' ELSE 'CONTINUATION_RETEST_CONFIRMED' END AS creason FROM c3)"""


def _continued(spark, d):
    return E.continuation(signal(spark, d).withColumns(E.setup_router()).withColumns(E.preferred_zone()))


@query(_SIG + _ROUTE + _ZONE + _CONT + " SELECT symbol, t, round(cq, 6) AS continuation_quality, cready AS continuation_ready, creason AS continuation_reason, round(CASE WHEN has THEN dep END, 6) AS departure_atr, accepted AS acceptance_bars, round(rebound, 6) AS rebound_atr FROM c4")
def w28_continuation_quality(spark, d):
    return _out(_continued(spark, d), "symbol", "ts", "continuation_quality", "continuation_ready", "continuation_reason", "departure_atr", "acceptance_bars", "rebound_atr")


_DOWN = "greatest(0, under)"
_BOTTOM = {
    "4H_DROP_EXTREME": ("ret4 <= -8", 8), "4H_DROP_LARGE": ("ret4 <= -5 AND ret4 > -8", 4), "12H_DROP_EXTREME": ("ret12 <= -18", 8), "12H_DROP_LARGE": ("ret12 <= -12 AND ret12 > -18", 4), "24H_COLLAPSE": ("ret24 <= -25", 6), "VERY_FAR_BELOW_EMA20": (f"{_DOWN} >= 2.5", 8), "FAR_BELOW_EMA20": (f"{_DOWN} >= 1.8 AND {_DOWN} < 2.5", 4),
    "NEAR_48H_RANGE_LOW": ("position48 <= 0.18", 6), "SUPPORT_VERY_CLOSE": ("near < 0.8", 9), "SUPPORT_CLOSE": ("near >= 0.8 AND near < 1.25", 4), "SUPPORT_UNKNOWN": ("near IS NULL", 3), "POSSIBLE_CAPITULATION": ("ret24 <= -8 AND (high - low) / atr >= 2 AND volume_ratio >= 2", 5),
}
_LOW12, _SPAN = "(close - low12) / atr", "greatest(high - low, 1e-12)"
_LOWS = {"AT_12H_LOW": (f"{_LOW12} <= 0.35", 6), "NEAR_12H_LOW": (f"{_LOW12} > 0.35 AND {_LOW12} <= 0.65", 3), "AT_24H_LOW": ("(close - low24) / atr <= 0.35", 4), "EXTENDED_BELOW_EMA20": (f"{_DOWN} >= 1.8", 4), "SUPPORT_TOO_CLOSE": ("near < 0.8", 6), "SUPPORT_UNKNOWN": ("near IS NULL", 2), "BOTTOM_15PCT_OF_24H_RANGE": ("position24 <= 0.15", 4)}
_REBOUND = {
    "LARGE_DOWNSIDE_LEG": ("(high12 - close) / atr >= 3", 4), "FAST_3H_DROP": ("(close_3_ago - close) / atr >= 2", 4), "CAPITULATION_REJECTION": (f"{_SPAN} / atr >= 1.5 AND volume_ratio >= 1.5 AND (least(open, close) - low) / {_SPAN} >= 0.35", 5), "4H_DROP_EXTREME": ("ret4 <= -8", 4), "4H_DROP_LARGE": ("ret4 <= -5 AND ret4 > -8", 2), "12H_DROP_EXTREME": ("ret12 <= -15", 3),
}
_SQUEEZE = {"MARKET_4H_BOUNCE": ("market_r4 >= 1.25", 3), "MARKET_RISK_ON": ("market_state = 'RISK_ON'", 4), "MARKET_BULL_TREND": ("market_trend = 'BULL'", 3), "COIN_RELATIVE_RECOVERY_1H": ("relative1 >= 1", 3), "COIN_RELATIVE_RECOVERY_3H": ("relative3 >= 1.75", 3), "FAST_REBOUND_FROM_BREAK_LOW": ("rebound >= 1.5", 3), "BROKEN_LEVEL_RECLAIM": ("reclaimed", 6)}


def _points(rules: dict) -> str:
    return f"CAST({plus(*(flag(*r) for r in rules.values()))} AS DOUBLE)"


def _named(rules: dict) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{k}' END" for k, (p, _) in rules.items()) + "], lambda x: x IS NOT NULL), ';')"


_CHASE = f"(CASE WHEN {_DOWN} >= 1.2 THEN least(8, ({_DOWN} - 1.2) * 4) ELSE 0 END) + {flag('ret4 <= -6', 3)}"


@query(_SIG + f" SELECT symbol, t, {_points(_BOTTOM)} AS bottom_risk, round({_CHASE}, 6) AS chase_risk, {_named(_BOTTOM)} AS bottom_reasons, {_points(_LOWS)} AS low_risk, {_points(_REBOUND)} AS rebound_points, {_named(_LOWS | _REBOUND).replace('AT_12H', 'AT_12H')} AS anti_bottom_reasons FROM s")
def w29_bottom_risk(spark, d):
    return _out(signal(spark, d).withColumns(E.bottom_and_chase() | E.rebound_risk()), "symbol", "ts", "bottom_risk", "chase_risk", "bottom_reasons", "low_risk", "rebound_points", "anti_bottom_reasons")


_DIRECTION = ("s4_ema_bear", "s4_lower_high", "s4_lower_low", "ema_bear", "lower_high", "lower_low", "relative4 <= -1", "relative24 <= -3", "relative24 <= -7", "market_state = 'RISK_OFF'", "market_trend = 'BEAR'", "market_trend = 'BULL'")
_FORMS = {"direction_a": ((8, 5, 4, 5, 3, 2, 2, 2, 0, 3, 3, -5), 30), "direction_b": ((4, 3, 2, 3, 2, 1, 2, 2, 1, 2, 2, -4), 22), "direction_c": ((4, 3, 2, 2, 2, 0, 2, 2, 0, 2, 1, 0), 20)}
_DIR = {k: f"CAST({_clamped(plus(*(flag(f, n) for f, n in zip(_DIRECTION, points))), 0, most)} AS DOUBLE)" for k, (points, most) in _FORMS.items()}
_INSIDE, _UNDER = "close >= plo AND close <= phi", "close < plo"
_PLACE = {
    "location_a": _clamped(plus(pts((_INSIDE, 14), (f"{_UNDER} AND pd <= 0.4", 12), (f"{_UNDER} AND pd <= 0.8", 8), (f"{_UNDER} AND pd <= 1.5", 4), ("close > phi AND pd <= 0.25", 8)), pts(*((f"psource = '{k}'", a) for k, (a, _) in E.SOURCES.items())), pts(("near >= 2", 8), ("near >= 1.25", 5), ("near >= 0.8", 2))), 0, 30),
    "location_b": _clamped(plus(pts((_INSIDE, 16), (f"{_UNDER} AND pd <= 0.35", 13), (f"{_UNDER} AND pd <= 0.75", 8), (f"{_UNDER} AND pd <= 1.25", 4), ("close > phi AND pd <= 0.20", 8)), pts(*((f"psource = '{k}'", b) for k, (_, b) in E.SOURCES.items()))), 0, 30),
    "trigger_a": _clamped(plus(flag("fsweep", 6), flag("rejection", 4), flag("breakdown", 4), flag("retest", 3), flag("volume_ratio >= 1.2", 2), flag("setup IS NOT NULL", 3)), 0, 20),
    "trigger_b": _clamped(plus(flag("fsweep", 7), flag("rejection", 5), f"(CASE WHEN setup = 'BEAR_CONTINUATION_RETEST' THEN {pts(('cready', 12), ('breakdown', 1))} ELSE {flag('setup IS NOT NULL', 3)} END)"), 0, 20),
}
_ALL = _SIG + _ROUTE + _ZONE + _CONT + ", a0 AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _DIR.items()) + ", " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _PLACE.items()) + f", {_points(_BOTTOM)} AS bottom_risk, {_CHASE} AS chase_risk, {_points(_LOWS)} + {_points(_REBOUND)} AS anti_bottom, {_points(_SQUEEZE)} AS squeeze_risk, {_named(_SQUEEZE)} AS squeeze_reasons FROM c4)"


def _filtered(spark, d):
    return _continued(spark, d).withColumns(E.directional_scores() | E.location_and_trigger() | E.bottom_and_chase() | E.rebound_risk() | E.squeeze_risk())


@query(_ALL + " SELECT symbol, t, direction_a, direction_b, direction_c, location_a, location_b, trigger_a, trigger_b, squeeze_risk, squeeze_reasons FROM a0")
def w30_bias_location_trigger(spark, d):
    return _out(_filtered(spark, d), "symbol", "ts", *_FORMS, *_PLACE, "squeeze_risk", "squeeze_reasons")


_ACTIONS = _ALL + f""", a1 AS (SELECT *, {_clamped("direction_a + location_a + trigger_a - bottom_risk - chase_risk")} AS score_a, {_clamped("direction_b + location_b + trigger_b - anti_bottom")} AS score_b, {_clamped("direction_c + location_b + cq * 0.3 - anti_bottom - squeeze_risk")} AS score_c, coalesce(setup = 'BEAR_CONTINUATION_RETEST', false) AS further, anti_bottom > 10 OR {_LOW12} <= 0.30 OR coalesce(near < 0.70, false) AS blocked FROM a0),
a2 AS (SELECT *, CASE WHEN further THEN cready ELSE setup IS NOT NULL AND trigger_b >= 5 AND pd <= 0.45 END AS ready_b, further AND cready AND NOT blocked AND squeeze_risk <= 6 AND score_c >= 38 AND market_state <> 'RISK_ON' AS go FROM a1)
SELECT symbol, t, CASE WHEN bottom_risk >= 15 THEN 'AVOID_BOTTOM_SHORT' WHEN score_a >= 68 AND pd <= 0.40 AND trigger_a >= 6 THEN 'SHORT_CANDIDATE' WHEN score_a >= 48 THEN 'WAIT_FOR_PULLBACK' ELSE 'FILTERED' END AS filter_status, CASE WHEN anti_bottom >= 12 THEN 'AVOID_BOTTOM_SHORT' WHEN score_b >= 56 AND pd <= 0.45 AND ready_b THEN 'SHORT_NOW' WHEN direction_b >= 9 THEN 'WAIT_PULLBACK' ELSE 'WATCH_ONLY' END AS action_b, CASE WHEN go THEN 'SHORT_NOW' WHEN blocked THEN 'AVOID_BOTTOM_SHORT' WHEN setup = 'REVERSAL_AT_LOCATION' THEN 'WAIT_REVERSAL' WHEN further OR direction_c >= 8 THEN 'WAIT_PULLBACK' ELSE 'WATCH_ONLY' END AS action_c, CASE WHEN go THEN 'CONTINUATION_RETEST_CONFIRMED' WHEN blocked THEN 'ANTI_BOTTOM_BLOCK' WHEN setup = 'REVERSAL_AT_LOCATION' THEN 'REVERSAL_NOT_PROMOTED_TO_SHORT_NOW' WHEN further THEN creason WHEN direction_c >= 8 THEN 'BEARISH_BIAS_NEEDS_LOCATION' ELSE 'WEAK_BIAS' END AS action_reason FROM a2"""


@query(_ACTIONS)
def p10_filter_actions(spark, d):
    return _out(_filtered(spark, d).withColumns(E.filter_actions()), "symbol", "ts", "filter_status", "action_b", "action_c", "action_reason")


_P11 = _ALL + ", q AS (SELECT symbol, t, (direction_b + trigger_b) / 42 AS p, location_b / 30 AS o, anti_bottom >= 17 AS severe, pd <= 0.75 AND close <= phi + 0.15 * atr AS zready FROM a0), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, symbol) AS k, count(*) OVER (PARTITION BY t) AS n FROM q)"


@query(_P11 + " SELECT symbol, t, k AS cross_rank, CASE WHEN severe THEN 'AVOID_SHORT' WHEN (k - 1) / greatest(n - 1, 1) <= 0.15 AND p >= 0.3 THEN CASE WHEN zready THEN 'PRIORITY_SHORT' ELSE 'WAIT_PULLBACK' END WHEN (k - 1) / greatest(n - 1, 1) <= 0.5 AND p >= 0.2 THEN 'WAIT_PULLBACK' ELSE 'WATCH' END AS scanner_status, CASE WHEN severe THEN 'AVOID_SHORT' WHEN (k - 1) / n < 0.15 AND p >= 0.3 THEN CASE WHEN NOT zready THEN 'WAIT_PULLBACK' WHEN o >= 0.5 THEN 'PRIORITY_SHORT_SWING' ELSE 'PRIORITY_SHORT_SCALP' END WHEN (k - 1) / n < 0.5 AND p >= 0.2 THEN 'WAIT_PULLBACK' ELSE 'WATCH' END AS swing_status FROM r")
def p11_scanner_status(spark, d):
    rows = _filtered(spark, d).withColumns({"p": (c("direction_b") + c("trigger_b")) / 42, "o": c("location_b") / 30, "severe": c("anti_bottom") >= 17, "zone_ready": (c("preferred_distance") <= 0.75) & (c("close") <= c("preferred_upper") + 0.15 * c("atr"))}).select("symbol", "ts", "p", "o", "severe", "zone_ready")
    bounds = {"priority": (0.15, 0.3), "wait": (0.5, 0.2)}
    first = E.scanner_status(rows, ["ts"], "p", **bounds).withColumnRenamed("scanner_status", "first_status")
    both = E.scanner_status(first, ["ts"], "p", "o", swing=0.5, **bounds).withColumnsRenamed({"scanner_status": "swing_status", "first_status": "scanner_status"})
    return _out(both, "symbol", "ts", "cross_rank", "scanner_status", "swing_status")


_W31 = _SIG + _ROUTE + _ZONE + f""", w0 AS (SELECT v.*, max(CASE WHEN l.high >= v.plo - 0.12 * v.atr AND l.low <= v.phi + 0.12 * v.atr THEN l.rn END) OVER (PARTITION BY v.symbol, v.rn) AS touch, l.rn AS lrn, l.close AS lc, l.high AS lh FROM v JOIN one l ON l.symbol = v.symbol AND l.rn BETWEEN v.rn - 2 AND v.rn AND l.atr > 0),
w1 AS (SELECT symbol, rn, max(rn - touch) AS touch_age, coalesce(bool_or(lrn >= touch AND lc > phi + 0.12 * atr), false) AS zrec, max(lh) FILTER (lrn >= touch) AS touch_high FROM w0 GROUP BY 1, 2),
w2 AS (SELECT v.*, touch_age, zrec, touch_high, touch_age IS NOT NULL AS touched, close < open AND ((high - greatest(open, close)) / {_SPAN} >= 0.25 OR (close - low) / {_SPAN} <= 0.45) AS rejn, coalesce(close < close_before AND (high < high_before OR low < low_before), false) AS turned, close <= (plo + phi) / 2 AS bmid, greatest(0, plo - close) / atr AS bz FROM v LEFT JOIN w1 ON w1.symbol = v.symbol AND w1.rn = v.rn),
w3 AS (SELECT *, {plus(flag("touched", 1), flag("touched AND NOT zrec", 1), flag("rejn", 1), flag("turned", 1), flag("bmid", 1))} AS cs, greatest(phi, coalesce(touch_high, phi)) + 0.18 * atr - close AS cr FROM w2)"""


@query(_W31 + " SELECT symbol, t, touched, CAST(touch_age AS INTEGER) AS touch_age, zrec AS zone_reclaimed, CAST(cs AS DOUBLE) AS confirm_score, touched AND NOT zrec AND rejn AND turned AND cs >= 4 AND bz <= 0.65 AS confirmed, round(CASE WHEN cr > 0 THEN cr END, 6) AS confirm_risk, coalesce(near * atr / CASE WHEN cr > 0 THEN cr END >= 2.2, false) AS room_ok FROM w3")
def w31_zone_confirmation(spark, d):
    rows = signal(spark, d).withColumns(E.setup_router()).withColumns(E.preferred_zone())
    return _out(E.zone_confirmation(rows, "preferred_lower", "preferred_upper"), "symbol", "ts", "touched", "touch_age", "zone_reclaimed", "confirm_score", "confirmed", "confirm_risk", "room_ok")


_RULE = "least(1, greatest(0, (0.24 * least(1, greatest(0, direction_a / 7.5)) + CASE WHEN fbreak THEN 0.16 ELSE 0 END + CASE WHEN near_supply THEN 0.14 ELSE 0 END + 0.18 * least(1, greatest(0, cq / 5)) + 0.14 * coalesce(least(1, greatest(0, near / 4)), 0) + 0.08 * least(1, greatest(0, position24)) + CASE WHEN htf THEN 0.06 ELSE 0 END) * CASE WHEN anti_bottom >= 17 THEN 0.35 ELSE 1 END * CASE WHEN reclaimed THEN 0.35 ELSE 1 END))"
_PROB = lambda x: f"ln(least(1, greatest(coalesce({x}, 0.5), 1e-4)))"


@query(_ALL + f", q AS (SELECT *, {_RULE.replace('position24)', 'coalesce(position24, 0.5))')} AS rule FROM a0) SELECT symbol, t, round(rule, 6) AS rule_quality, round(0.75 * rule + 0.25 * exp(({_PROB('direction_a / 30')} + {_PROB('location_a / 30')}) / 2), 6) AS blended FROM q")
def e14_rule_quality(spark, d):
    near = E.yes(c("supply_distance") <= 0.85)
    broke = E.yes(c("breakdown") & (c("break_bars_ago") <= 12) & (c("break_bars_ago") > 0))
    htf = E.yes(c("s4_ema_bear")) | (E.yes(c("s4_lower_high")) & E.yes(c("s4_lower_low")))
    rule = E.rule_quality(structure=c("direction_a"), fresh_break=broke, strong_zone=near, confirm_score=c("continuation_quality"), room_r=E.support_distance(), weakness=c("position24"), early=htf, severe=c("anti_bottom") >= 17, reclaimed=c("reclaimed"))
    rows = _filtered(spark, d).withColumn("rule_quality", rule)
    return _out(rows.withColumn("blended", E.blended_rank(c("rule_quality"), [c("direction_a") / 30, c("location_a") / 30])), "symbol", "ts", "rule_quality", "blended")


@query(_ALL + " SELECT symbol, t, CASE WHEN NOT (market_state = 'RISK_OFF' AND coalesce(s4_macro_bear, false)) THEN NULL WHEN under >= 1.36 AND anti_bottom >= 17 THEN 'A+' WHEN anti_bottom >= 17 THEN 'A' WHEN under >= 1.36 THEN 'B' ELSE 'C' END AS gate_tier, CASE WHEN ema_bear::INT + lower_high::INT + lower_low::INT + macro_bear::INT >= 3 AND rejection AND market_state <> 'RISK_ON' THEN 'A' WHEN ema_bear::INT + lower_high::INT + lower_low::INT + macro_bear::INT >= 2 AND rejection THEN 'B' ELSE 'C' END AS vote_tier FROM a0")
def p16_tiers(spark, d):
    votes = E.total([c(k).cast("int") for k in ("ema_bear", "lower_high", "lower_low", "macro_bear")])
    rows = _filtered(spark, d)
    under = (c("ema20") - c("close")) / c("atr")
    return _out(rows.withColumns({"gate_tier": E.gate_tier(c("market_state") == "RISK_OFF", c("s4_macro_bear"), under, c("anti_bottom")), "vote_tier": E.vote_tier(votes, c("rejection"), c("market_state") == "RISK_ON")}), "symbol", "ts", "gate_tier", "vote_tier")


@query(_SIG + " SELECT t, any_value(market_state) AS market_state, any_value(market_trend) AS market_trend, any_value(market_state) || '|' || any_value(market_trend) AS regime_key, round(any_value(market_r4), 6) AS market_r4 FROM s GROUP BY 1")
def p17_market_regime(spark, d):
    out = signal(spark, d).groupBy("ts").agg(*(F.first(k).alias(k) for k in ("market_state", "market_trend", "market_r4")))
    return _out(out.withColumn("regime_key", F.concat_ws("|", "market_state", "market_trend")), "ts", "market_state", "market_trend", "regime_key", "market_r4")
