"""Registered queries of setups, path classes and models, each beside its DuckDB SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import features as W
from tidewatch.operators import models as M
from tidewatch.operators import setups as P
from tidewatch.plans.catalog import _JOINED, BARS, STEP, TRADES, W_, _out, _signals, bars, query, trades

_ATR = BARS + f", r0 AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W_})), 0), coalesce(abs(low - lag(close) OVER ({W_})), 0)) AS tr, row_number() OVER ({W_}) AS rn FROM bars), a AS (SELECT *, CASE WHEN count(tr) OVER ({W_} ROWS 13 PRECEDING) >= 7 THEN avg(tr) OVER ({W_} ROWS 13 PRECEDING) END AS atr, CASE WHEN count(low) OVER p = 20 THEN min(low) OVER p END AS level FROM r0 WINDOW p AS ({W_} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


@query(_ATR.replace("ROWS BETWEEN 20 PRECEDING", "ROWS BETWEEN 5 PRECEDING").replace("= 20", "= 5") + ", k AS (SELECT c.symbol, c.rn, max(b.rn) AS brk FROM a c JOIN a b ON b.symbol = c.symbol AND b.rn BETWEEN c.rn - 11 AND c.rn AND b.close < b.level - 0.02 * c.atr GROUP BY 1, 2), m AS (SELECT c.*, k.brk, l.level AS lv FROM a c LEFT JOIN k USING (symbol, rn) LEFT JOIN a l ON l.symbol = c.symbol AND l.rn = k.brk), e AS (SELECT DISTINCT m.symbol, m.rn FROM m JOIN a b ON b.symbol = m.symbol AND b.rn > m.brk AND b.rn <= m.rn AND b.high >= m.lv - 0.15 * m.atr AND b.close <= m.lv + 0.1 * m.atr) SELECT m.symbol, t, brk IS NOT NULL AS breakdown, m.rn - brk AS break_bars_ago, round(lv, 6) AS break_level, brk IS NOT NULL AND (e.rn IS NOT NULL OR abs(close - lv) <= 0.55 * atr) AS retest FROM m LEFT JOIN e ON e.symbol = m.symbol AND e.rn = m.rn")
def w13_breakdown_retest(spark, d):
    return _out(P.with_breakdown(W.with_atr(bars(spark, d)), n=5, below=0.02), "symbol", "ts", "breakdown", "break_bars_ago", "break_level", "retest")


@query(_ATR + f", z AS (SELECT *, count(low) OVER n = 4 AND (low - min(low) OVER n) / atr >= 0.3 AND atr > 0 AND (close >= open OR abs(close - open) / greatest(high - low, 1e-12) <= 0.45) AS ok FROM a WINDOW n AS ({W_} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)), j AS (SELECT c.symbol, c.t, c.close, c.atr, z.t AS zt, least(z.open, z.close) AS lower, z.high AS upper FROM a c LEFT JOIN z ON z.symbol = c.symbol AND z.ok AND z.rn BETWEEN c.rn - 74 AND c.rn - 4), q AS (SELECT *, CASE WHEN lower <= close AND close <= upper THEN 0.0 ELSE least(abs(close - lower), abs(close - upper)) END AS dist FROM j), o AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY upper < close * 0.995, dist, zt) AS k FROM q) SELECT symbol, t, round(lower, 6) AS zone_lower, round(upper, 6) AS zone_upper, round(CASE WHEN lower IS NOT NULL THEN dist END / nullif(atr, 0), 6) AS zone_distance_atr FROM o WHERE k = 1")
def w14_supply_zone(spark, d):
    return _out(P.with_supply_zone(W.with_atr(bars(spark, d)), drop=0.3), "symbol", "ts", "zone_lower", "zone_upper", "zone_distance_atr")


@query(_ATR + f", v AS (SELECT symbol, t, count(*) OVER l = 20 AS ready, max(high) OVER r <= max(high) OVER p - 0.1 * atr AS v1, (avg(close) OVER r - min(low) OVER l) / atr <= (avg(close) OVER p - min(low) OVER l) / atr - 0.1 AS v2, (close - min(low) OVER l) / atr BETWEEN -0.2 AND 1 AS v3, close <= avg(close) OVER r AND avg(close) OVER r <= avg(close) OVER l + 0.05 * atr AND sum(CASE WHEN close < open THEN 1 ELSE 0 END) OVER r >= 3 AS v4, coalesce(close / lag(close, 4) OVER ({W_}) - 1, 0) < 0 AS v5 FROM a WINDOW r AS ({W_} ROWS 7 PRECEDING), p AS ({W_} ROWS BETWEEN 15 PRECEDING AND 8 PRECEDING), l AS ({W_} ROWS 19 PRECEDING)) SELECT symbol, t, CASE WHEN ready THEN CAST(coalesce(v1, false) AS BIGINT) END AS lower_highs, CASE WHEN ready THEN CAST(coalesce(v2, false) AS BIGINT) END AS close_compression, CASE WHEN ready THEN CAST(coalesce(v3, false) AS BIGINT) + CAST(coalesce(v1, false) AS BIGINT) + CAST(coalesce(v2, false) AS BIGINT) + CAST(coalesce(v4, false) AS BIGINT) + CAST(v5 AS BIGINT) END AS pressure FROM v")
def w27_pressure(spark, d):
    b = W.with_atr(bars(spark, d)).withColumn("ret", W.returns(4))
    return _out(b.withColumns(P.pressure(F.min("low").over(W.rows(-19, 0)), F.col("atr"), F.col("ret"))), "symbol", "ts", "lower_highs", "close_compression", "pressure")


_SIGNALS = f", f AS (SELECT symbol, t, open, high, low, close, coalesce(close / lag(close, 4) OVER ({W_}) - 1, 0) AS ret, coalesce(high > lag(high) OVER ({W_}) AND close < open, false) AS sweep, coalesce(close < lag(low) OVER ({W_}), false) AS brk, (high - greatest(open, close)) / greatest(high - low, 1e-12) >= 0.3 AS rej, (close - low) / greatest(high - low, 1e-12) AS pos FROM bars)"


def _flags(spark, d):
    b, before = bars(spark, d).withColumns(W.anatomy()), W.by_symbol()
    return b.withColumns({"ret": F.coalesce(W.returns(4) / 100, F.lit(0.0)), "sweep": F.coalesce((F.col("high") > F.lag("high").over(before)) & (F.col("close") < F.col("open")), F.lit(False)), "brk": F.coalesce(F.col("close") < F.lag("low").over(before), F.lit(False)), "rej": F.col("upper_wick") >= 0.3, "pos": F.col("close_position")})


@query(BARS + _SIGNALS + " SELECT symbol, t, CASE WHEN sweep AND (rej OR pos <= 1.0) AND ret > 0 THEN 'LIQUIDITY_REVERSAL' WHEN brk AND (rej OR pos <= 0.2) AND close < open AND 40 * (1 - pos) >= 28 THEN 'TREND_CONTINUATION' WHEN pos <= 0.75 AND (rej OR 20 * (1 - pos) >= 17) AND NOT rej THEN 'SUPPLY_FADE' ELSE 'UNCLASSIFIED' END AS setup, CASE WHEN 100 * (1 - pos) >= 80 AND close < open AND ret < 0.5 AND brk AND rej IS NOT NULL AND sweep THEN 'ENTRY_READY' WHEN 100 * (1 - pos) >= 60 AND close < open AND ret < 0.5 THEN 'DEVELOPING' WHEN 100 * (1 - pos) >= 40 THEN 'WATCH' ELSE 'IGNORE' END AS status FROM f")
def p4_p5_setup_and_status(spark, d):
    c = F.col
    setup = P.setup_class(c("sweep"), c("brk"), c("rej"), c("rej"), c("pos") <= 0.2, c("close") < c("open"), 40 * (1 - c("pos")), 20 * (1 - c("pos")), c("pos"), c("ret"))
    status = P.status_gate(100 * (1 - c("pos")), c("sweep"), c("close") < c("open"), c("ret") < 0.5, c("brk"), F.lit(True), ready=80, developing=60, watch=40)
    return _out(_flags(spark, d).withColumns({"setup": setup, "status": status}), "symbol", "ts", "setup", "status")


@query(BARS + _SIGNALS + ", s AS (SELECT *, 4.0 * brk::INT + 2.0 * (close < open)::INT AS st, 3.0 * (pos < 0.2)::INT + 2.0 * (ret < -0.5)::INT AS ex, 3.0 * (pos > 0.8)::INT + 2.0 * (ret > 1)::INT AS re FROM f) SELECT symbol, t, CASE WHEN re >= 4 THEN 'RECOVERY_RECLAIM' WHEN ex >= 5 THEN 'EXHAUSTED_DOWNTREND' WHEN st >= 4 AND brk AND ex <= 2 AND re <= 2 THEN 'EARLY_DOWNTREND' WHEN st >= 5 AND ex <= 4 AND re <= 2 THEN 'MATURE_DOWNTREND' ELSE 'UNCONFIRMED' END AS phase FROM s")
def p12_trend_phase(spark, d):
    on = lambda c, w: w * c.cast("int")
    c = F.col
    phase = P.trend_phase(on(c("brk"), 4.0) + on(c("close") < c("open"), 2.0), on(c("pos") < 0.2, 3.0) + on(c("ret") < -0.5, 2.0), on(c("pos") > 0.8, 3.0) + on(c("ret") > 1, 2.0), c("brk"))
    return _out(_flags(spark, d).withColumn("phase", phase), "symbol", "ts", "phase")


@query(TRADES + ", s AS (SELECT *, CASE WHEN r > -1 AND regime > 0 AND score >= CASE engine WHEN 'E0' THEN 68 WHEN 'E1' THEN 66 WHEN 'E2' THEN 65 ELSE 64 END THEN 'ENTRY_READY' WHEN score >= 50 THEN 'WATCH' ELSE 'IGNORE' END AS status FROM (SELECT DISTINCT ON (symbol, day, engine) symbol, day, engine, score, r, regime FROM trades ORDER BY symbol, day, engine, score DESC, id)) SELECT symbol, day, engine, status, row_number() OVER (PARTITION BY symbol, day ORDER BY CASE status WHEN 'ENTRY_READY' THEN 0 WHEN 'WATCH' THEN 1 ELSE 2 END, score DESC, engine) = 1 AS primary_one FROM s")
def p8_engine_status(spark, d):
    from tidewatch.operators.selection import dedupe

    best = dedupe(trades(spark, d), ["symbol", "day", "engine"], [F.col("score").desc(), F.col("id")])
    rows = best.withColumns({"ts": F.col("day"), "hard_ok": F.col("r") > -1, "risk_ok": F.col("regime") > 0})
    out = P.engine_status(rows, {"E0": 68.0, "E1": 66.0, "E2": 65.0, "E3": 64.0})
    return out.select("symbol", "day", "engine", "status", F.col("primary").alias("primary_one"))


@query(TRADES + ", p AS (SELECT id, greatest(score / 100, 1e-4) AS a, greatest((regime + 1) / 4.0, 1e-4) AS b, greatest((id % 10) / 10.0, 1e-4) AS c, greatest((id % 7) / 7.0, 1e-4) AS d, (id % 5) / 5.0 AS v FROM trades) SELECT id, round(exp(0.7 * (ln(a) + ln(b)) / 2 + 0.3 * (ln(c) + ln(d)) / 2) * greatest(1 - v, 1e-4) ** 0.5, 6) AS consensus FROM p")
def m8_consensus(spark, d):
    c = F.col
    out = P.consensus([c("score") / 100, (c("regime") + 1) / 4], [(c("id") % 10) / 10, (c("id") % 7) / 7], (c("id") % 5) / 5, power=0.5)
    return trades(spark, d).select("id", F.round(out, 6).alias("consensus"))


_CLASS = BARS + _JOINED + ", w AS (SELECT *, entry * 0.3 AS atr, (bt - t) // 14400 AS n, min(struct_pack(l := low, b := bt)) OVER (PARTITION BY symbol, t) AS tr FROM j), h AS (SELECT symbol, t, any_value(entry) AS entry, any_value(atr) AS atr, min(low) FILTER (n <= 3) AS l1, max(high) FILTER (n <= 3) AS h1, arg_max(close, bt) FILTER (n <= 3) AS c1, min(low) AS l2, arg_max(close, bt) AS c2, coalesce(bool_or(bt > tr.b AND close >= entry), false) AS reclaimed, max(high) FILTER (bt > tr.b) AS hr FROM w GROUP BY 1, 2), m AS (SELECT *, coalesce(greatest(0, entry - l1) / atr, 0) AS fast, coalesce(greatest(0, h1 - entry) / atr, 0) AS wrong, greatest(0, entry - l2) / atr AS slow, c2 < entry AS lower FROM h)"


@query(_CLASS + " SELECT symbol, t, CASE WHEN fast >= 0.5 AND lower AND NOT reclaimed THEN 'PERSISTENT_SHORT' WHEN fast >= 0.5 AND (NOT lower OR reclaimed) THEN 'SHORT_THEN_REVERSE' WHEN fast < 0.5 AND slow >= 1 AND lower THEN 'DELAYED_SHORT' WHEN wrong >= 0.5 AND fast < 0.5 THEN 'WRONG_WAY_EARLY' ELSE 'MIXED' END AS path_class, round(slow, 6) AS late_mfe_atr, round(greatest(0, coalesce(hr - l2, 0)) / atr, 6) AS rebound_atr, c1 < entry AND lower AS persistent, slow >= 0.5 AND reclaimed AS reversed FROM m")
def l5_l6_path_class(spark, d):
    s, b = _signals(spark, d)
    return _out(P.path_class(s.withColumn("atr", F.col("entry") * 0.3), b, STEP, 3, 12), "symbol", "ts", "path_class", "late_mfe_atr", "rebound_atr", "persistent", "reversed")


@query(BARS + _JOINED + ", k AS (SELECT *, sum(CASE WHEN close > entry * 1.1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, t ORDER BY bt ROWS 1 PRECEDING) = 2 AS ok FROM j) SELECT symbol, t, min(bt) FILTER (ok) AS reclaim_t, round(max(greatest(0, close - entry * 1.1)), 6) AS highest_above FROM k GROUP BY 1, 2")
def l17_reclaim_after(spark, d):
    s, b = _signals(spark, d)
    return _out(P.reclaim_after(s.withColumn("zone", F.col("entry") * 1.1), b, 172_800, "zone", 2), "symbol", "ts", "reclaim_t", "highest_above")


_EDGES = [1_704_067_200 + 864_000 * k for k in (1, 2, 3)]


@query(TRADES + f", e AS (SELECT * FROM (VALUES (0, {_EDGES[0]}, {_EDGES[1]}), (1, {_EDGES[1]}, {_EDGES[2]})) AS v(fold, a, b)), x AS (SELECT fold, CASE WHEN t < a THEN 'train' WHEN t >= a + 28800 AND t < b THEN 'test' END AS role, engine FROM trades, e) SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS n, CAST(sum(CASE WHEN engine = 'E1' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS e1 FROM x WHERE role IS NOT NULL GROUP BY 1, 2")
def m3_m5_expanding_folds(spark, d):
    folds = M.expanding_folds(trades(spark, d).withColumns(M.flags("engine", ["E0", "E1"])), "t", _EDGES, 28_800)
    return folds.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("engine_E1").alias("e1"))


_FOLDS, _FIRST, _GAP = 5, 0.4, 20


@query(TRADES + f", k AS (SELECT *, dense_rank() OVER (ORDER BY t) - 1 AS rk FROM trades), u AS (SELECT max(rk) + 1 AS u FROM k), f AS (SELECT i AS fold, CAST(floor(u * ({_FIRST} + (1 - {_FIRST}) * i / {_FOLDS})) AS BIGINT) AS a, CASE WHEN i + 1 = {_FOLDS} THEN u ELSE CAST(floor(u * ({_FIRST} + (1 - {_FIRST}) * (i + 1) / {_FOLDS})) AS BIGINT) END AS b FROM u, range({_FOLDS}) r(i)), x AS (SELECT fold, t, r, CASE WHEN rk < a - {_GAP} THEN 'train' WHEN rk >= a AND rk < b THEN 'test' END AS role FROM k, f) SELECT fold, role, count(*) AS n, min(t) AS first_t, max(t) AS last_t, round(avg(r), 6) AS mean_r FROM x WHERE role IS NOT NULL GROUP BY 1, 2")
def m5_rank_folds(spark, d):
    folds = M.rank_folds(trades(spark, d), "t", _FOLDS, first=_FIRST, embargo=_GAP)
    return folds.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.round(F.avg("r"), 6).alias("mean_r"))


def _scored(spark, d, kind):
    rows = trades(spark, d).withColumns({"win": (F.col("r") > 0).cast("int"), "big": (F.col("r") > 2).cast("int"), "hour": (F.col("t") % 86_400) / 3600} | M.flags("engine", ["E0", "E1", "E2"]))
    return M.walk_forward_scores(M.expanding_folds(rows, "t", _EDGES, 28_800), 2, ["score", "hour", "regime", "engine_E0", "engine_E1", "engine_E2"], ["win", "big"], kind=kind)


@query()
def m1_logistic_walk_forward(spark, d):
    return _scored(spark, d, "logistic")[0].select("fold", "id", "p_win", "p_big")


@query()
def m2_boosted_heads(spark, d):
    return _scored(spark, d, "trees")[0].select("fold", "id", "p_win", "p_big")


@query()
def m9_importance(spark, d):
    return M.importance(spark.createDataFrame(_scored(spark, d, "logistic")[1], "fold int, label string, feature string, weight double"))


@query(BARS + f", l AS (SELECT *, list(close) OVER ({W_} ROWS 179 PRECEDING) AS v FROM bars), e AS (SELECT *, list_reduce(v, lambda s, x: x * (2.0 / 21) + s * (1 - 2.0 / 21)) AS ema, max(high) OVER ({W_} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS top FROM l), f AS (SELECT symbol, t, close < ema AS c1, high < lag(high) OVER ({W_}) AS c2, low < lag(low) OVER ({W_}) AS c3, max(CASE WHEN high >= ema * 0.995 THEN 1 ELSE 0 END) OVER ({W_} ROWS 4 PRECEDING) = 1 AND close < ema AS c4, max(CASE WHEN (high - greatest(open, close)) / greatest(high - low, 1e-12) >= 0.3 THEN 1 ELSE 0 END) OVER ({W_} ROWS 3 PRECEDING) = 1 AS c5, close < min(low) OVER ({W_} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS c6, high > top * 1.0005 AND close < top AS c7 FROM e) SELECT symbol, t, CAST(least(20, 4 * c1::INT + 5 * coalesce(c2, false)::INT + 4 * coalesce(c3, false)::INT + 5 * c4::INT + 3 * c5::INT + 2 * coalesce(c6, false)::INT + 2 * coalesce(c7, false)::INT) AS BIGINT) AS trigger FROM f")
def w26_micro_trigger(spark, d):
    before = W.by_symbol()
    b = bars(spark, d).withColumns({"ema20": W.ema(20), "rejected": W.anatomy()["upper_wick"] >= 0.3, "lower_high": F.col("high") < F.lag("high").over(before), "lower_low": F.col("low") < F.lag("low").over(before)})
    return _out(b.withColumn("trigger", P.micro_trigger(F.col("ema20"), F.col("lower_high"), F.col("lower_low"), F.col("rejected"))), "symbol", "ts", "trigger")
