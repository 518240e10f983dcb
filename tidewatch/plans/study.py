"""Registered queries over sequences of later bars, policies, walk-forward folds and slots, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import cohorts as K
from tidewatch.operators import features as W
from tidewatch.operators import labels as L
from tidewatch.operators import sequences as Q
from tidewatch.plans.catalog import _JOINED, _MATCH, BARS, DAY, STEP, TRADES, W_, _matches, _metrics, _out, _signals, bars, query, trades

_LONG = BARS + _JOINED.replace("b.high, b.low, b.close", "b.open, b.high, b.low, b.close")


@query(_LONG + ", h AS (SELECT symbol, t, min(CASE WHEN low <= entry * 0.8 THEN bt END) AS hit, min(CASE WHEN high >= entry * 1.5 THEN bt END) AS barred_t FROM j GROUP BY 1, 2) SELECT s.symbol, s.t, CASE WHEN hit < coalesce(barred_t, 4611686018427387904) THEN hit END AS hit_t, barred_t FROM s LEFT JOIN h USING (symbol, t)")
def j7_first_after(spark, d):
    s, b = _signals(spark, d)
    return _out(Q.first_after(s, b, 172_800, F.col("bar_low") <= F.col("entry") * 0.8, F.col("bar_high") >= F.col("entry") * 1.5), "symbol", "ts", "hit_t", "barred_t")


@query(_LONG + ", h AS (SELECT symbol, t, min(bt) AS fill_t, arg_min(open, bt) AS o, any_value(entry) AS entry FROM j WHERE bt <= t + 57600 AND high >= entry * 1.05 GROUP BY 1, 2) SELECT s.symbol, s.t, CASE WHEN fill_t IS NULL THEN 'NO_FILL' WHEN o >= s.entry * 1.05 THEN 'FILLED_GAP' ELSE 'FILLED' END AS fill_state, (fill_t - s.t) // 14400 - 1 AS wait_bars FROM s LEFT JOIN h USING (symbol, t)")
def j8_limit_fill(spark, d):
    s, b = _signals(spark, d)
    return _out(Q.limit_fill(s.withColumn("limit_price", F.col("entry") * 1.05), b, STEP, 4), "symbol", "ts", "fill_state", "wait_bars")


@query(_MATCH + ", m2 AS (SELECT * FROM k WHERE control_rank <= 3), w AS (SELECT DISTINCT c_symbol, t, c_symbol AS symbol, true AS is_case FROM m2 UNION ALL SELECT DISTINCT c_symbol, t, p_symbol, false FROM m2), o AS (SELECT w.*, (a.close - b.close) / a.close * 100 AS outcome FROM w LEFT JOIN bars a ON a.symbol = w.symbol AND a.t = w.t + 86400 LEFT JOIN bars b ON b.symbol = w.symbol AND b.t = w.t + 259200) SELECT c_symbol, t, round(max(outcome) FILTER (is_case), 6) AS case_outcome, round(avg(outcome) FILTER (NOT is_case), 6) AS control_mean, count(outcome) FILTER (NOT is_case) AS controls, round(max(outcome) FILTER (is_case) - avg(outcome) FILTER (NOT is_case), 6) AS edge FROM o GROUP BY 1, 2")
def j9_rebased_controls(spark, d):
    e = Q.rebased_controls(_matches(spark, d), bars(spark, d, DAY, 8), DAY, 3 * DAY)
    return e.select("c_symbol", F.unix_seconds("c_ts").alias("t"), F.round("case_outcome", 6).alias("case_outcome"), F.round("control_mean", 6).alias("control_mean"), "controls", F.round("edge", 6).alias("edge"))


_LADDER = _LONG + ", p AS (SELECT *, entry * 1.2 AS stop, entry * 1.2 - entry AS risk, min(CASE WHEN low <= entry - (entry * 1.2 - entry) THEN bt END) OVER (PARTITION BY symbol, t) AS t1 FROM j), h AS (SELECT symbol, t, any_value(t1) AS tp1_t, min(CASE WHEN high >= stop THEN bt END) AS stop_t, arg_min(open, bt) FILTER (high >= stop) AS so, min(CASE WHEN low <= entry - 2 * risk THEN bt END) AS tp2_t, min(CASE WHEN bt > t1 AND high >= entry THEN bt END) AS be_t, arg_max(close, bt) AS lc FROM p GROUP BY 1, 2), z AS (SELECT s.symbol, s.t, s.entry, s.entry * 1.2 AS stop, s.entry * 1.2 - s.entry AS risk, so, lc, CASE WHEN lc IS NULL THEN 'UNRESOLVED' WHEN stop_t <= coalesce(tp1_t, stop_t) THEN 'SL_FIRST' WHEN tp1_t IS NULL THEN 'TIME_EXIT' WHEN be_t <= coalesce(tp2_t, be_t) THEN 'TP1_THEN_BE' WHEN tp2_t IS NOT NULL THEN 'TP2_FULL' ELSE 'TP1_TIME_EXIT' END AS state, CASE WHEN lc IS NULL THEN NULL WHEN stop_t <= coalesce(tp1_t, stop_t) THEN stop_t WHEN tp1_t IS NULL THEN NULL WHEN be_t <= coalesce(tp2_t, be_t) THEN be_t ELSE tp2_t END AS exit_t FROM s LEFT JOIN h USING (symbol, t)), r AS (SELECT *, CASE state WHEN 'SL_FIRST' THEN (entry - greatest(so, stop)) / risk WHEN 'TIME_EXIT' THEN (entry - lc) / risk WHEN 'TP1_THEN_BE' THEN 0.5 WHEN 'TP2_FULL' THEN 1.5 WHEN 'TP1_TIME_EXIT' THEN 0.5 + 0.5 * (entry - lc) / risk END - entry * 14 / 1e4 / risk AS net_r FROM z)"


@query(_LADDER + " SELECT symbol, t, state, exit_t, round(net_r, 6) AS net_r FROM r")
def l10_ladder(spark, d):
    return _out(Q.ladder(*_signals(spark, d), 172_800), "symbol", "ts", "state", "exit_t", "net_r")


@query(_LADDER + " SELECT symbol, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share, round(avg((exit_t - t) / 14400), 6) AS average_wait, round(avg(net_r), 6) AS average_r FROM r GROUP BY 1, 2")
def a31_lifecycle(spark, d):
    s, b = _signals(spark, d)
    rows = Q.ladder(s, b, 172_800).withColumn("wait", (F.col("exit_t") - F.unix_seconds("ts")) / STEP)
    return _metrics(K.lifecycle(rows, ["symbol"], "state", "wait", "net_r"))


_SLIP = BARS + f", s AS (SELECT symbol, t FROM (SELECT *, {{ret}} AS ret FROM bars) WHERE ret <= 0), j AS (SELECT s.symbol, s.t, (b.t - s.t) // 14400 AS n, b.open, b.high, b.low, b.close, count(*) OVER (PARTITION BY s.symbol, s.t) AS nb FROM s JOIN bars b ON b.symbol = s.symbol AND b.t > s.t AND b.t <= s.t + 57600), g AS (SELECT unnest([1, 2]) AS delay), v AS (SELECT unnest([0.0, 20.0]) AS slip_bps), e AS (SELECT j.*, delay, slip_bps, first_value(open) OVER (PARTITION BY symbol, t, delay, slip_bps ORDER BY n) AS entry FROM j, g, v WHERE nb = 4 AND n >= delay), p AS (SELECT *, entry * (1 - slip_bps / 1e4) AS sold, high >= entry * (1 - slip_bps / 1e4) * 1.1 AS hit FROM e), x AS (SELECT symbol, t, delay, slip_bps, any_value(entry) AS entry, any_value(sold) AS sold, min(n) FILTER (hit) AS s, arg_min(open, n) FILTER (hit) AS so, min(n) FILTER (low <= sold * (1 - 20.0 / 100)) AS p, arg_max(close, n) AS lc FROM p GROUP BY 1, 2, 3, 4), y AS (SELECT *, CASE WHEN s <= coalesce(p, s) AND so >= sold * 1.1 THEN 'GAP_STOP' WHEN s = p THEN 'SL_FIRST_SAME_BAR' WHEN s <= coalesce(p, s) THEN 'SL' WHEN p IS NOT NULL THEN 'TP' ELSE 'HORIZON_CLOSE' END AS reason, CASE WHEN s <= coalesce(p, s) THEN greatest(so, sold * 1.1) WHEN p IS NOT NULL THEN sold * (1 - 20.0 / 100) ELSE lc END * (1 + slip_bps / 1e4) AS bought FROM x) SELECT symbol, t, delay, slip_bps, reason, round((sold - bought - (sold + bought) * 5 / 1e4) / sold * 100, 6) AS net_pct FROM y"


@query(_SLIP.replace("{ret}", "(close / lag(close, 4) OVER (" + W_ + ") - 1) * 100"))
def l13_slipped_entries(spark, d):
    s, b = _signals(spark, d)
    return _out(Q.slipped_entries(s, b, STEP, 4, [1, 2], [0.0, 20.0], [(10.0, 20.0)]), "symbol", "ts", "delay", "slip_bps", "reason", "net_pct")


_STOPPED = BARS + _JOINED.replace("172800", "259200").replace("b.high, b.low, b.close", "b.open, b.high, b.low, b.close") + f", p AS (SELECT *, entry * 1.2 - entry AS risk, min(CASE WHEN bt <= t + 172800 AND high >= entry * 1.2 THEN bt END) OVER (PARTITION BY symbol, t) AS stop_t, lead(open) OVER w AS no, lead(bt) OVER w AS nt FROM j WINDOW w AS (PARTITION BY symbol, t ORDER BY bt))"


@query(_STOPPED + ", h AS (SELECT symbol, t, any_value(stop_t) AS stop_t, any_value(entry) AS entry, any_value(risk) AS risk, min(low) FILTER (bt > stop_t AND bt <= stop_t + 86400) AS lo, max(high) FILTER (bt > stop_t AND bt <= stop_t + 86400) AS hi, count(*) FILTER (bt > stop_t AND bt <= stop_t + 86400) AS bars_after FROM p WHERE stop_t IS NOT NULL GROUP BY 1, 2) SELECT symbol, t, stop_t, bars_after, CASE WHEN lo IS NULL THEN 'NO_DATA' WHEN lo <= entry - 2 * risk THEN 'FALSE_STOP_THEN_TARGET' WHEN lo <= entry - risk THEN 'FALSE_STOP_THEN_1R' WHEN lo <= entry THEN 'STOP_THEN_RECLAIM_ENTRY' ELSE 'VALID_STOP' END AS post_stop_class, round(CASE WHEN lo IS NOT NULL THEN greatest(0, entry - lo) / risk END, 6) AS mfe_r, round(CASE WHEN hi IS NOT NULL THEN greatest(0, hi - entry * 1.2) / risk END, 6) AS extra_adverse_r FROM h")
def l16_after_stop(spark, d):
    return _out(Q.after_stop(*_signals(spark, d), 172_800, 86_400), "symbol", "ts", "stop_t", "bars_after", "post_stop_class", "mfe_r", "extra_adverse_r")


@query(_STOPPED + ", h AS (SELECT symbol, t, any_value(stop_t) AS stop_t, any_value(risk) AS risk, min(bt) FILTER (bt > stop_t AND bt <= stop_t + 86400 AND close < entry) AS reclaim_t FROM p WHERE stop_t IS NOT NULL GROUP BY 1, 2) SELECT h.symbol, h.t, h.stop_t, reclaim_t, p.nt AS reentry_t, round(p.no, 6) AS reentry, round(p.no + h.risk, 6) AS reentry_stop FROM h LEFT JOIN p ON p.symbol = h.symbol AND p.t = h.t AND p.bt = h.reclaim_t")
def l19_reentry(spark, d):
    return _out(Q.reentry(*_signals(spark, d), 172_800, 86_400), "symbol", "ts", "stop_t", "reclaim_t", "reentry_t", "reentry", "reentry_stop")


@query(BARS + f", r AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W_})), 0), coalesce(abs(low - lag(close) OVER ({W_})), 0)) AS tr, max(high) OVER ({W_} ROWS 3 PRECEDING) AS hi FROM bars), a AS (SELECT *, CASE WHEN count(tr) OVER ({W_} ROWS 13 PRECEDING) >= 7 THEN avg(tr) OVER ({W_} ROWS 13 PRECEDING) END AS atr FROM r) SELECT symbol, t, CASE WHEN atr IS NULL OR close <= 0 OR hi - close <= 0 OR atr <= 0 THEN 'INVALID_PLAN' WHEN 100 * (hi - close) / close > 40 THEN 'SKIP_STOP_PCT' WHEN (hi - close) / atr > 1.2 THEN 'SKIP_RISK_TOO_WIDE' WHEN 14 / 1e4 * close / (hi - close) > 0.02 THEN 'SKIP_COST_R' END AS reason FROM a")
def p13_plan_reason(spark, d):
    b = W.with_atr(bars(spark, d)).withColumn("hi", F.max("high").over(W.rows(-3, 0)))
    return _out(b.withColumn("reason", Q.plan_reason(F.col("close"), F.col("hi"), F.col("atr"), max_stop_pct=40.0, max_risk_atr=1.2, max_cost_r=0.02)), "symbol", "ts", "reason")


_PATH = BARS + _JOINED + ", q AS (SELECT symbol, t, (bt - t) // 14400 AS point, (entry - min(low) OVER w) / entry * 100 AS mfe, (max(high) OVER w - entry) / entry * 100 AS mae FROM j WINDOW w AS (PARTITION BY symbol, t ORDER BY bt ROWS UNBOUNDED PRECEDING))"


@query(_PATH + " SELECT point, count(*) AS n, round(quantile_cont(mfe, 0.25), 6) AS mfe_q25, round(quantile_cont(mfe, 0.5), 6) AS mfe_q50, round(quantile_cont(mfe, 0.75), 6) AS mfe_q75, round(quantile_cont(mae, 0.5), 6) AS mae_q50, round(100 * avg(CASE WHEN mfe >= 20 THEN 1.0 ELSE 0.0 END), 6) AS reach_20_pct FROM q GROUP BY 1")
def a25_path_summary(spark, d):
    s, b = _signals(spark, d)
    return _metrics(K.path_summary(L.hourly_path(s, b, STEP, 12), "point", [20.0]))


_WIDE = _PATH + ", u AS (SELECT 'mfe' AS side, point, mfe AS v FROM q UNION ALL SELECT 'mae', point, mae FROM q), k AS (SELECT unnest([10.0, 25.0, 50.0]) AS level)"


@query(_WIDE + " SELECT side, point, level, count(*) AS n, count(*) FILTER (v >= level) AS reached, round(avg(v) FILTER (v >= level), 6) AS mean_reached FROM u, k GROUP BY 1, 2, 3")
def a26_path_cohorts(spark, d):
    s, b = _signals(spark, d)
    return _metrics(K.path_cohorts(L.hourly_path(s, b, STEP, 12), "point", ["mfe", "mae"], [10.0, 25.0, 50.0]))


@query(TRADES + " SELECT engine, count(*) AS opportunities, count(*) FILTER (score >= 25) AS fills, round(100.0 * count(*) FILTER (score >= 25) / count(*), 6) AS fill_pct, round(100.0 * count(*) FILTER (score >= 25 AND r >= 2) / nullif(count(*) FILTER (score >= 25), 0), 6) AS target_pct, round(100.0 * count(*) FILTER (score >= 25 AND r <= -1) / nullif(count(*) FILTER (score >= 25), 0), 6) AS stop_pct, round(avg(r) FILTER (score >= 25), 6) AS per_fill, round(coalesce(sum(r) FILTER (score >= 25), 0) / count(*), 6) AS per_opportunity FROM trades GROUP BY 1")
def a17_policy_metrics(spark, d):
    return _metrics(K.policy_metrics(trades(spark, d), ["engine"], F.col("score") >= 25, F.col("r")))


_DIMS = " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS bucket, (t - 1704067200) // 604800 AS block, r FROM trades" for c in ("symbol", "engine", "regime"))


@query(TRADES + f", l AS ({_DIMS}), b AS (SELECT dimension, bucket, avg(r) AS m, count(*) AS n, count(DISTINCT block) AS blocks FROM l GROUP BY 1, 2 HAVING count(*) >= 20 AND count(DISTINCT block) >= 2) SELECT dimension, count(*) AS buckets, arg_max(bucket, m) AS best, arg_min(bucket, m) AS worst, round(max(m) - min(m), 6) AS spread FROM b GROUP BY 1")
def a21_attribution(spark, d):
    rows = trades(spark, d).withColumn("block", F.floor((F.col("t") - 1_704_067_200) / 604_800))
    return _metrics(K.attribution(rows, ["symbol", "engine", "regime"], "r", "block", 20, 2))


_V = "SELECT id, symbol, 'full' AS variant, r AS x FROM trades UNION ALL SELECT id, symbol, 'half', 0.5 * least(r, 1.0) + 0.5 * r FROM trades UNION ALL SELECT id, symbol, 'capped', least(r, 2.0) FROM trades"


@query(TRADES + f", v AS ({_V}) SELECT variant, symbol, count(*) AS n, round(100.0 * count(*) FILTER (x > 0) / count(*), 6) AS positive_pct, round(avg(x), 6) AS expectancy, round(sum(x), 4) AS total FROM v GROUP BY 1, 2")
def a33_variants(spark, d):
    r = F.col("r")
    v = K.per_variant(trades(spark, d), ["symbol"], {"full": r, "half": 0.5 * F.least(r, F.lit(1.0)) + 0.5 * r, "capped": F.least(r, F.lit(2.0))})
    return v.select("variant", "symbol", "n", F.round("positive_pct", 6).alias("positive_pct"), F.round("expectancy", 6).alias("expectancy"), F.round("total", 4).alias("total"))


_HIT = BARS + _JOINED + ", p AS (SELECT *, min(CASE WHEN low <= entry * (1 - 0.2) THEN bt END) OVER (PARTITION BY symbol, t) AS hit_t FROM j), h AS (SELECT symbol, t, any_value(hit_t) AS hit_t, (max(high) FILTER (bt <= coalesce(hit_t, bt)) - any_value(entry)) / any_value(entry) * 100 AS adverse FROM p GROUP BY 1, 2)"


@query(_HIT + " SELECT symbol, count(*) AS n, round(100.0 * count(hit_t) / count(*), 6) AS hit_pct, round(100.0 * count(*) FILTER (hit_t IS NOT NULL AND adverse < 10) / count(*), 6) AS clean_10_pct, round(100.0 * count(*) FILTER (hit_t IS NOT NULL AND adverse < 30) / count(*), 6) AS clean_30_pct, round(quantile_cont(adverse, 0.5), 6) AS adverse_q50, round(quantile_cont(adverse, 0.75), 6) AS adverse_q75, round(quantile_cont((hit_t - t) / 60, 0.5), 6) AS minutes_q50 FROM h GROUP BY 1")
def a32_target_hits(spark, d):
    return _metrics(K.target_hits(*_signals(spark, d), 172_800, 20.0, [10.0, 30.0]))


_TIER = "CASE WHEN score >= 75 THEN 'A' WHEN score >= 50 THEN 'B' ELSE 'C' END"


@query(TRADES + f" SELECT {_TIER} AS tier, count(*) AS closed, count(*) FILTER (r > 0) AS positive, round(100.0 * count(*) FILTER (r > 0) / count(*), 6) AS positive_pct, round(avg(r), 6) AS expectancy, round(CASE WHEN -sum(r) FILTER (r < 0) > 0 THEN coalesce(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0) WHEN sum(r) FILTER (r > 0) > 0 THEN 999.0 END, 6) AS profit_factor, round(sum(r), 4) AS total_r FROM trades GROUP BY 1")
def t10_ledger(spark, d):
    tier = F.when(F.col("score") >= 75, "A").when(F.col("score") >= 50, "B").otherwise("C")
    out = K.ledger_summary(trades(spark, d).withColumn("tier", tier), "tier", "r")
    return _metrics(out.withColumn("total_r", F.round("total_r", 4)))


@query("WITH c AS (SELECT event_type AS symbol, epoch_us(ts) // 1000000 AS t FROM events), k AS (SELECT symbol, (t // 14400) * 14400 AS slot, min(t) AS first_t, count(*) AS n FROM c GROUP BY 1, 2) SELECT symbol, (max(slot) - min(slot)) // 14400 + 1 AS expected, count(*) AS present, (max(slot) - min(slot)) // 14400 + 1 - count(*) AS missed, count(*) FILTER (first_t - slot > 3600) AS late, CAST(sum(n) AS BIGINT) - count(*) AS duplicates, max(first_t) FILTER (first_t - slot <= 3600) AS newest_valid_t, count(*) FILTER (first_t - slot <= 3600) / ((max(slot) - min(slot)) // 14400 + 1) >= 0.7 AS healthy FROM k GROUP BY 1")
def t7_t8_slot_health(spark, d):
    from tidewatch.operators import bars as B

    captures = B.with_utc(spark.read.parquet(f"{d}/events.parquet")).select(F.col("event_type").alias("symbol"), "ts")
    return K.slot_health(captures, ["symbol"], STEP, 3600, 0.7)


_FOLDS = TRADES + ", f AS (SELECT unnest(range(3)) AS fold), x AS (SELECT fold, CASE WHEN t >= 1704067200 + fold * 432000 AND t < 1704067200 + fold * 432000 + 864000 THEN 'train' WHEN t >= 1704067200 + fold * 432000 + 864000 + 28800 AND t < 1704067200 + fold * 432000 + 864000 + 28800 + 432000 THEN 'test' END AS role, trades.* FROM trades, f)"
_PF = "CASE WHEN count(*) FILTER (r < 0) = 0 THEN 999.0 ELSE coalesce(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0) END"


@query(_FOLDS + " SELECT fold, role, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM x WHERE role IS NOT NULL GROUP BY 1, 2")
def m4_walk_forward(spark, d):
    return K.walk_forward(trades(spark, d), "t", 1_704_067_200, 3, 864_000, 432_000, 28_800).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(_FOLDS + f", e AS (SELECT fold, engine, count(*) AS n, avg(r) AS x, {_PF} AS pf, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS p, coalesce(avg(r) FILTER (r > 0), 0) AS w, coalesce(avg(r) FILTER (r <= 0), 0) AS l FROM x WHERE role = 'train' GROUP BY 1, 2), g AS (SELECT fold, engine, regime, count(*) AS n, avg(r) AS x, {_PF} AS pf FROM x WHERE role = 'train' GROUP BY 1, 2, 3) SELECT x.fold, x.id, x.engine, x.regime, CASE WHEN e.n >= 30 AND e.x > 0 AND e.pf >= 1.05 THEN 'ACTIVE' ELSE 'SHADOW' END AS engine_state, CASE WHEN coalesce(g.n, 0) < 15 THEN 'INSUFFICIENT' WHEN g.x > 0 AND g.pf >= 1 THEN 'ACTIVE' ELSE 'SHADOW' END AS regime_state, round(e.p * e.w + (1 - e.p) * e.l, 6) AS expected_r FROM x LEFT JOIN e USING (fold, engine) LEFT JOIN g USING (fold, engine, regime) WHERE role = 'test'")
def m7_edge_states(spark, d):
    folds = K.walk_forward(trades(spark, d), "t", 1_704_067_200, 3, 864_000, 432_000, 28_800)
    out = K.edge_states(folds, "engine", "regime", "r", min_engine=30, min_regime=15, min_pf=1.05)
    return _metrics(out.select("fold", "id", "engine", "regime", "engine_state", "regime_state", "expected_r"))


@query(BARS + f", m AS (SELECT *, count(*) OVER a = 2 AND count(*) OVER b = 2 AND low < min(low) OVER a AND low <= min(low) OVER b AS pl FROM bars WINDOW a AS ({W_} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), b AS ({W_} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)), k AS (SELECT *, CASE WHEN lag(pl, 2) OVER ({W_}) THEN lag(low, 2) OVER ({W_}) END AS v FROM m), l AS (SELECT *, list(v) FILTER (v IS NOT NULL) OVER ({W_} ROWS 119 PRECEDING) AS vs FROM k) SELECT symbol, t, round(coalesce((close - list_max(list_filter(vs[-6:], lambda x: x < close))) / (close * 0.2), 5.0), 6) AS room_r FROM l")
def w15_support_room(spark, d):
    b = W.with_strict_pivots(bars(spark, d))
    return _out(b.withColumn("room_r", K.support_room("pivot_low", F.col("close"), F.col("close") * 0.2)), "symbol", "ts", "room_r")


_FILL = _LONG.replace("172800", "230400") + ", p AS (SELECT *, entry * 1.05 AS lim, entry * 1.2 - entry * 1.05 AS risk, min(CASE WHEN bt <= t + 57600 AND high >= entry * 1.05 THEN bt END) OVER (PARTITION BY symbol, t) AS fill_t FROM j), h AS (SELECT symbol, t, any_value(fill_t) AS fill_t, any_value(lim) AS lim, any_value(risk) AS risk, min(bt) FILTER (bt > fill_t AND high >= entry * 1.2) AS st, min(bt) FILTER (bt > fill_t AND low <= lim - 2 * risk) AS tt, arg_max(close, bt) AS lc FROM p WHERE bt >= fill_t AND bt <= fill_t + 172800 GROUP BY 1, 2), o AS (SELECT s.symbol, s.t, h.fill_t, lim, risk, lc, CASE WHEN h.fill_t IS NULL THEN 'NO_FILL' WHEN st <= coalesce(tt, st) THEN 'STOP' WHEN tt IS NOT NULL THEN 'TARGET' ELSE 'TIME' END AS state FROM s LEFT JOIN h USING (symbol, t))"


@query(_FILL + " SELECT symbol, t, fill_t, state, round(CASE state WHEN 'STOP' THEN -1.0 WHEN 'TARGET' THEN 2.0 WHEN 'TIME' THEN (lim - lc) / risk END, 6) AS gross_r FROM o")
def l9_fill_then_barrier(spark, d):
    s, b = _signals(spark, d)
    return _out(Q.fill_then_barrier(s.withColumn("limit_price", F.col("entry") * 1.05), b, 57_600, 172_800), "symbol", "ts", "fill_t", "state", "gross_r")


_STAGES = _LONG + ", k AS (SELECT *, entry * 1.2 - entry AS risk FROM j), p AS (SELECT *, min(CASE WHEN high >= entry * 1.2 THEN bt END) OVER q AS ts, min(CASE WHEN low <= entry - 1.0 * risk THEN bt END) OVER q AS t1, min(CASE WHEN low <= entry - 2.0 * risk THEN bt END) OVER q AS t2, min(CASE WHEN low <= entry - 4.0 * risk THEN bt END) OVER q AS t3 FROM k WINDOW q AS (PARTITION BY symbol, t)), h AS (SELECT symbol, t, any_value(ts) AS ts, any_value(t1) AS t1, any_value(t2) AS t2, any_value(t3) AS t3, any_value(risk) AS risk, min(bt) FILTER (bt > t1 AND high >= entry) AS be, min(bt) FILTER (bt > t2 AND high >= entry - 1.0 * risk) AS tr, arg_max(close, bt) AS lc FROM p GROUP BY 1, 2), n AS (SELECT s.symbol, s.t, s.entry, h.* EXCLUDE (symbol, t), CASE WHEN lc IS NULL THEN NULL WHEN NOT coalesce(t1 < coalesce(ts, t1 + 1), false) THEN 0 WHEN NOT coalesce(t2 < coalesce(be, t2 + 1), false) THEN 1 WHEN NOT coalesce(t3 < coalesce(tr, t3 + 1), false) THEN 2 ELSE 3 END AS stages FROM s LEFT JOIN h USING (symbol, t)), o AS (SELECT *, CASE WHEN stages IS NULL THEN 'UNRESOLVED' WHEN stages = 0 AND ts IS NOT NULL THEN 'STOP' WHEN stages = 1 AND be IS NOT NULL THEN 'BREAK_EVEN' WHEN stages = 2 AND tr IS NOT NULL THEN 'TRAILED' WHEN stages = 3 THEN 'RUNNER' ELSE 'TIME' END AS state FROM n)"


@query(_STAGES + " SELECT symbol, t, CAST(stages AS BIGINT) AS stages, state, round(CASE stages WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 1.0 WHEN 3 THEN 2.2 END + CASE stages WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.0 END * CASE state WHEN 'STOP' THEN -1.0 WHEN 'BREAK_EVEN' THEN 0.0 WHEN 'TRAILED' THEN 1.0 WHEN 'RUNNER' THEN 0.0 ELSE (entry - lc) / risk END, 6) AS gross_r FROM o")
def l11_three_stages(spark, d):
    return _out(Q.three_stages(*_signals(spark, d), 172_800), "symbol", "ts", "stages", "state", "gross_r")


@query(_LONG + ", z AS (SELECT *, high >= entry * 1.3 AND low <= entry * 1.5 AS touch, lead(bt) OVER w IS NOT NULL AS more FROM j WINDOW w AS (PARTITION BY symbol, t ORDER BY bt)), e AS (SELECT *, touch AND NOT coalesce(lag(touch) OVER (PARTITION BY symbol, t ORDER BY bt), false) AS enter FROM z), h AS (SELECT symbol, t, count(*) AS age_bars, count(*) FILTER (enter AND more) AS touches, min(bt) FILTER (close > entry * 1.5) AS broken_t FROM e GROUP BY 1, 2) SELECT s.symbol, s.t, coalesce(age_bars, 0) AS age_bars, coalesce(touches, 0) AS touches, broken_t, CASE WHEN broken_t IS NOT NULL THEN 'INVALIDATED_CLOSE_ABOVE' WHEN touches > 1 THEN 'TOO_MANY_PRIOR_TOUCHES' ELSE 'FRESH' END AS freshness FROM s LEFT JOIN h USING (symbol, t)")
def p22_level_freshness(spark, d):
    s, b = _signals(spark, d)
    return _out(Q.level_freshness(s.withColumns({"lower": F.col("entry") * 1.3, "upper": F.col("entry") * 1.5}), b, STEP, 172_800, 1), "symbol", "ts", "age_bars", "touches", "broken_t", "freshness")


@query(BARS + f", r AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W_})), 0), coalesce(abs(low - lag(close) OVER ({W_})), 0)) AS tr, max(high) OVER ({W_} ROWS 11 PRECEDING) AS hi, min(low) OVER ({W_} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sup FROM bars), a AS (SELECT *, CASE WHEN count(tr) OVER ({W_} ROWS 13 PRECEDING) >= 7 THEN avg(tr) OVER ({W_} ROWS 13 PRECEDING) END AS atr FROM r), k AS (SELECT *, CASE WHEN atr > 0 THEN greatest(hi + 0.1 * atr - close, atr) END AS risk FROM a), p AS (SELECT *, CASE WHEN sup < close THEN (close - sup) / risk WHEN risk IS NOT NULL THEN 5.0 END AS room FROM k) SELECT symbol, t, round(close + risk, 6) AS plan_stop, round(close - 3.0 * risk, 6) AS tp2, round(room, 6) AS room_r, coalesce(100 * risk / close <= 200 AND room >= 0.3 AND close * 14 / 1e4 / risk <= 0.25, false) AS risk_ok FROM p")
def p23_plan_ladder(spark, d):
    b = W.with_atr(bars(spark, d)).withColumns({"hi": F.max("high").over(W.rows(-11, 0)), "sup": F.min("low").over(W.rows(-20, -1))})
    return _out(b.withColumns(Q.plan_ladder(F.col("close"), F.col("hi"), F.col("atr"), F.col("sup"), max_stop_pct=200.0, min_room=0.3)), "symbol", "ts", "plan_stop", "tp2", "room_r", "risk_ok")
