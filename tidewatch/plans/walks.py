"""Registered queries on fixtures where every state of an operator occurs: the price walk in place of ticks that jump, folds laid to the end of the data, cohorts with all problems. Each is beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import cohorts as K
from tidewatch.operators import events as E
from tidewatch.operators import features as W
from tidewatch.operators import models as M
from tidewatch.operators import selection as S
from tidewatch.operators import sequences as Q
from tidewatch.operators import setups as P
from tidewatch.plans import intake
from tidewatch.plans.catalog import BARS, STEP, TRADES, W_, _out, _signals, query, trades
from tidewatch.plans.scores import _TICKS, _bars_sql, frames, walk
from tidewatch.plans.setups import _ATR
from tidewatch.plans.study import _FILL, _PF

c = F.col


def _on_walk(sql: str, step: int, scale: int = 4000) -> str:
    """The SQL with bars of the walk."""
    return sql.replace(BARS, f"WITH {_TICKS.replace('/ 4000', f'/ {scale}')}, {_bars_sql('bars', step)}")


_BREAK = (
    ", k AS (SELECT c.symbol, c.rn, max(b.rn) AS brk FROM a c JOIN a b ON b.symbol = c.symbol AND b.rn BETWEEN c.rn - 11 AND c.rn AND b.close < b.level - 0.1 * c.atr GROUP BY 1, 2), m AS (SELECT c.*, k.brk, l.level AS lv FROM a c LEFT JOIN k USING (symbol, rn) LEFT JOIN a l ON l.symbol = c.symbol AND l.rn = k.brk), e AS (SELECT DISTINCT m.symbol, m.rn FROM m JOIN a b ON b.symbol = m.symbol AND b.rn > m.brk AND b.rn <= m.rn AND b.high >= m.lv - 0.15 * m.atr AND b.close <= m.lv + 0.1 * m.atr)"
    " SELECT m.symbol, t, brk IS NOT NULL AS breakdown, m.rn - brk AS break_bars_ago, round(lv, 6) AS break_level, brk IS NOT NULL AND (e.rn IS NOT NULL OR abs(close - lv) <= 0.55 * atr) AS retest FROM m LEFT JOIN e ON e.symbol = m.symbol AND e.rn = m.rn"
)


@query(_on_walk(_ATR, STEP) + _BREAK)
def w13_breakdown_on_walk(spark, d):
    return _out(P.with_breakdown(W.with_atr(frames(spark, d, STEP)[0])), "symbol", "ts", "breakdown", "break_bars_ago", "break_level", "retest")


_ZONE = f", z AS (SELECT *, count(low) OVER n = 4 AND (low - min(low) OVER n) / atr >= 1.15 AND atr > 0 AND (close >= open OR abs(close - open) / greatest(high - low, 1e-12) <= 0.45) AS ok FROM a WINDOW n AS ({W_} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)), j AS (SELECT c.symbol, c.t, c.close, c.atr, z.t AS zt, least(z.open, z.close) AS lower, z.high AS upper FROM a c LEFT JOIN z ON z.symbol = c.symbol AND z.ok AND z.rn BETWEEN c.rn - 74 AND c.rn - 4), q AS (SELECT *, CASE WHEN lower <= close AND close <= upper THEN 0.0 ELSE least(abs(close - lower), abs(close - upper)) END AS dist FROM j), o AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY upper < close * 0.995, dist, zt) AS k FROM q) SELECT symbol, t, round(lower, 6) AS zone_lower, round(upper, 6) AS zone_upper, round(CASE WHEN lower IS NOT NULL THEN dist END / nullif(atr, 0), 6) AS zone_distance_atr FROM o WHERE k = 1"


@query(_on_walk(_ATR, STEP) + _ZONE)
def w14_supply_zone_on_walk(spark, d):
    return _out(P.with_supply_zone(W.with_atr(frames(spark, d, STEP)[0])), "symbol", "ts", "zone_lower", "zone_upper", "zone_distance_atr")


_SHORT = (900, 4000)


@query(_on_walk(intake._E6, *_SHORT) + " SELECT symbol, t, " + ", ".join(f'coalesce(ready AND {p}, false) AS "{k}"' for k, p in intake._FLAGS.items()) + " FROM j")
def e6_quality_families_on_walk(spark, d):
    return _out(E.families(walk(spark, d, *_SHORT), "purchase", min_turnover=8000, day=24, warm_up=48), "symbol", "ts", *E.FAMILIES)


_WITH_SHIFT = TRADES.replace("value / 50.0 - 2.0 AS r", "value / 50.0 - 2.0 + (user_id % 4) * 0.5 + (user_id % 3) * 0.25 AS r")
_TRAIN, _TEST, _GAP = 864_000, 259_200, 28_800
_TO_THE_END = _WITH_SHIFT + f", z AS (SELECT min(t) AS t0, max(t) AS t1 FROM trades), f AS (SELECT unnest(range(greatest(1, CAST(ceil((t1 - t0 - {_TRAIN + _GAP} + 1) / {_TEST}.0) AS BIGINT)))) AS fold, t0 FROM z), x AS (SELECT fold, CASE WHEN t >= t0 + fold * {_TEST} AND t < t0 + fold * {_TEST} + {_TRAIN} THEN 'train' WHEN t >= t0 + fold * {_TEST} + {_TRAIN + _GAP} AND t < t0 + fold * {_TEST} + {_TRAIN + _GAP + _TEST} THEN 'test' END AS role, trades.* FROM trades, f)"


def _rolling(spark, d):
    shifted = trades(spark, d).withColumn("r", c("r") + F.substring("engine", 2, 1).cast("int") * 0.5 + c("regime") * 0.25)
    return K.rolling_folds(shifted, "t", _TRAIN, _TEST, _GAP)


@query(_TO_THE_END + " SELECT fold, role, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM x WHERE role IS NOT NULL GROUP BY 1, 2")
def m4_walk_forward_to_the_end(spark, d):
    return _rolling(spark, d).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


_STATES = f", e AS (SELECT fold, engine, count(*) AS n, avg(r) AS x, {_PF} AS pf, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS p, coalesce(avg(r) FILTER (r > 0), 0) AS w, coalesce(avg(r) FILTER (r <= 0), 0) AS l FROM x WHERE role = 'train' GROUP BY 1, 2), g AS (SELECT fold, engine, regime, count(*) AS n, avg(r) AS x, {_PF} AS pf FROM x WHERE role = 'train' GROUP BY 1, 2, 3) SELECT x.fold, x.id, x.engine, x.regime, CASE WHEN e.n >= 30 AND e.x > 0 AND e.pf >= 1.05 THEN 'ACTIVE' ELSE 'SHADOW' END AS engine_state, CASE WHEN coalesce(g.n, 0) < 250 THEN 'INSUFFICIENT' WHEN g.x > 0 AND g.pf >= 1 THEN 'ACTIVE' ELSE 'SHADOW' END AS regime_state, round(e.p * e.w + (1 - e.p) * e.l, 6) AS expected_r FROM x LEFT JOIN e USING (fold, engine) LEFT JOIN g USING (fold, engine, regime) WHERE role = 'test'"


@query(_TO_THE_END + _STATES)
def m7_edge_states_to_the_end(spark, d):
    out = K.edge_states(_rolling(spark, d), "engine", "regime", "r", min_engine=30, min_regime=250, min_pf=1.05)
    return _out(out, "fold", "id", "engine", "regime", "engine_state", "regime_state", "expected_r")


@query("WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT user_id AS k FROM events WHERE user_id % 5 <> 0) SELECT k, 'MISSING' AS problem FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT DISTINCT k, 'UNEXPECTED' FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'DUPLICATE' FROM b GROUP BY k HAVING count(*) > 11")
def j11_cohort_problems(spark, d):
    expected = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 3 <> 0").select(c("c_custkey").alias("k"))
    found = spark.read.parquet(f"{d}/events.parquet").where("user_id % 5 <> 0").select(c("user_id").alias("k"))
    return S.cohort_check(expected, found, "k", most=11)


_PRESSURE = f", v AS (SELECT symbol, t, count(*) OVER q = 24 AS ready, max(high) OVER r <= max(high) OVER p - 0.05 * atr AS v1, (avg(close) OVER r - min(low) OVER l) / atr <= (avg(close) OVER p - min(low) OVER l) / atr - 0.05 AS v2, (close - min(low) OVER l) / atr BETWEEN -0.2 AND 1.25 AS v3, close <= avg(close) OVER r AND avg(close) OVER r <= avg(close) OVER l + 0.05 * atr AND sum(CASE WHEN close < open THEN 1 ELSE 0 END) OVER r >= 3 AS v4, coalesce(close / lag(close, 4) OVER ({W_}) - 1, 0) < 0 AS v5 FROM a WINDOW r AS ({W_} ROWS 7 PRECEDING), p AS ({W_} ROWS BETWEEN 15 PRECEDING AND 8 PRECEDING), l AS ({W_} ROWS 19 PRECEDING), q AS ({W_} ROWS 23 PRECEDING))"


@query(_on_walk(_ATR, STEP) + _PRESSURE + " SELECT symbol, t, " + ", ".join(f"CASE WHEN ready THEN CAST(coalesce({v}, false) AS BIGINT) END AS {k}" for v, k in (("v1", "lower_highs"), ("v2", "close_compression"), ("v3", "near_support"), ("v4", "bearish_alignment"), ("v5", "relative_weakness"))) + ", CASE WHEN ready THEN " + " + ".join(f"CAST(coalesce(v{k}, false) AS BIGINT)" for k in range(1, 6)) + " END AS pressure FROM v")
def w27_published_pressure(spark, d):
    b = W.with_atr(frames(spark, d, STEP)[0]).withColumn("ret", W.returns(4))
    votes = P.pressure(F.min("low").over(W.rows(-19, 0)), c("atr"), c("ret"), **P.PUBLISHED)
    return _out(b.withColumns(votes), "symbol", "ts", *votes)


@query(_FILL.replace("bt > fill_t AND high >=", "bt >= fill_t AND high >=") + " SELECT symbol, t, fill_t, state, round(CASE state WHEN 'STOP' THEN -1.0 WHEN 'TARGET' THEN 2.0 WHEN 'TIME' THEN (lim - lc) / risk END, 6) AS gross_r FROM o")
def l9_stop_in_the_fill_bar(spark, d):
    s, b = _signals(spark, d)
    return _out(Q.fill_then_barrier(s.withColumn("limit_price", c("entry") * 1.05), b, 57_600, 172_800, fill_bar="stop"), "symbol", "ts", "fill_t", "state", "gross_r")


_SETS = {"score": ["score", "score_missing"], "context": ["hour", "regime", "engine_E0", "engine_E1", "engine_E2"], "all": ["score", "score_missing", "hour", "regime", "engine_E0", "engine_E1", "engine_E2"]}


@query()
def m2_six_heads_three_sets(spark, d):
    """Held-out rows, positives and AUC of each head and feature set, over the last of the rank folds."""
    rows = trades(spark, d).withColumns({"score": F.when(c("id") % 17 != 0, c("score")), "hour": c("t") % 86_400 / 3600} | M.flags("engine", ["E0", "E1", "E2"]))
    heads = {"win": c("r") > 0, "big": c("r") > 1.5, "loss": c("r") < -1, "flat": F.abs("r") < 0.5, "long_hold": c("t_exit") - c("t") > 14_400, "late": c("t") % 86_400 >= 43_200}
    folds = M.rank_folds(rows, "t", 1, first=0.7, embargo=20)
    scored = M.boosted_heads(folds, ["id"], heads, _SETS, trees=3)
    return M.head_report(scored)
