"""Registered queries of the event-study operators, each beside the DuckDB SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import brier, interval_bin, rounded
from tidewatch.operators import bars as B
from tidewatch.operators import events as E
from tidewatch.operators import features as W
from tidewatch.operators import labels as L
from tidewatch.operators import matching as J
from tidewatch.operators import selection as S
from tidewatch.operators import stats as A

STEP, DAY = 14_400, 86_400
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BAR = "arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount"
BARS = f"WITH bars AS (SELECT event_type AS symbol, (epoch_us(ts) // 14400000000) * 14400 AS t, {_BAR} FROM events GROUP BY 1, 2)"
DAILY = f"WITH bars AS (SELECT event_type || '_' || CAST(user_id % 8 AS VARCHAR) AS symbol, (epoch_us(ts) // 86400000000) * 86400 AS t, {_BAR} FROM events GROUP BY 1, 2)"
TRADES = "WITH trades AS (SELECT event_id AS id, event_type AS symbol, epoch_us(ts) // 1000000 AS t, epoch_us(ts) // 1000000 + (user_id % 7 + 1) * 3600 AS t_exit, value / 50.0 - 2.0 AS r, CAST((user_id * 37) % 100 AS DOUBLE) AS score, 'E' || CAST(user_id % 4 AS VARCHAR) AS engine, CAST(user_id % 3 AS BIGINT) AS regime, epoch_us(ts) // 86400000000 AS day FROM events)"
W_ = "PARTITION BY symbol ORDER BY t"


def bars(spark: SparkSession, sf_dir: str, step: int = STEP, groups: int | None = None) -> DataFrame:
    return B.from_ticks(B.ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), groups), step)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.with_utc(spark.read.parquet(f"{sf_dir}/events.parquet"))
    t = F.unix_seconds("ts")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "ts", t.alias("t"), (t + (F.col("user_id") % 7 + 1) * 3600).alias("t_exit"), (F.col("value") / 50.0 - 2.0).alias("r"), ((F.col("user_id") * 37) % 100).cast("double").alias("score"), F.concat(F.lit("E"), (F.col("user_id") % 4).cast("string")).alias("engine"), (F.col("user_id") % 3).alias("regime"), F.floor(t / DAY).alias("day"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _out(df: DataFrame, *columns: str) -> DataFrame:
    """Times as seconds and doubles rounded, so that sums of any order compare equal."""
    kinds = dict(df.dtypes)
    return df.select(*(F.unix_seconds("ts").alias("t") if c == "ts" else rounded(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


@query(BARS + " SELECT symbol, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, round(amount, 6) AS amount FROM bars")
def t2_bars_from_ticks(spark, d):
    return _out(bars(spark, d), "symbol", "ts", "open", "high", "low", "close", "volume", "amount")


@query(BARS + " SELECT symbol, (t // 86400) * 86400 AS t, round(arg_min(open, t), 6) AS open, max(high) AS high, min(low) AS low, round(arg_max(close, t), 6) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2")
def t2_resample(spark, d):
    return _out(B.resample(bars(spark, d), DAY), "symbol", "ts", "open", "high", "low", "close", "volume")


@query(BARS + ", spans AS (SELECT symbol, min(t) lo, max(t) hi FROM bars GROUP BY 1), slots AS (SELECT symbol, unnest(range(lo, hi + 1, 14400)) AS t FROM spans) SELECT s.symbol, s.t, round(b.close, 6) AS close FROM slots s LEFT JOIN bars b USING (symbol, t)")
def j16_calendar_grid(spark, d):
    return _out(B.on_grid(bars(spark, d), STEP), "symbol", "ts", "close")


@query(BARS + ", g AS (SELECT symbol, t, (lead(t) OVER (" + W_ + ") - t) // 14400 - 1 AS gap FROM bars) SELECT symbol, count(*) AS present, (max(t) - min(t)) // 14400 + 1 AS expected, max(gap) AS longest_gap, count(*) FILTER (gap > 0) AS gaps, round(count(*) / ((max(t) - min(t)) // 14400 + 1), 6) AS coverage, count(*) / ((max(t) - min(t)) // 14400 + 1) >= 0.9 AS eligible FROM g GROUP BY 1")
def w37_coverage(spark, d):
    return _out(B.coverage(bars(spark, d), STEP), "symbol", "present", "expected", "longest_gap", "gaps", "coverage", "eligible")


@query("SELECT l_suppkey AS symbol, CAST(count(*) AS BIGINT) AS rows_in, count(*) FILTER (l_quantity > 0 AND l_discount <= l_quantity AND l_tax <= l_extendedprice) AS good FROM lineitem GROUP BY 1")
def s2_integrity(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    good = (F.col("l_quantity") > 0) & (F.col("l_discount") <= F.col("l_quantity")) & (F.col("l_tax") <= F.col("l_extendedprice"))
    return li.groupBy(F.col("l_suppkey").alias("symbol")).agg(F.count("*").alias("rows_in"), F.count_if(good).alias("good"))


@query(BARS + f", r AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W_})), 0), coalesce(abs(low - lag(close) OVER ({W_})), 0)) AS tr FROM bars) SELECT symbol, t, round(CASE WHEN count(tr) OVER ({W_} ROWS 13 PRECEDING) >= 7 THEN avg(tr) OVER ({W_} ROWS 13 PRECEDING) END, 6) AS atr FROM r")
def w2_atr(spark, d):
    return _out(W.with_atr(bars(spark, d)), "symbol", "ts", "atr")


@query(BARS + f", l AS (SELECT symbol, t, list(close) OVER ({W_} ROWS 179 PRECEDING) AS v FROM bars) SELECT symbol, t, round(list_reduce(v, lambda s, x: x * (2.0 / 21) + s * (1 - 2.0 / 21)), 6) AS ema FROM l")
def w1_ema(spark, d):
    return _out(bars(spark, d).withColumn("ema", W.ema(20)), "symbol", "ts", "ema")


_W20, _W24 = f"({W_} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", f"({W_} ROWS 23 PRECEDING)"


@query(BARS + f" SELECT symbol, t, round((close / lag(close, 4) OVER ({W_}) - 1) * 100, 6) AS ret, round(CASE WHEN count(*) OVER {_W20} = 20 AND quantile_cont(volume, 0.5) OVER {_W20} > 0 THEN volume / quantile_cont(volume, 0.5) OVER {_W20} ELSE 1.0 END, 6) AS volume_ratio, round((close - min(low) OVER {_W24}) / nullif(max(high) OVER {_W24} - min(low) OVER {_W24}, 0), 6) AS position, round(coalesce(sum((high + low + close) / 3 * volume) OVER {_W24} / nullif(sum(volume) OVER {_W24}, 0), close), 6) AS vwap FROM bars")
def w3_w4_w9_w10_features(spark, d):
    return _out(bars(spark, d).withColumns({"ret": W.returns(4), "volume_ratio": W.volume_ratio(), "position": W.range_position(), "vwap": W.vwap()}), "symbol", "ts", "ret", "volume_ratio", "position", "vwap")


@query(BARS + f" SELECT symbol, t, round(avg(close) OVER w, 6) AS bb_mean, round(stddev_pop(close) OVER w, 6) AS bb_sigma FROM bars WINDOW w AS ({W_} ROWS 19 PRECEDING)")
def w8_bollinger(spark, d):
    return _out(bars(spark, d).withColumns(W.bollinger()), "symbol", "ts", "bb_mean", "bb_sigma")


@query(BARS + " SELECT symbol, t, round((greatest(open, close) - least(open, close)) / greatest(high - low, 1e-12), 6) AS body, round((high - greatest(open, close)) / greatest(high - low, 1e-12), 6) AS upper_wick, round((close - low) / greatest(high - low, 1e-12), 6) AS close_position, close < open AS bearish FROM bars")
def w11_anatomy(spark, d):
    return _out(bars(spark, d).withColumns(W.anatomy()), "symbol", "ts", "body", "upper_wick", "close_position", "bearish")


@query(BARS + f", m AS (SELECT *, count(*) OVER c = 5 AND high >= max(high) OVER c AS sh, count(*) OVER c = 5 AND low <= min(low) OVER c AS sl FROM bars WINDOW c AS ({W_} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT symbol, t, CASE WHEN lag(sh, 2) OVER ({W_}) THEN round(lag(high, 2) OVER ({W_}), 6) END AS swing_high, CASE WHEN lag(sl, 2) OVER ({W_}) THEN round(lag(low, 2) OVER ({W_}), 6) END AS swing_low FROM m")
def w5_swings(spark, d):
    return _out(W.with_swings(bars(spark, d)), "symbol", "ts", "swing_high", "swing_low")


@query(BARS + f", m AS (SELECT *, count(*) OVER a = 2 AND count(*) OVER b = 2 AND low < min(low) OVER a AND low <= min(low) OVER b AS pl FROM bars WINDOW a AS ({W_} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), b AS ({W_} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) SELECT symbol, t, CASE WHEN lag(pl, 2) OVER ({W_}) THEN round(lag(low, 2) OVER ({W_}), 6) END AS pivot_low FROM m")
def w6_strict_pivots(spark, d):
    return _out(W.with_strict_pivots(bars(spark, d)), "symbol", "ts", "pivot_low")


@query(BARS + f", m AS (SELECT *, row_number() OVER ({W_}) AS rn, max(high) OVER p AS level, count(*) OVER p = 20 AND high > 1.001 * max(high) OVER p AND close < max(high) OVER p AS hit FROM bars WINDOW p AS ({W_} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT symbol, t, coalesce(rn - max(CASE WHEN hit THEN rn END) OVER ({W_} ROWS 7 PRECEDING), -1) AS sweep_bars_ago FROM m")
def w12_sweep(spark, d):
    return _out(W.with_sweep(bars(spark, d)).withColumn("sweep_bars_ago", F.coalesce("sweep_bars_ago", F.lit(-1).cast("long"))), "symbol", "ts", "sweep_bars_ago")


@query(BARS + f", m AS (SELECT *, sum(CASE WHEN close < open THEN 0 ELSE 1 END) OVER ({W_} ROWS UNBOUNDED PRECEDING) AS island FROM bars) SELECT symbol, t, CAST(sum(CASE WHEN close < open THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m")
def w21_runs(spark, d):
    return _out(W.with_runs(bars(spark, d), F.col("close") < F.col("open")), "symbol", "ts", "run")


@query(BARS + f", m AS (SELECT symbol, t, high >= 200 AND low <= 300 AS touched FROM bars), n AS (SELECT *, touched AND NOT coalesce(lag(touched) OVER ({W_}), false) AS entered FROM m) SELECT symbol, count(*) FILTER (entered) AS episodes, count(*) FILTER (touched) AS bars FROM n GROUP BY 1")
def w20_touch_episodes(spark, d):
    return W.touch_episodes(bars(spark, d), F.lit(200.0), F.lit(300.0))


@query(DAILY + ", r AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY t ORDER BY close DESC, symbol) - 1 AS rank, count(*) OVER (PARTITION BY t) AS n FROM bars) SELECT symbol, t, rank, round(rank / n, 6) AS rank_share, round(rank / greatest(n - 1, 1), 6) AS weakness FROM r")
def w23_cross_section(spark, d):
    return _out(W.cross_section(bars(spark, d, DAY, 8), "close"), "symbol", "ts", "rank", "rank_share", "weakness")


@query(BARS + ", l AS (SELECT symbol, low, CASE WHEN low - lag(low) OVER (PARTITION BY symbol ORDER BY low) > 1.0 THEN 1 ELSE 0 END AS fresh FROM bars), c AS (SELECT symbol, low, CAST(sum(fresh) OVER (PARTITION BY symbol ORDER BY low ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM l) SELECT symbol, cluster, round(min(low), 6) AS lower, round(max(low), 6) AS upper, round(avg(low), 6) AS centre, count(*) AS touches FROM c GROUP BY 1, 2 HAVING count(*) >= 2")
def w17_price_clusters(spark, d):
    return _out(W.price_clusters(bars(spark, d), ["symbol"], "low", F.lit(1.0), 2), "symbol", "cluster", "lower", "upper", "centre", "touches")


@query(TRADES + ", e AS (SELECT symbol, id, sum(r) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY t, id ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY id ROWS UNBOUNDED PRECEDING), 0) AS peak FROM e) SELECT symbol, round(max(peak - equity), 4) AS max_drawdown, round(max(peak), 4) AS peak FROM p GROUP BY 1")
def w24_drawdown(spark, d):
    e = W.equity(trades(spark, d), ["symbol"], ["t", "id"])
    return e.groupBy("symbol").agg(F.round(F.max("drawdown"), 4).alias("max_drawdown"), F.round(F.max("peak"), 4).alias("peak"))


_RET = "(close / lag(close, 4) OVER (" + W_ + ") - 1) * 100"


@query(BARS + f", e AS (SELECT symbol, t FROM (SELECT symbol, t, {_RET} AS ret FROM bars) WHERE ret <= -30), s AS (SELECT symbol, list_sort(list(t)) AS ts FROM e GROUP BY 1) SELECT symbol, unnest(list_reduce(list_transform(ts, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 172800 THEN list_concat(a, x) ELSE a END)) AS t FROM s")
def w22_cooldown(spark, d):
    e = bars(spark, d).withColumn("ret", W.returns(4)).where("ret <= -30")
    return _out(E.cooldown(e, ["symbol"], 172_800), "symbol", "ts")


@query(BARS + f", f AS (SELECT *, min(low) OVER p AS low20, max(high) OVER p AS high20, quantile_cont(amount, 0.5) OVER m AS med, {_RET} AS ret, sum(amount) OVER ({W_} ROWS 3 PRECEDING) AS am4, count(*) OVER m = 40 AS ready FROM bars WINDOW p AS ({W_} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), m AS ({W_} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)), j AS (SELECT f.*, b.ret AS bret FROM f LEFT JOIN f b ON b.symbol = 'purchase' AND b.t = f.t) SELECT symbol, t, coalesce(ready AND close < 0.998 * low20, false) AS \"E01\", coalesce(ready AND ret <= -2.5 AND am4 >= 7.2 * med, false) AS \"E02\", coalesce(ready AND high > 1.002 * high20 AND close < high20 AND close < open, false) AS \"E03\", coalesce(ready AND ret <= -1 AND ret - bret <= -2, false) AS \"E07\" FROM j")
def e6_event_families(spark, d):
    return _out(E.families(bars(spark, d), "purchase"), "symbol", "ts", "E01", "E02", "E03", "E07")


@query()
def e6_all_families(spark, d):
    f = E.families(bars(spark, d), "purchase")
    return f.select(F.explode(F.array(*(F.struct(F.lit(k).alias("family"), F.col(k).alias("on")) for k in E.FAMILIES))).alias("x")).groupBy("x.family").agg(F.count_if("x.on").alias("events"), F.count("*").alias("bars"))


@query(BARS + f", f AS (SELECT *, max(high) OVER p AS prev_high, count(*) OVER p = 12 AS back, (close / lag(close, 6) OVER ({W_}) - 1) * 100 AS ret FROM bars WINDOW p AS ({W_} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT symbol, t, round(ret, 6) AS ret_day, round((high / prev_high - 1) * 100, 6) AS sweep, coalesce(back AND ret >= -20 AND (high / prev_high - 1) * 100 >= 0.25 AND close < prev_high AND close < open AND (high - greatest(open, close)) / greatest(high - low, 1e-12) >= 0.05, false) AS is_event FROM f")
def e7_failed_breakout(spark, d):
    return _out(E.failed_breakouts(bars(spark, d), back=12, rise=-20, wick=0.05, day=6), "symbol", "ts", "ret_day", "sweep", "is_event")


@query(BARS + f", f AS (SELECT *, lag(t, 24) OVER ({W_}) = t - 345600 AS whole, (lag(close, 6) OVER ({W_}) / lag(close, 24) OVER ({W_}) - 1) * 100 AS prior18, (close / lag(close, 6) OVER ({W_}) - 1) * 100 AS last6 FROM bars) SELECT f.symbol, f.t, round(f.prior18, 6) AS prior18, round(f.last6, 6) AS last6, round(f.last6 - b.last6, 6) AS relative6, coalesce(f.whole AND f.prior18 >= 10 AND f.last6 <= -2 AND f.last6 - b.last6 <= -3, false) AS is_event FROM f LEFT JOIN f b ON b.symbol = 'purchase' AND b.t = f.t")
def e9_exhaustion(spark, d):
    return _out(E.exhaustion(bars(spark, d), "purchase", STEP), "symbol", "ts", "prior18", "last6", "relative6", "is_event")


_J1 = BARS + ", b AS (SELECT (t // 86400) * 86400 AS bt, symbol, arg_max(close, t) AS day_close FROM bars GROUP BY 1, 2) SELECT r.symbol, r.t, round(b.day_close, 6) AS day_close FROM bars r ASOF LEFT JOIN (SELECT symbol, bt + 86400 AS closed_at, day_close FROM b) b ON r.symbol = b.symbol AND r.t >= b.closed_at"


def _as_of(spark, d, span):
    fine = bars(spark, d)
    coarse = B.resample(fine, DAY).select("symbol", F.timestamp_seconds(F.unix_seconds("ts") + DAY).alias("closed_at"), F.col("close").alias("day_close"))
    return _out(J.as_of(fine.select("symbol", "ts"), coarse, ["symbol"], "ts", "closed_at", ["day_close"], span=span), "symbol", "ts", "day_close")


@query(_J1)
def j1_as_of(spark, d):
    return _as_of(spark, d, None)


@query(_J1)
def j1_as_of_over_spans(spark, d):
    return _as_of(spark, d, 3 * DAY)


_MATCH = DAILY + f", f AS (SELECT symbol, t, (close / lag(close) OVER ({W_}) - 1) * 100 AS ret, amount, (lead(open) OVER ({W_}) - lead(close, 2) OVER ({W_})) / lead(open) OVER ({W_}) * 100 AS outcome FROM bars), c AS (SELECT * FROM f WHERE ret <= -60), p AS (SELECT * FROM f WHERE ret > -60), m AS (SELECT c.symbol AS c_symbol, c.t, p.symbol AS p_symbol, c.outcome AS co, p.outcome AS po, abs(c.ret - p.ret) / 6 + 0.35 * abs(ln(c.amount / p.amount)) AS distance FROM c JOIN p ON c.t = p.t AND c.symbol <> p.symbol AND abs(c.ret - p.ret) <= 40), k AS (SELECT *, row_number() OVER (PARTITION BY c_symbol, t ORDER BY distance, p_symbol) AS control_rank FROM m)"


def _matches(spark, d):
    f = bars(spark, d, DAY, 8).withColumns({"ret": W.returns(1), "outcome": (F.lead("open").over(W.by_symbol()) - F.lead("close", 2).over(W.by_symbol())) / F.lead("open").over(W.by_symbol()) * 100}).select("symbol", "ts", "ret", "amount", "outcome")
    distance = F.abs(F.col("c_ret") - F.col("p_ret")) / 6 + 0.35 * F.abs(F.log(F.col("c_amount") / F.col("p_amount")))
    return J.matched_controls(f.where("ret <= -60"), f.where("ret > -60"), {"ret": 40.0}, distance)


@query(_MATCH + " SELECT c_symbol, t, p_symbol, round(distance, 6) AS distance, control_rank FROM k WHERE control_rank <= 3")
def j3_matched_controls(spark, d):
    return _matches(spark, d).select("c_symbol", F.unix_seconds("c_ts").alias("t"), "p_symbol", F.round("distance", 6).alias("distance"), "control_rank")


@query(_MATCH + " SELECT c_symbol, t, round(any_value(co), 6) AS case_outcome, round(avg(po), 6) AS control_mean, count(po) AS controls, string_agg(p_symbol, ';' ORDER BY p_symbol) AS control_symbols, round(any_value(co) - avg(po), 6) AS edge FROM k WHERE control_rank <= 3 GROUP BY 1, 2")
def j10_paired_edges(spark, d):
    e = J.paired_edges(_matches(spark, d), "outcome")
    return e.select("c_symbol", F.unix_seconds("c_ts").alias("t"), F.round("case_outcome", 6).alias("case_outcome"), F.round("control_mean", 6).alias("control_mean"), "controls", "control_symbols", F.round("edge", 6).alias("edge"))


@query(_MATCH + ", e AS (SELECT c_symbol, t, any_value(co) AS c, avg(po) AS m, any_value(co) - avg(po) AS e FROM k WHERE control_rank <= 3 GROUP BY 1, 2), y AS (SELECT t, sum(c) AS c, sum(m) AS m, sum(e) AS e, count(*) FILTER (e > 0) AS p, count(e) AS n FROM e GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS pairs, count(*) AS days, round(sum(c) / sum(n), 6) AS mean_case, round(sum(m) / sum(n), 6) AS mean_control, round(sum(e) / sum(n), 6) AS mean_edge, round(sum(p) / sum(n), 6) AS positive_share, round(avg(CASE WHEN e > 0 THEN 1.0 WHEN e IS NULL THEN NULL ELSE 0.0 END), 6) AS positive_days FROM y")
def a27_horizon_summary(spark, d):
    s = A.horizon_summary(J.paired_edges(_matches(spark, d), "outcome"), F.col("c_ts"))
    return _out(s, *s.columns)


@query(BARS + f" SELECT symbol, t, round(CASE WHEN lead(t, 3) OVER w = t + 43200 THEN (lead(open) OVER w - lead(close, 3) OVER w) / lead(open) OVER w * 100 END, 6) AS short_3, round(CASE WHEN lead(t, 3) OVER w = t + 43200 THEN (max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) - lead(open) OVER w) / lead(open) OVER w * 100 END, 6) AS mae_3 FROM bars WINDOW w AS ({W_})")
def l1_horizon_labels(spark, d):
    return _out(L.horizon_labels(bars(spark, d), STEP, (3,)), "symbol", "ts", "short_3", "mae_3")


_JOINED = f", s AS (SELECT symbol, t, close AS entry FROM (SELECT *, {_RET} AS ret FROM bars) WHERE ret <= 0), j AS (SELECT s.symbol, s.t, s.entry, b.t AS bt, b.high, b.low, b.close FROM s JOIN bars b ON b.symbol = s.symbol AND b.t > s.t AND b.t <= s.t + 172800)"


def _signals(spark, d):
    b = bars(spark, d)
    return b.withColumn("ret", W.returns(4)).where("ret <= 0").select("symbol", "ts", "close", F.col("close").alias("entry"), (F.col("close") * 1.2).alias("stop")), b


@query(BARS + _JOINED + ", h AS (SELECT symbol, t, min(CASE WHEN low <= entry * (1 - 0.1) THEN bt END) AS dn, min(CASE WHEN high >= entry * (1 + 0.1) THEN bt END) AS up FROM j GROUP BY 1, 2) SELECT symbol, t, CASE WHEN dn IS NULL AND up IS NULL THEN 'NONE' WHEN dn = up THEN 'AMBIGUOUS' WHEN up IS NULL OR dn < up THEN 'DOWN' ELSE 'UP' END AS first_move FROM h")
def l4_first_move(spark, d):
    s, b = _signals(spark, d)
    return _out(L.first_move(s, b, 172_800, 0.1), "symbol", "ts", "first_move")


@query(BARS + _JOINED + ", h AS (SELECT symbol, t, any_value(entry) AS entry, min(CASE WHEN high >= entry * 1.2 THEN bt END) AS ts, min(CASE WHEN low <= entry - 2 * (entry * 1.2 - entry) THEN bt END) AS tt, arg_max(close, bt) AS lc FROM j GROUP BY 1, 2), o AS (SELECT s.symbol, s.t, CASE WHEN lc IS NULL THEN 'UNRESOLVED' WHEN ts IS NOT NULL AND coalesce(tt, ts) >= ts THEN 'STOP' WHEN tt IS NOT NULL THEN 'TARGET' ELSE 'TIME' END AS outcome, s.entry, lc FROM s LEFT JOIN h USING (symbol, t)) SELECT symbol, t, outcome, round(CASE outcome WHEN 'STOP' THEN -1.0 WHEN 'TARGET' THEN 2.0 WHEN 'TIME' THEN (entry - lc) / (entry * 1.2 - entry) END - entry * 14 / 1e4 / (entry * 1.2 - entry), 6) AS net_r FROM o")
def l7_triple_barrier(spark, d):
    s, b = _signals(spark, d)
    return _out(L.triple_barrier(s, b, 172_800), "symbol", "ts", "outcome", "net_r")


@query(BARS + _JOINED + ", g AS (SELECT unnest([{'s': 10.0, 'p': 20.0}, {'s': 20.0, 'p': 40.0}], recursive := true)), h AS (SELECT symbol, t, g.s AS stop_pct, g.p AS target_pct, any_value(entry) AS entry, min(CASE WHEN high >= entry * (1 + s / 100) THEN bt END) AS ts, min(CASE WHEN low <= entry * (1 - p / 100) THEN bt END) AS tt, arg_max(close, bt) AS lc FROM j, g GROUP BY 1, 2, 3, 4) SELECT symbol, t, stop_pct, target_pct, round(CASE WHEN ts IS NOT NULL AND coalesce(tt, ts) >= ts THEN -stop_pct WHEN tt IS NOT NULL THEN target_pct ELSE (entry - lc) / entry * 100 END, 6) AS result_pct FROM h")
def l12_target_grid(spark, d):
    s, b = _signals(spark, d)
    return _out(L.target_grid(s, b, 172_800, [(10.0, 20.0), (20.0, 40.0)]), "symbol", "ts", "stop_pct", "target_pct", "result_pct")


@query(BARS + _JOINED + " SELECT symbol, t, (bt - t) // 14400 AS point, round((entry - min(low) OVER w) / entry * 100, 6) AS mfe, round((max(high) OVER w - entry) / entry * 100, 6) AS mae FROM j WINDOW w AS (PARTITION BY symbol, t ORDER BY bt ROWS UNBOUNDED PRECEDING)")
def l14_hourly_path(spark, d):
    s, b = _signals(spark, d)
    return _out(L.hourly_path(s, b, STEP, 12), "symbol", "ts", "point", "mfe", "mae")


@query(TRADES + " SELECT a.symbol, a.id, count(b.id) AS open_trades FROM trades a LEFT JOIN trades b ON a.symbol = b.symbol AND a.id <> b.id AND b.t <= a.t AND b.t_exit > a.t GROUP BY 1, 2")
def j17_overlaps(spark, d):
    return J.overlaps(trades(spark, d).select("symbol", "id", "t", "t_exit"), "t", "t_exit", ["symbol"]).select("symbol", "id", "open_trades")


_METRICS = "count(*) AS signals, count(r) AS resolved, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, round(100.0 * count(*) FILTER (r > 0) / count(r), 6) AS win_pct, round(avg(r), 6) AS expectancy, round(CASE WHEN count(*) FILTER (r < 0) = 0 THEN 999.0 ELSE coalesce(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r < 0) END, 6) AS profit_factor"


def _metrics(df: DataFrame) -> DataFrame:
    return _out(df, *df.columns)


@query(TRADES + f" SELECT symbol, {_METRICS} FROM trades GROUP BY 1")
def a1_trade_metrics(spark, d):
    return _metrics(A.metrics(trades(spark, d), ["symbol"]))


@query(TRADES + f" SELECT CASE WHEN grouping(engine) = 0 THEN 'engine' WHEN grouping(symbol) = 0 THEN 'symbol' WHEN grouping(regime) = 0 THEN 'regime' ELSE 'ALL' END AS dimension, CASE WHEN grouping(engine) = 0 THEN engine WHEN grouping(symbol) = 0 THEN symbol WHEN grouping(regime) = 0 THEN CAST(regime AS VARCHAR) ELSE '' END AS value, {_METRICS} FROM trades GROUP BY GROUPING SETS ((engine), (symbol), (regime), ())")
def a2_breakdowns(spark, d):
    return _metrics(A.breakdowns(trades(spark, d), ["engine", "symbol", "regime"]))


@query(TRADES + f" SELECT CASE WHEN score <= 25 THEN '<= 25' WHEN score <= 50 THEN '(25, 50]' WHEN score <= 75 THEN '(50, 75]' ELSE '> 75' END AS bin, {_METRICS} FROM trades GROUP BY 1")
def a3_bins(spark, d):
    return _metrics(A.metrics(trades(spark, d).withColumn("bin", interval_bin(F.col("score"), [25, 50, 75])), ["bin"]))


@query(TRADES + f", c AS (SELECT quantile_cont(score, [0.25, 0.5, 0.75]) AS q FROM trades) SELECT CASE WHEN score <= q[1] THEN 'Q1' WHEN score <= q[2] THEN 'Q2' WHEN score <= q[3] THEN 'Q3' ELSE 'Q4' END AS bucket, {_METRICS} FROM trades, c GROUP BY 1")
def a4_quartiles(spark, d):
    return _metrics(A.quartile_buckets(trades(spark, d), "score"))


@query(TRADES + " SELECT symbol, count(r) AS n, round(avg(r), 6) AS mean, round(min(r), 6) AS least, round(max(r), 6) AS most, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.75), 6) AS p75, round(quantile_cont(r, 0.9), 6) AS p90 FROM trades GROUP BY 1")
def a5_distribution(spark, d):
    return _metrics(A.distribution(trades(spark, d), ["symbol"], "r"))


@query(TRADES + ", c AS (SELECT symbol, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM trades GROUP BY 1) SELECT symbol, round(avg(r), 6) AS mean, round(avg(CASE WHEN r BETWEEN lo AND hi THEN r END), 6) AS trimmed, round(avg(least(greatest(r, lo), hi)), 6) AS winsorised FROM trades JOIN c USING (symbol) GROUP BY 1")
def a6_robust_means(spark, d):
    return _metrics(A.robust_means(trades(spark, d), ["symbol"], "r"))


@query(TRADES + ", k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) AS rk, count(*) OVER (PARTITION BY symbol) AS n FROM trades) SELECT symbol, round(quantile_cont(r, 0.01), 6) AS p01, round(quantile_cont(r, 0.05), 6) AS p05, round(quantile_cont(r, 0.95), 6) AS p95, round(avg(CASE WHEN rk <= ceil(n * 0.05) THEN r END), 6) AS shortfall, count(*) FILTER (r < -0.9) AS exceedances FROM k GROUP BY 1")
def a7_tail_risk(spark, d):
    return _metrics(A.tail_risk(trades(spark, d), ["symbol"], "r"))


@query(TRADES + ", c AS (SELECT day, sum(r) AS s, count(r) AS n FROM trades GROUP BY 1), x AS (SELECT *, sum(s) OVER () AS ts, sum(n) OVER () AS tn FROM c) SELECT count(*) AS clusters, round(avg(s / n), 6) AS equal_mean, count(*) FILTER (s > 0) AS positive, round(min((ts - s) / (tn - n)), 6) AS least_without_one, round(max((ts - s) / (tn - n)), 6) AS most_without_one FROM x")
def a8_a9_clusters(spark, d):
    return _metrics(A.by_cluster(trades(spark, d), "day", "r"))


@query()
def a10_cluster_bootstrap(spark, d):
    return A.cluster_bootstrap(trades(spark, d), "day", "r")


@query(TRADES + ", c AS (SELECT engine, count(*) FILTER (r > 0) AS wins, count(*) AS n FROM trades GROUP BY 1) SELECT engine, wins, n, round((wins / n + 3.8416 / (2 * n) - 1.96 * sqrt(wins / n * (1 - wins / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((wins / n + 3.8416 / (2 * n) + 1.96 * sqrt(wins / n * (1 - wins / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM c")
def a12_wilson(spark, d):
    return _metrics(A.wilson_by(trades(spark, d), ["engine"], F.col("r") > 0))


@query(TRADES + ", a AS (SELECT symbol, score, count(*) FILTER (r > 0) AS p, count(*) FILTER (NOT r > 0) AS n FROM trades GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY symbol ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a) SELECT symbol, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b GROUP BY 1")
def a13_auc(spark, d):
    return _metrics(A.auc(trades(spark, d), ["symbol"], "score", F.col("r") > 0))


@query(TRADES + " SELECT symbol, round(avg(pow(score / 100 - CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END, 2)), 6) AS brier FROM trades GROUP BY 1")
def a14_brier(spark, d):
    return _metrics(trades(spark, d).groupBy("symbol").agg(brier(F.col("score") / 100, (F.col("r") > 0).cast("double")).alias("brier")))


@query(TRADES + ", b AS (SELECT (t - 1704067200) // 604800 AS block, avg(r) AS e, coalesce(sum(r) FILTER (r > 0), 0) / nullif(-sum(r) FILTER (r < 0), 0) AS pf FROM trades GROUP BY 1) SELECT count(*) AS blocks, count(*) FILTER (e > 0) AS positive, count(*) FILTER (pf > 1) AS profitable, round(min(e), 6) AS worst, round(max(e), 6) AS best FROM b")
def a18_j15_blocks(spark, d):
    return _metrics(A.block_stability(J.assign_blocks(trades(spark, d), F.col("ts"), 1_704_067_200, 604_800), "block"))


@query(TRADES + f", h AS (SELECT unnest([0.0, 25.0, 50.0, 75.0, 90.0]) AS threshold) SELECT threshold, {_METRICS} FROM trades JOIN h ON score >= threshold GROUP BY 1")
def a20_threshold_sweep(spark, d):
    return _metrics(A.threshold_sweep(trades(spark, d), "score", [0, 25, 50, 75, 90]))


_COHORTS = "CASE name WHEN 'high_score' THEN score >= 50 ELSE regime = 0 END"


@query(TRADES + f", n AS (SELECT unnest(['high_score', 'calm']) AS name) SELECT name, {_COHORTS} AS holds, {_METRICS} FROM trades, n GROUP BY 1, 2")
def a19_cohorts(spark, d):
    return _metrics(A.named_cohorts(trades(spark, d), {"high_score": F.col("score") >= 50, "calm": F.col("regime") == 0}))


@query(TRADES + " SELECT count(*) AS rows, count(*) FILTER (score >= 30) AS alone_score, count(*) FILTER (score >= 30) AS through_score, count(*) FILTER (regime > 0) AS alone_regime, count(*) FILTER (score >= 30 AND regime > 0) AS through_regime, count(*) FILTER (r > 0) AS alone_won, count(*) FILTER (score >= 30 AND regime > 0 AND r > 0) AS through_won FROM trades")
def a22_funnel(spark, d):
    return A.funnel(trades(spark, d), {"score": F.col("score") >= 30, "regime": F.col("regime") > 0, "won": F.col("r") > 0})


@query(TRADES + ", f AS (SELECT id, 'high' AS x FROM trades WHERE score >= 50 UNION ALL SELECT id, 'won' FROM trades WHERE r > 0 UNION ALL SELECT id, 'calm' FROM trades WHERE regime = 0) SELECT a.x AS a, b.x AS b, count(*) AS n FROM f a JOIN f b USING (id) WHERE a.x <= b.x GROUP BY 1, 2")
def a23_co_occurrence(spark, d):
    return A.co_occurrence(trades(spark, d), {"high": F.col("score") >= 50, "won": F.col("r") > 0, "calm": F.col("regime") == 0})


@query(TRADES + ", x AS (SELECT 'score' AS feature, score AS v, r > 0 AS g FROM trades UNION ALL SELECT 'regime', CAST(regime AS DOUBLE), r > 0 FROM trades) SELECT feature, quantile_cont(v, 0.5) FILTER (g) AS good, quantile_cont(v, 0.5) FILTER (NOT g) AS other, quantile_cont(v, 0.5) FILTER (g) - quantile_cont(v, 0.5) FILTER (NOT g) AS delta FROM x GROUP BY 1")
def a24_contrast(spark, d):
    return A.contrast(trades(spark, d), ["score", "regime"], F.col("r") > 0)


@query(TRADES + ", h AS (SELECT unnest([0.0, 25.0, 50.0, 75.0]) AS threshold), o AS (SELECT (t - 1704067200) // 604800 AS fold, threshold, sum(r) AS s, count(r) AS n FROM trades JOIN h ON score >= threshold GROUP BY 1, 2), b AS (SELECT *, sum(s) OVER w AS bs, sum(n) OVER w AS bn FROM o WINDOW w AS (PARTITION BY threshold ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY bs / bn DESC, threshold DESC) AS rn FROM b WHERE bn >= 20) SELECT fold, threshold, n AS trades, round(s / n, 6) AS expectancy FROM k WHERE rn = 1")
def m6_threshold_walk_forward(spark, d):
    folds = J.assign_blocks(trades(spark, d), F.col("ts"), 1_704_067_200, 604_800).withColumnRenamed("block", "fold")
    return _metrics(A.best_thresholds(folds, "fold", "score", [0, 25, 50, 75], 20))


@query(TRADES + ", c AS (SELECT *, row_number() OVER (PARTITION BY day, symbol ORDER BY score DESC, r DESC, id) AS k FROM trades), p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, r DESC, id) AS position FROM c WHERE k <= 2) SELECT day, id, position FROM p WHERE position <= 5")
def o2_o3_capped_top(spark, d):
    return S.capped_top(trades(spark, d), ["day"], "symbol", [F.col("score").desc(), F.col("r").desc(), F.col("id")], 2, 5).select("day", "id", "position")


@query(TRADES + ", h AS (SELECT symbol, id, sha256('v1|' || symbol || '|' || CAST(id AS VARCHAR)) AS digest FROM trades), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY digest) AS position FROM h) SELECT symbol, id, digest, position FROM k WHERE position <= 20")
def o5_hash_sample(spark, d):
    return S.hash_sample(trades(spark, d), ["symbol"], ["symbol", "id"], 20, "v1").select("symbol", "id", "digest", "position")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def u2_dedupe(spark, d):
    return S.dedupe(spark.read.parquet(f"{d}/events.parquet"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def u4_duplicates(spark, d):
    return S.duplicates(spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"])


@query("SELECT DISTINCT c_custkey AS k, 'MISSING' AS problem FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'UNEXPECTED' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def j11_cohort_check(spark, d):
    c, u = (spark.read.parquet(f"{d}/{t}.parquet").select(F.col(k).alias("k")) for t, k in (("customer", "c_custkey"), ("events", "user_id")))
    return S.cohort_check(c, u, "k")


@query("WITH h AS (SELECT event_type, sha256(CAST(event_id AS VARCHAR) || '|' || CAST(user_id AS VARCHAR)) AS d FROM events) SELECT event_type, count(*) AS rows, CAST(sum(CAST('0x' || d[1:8] AS BIGINT)) AS BIGINT) AS low, CAST(sum(CAST('0x' || d[9:16] AS BIGINT)) AS BIGINT) AS high FROM h GROUP BY 1")
def c3_fingerprint(spark, d):
    return S.fingerprint(spark.read.parquet(f"{d}/events.parquet"), ["event_type"], ["event_id", "user_id"])


@query(TRADES + " SELECT CASE WHEN t >= 1704067200 + 1900800 THEN 'holdout' WHEN t >= 1704067200 + 1900800 - 28800 THEN 'purged' ELSE 'discovery' END AS split, count(*) AS n FROM trades GROUP BY 1")
def c5_chronological_split(spark, d):
    return S.chronological_split(trades(spark, d), F.col("t"), 1_704_067_200, 1_704_067_200 + 2_534_400, 0.75, 28_800).groupBy("split").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to bars, events with matched controls at the same time, forward outcomes and the summary of paired edges."""
    return a27_horizon_summary(spark, sf_dir)
