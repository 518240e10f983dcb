"""Registered queries of sources, intake, bookkeeping, labels and further statistics, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.columns import clamp, finite, ln, ratio
from tidewatch.operators import bars as B
from tidewatch.operators import events as E
from tidewatch.operators import features as W
from tidewatch.operators import intake as N
from tidewatch.operators import labels as L
from tidewatch.operators import matching as J
from tidewatch.operators import selection as S
from tidewatch.operators import stats as A
from tidewatch.operators.scans import in_chunks, with_ema
from tidewatch.plans.catalog import _JOINED, _RET, BARS, DAILY, DAY, ORACLES, STEP, TRADES, W_, _metrics, _out, _signals, bars, query, trades
from tidewatch.sources import candles as K

c = F.col
START, END = 1_704_067_200, 1_706_659_200  # the period of the studies: 30 days


def span():
    return F.floor(c("t") / DAY)


# sources

_BAR_OUT = "symbol, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, round(amount, 6) AS amount"
_BARS7 = ("symbol", "ts", "open", "high", "low", "close", "volume", "amount")


def _payloads(spark, d, rows: bool):
    """Bars of a symbol and day as one payload each, landed twice, the second time with another price that must lose."""
    b = bars(spark, d).withColumn("day", B.floor_ts(c("ts"), DAY))
    t = F.unix_seconds("ts")
    t = F.when(F.unix_seconds("day") % (2 * DAY) == 0, t * 1000).otherwise(t)  # seconds and milliseconds
    kept = (F.lit(0), c("close")), (F.lit(1), c("close") + 1)
    both = [b.select("symbol", "day", seq.alias("ingest_seq"), F.struct(t.alias("t"), "open", "high", "low", close.alias("close"), "volume", "amount").alias("x")) for seq, close in kept]
    grouped = both[0].union(both[1]).groupBy("symbol", "day", "ingest_seq").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a day's bars
    if rows:
        text = F.to_json(F.transform("x", lambda x: F.array(*(x[k].cast("string") for k in ("t", "open", "high", "low", "close", "volume", "amount")))))
    else:
        text = F.to_json(F.struct(F.transform("x", lambda x: x["t"]).alias("time"), *(F.transform("x", lambda x, k=k: x[k].cast("string")).alias("vol" if k == "volume" else k) for k in ("open", "high", "low", "close", "volume", "amount"))))
    return grouped.select("symbol", "ingest_seq", text.alias("payload"))


@query(BARS + f" SELECT {_BAR_OUT} FROM bars")
def s1_parse_payloads(spark, d):
    return _out(K.parse_rows(_payloads(spark, d, True)), *_BARS7)


_S2 = "WITH l AS (SELECT l_suppkey AS symbol, l_extendedprice / l_quantity AS p, l_discount * 10 AS x, l_tax * 10 AS y FROM lineitem), b AS (SELECT symbol, p AS open, p + x AS high, p - y AS low, p + x - y * 2 AS close FROM l) SELECT symbol, low > 0 AND low <= least(open, close) AND greatest(open, close) <= high AS good, count(*) AS n FROM b GROUP BY 1, 2"


@query(_S2)
def s2_quarantine(spark, d):
    li, p = spark.read.parquet(f"{d}/lineitem.parquet"), c("l_extendedprice") / c("l_quantity")
    b = li.select(c("l_suppkey").alias("symbol"), p.alias("open"), (p + c("l_discount") * 10).alias("high"), (p - c("l_tax") * 10).alias("low"), (p + c("l_discount") * 10 - c("l_tax") * 10 * 2).alias("close"))
    good, bad = K.quarantine(b)
    return good.withColumn("good", F.lit(True)).union(bad.withColumn("good", F.lit(False))).groupBy("symbol", "good").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT p_partkey AS symbol, p_brand AS asset, CASE WHEN p_size % 10 = 0 THEN 'USDC' ELSE 'USDT' END AS quote, CASE WHEN p_partkey % 13 = 0 THEN 3 ELSE 0 END AS state, p_partkey % 7 <> 0 AS perpetual FROM part), d AS (SELECT DISTINCT p_brand AS asset FROM part WHERE p_partkey % 197 = 0) SELECT coalesce(CASE WHEN quote <> 'USDT' THEN 'QUOTE' WHEN state <> 0 THEN 'STATE' WHEN NOT perpetual THEN 'NOT_PERPETUAL' WHEN d.asset IS NOT NULL THEN 'ASSET_TYPE' END, 'ACCEPTED') AS reject_reason, count(*) AS n, count(DISTINCT symbol) AS symbols FROM c LEFT JOIN d USING (asset) GROUP BY 1")
def s3_catalogue(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    contracts = part.select(c("p_partkey").alias("symbol"), c("p_brand").alias("asset"), F.when(c("p_size") % 10 == 0, "USDC").otherwise("USDT").alias("quote"), F.when(c("p_partkey") % 13 == 0, 3).otherwise(0).alias("state"), (c("p_partkey") % 7 != 0).alias("perpetual"))
    marked = K.catalogue(contracts, "USDT", part.where("p_partkey % 197 = 0").select(c("p_brand").alias("asset")))
    return marked.groupBy(F.coalesce("reject_reason", F.lit("ACCEPTED")).alias("reject_reason")).agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


@query("WITH r AS (SELECT event_id, value AS last, value * 0.99 AS bid, CASE WHEN event_id % 3 = 0 THEN value * 0.98 ELSE value * 1.01 END AS ask, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS volume FROM events) SELECT event_id, last, round(bid, 6) AS bid, round(ask, 6) AS ask, volume, round(CASE WHEN ask >= bid AND (ask + bid) / 2 > 0 THEN (ask - bid) / ((ask + bid) / 2) * 1e4 END, 6) AS spread_bps FROM r")
def s4_tickers(spark, d):
    e, s = spark.read.parquet(f"{d}/events.parquet"), lambda x: x.cast("string")
    ask, volume = F.when(c("event_id") % 3 == 0, c("value") * 0.98).otherwise(c("value") * 1.01), F.when(c("event_id") % 5 == 0, "n/a").otherwise(s(c("user_id")))
    first = F.create_map(F.lit("last"), s(c("value")), F.lit("bid"), s(c("value") * 0.99), F.lit("ask"), s(ask), F.lit("volume"), volume)
    second = F.create_map(F.lit("last"), F.lit("-"), F.lit("lastPrice"), s(c("value")), F.lit("bid1"), s(c("value") * 0.99), F.lit("ask1"), s(ask), F.lit("volume24"), volume)
    raw = e.select(c("event_id").alias("symbol"), F.when(c("event_id") % 2 == 0, first).otherwise(second).alias("fields"))
    return _metrics(K.tickers(raw).select(c("symbol").alias("event_id"), "last", "bid", "ask", "volume", "spread_bps"))


@query(BARS + f" SELECT symbol, t, round(close + 2, 6) AS close FROM bars WHERE t BETWEEN {START + 86400} AND {START + 864000}")
def s5_combine_chunks(spark, d):
    b = bars(spark, d)
    chunks = N.union_all([b.withColumns({"ingest_seq": F.lit(k), "close": c("close") + k}) for k in range(3)])
    return _out(K.combine(chunks, F.timestamp_seconds(F.lit(START + DAY)), F.timestamp_seconds(F.lit(START + 10 * DAY))), "symbol", "ts", "close")


def _features(spark, d):
    f = E.families(bars(spark, d), "purchase")
    return f.select("symbol", F.unix_seconds("ts").alias("t"), "close", "E01", "E03")


_E13 = BARS + f", f AS (SELECT *, min(low) OVER p AS low20, max(high) OVER p AS high20, count(*) OVER ({W_} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) = 40 AS ready FROM bars WINDOW p AS ({W_} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


@query(_E13 + " SELECT symbol, t, round(close, 6) AS close, CAST(coalesce(ready AND close < 0.998 * low20, false) AS INTEGER) AS \"E01\", CAST(coalesce(ready AND high > 1.002 * high20 AND close < high20 AND close < open, false) AS INTEGER) AS \"E03\" FROM f")
def s6_s7_features_written_and_read(spark, d):
    path = K.shared_folder(spark, "features")
    K.write_features(_features(spark, d), path, ["symbol", "t", "close", "E01", "E03"], ["E01", "E03"], kind="parquet")
    return _metrics(K.read_checked(spark, path, "symbol string, t long, close double, E01 int, E03 int", ["symbol", "t"], ["E01", "E03"]))


@query(TRADES + " SELECT id, symbol, t, round(r, 6) AS r, engine FROM trades WHERE r <= -1")
def s8_event_registry(spark, d):
    path = K.shared_folder(spark, "registry")
    K.write_registry(trades(spark, d).where("r <= -1").select("id", "symbol", "t", "r", "engine"), path, ["t", "id"])
    return _metrics(K.read_registry(spark, path, "id long, symbol string, t long, r double, engine string"))


@query(TRADES + " SELECT id, symbol, round(r, 6) AS r FROM trades")
def s9_gathered_reports(spark, d):
    path = K.shared_folder(spark, "reports")
    reports = trades(spark, d).groupBy("engine", "day").agg(F.collect_list(F.struct("id", "symbol", "r")).alias("trades"))  # one report for each engine and day
    reports.write.partitionBy("engine", "day").json(path)  # a file for each
    return _metrics(K.gather_reports(spark, path, "trades array<struct<id:long,symbol:string,r:double>>", "trades"))


@query(TRADES + " SELECT id, symbol, t, round(r, 6) AS r, to_json({'engine': engine, 'regime': regime}) AS detail FROM trades")
def s10_table_sinks(spark, d):
    path = K.shared_folder(spark, "sink")
    flat = trades(spark, d).select("id", "symbol", "t", F.round("r", 6).alias("r"), F.to_json(F.struct("engine", "regime")).alias("detail"))
    K.write_once(flat, path, "csv", header="true", escape='"')
    return spark.read.schema("id long, symbol string, t long, r double, detail string").option("header", True).option("escape", '"').csv(path)


@query(TRADES + " SELECT count(*) AS rows_kept, true AS refused FROM trades WHERE engine = 'E1'")
def s11_write_once(spark, d):
    from pyspark.errors import AnalysisException

    path, rows = K.shared_folder(spark, "once"), trades(spark, d)
    K.write_once(rows.where("engine = 'E1'"), path)
    try:
        K.write_once(rows, path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).agg(F.count("*").alias("rows_kept"), F.lit(refused).alias("refused"))


@query("SELECT DISTINCT user_id AS symbol FROM events WHERE user_id % 3 <> 0 AND user_id % 7 <> 0")
def s12_not_yet_loaded(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select(c("user_id").alias("symbol")).distinct()
    return K.not_yet_loaded(users, users.where("symbol % 3 = 0"), users.where("symbol % 7 = 0"), ["symbol"])


# predicates and eligible rows


@query(BARS + f" SELECT symbol, t, round(close, 6) AS close FROM bars WHERE t + 14400 <= {START + 1000000}")
def p1_closed_bars(spark, d):
    return _out(B.closed(bars(spark, d), F.timestamp_seconds(F.lit(START + 1_000_000)), STEP), "symbol", "ts", "close")


_P2 = BARS + f", n AS (SELECT *, row_number() OVER ({W_}) - 1 AS place FROM bars), i AS (SELECT *, row_number() OVER ({W_}) - 1 AS k FROM n WHERE t BETWEEN {START + 172800} AND {END - 172800})"


@query(_P2 + " SELECT symbol, t, 'every' AS form FROM i WHERE k % 3 = 0 AND place >= 30 UNION ALL SELECT symbol, t, 'cadence' FROM i WHERE (t // 3600) % 12 = 0 AND place >= 30")
def p2_eligible_rows(spark, d):
    own = lambda form, **kw: N.eligible_rows(bars(spark, d), START + 2 * DAY, END, 2 * DAY, warm_up=30, **kw).withColumn("form", F.lit(form))
    return _out(N.union_all([own("every", every=3), own("cadence", cadence_hours=12)]), "symbol", "ts", "form")


@query(BARS + " SELECT symbol, t, round(amount, 6) AS amount FROM bars WHERE coalesce(amount >= 700, false) OR coalesce(CASE WHEN volume > 3 THEN volume * 2 END <= 20, false)")
def p3_liquidity(spark, d):
    return _out(bars(spark, d).where(N.liquid(c("amount"), F.when(c("volume") > 3, c("volume") * 2), min_turnover=700)), "symbol", "ts", "amount")


_STATE = "CASE WHEN r IS NULL OR id % 11 = 0 THEN 'CENSORED_GAP' WHEN r <= -1 THEN 'SL_FIRST' WHEN r >= 2 THEN 'TP2R_FIRST' ELSE 'TIME_EXIT' END"


@query(TRADES + f" SELECT engine, count(*) AS n, round(avg(r), 6) AS mean_r FROM trades WHERE {_STATE} <> 'CENSORED_GAP' AND isfinite(CASE WHEN id % 17 = 0 THEN 'nan'::DOUBLE ELSE r END) GROUP BY 1")
def p15_resolved(spark, d):
    state = F.when(c("r").isNull() | (c("id") % 11 == 0), "CENSORED_GAP").when(c("r") <= -1, "SL_FIRST").when(c("r") >= 2, "TP2R_FIRST").otherwise("TIME_EXIT")
    net = F.when(c("id") % 17 == 0, F.lit(float("nan"))).otherwise(c("r"))
    return _metrics(trades(spark, d).where(N.resolved(state, net)).groupBy("engine").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r")))


@query(TRADES + " SELECT id, round(r, 6) AS v2_r, score AS v2_mark_score, engine AS v2_mark_engine, symbol FROM trades")
def p18_relabelled(spark, d):
    rows = trades(spark, d).select("id", "symbol", F.round("r", 6).alias("v1_r"), F.struct("score", "engine").alias("v1_mark"))
    return N.relabelled(rows, "v1_", "v2_", ["id", "symbol"])


@query(TRADES + " SELECT id, 'baseline' AS view, round(r, 6) AS result, engine AS state FROM trades UNION ALL SELECT id, 'shadow', round(least(r, 2), 6), CASE WHEN score > 50 THEN 'TAKEN' ELSE 'SKIPPED' END FROM trades")
def p19_side_by_side(spark, d):
    views = {"baseline": {"result": F.round("r", 6), "state": c("engine")}, "shadow": {"result": F.round(F.least(c("r"), F.lit(2.0)), 6), "state": F.when(c("score") > 50, "TAKEN").otherwise("SKIPPED")}}
    return N.side_by_side(trades(spark, d), views, ["id"])


@query(BARS + f" SELECT symbol, t, round(close, 6) AS last_price, round((close / lag(close, 24) OVER ({W_}) - 1) * 100, 6) AS change_pct, CAST(NULL AS DOUBLE) AS funding_rate FROM bars")
def p24_as_of_ticker(spark, d):
    return _out(N.as_of_ticker(bars(spark, d)), "symbol", "ts", "last_price", "change_pct", "funding_rate")


@query(TRADES + ", n AS (SELECT max(t) - 86400 AS now FROM trades) SELECT id, t FROM trades, n WHERE now - t >= -300 AND now - t <= 5400")
def t9_fresh_signals(spark, d):
    rows = trades(spark, d)
    now = rows.agg((F.max("t") - DAY).alias("now"))  # one row
    return rows.join(F.broadcast(now)).where(N.fresh(F.timestamp_seconds("t"), F.timestamp_seconds("now"))).select("id", "t")


# joins

_FAMILY = DAILY + f", f AS (SELECT symbol, t, (close / lag(close) OVER ({W_}) - 1) * 100 AS ret, amount, close < open AS \"E1\", high > lag(high) OVER ({W_}) AS \"E2\", (lead(open) OVER ({W_}) - lead(close, 2) OVER ({W_})) / lead(open) OVER ({W_}) * 100 AS outcome FROM bars), x AS (SELECT symbol, t, ret, amount, unnest(list_filter([CASE WHEN \"E1\" THEN 'E1' END, CASE WHEN \"E2\" THEN 'E2' END], lambda y: y IS NOT NULL)) AS family FROM f), m AS (SELECT x.symbol AS c_symbol, x.t, x.family, p.symbol AS p_symbol, abs(x.ret - p.ret) / 6 + 2 * abs(ln(x.amount / p.amount)) AS distance FROM x JOIN f p ON p.t = x.t AND p.symbol <> x.symbol AND abs(x.ret - p.ret) <= 15 AND p.amount / x.amount BETWEEN 0.1 AND 10 AND NOT coalesce(CASE x.family WHEN 'E1' THEN p.\"E1\" ELSE p.\"E2\" END, false)), k AS (SELECT *, row_number() OVER (PARTITION BY c_symbol, t, family ORDER BY distance, p_symbol) AS control_rank FROM m)"


@query(_FAMILY + " SELECT c_symbol, t, family, p_symbol, round(distance, 6) AS distance, control_rank FROM k WHERE control_rank <= 3")
def j4_family_controls(spark, d):
    w = W.by_symbol()
    f = bars(spark, d, DAY, 8).withColumns({"ret": W.returns(1), "E1": c("close") < c("open"), "E2": c("high") > F.lag("high").over(w)}).select("symbol", "ts", "ret", "amount", F.filter(F.array(F.when(c("E1"), "E1"), F.when(c("E2"), "E2")), lambda x: x.isNotNull()).alias("families"))
    cases = f.withColumn("family", F.explode("families"))
    distance = F.abs(c("c_ret") - c("p_ret")) / 6 + 2 * F.abs(F.log(c("c_amount") / c("p_amount")))
    allowed = ~F.array_contains("p_families", c("c_family")) & (c("p_amount") / c("c_amount")).between(0.1, 10)
    m = J.matched_controls(cases, f, {"ret": 15.0}, distance, allowed=allowed, per=("family",))
    return m.select("c_symbol", F.unix_seconds("c_ts").alias("t"), c("c_family").alias("family"), "p_symbol", F.round("distance", 6).alias("distance"), "control_rank")


_J5 = BARS + f", g AS (SELECT symbol, t, close, ln(close / lag(close) OVER ({W_})) AS ch, (lag(close, 6) OVER ({W_}) / lag(close, 24) OVER ({W_}) - 1) * 100 AS prior18, (close / lag(close, 6) OVER ({W_}) - 1) * 100 AS last6 FROM bars), h AS (SELECT *, stddev_pop(ch) OVER ({W_} ROWS 23 PRECEDING) * sqrt(24) * 100 AS vol FROM g), e AS (SELECT *, coalesce(prior18 >= 10 AND last6 <= -2, false) AS ev FROM h WHERE prior18 IS NOT NULL AND vol IS NOT NULL), k AS (SELECT a.symbol AS c_symbol, a.t, b.symbol AS p_symbol, abs(a.prior18 - b.prior18) / 6 + abs(a.vol - b.vol) / 6 AS distance, row_number() OVER (PARTITION BY a.symbol, a.t ORDER BY abs(a.prior18 - b.prior18) / 6 + abs(a.vol - b.vol) / 6, b.symbol) AS control_rank FROM e a JOIN e b ON a.ev AND NOT b.ev AND a.t = b.t AND a.symbol <> b.symbol AND abs(a.prior18 - b.prior18) <= 200 AND abs(a.vol - b.vol) <= 500)"


@query(_J5 + " SELECT c_symbol, t, p_symbol, round(distance, 6) AS distance, control_rank FROM k WHERE control_rank <= 3")
def j5_exhaustion_controls(spark, d):
    w = W.by_symbol()
    f = bars(spark, d).withColumns({"ch": F.log(c("close") / F.lag("close").over(w)), "prior18": (F.lag("close", 6).over(w) / F.lag("close", 24).over(w) - 1) * 100, "last6": W.returns(6)}).withColumn("vol", F.stddev_pop("ch").over(W.rows(-23, 0)) * F.sqrt(F.lit(24.0)) * 100)
    f = f.where("prior18 IS NOT NULL AND vol IS NOT NULL").select("symbol", "ts", "prior18", "vol", F.coalesce((c("prior18") >= 10) & (c("last6") <= -2), F.lit(False)).alias("ev"))
    distance = F.abs(c("c_prior18") - c("p_prior18")) / 6 + F.abs(c("c_vol") - c("p_vol")) / 6
    m = J.matched_controls(f.where("ev"), f.where("NOT ev"), {"prior18": 200.0, "vol": 500.0}, distance)
    return m.select("c_symbol", F.unix_seconds("c_ts").alias("t"), "p_symbol", F.round("distance", 6).alias("distance"), "control_rank")


@query(TRADES + " SELECT symbol, count(*) AS n FROM trades WHERE symbol IN (SELECT event_type FROM events WHERE user_id = 8 AND value > 60) GROUP BY 1")
def j12_only_listed(spark, d):
    listed = spark.read.parquet(f"{d}/events.parquet").where("user_id = 8 AND value > 60").select(c("event_type").alias("symbol"))
    return N.only_listed(trades(spark, d), listed).groupBy("symbol").agg(F.count("*").alias("n"))


_J13 = TRADES + ", o AS (SELECT symbol, day, engine, max(r) AS r FROM trades WHERE engine IN ('E0', 'E1') GROUP BY 1, 2, 3), q AS (SELECT a.symbol, a.day, b.r - a.r AS delta FROM o a JOIN o b ON a.symbol = b.symbol AND a.day = b.day AND a.engine = 'E0' AND b.engine = 'E1')"


@query(_J13 + " SELECT count(*) AS both_filled, round(avg(delta), 6) AS mean_delta, round(100.0 * count(*) FILTER (delta > 0) / count(*), 6) AS better_pct FROM q")
def j13_policy_pairs(spark, d):
    return _metrics(N.policy_pair_summary(N.policy_pairs(trades(spark, d), ["symbol", "day"], "engine", "E0", "E1", "r")))


_J14 = TRADES + ", s AS (SELECT symbol || '|' || day AS batch_id, day, '{\"day\":' || day || ',\"n\":' || count(*) || '}' AS payload FROM trades GROUP BY symbol, day), o AS (SELECT batch_id, CASE WHEN day % 5 = 0 THEN sha256('x') ELSE sha256(payload) END AS digest FROM s WHERE day % 3 <> 0)"


@query(_J14 + " SELECT CASE WHEN digest IS NULL THEN 'OPEN' WHEN digest = sha256(payload) THEN 'LINKED' ELSE 'CHANGED' END AS link, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s LEFT JOIN o USING (batch_id) GROUP BY 1")
def j14_linked_ledger(spark, d):
    from pyspark.sql import Window

    s = trades(spark, d).groupBy("symbol", "day").agg(F.count("*").alias("n")).select(F.concat_ws("|", "symbol", "day").alias("batch_id"), "day", F.to_json(F.struct("day", "n")).alias("payload"))
    o = s.where("day % 3 <> 0").select("batch_id", F.when(c("day") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("payload", 256)).alias("digest"))
    counted = N.linked_ledger(s, o, "batch_id", "payload", "digest").groupBy("link").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy()), 6))  # three rows


@query(BARS + ", x AS (SELECT symbol, t, close, close + CASE WHEN t % 86400 = 0 THEN 0.5 ELSE 0 END AS other FROM bars) SELECT symbol, t, CASE WHEN t % 259200 = 0 THEN 'MISSING' WHEN t % 86400 = 0 THEN 'DIFFERS' END AS problem FROM x WHERE t % 86400 = 0")
def j18_differences(spark, d):
    b, t = bars(spark, d).select("symbol", "ts", "close"), F.unix_seconds("ts")
    again = b.where(t % (3 * DAY) != 0).withColumn("close", c("close") + F.when(t % DAY == 0, 0.5).otherwise(0.0))
    return _out(J.differences(b, again, ["symbol", "ts"], ["close"], 1e-6), "symbol", "ts", "problem")


@query(BARS + f", e AS (SELECT symbol, t FROM (SELECT symbol, t, {_RET} AS ret FROM bars) WHERE ret <= -50) SELECT DISTINCT b.symbol, b.t, round(b.close, 6) AS close FROM bars b JOIN e ON b.symbol = e.symbol AND b.t BETWEEN e.t - 28800 AND e.t + 43200")
def j19_within_windows(spark, d):
    b = bars(spark, d)
    e = b.withColumn("ret", W.returns(4)).where("ret <= -50").select("symbol", F.timestamp_seconds(F.unix_seconds("ts") - 28_800).alias("start"), F.timestamp_seconds(F.unix_seconds("ts") + 43_200).alias("end"))
    return _out(J.within_windows(b, e, STEP, holdout=2_000_000_000), "symbol", "ts", "close")


# features and events


@query(BARS + f", m AS (SELECT *, count(*) OVER a = 2 AND count(*) OVER b = 2 AND low < min(low) OVER a AND low <= min(low) OVER b AS pl, count(*) OVER a = 2 AND count(*) OVER b = 2 AND high > max(high) OVER a AND high >= max(high) OVER b AS ph, max(high) OVER x - low AS prom, row_number() OVER ({W_}) AS rn FROM bars WINDOW a AS ({W_} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), b AS ({W_} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), x AS ({W_} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), k AS (SELECT *, lag(pl, 2) OVER ({W_}) AS known, lag(prom, 2) OVER ({W_}) AS kprom FROM m) SELECT symbol, t, CASE WHEN lag(ph, 2) OVER ({W_}) THEN round(lag(high, 2) OVER ({W_}), 6) END AS pivot_high, CASE WHEN known THEN round(kprom, 6) END AS low_prominence, rn - max(CASE WHEN known THEN rn - 2 END) OVER ({W_} ROWS UNBOUNDED PRECEDING) AS low_age FROM k")
def w6_pivot_prominence(spark, d):
    return _out(W.with_pivot_age(W.with_strict_pivots(bars(spark, d))), "symbol", "ts", "pivot_high", "low_prominence", "low_age")


@query(BARS + f" SELECT symbol, t, round((close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0), 6) AS bb_z, coalesce(high > avg(close) OVER w + 2 * stddev_pop(close) OVER w AND close < avg(close) OVER w + 2 * stddev_pop(close) OVER w AND count(*) OVER w = 20, false) AS failed_upper FROM bars WINDOW w AS ({W_} ROWS 19 PRECEDING)")
def w8_bollinger_failures(spark, d):
    b = bars(spark, d).withColumns(W.bollinger())
    upper = c("bb_mean") + 2 * c("bb_sigma")
    return _out(b.withColumn("failed_upper", F.coalesce((c("high") > upper) & (c("close") < upper) & (F.count("close").over(W.rows(-19, 0)) == 20), F.lit(False))), "symbol", "ts", "bb_z", "failed_upper")


_W16 = BARS + f", f AS (SELECT *, ln(close / lag(close) OVER ({W_})) AS ch, (close / lag(close, 4) OVER ({W_}) - 1) * 100 AS r4, (close / lag(close, 8) OVER ({W_}) - 1) * 100 AS r8, (close / lag(close, 24) OVER ({W_}) - 1) * 100 AS r24, (lag(close, 1) OVER ({W_}) / lag(close, 25) OVER ({W_}) - 1) * 100 AS ru, max(high) OVER a AS h20, min(low) OVER a AS l20, max(high) OVER b AS h16, quantile_cont(amount, 0.5) OVER m AS med, avg(close) OVER ({W_} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS m12, sum(amount) OVER ({W_} ROWS 23 PRECEDING) AS turn, count(*) OVER ({W_} ROWS 31 PRECEDING) = 32 AS complete FROM bars WINDOW a AS ({W_} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS ({W_} ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), m AS ({W_} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)), g AS (SELECT *, stddev_samp(ch) OVER ({W_} ROWS 23 PRECEDING) * sqrt(24) * 100 AS vol FROM f)"


@query(_W16 + " SELECT g.symbol, g.t, round(g.h20, 6) AS prior_high20, round(g.l20, 6) AS prior_low20, round(g.h16, 6) AS prior_high16, round(g.med, 6) AS median_amount40, round(g.r4, 6) AS ret_short, round(g.r8, 6) AS ret_middle, round(g.r24, 6) AS ret_day, round(g.ru, 6) AS run_up, round(g.m12, 6) AS mean12, round(g.turn, 6) AS turnover_day, g.complete, round(g.vol, 4) AS volatility_day, round(g.r4 - b.r4, 6) AS relative_short FROM g LEFT JOIN g b ON b.symbol = 'purchase' AND b.t = g.t")
def w16_rolling_set(spark, d):
    out = E.rolling_set(bars(spark, d), "purchase", middle=8, day=24, warm_up=32).withColumn("volatility_day", F.round("volatility_day", 4))
    return _out(out, "symbol", "ts", "prior_high20", "prior_low20", "prior_high16", "median_amount40", "ret_short", "ret_middle", "ret_day", "run_up", "mean12", "turnover_day", "complete", "volatility_day", "relative_short")


_E6 = BARS + f", f AS (SELECT *, min(low) OVER p AS low20, max(high) OVER p AS high20, quantile_cont(amount, 0.5) OVER m AS med, {_RET} AS ret, sum(amount) OVER ({W_} ROWS 3 PRECEDING) AS am4, avg(close) OVER ({W_} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS m12, max(high) OVER q AS h16, min(low) OVER q AS l16, lag(close) OVER ({W_}) AS cb, (lag(close) OVER ({W_}) / lag(close, 25) OVER ({W_}) - 1) * 100 AS ru, count(*) OVER m = 40 AS rd, count(*) OVER ({W_} ROWS 47 PRECEDING) = 48 AS whole, sum(amount) OVER ({W_} ROWS 23 PRECEDING) AS turn, ln(close / lag(close) OVER ({W_})) AS ch FROM bars WINDOW p AS ({W_} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), q AS ({W_} ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), m AS ({W_} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)), g AS (SELECT *, close < 0.998 * low20 AS broke, stddev_samp(ch) OVER ({W_} ROWS 23 PRECEDING) AS vol FROM f), h AS (SELECT *, last_value(CASE WHEN broke THEN low20 END IGNORE NULLS) OVER ({W_} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS sup, bool_or(broke) OVER ({W_} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS rb, rd AND whole AND turn >= 8000 AND vol IS NOT NULL AS ready FROM g), j AS (SELECT h.*, b.ret AS bret FROM h LEFT JOIN h b ON b.symbol = 'purchase' AND b.t = h.t)"
_FLAGS = {"E01": "broke", "E02": "ret <= -2.5 AND am4 >= 1.8 * 4 * med", "E03": "high > 1.002 * high20 AND close < high20 AND close < open", "E04": "ru >= 10 AND close < m12 AND close < open", "E05": "rb AND high >= 0.995 * sup AND close < sup AND close < open", "E06": "high > high20 AND amount >= 3 * med AND (high - greatest(open, close)) / high >= 0.004 AND close < open", "E07": "ret <= -1 AND ret - bret <= -2", "E08": "(h16 - l16) / cb < 0.035 AND close < 0.998 * l16 AND amount >= 1.25 * med"}


@query(_E6 + " SELECT symbol, t, " + ", ".join(f'coalesce(ready AND {p}, false) AS "{k}"' for k, p in _FLAGS.items()) + " FROM j")
def e6_quality_families(spark, d):
    return _out(E.families(bars(spark, d), "purchase", min_turnover=8000, day=24, warm_up=48), "symbol", "ts", *E.FAMILIES)


_E8 = BARS + f", e AS (SELECT symbol, t, low, ph FROM (SELECT symbol, t, low, high, close, max(high) OVER ({W_} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS ph FROM bars) WHERE high > ph AND close < ph), z AS (SELECT symbol, max(t) AS last_t FROM bars GROUP BY 1), l AS (SELECT e.*, unnest(range(1, 10)) AS lag, last_t FROM e JOIN z USING (symbol)), j AS (SELECT l.*, b.close, CASE WHEN b.close IS NULL AND l.t + lag * 14400 > last_t THEN 'NOT_MATURED' WHEN b.close IS NULL THEN 'DATA_GAP' WHEN b.close >= ph THEN 'RECLAIMED' WHEN b.close < l.low THEN 'CONFIRMED' END AS says FROM l LEFT JOIN bars b ON b.symbol = l.symbol AND b.t = l.t + lag * 14400), f AS (SELECT symbol, t, any_value(last_t) AS last_t, min(CASE WHEN says IS NOT NULL AND lag <= 6 THEN lag END) AS lag, arg_min(says, lag) FILTER (says IS NOT NULL AND lag <= 6) AS says, list(lag) FILTER (close IS NULL) AS gone FROM j GROUP BY 1, 2)"


@query(_E8 + " SELECT symbol, t, CASE WHEN says IS NULL THEN 'NONE' WHEN says <> 'CONFIRMED' THEN says WHEN t + (lag + 3) * 14400 > last_t THEN 'NOT_MATURED' WHEN len(list_filter(coalesce(gone, []), lambda x: x > lag AND x <= lag + 3)) > 0 THEN 'DATA_GAP' ELSE 'CONFIRMED' END AS status, lag FROM f")
def e8_confirmation(spark, d):
    b = bars(spark, d)
    e = b.withColumn("prev_high", F.max("high").over(W.rows(-12, -1))).where("high > prev_high AND close < prev_high").select("symbol", "ts", "low", "prev_high")
    return _out(E.confirmation(e, b, STEP, 6, 2), "symbol", "ts", "status", "lag")


# labels


@query(BARS + f" SELECT symbol, t, " + ", ".join(f"round(CASE WHEN lead(t, 8) OVER w = t + 115200 AND t + 115200 < {END - 432000} THEN (close - lead(close, {h}) OVER w) / close * 100 END, 6) AS fall_{k}" for k, h in (("1", 1), ("4", 4), ("8", 8))) + f" FROM bars WINDOW w AS ({W_})")  # noqa: F541
def l2_close_labels(spark, d):
    return _out(L.close_labels(bars(spark, d), STEP, {"1": 1, "4": 4, "8": 8}, 8, END - 5 * DAY), "symbol", "ts", "fall_1", "fall_4", "fall_8")


_L3 = BARS + f", s AS (SELECT symbol, t, close, close * 0.4 AS atr FROM (SELECT *, {_RET} AS ret FROM bars) WHERE ret <= 0), j AS (SELECT s.*, (b.t - s.t) / 14400 AS n, b.high AS bh, b.low AS bl, b.close AS bc FROM s JOIN bars b ON b.symbol = s.symbol AND b.t > s.t AND b.t <= s.t + 172800), h AS (SELECT symbol, t, any_value(close) AS close, any_value(atr) AS atr, min(n) FILTER (bl <= close - 0.5 * atr) AS dn, min(n) FILTER (bh >= close + 0.5 * atr) AS up, " + ", ".join(f"arg_max(bc, n) FILTER (n <= {h}) AS c{h}, min(bl) FILTER (n <= {h}) AS l{h}, max(bh) FILTER (n <= {h}) AS h{h}" for h in (1, 4, 12)) + " FROM j GROUP BY 1, 2), k AS (SELECT *, CASE WHEN dn IS NULL AND up IS NULL THEN 'NONE' WHEN dn = up THEN 'AMBIGUOUS' WHEN up IS NULL OR dn < up THEN 'SHORT_FIRST' ELSE 'ADVERSE_FIRST' END AS first_move, CAST(coalesce(c1 < close, false) AS INT) + CAST(coalesce(c4 < close, false) AS INT) + CAST(coalesce(c12 < close, false) AS INT) AS votes FROM h), z AS (SELECT *, CASE WHEN first_move = 'SHORT_FIRST' AND votes >= 2 AND coalesce((close - c4) / atr, 0) > 0 THEN 'STRONG_SHORT_FOLLOWTHROUGH' WHEN votes >= 2 THEN 'SHORT_FOLLOWTHROUGH' WHEN first_move = 'ADVERSE_FIRST' THEN 'BOTTOM_OR_WRONG_TIMING' ELSE 'MIXED' END AS direction FROM k)"


def _direction(spark, d):
    s, b = _signals(spark, d)
    return L.direction_labels(s.select("symbol", "ts", "close", (c("close") * 0.4).alias("atr")), b, STEP, (1, 4, 12), 12)


@query(_L3 + " SELECT symbol, t, first_move, CAST(votes AS BIGINT) AS votes, direction, round((close - c4) / atr, 6) AS close_4_atr, round(greatest(0, close - l12) / atr, 6) AS mfe_12_atr, round(greatest(0, h1 - close) / atr, 6) AS mae_1_atr FROM z")
def l3_direction_labels(spark, d):
    return _out(_direction(spark, d), "symbol", "ts", "first_move", "votes", "direction", "close_4_atr", "mfe_12_atr", "mae_1_atr")


_NEXT = BARS + f", s AS (SELECT symbol, t + 14400 AS t, CASE WHEN t % 259200 = 0 THEN close * 1.05 ELSE close END AS entry, close * 1.2 AS stop FROM (SELECT *, {_RET} AS ret FROM bars) WHERE ret <= 0), j AS (SELECT s.*, (b.t - s.t) // 14400 AS slot, b.open AS bo, b.high AS bh, b.low AS bl, b.close AS bc, row_number() OVER (PARTITION BY s.symbol, s.t ORDER BY b.t) - 1 AS place FROM s JOIN bars b ON b.symbol = s.symbol AND b.t >= s.t AND b.t < s.t + 172800)"


def _entries(spark, d):
    b = bars(spark, d)
    s = b.withColumn("ret", W.returns(4)).where("ret <= 0").select("symbol", F.timestamp_seconds(F.unix_seconds("ts") + STEP).alias("ts"), F.when(F.unix_seconds("ts") % (3 * DAY) == 0, c("close") * 1.05).otherwise(c("close")).alias("entry"), (c("close") * 1.2).alias("stop"))
    return s, b


_L8 = _NEXT + ", h AS (SELECT symbol, t, max(bo) FILTER (slot = 0) AS o, min(slot) FILTER (slot = place AND bh >= stop) AS s, min(slot) FILTER (slot = place AND bl <= entry - 2 * (stop - entry)) AS p, arg_min(bo, slot) FILTER (slot = place AND bh >= stop) AS so, count(*) FILTER (slot = place) AS whole, count(*) AS n, arg_max(bc, slot) FILTER (slot = place) AS last FROM j GROUP BY 1, 2), z AS (SELECT x.*, h.* EXCLUDE (symbol, t), CASE WHEN NOT (entry > 0 AND stop - entry > 0 AND entry - 2 * (stop - entry) > 0) THEN 'INVALID_PLAN' WHEN o IS NULL THEN 'NO_NEXT_OPEN' WHEN o >= stop THEN 'GAP_BEYOND_STOP' WHEN s IS NOT NULL AND coalesce(p, s) >= s THEN CASE WHEN p = s THEN 'SL_SAME_BAR' ELSE 'SL_FIRST' END WHEN p IS NOT NULL THEN 'TP2R_FIRST' WHEN whole < n THEN 'CENSORED_GAP' WHEN whole < 12 THEN 'CENSORED_INCOMPLETE_HORIZON' ELSE 'TIME_EXIT' END AS state FROM (SELECT DISTINCT symbol, t, entry, stop FROM s) x LEFT JOIN h USING (symbol, t)), y AS (SELECT *, CASE WHEN state IN ('SL_FIRST', 'SL_SAME_BAR') THEN (entry - greatest(so, stop)) / (stop - entry) WHEN state = 'TP2R_FIRST' THEN 2.0 WHEN state = 'TIME_EXIT' THEN (entry - last) / (stop - entry) END AS gross FROM z)"


@query(_L8 + " SELECT symbol, t, state, round(gross - entry * 14 / 1e4 / (stop - entry), 6) AS net_r, CASE WHEN state IN ('SL_FIRST', 'SL_SAME_BAR') THEN s + 1 WHEN state = 'TP2R_FIRST' THEN p + 1 WHEN state = 'TIME_EXIT' THEN 12 END AS hold_bars FROM y")
def l8_censored_barrier(spark, d):
    return _out(L.censored_barrier(*_entries(spark, d), STEP, 12), "symbol", "ts", "state", "net_r", "hold_bars")


@query(_L8 + " SELECT cost_bps, count(*) AS n, round(avg(gross - entry * cost_bps / 1e4 / (stop - entry)), 6) AS mean_r FROM y, (SELECT unnest([0.0, 20.0, 40.0]) AS cost_bps) WHERE gross IS NOT NULL GROUP BY 1")
def l18_cost_stress(spark, d):
    out = L.cost_stress(L.censored_barrier(*_entries(spark, d), STEP, 12).where("gross_r IS NOT NULL"), "gross_r", "entry", "risk", [0.0, 20.0, 40.0])
    return _metrics(out.groupBy("cost_bps").agg(F.count("*").alias("n"), F.avg("stressed_r").alias("mean_r")))


_L15 = _NEXT.replace("close * 1.2 AS stop", "close * 0.3 AS atr") + ", w AS (SELECT * FROM j WHERE slot = place), e AS (SELECT w.*, unnest([3, 6]) AS horizon FROM w), x AS (SELECT symbol, t, horizon, any_value(entry) AS entry, any_value(atr) AS atr, count(*) AS n, max(bh) AS hi, min(bl) AS lo, -min(struct_pack(a := -bh, b := slot + 1)).a AS h2, min(struct_pack(a := -bh, b := slot + 1)).b AS bm, min(struct_pack(a := bl, b := slot + 1)).b AS bf, arg_max(bc, slot) AS cl FROM e WHERE slot < horizon GROUP BY 1, 2, 3), y AS (SELECT w.*, min(CASE WHEN bl <= entry - 1.5 * atr THEN slot + 1 END) OVER (PARTITION BY symbol, t) AS hit FROM w WHERE slot < 6), z AS (SELECT symbol, t, count(*) AS al, any_value(hit) AS hit, max(bh) FILTER (slot + 1 <= hit) AS up FROM y GROUP BY 1, 2)"


@query(_L15 + " SELECT symbol, t, CAST(horizon AS BIGINT) AS horizon, round(greatest(0, hi - entry) / atr, 6) AS mae_atr, round(greatest(0, entry - lo) / atr, 6) AS mfe_atr, bm AS bars_to_mae, bf AS bars_to_mfe, round((entry - cl) / atr, 6) AS close_atr, CASE WHEN al = 6 OR hit IS NOT NULL THEN hit IS NOT NULL END AS hit, hit AS bars_to_hit, round(greatest(CASE WHEN up IS NULL THEN NULL ELSE 0 END, up - entry) / atr, 6) AS mae_before_hit_atr FROM x JOIN z USING (symbol, t) WHERE n = horizon")
def l15_path_study(spark, d):
    s, b = _entries(spark, d)
    rows = s.select("symbol", "ts", "entry", (c("stop") / 1.2 * 0.3).alias("atr"))
    out = L.path_study(rows, b, STEP, (3, 6), 1.5).withColumn("mae_before_hit_atr", F.when(c("bars_to_hit").isNotNull(), c("mae_before_hit_atr")))
    return _out(out, "symbol", "ts", "horizon", "mae_atr", "mfe_atr", "bars_to_mae", "bars_to_mfe", "close_atr", "hit", "bars_to_hit", "mae_before_hit_atr")


_L5 = BARS + f", s AS (SELECT symbol, t, close, close * 0.4 AS atr FROM (SELECT *, {_RET} AS ret FROM bars) WHERE ret <= 0), mk AS (SELECT t, avg(close) AS level FROM bars GROUP BY 1 HAVING count(*) >= 2), j AS (SELECT s.*, (b.t - s.t) // 14400 AS n, b.high AS bh, b.low AS bl, b.close AS bc, unnest([1, 2, 3, 4, 6, 8, 10, 12]) AS point FROM s JOIN bars b ON b.symbol = s.symbol AND b.t > s.t AND b.t <= s.t + 172800), h AS (SELECT symbol, t, point, any_value(close) AS close, any_value(atr) AS atr, arg_max(bc, n) AS c, min(bl) AS l, max(bh) AS h, arg_max(bc, n) FILTER (n <= point - 4) AS bf, count(*) FILTER (n > point - 4) AS inn FROM j WHERE n <= point GROUP BY 1, 2, 3), k AS (SELECT h.*, (m1.level / m0.level - 1) * 100 AS mp FROM h LEFT JOIN mk m0 ON m0.t = h.t LEFT JOIN mk m1 ON m1.t = h.t + h.point * 14400)"


@query(_L5 + " SELECT symbol, t, CAST(point AS BIGINT) AS point, round((close - c) / atr, 6) AS close_atr, round(greatest(0, close - l) / atr, 6) AS mfe_atr, round(greatest(0, h - close) / atr, 6) AS mae_atr, round((c / close - 1) * 100 - mp, 6) AS relative_pct, round(CASE WHEN point % 4 = 0 AND inn > 0 THEN (coalesce(bf, close) - c) / atr END, 6) AS block_atr FROM k")
def l5_path_checkpoints(spark, d):
    s, b = _signals(spark, d)
    market = b.groupBy("ts").agg(F.avg("close").alias("level"), F.count("*").alias("n")).where("n >= 2").drop("n")
    out = L.path_checkpoints(s.select("symbol", "ts", "close", (c("close") * 0.4).alias("atr")), b, market, STEP, (1, 2, 3, 4, 6, 8, 10, 12), 4)
    return _out(out, "symbol", "ts", "point", "close_atr", "mfe_atr", "mae_atr", "relative_pct", "block_atr")


_L19 = BARS + _JOINED.replace("172800", "259200").replace("b.high, b.low, b.close", "b.open, b.high, b.low, b.close") + ", p AS (SELECT *, entry * 1.2 AS stop, entry * 1.2 - entry AS risk FROM j), h AS (SELECT symbol, t, any_value(entry) AS entry, any_value(risk) AS risk, min(bt) FILTER (bt <= t + 172800 AND high >= stop) AS st, min(bt) FILTER (bt <= t + 172800 AND low <= entry - 2 * risk) AS tt, arg_max(close, bt) FILTER (bt <= t + 172800) AS lc FROM p GROUP BY 1, 2), f AS (SELECT *, CASE WHEN st IS NOT NULL AND coalesce(tt, st) >= st THEN -1.0 WHEN tt IS NOT NULL THEN 2.0 ELSE (entry - lc) / risk END - entry * 14 / 1e4 / risk AS r1 FROM h WHERE lc IS NOT NULL), n AS (SELECT p.*, h.st, lead(open) OVER w AS no, lead(bt) OVER w AS nt FROM p JOIN h USING (symbol, t) WINDOW w AS (PARTITION BY symbol, t ORDER BY bt)), g AS (SELECT symbol, t, any_value(risk) AS risk, arg_min(nt, bt) AS nt, arg_min(no, bt) AS ne FROM n WHERE st IS NOT NULL AND bt > st AND bt <= st + 86400 AND close < entry GROUP BY 1, 2), q AS (SELECT g.symbol, g.t, ne, ne + risk AS ns, b.t AS bt, b.high, b.low, b.close FROM g JOIN bars b ON b.symbol = g.symbol AND b.t > g.nt AND b.t <= g.nt + 172800 WHERE ne IS NOT NULL), x AS (SELECT symbol, t, any_value(ne) AS e2, any_value(ns - ne) AS k2, min(bt) FILTER (high >= ns) AS st, min(bt) FILTER (low <= ne - 2 * (ns - ne)) AS tt, arg_max(close, bt) AS lc FROM q GROUP BY 1, 2), y AS (SELECT symbol, t, CASE WHEN st IS NOT NULL AND coalesce(tt, st) >= st THEN -1.0 WHEN tt IS NOT NULL THEN 2.0 ELSE (e2 - lc) / k2 END - e2 * 14 / 1e4 / k2 AS r2 FROM x)"


@query(_L19 + " SELECT s.symbol, s.t, round(r1, 6) AS net_r, round(r2, 6) AS second_r, round(r1 + coalesce(r2, 0), 6) AS sequence_r FROM s LEFT JOIN f USING (symbol, t) LEFT JOIN y USING (symbol, t)")
def l19_sequence_sum(spark, d):
    from tidewatch.operators import sequences as Q

    s, b = _signals(spark, d)
    primary = L.triple_barrier(s, b, 172_800).withColumn("net_r", F.when(c("outcome").isin("STOP", "TARGET", "TIME"), c("net_r")))
    out = Q.reentry_sequence(primary.select("symbol", "ts", "outcome", "net_r"), Q.reentry(s, b, 172_800, 86_400), b, 172_800)
    return _out(out, "symbol", "ts", "net_r", "second_r", "sequence_r")


@query(ORACLES["w3_w4_w9_w10_features"])
def w3_w4_w9_w10_in_chunks(spark, d):
    """The same features as over whole symbols, in chunks of 64 bars with halos."""
    features = lambda b: b.withColumns({"ret": W.returns(4), "volume_ratio": W.volume_ratio(), "position": W.range_position(), "vwap": W.vwap()})
    return _out(in_chunks(bars(spark, d), features, back=24, chunk=64), "symbol", "ts", "ret", "volume_ratio", "position", "vwap")


@query(BARS + f", l AS (SELECT symbol, t, list(close) OVER ({W_} ROWS UNBOUNDED PRECEDING) AS v FROM bars) SELECT symbol, t, " + ", ".join(f"round(list_reduce(v, lambda s, x: x * (2.0 / {n + 1}) + s * (1 - 2.0 / {n + 1})), 6) AS ema{n}" for n in (20, 100)) + " FROM l")
def w1_ema_whole_history(spark, d):
    return _out(with_ema(bars(spark, d), (20, 100)), "symbol", "ts", "ema20", "ema100")


ORACLES["e6_all_families"] = _E6.replace("rd AND whole AND turn >= 8000 AND vol IS NOT NULL AS ready", "rd AS ready") + ", k AS (SELECT " + ", ".join(f'coalesce(ready AND {p}, false) AS "{n}"' for n, p in _FLAGS.items()) + " FROM j) SELECT unnest([" + ", ".join(f"'{n}'" for n in _FLAGS) + "]) AS family, unnest([" + ", ".join(f'count(*) FILTER ("{n}")' for n in _FLAGS) + "]) AS events, count(*) AS bars FROM k"


# statistics

_BOOT = ", m AS (SELECT i // (SELECT n FROM z) AS rep, ('0x' || substr(md5('{salt}|' || (i // (SELECT n FROM z)) || '|' || (i % (SELECT n FROM z))), 1, 8))::BIGINT % (SELECT n FROM z) AS k FROM (SELECT unnest(range(0, 500 * (SELECT n FROM z))) AS i)), r AS (SELECT rep, sum(s) / sum(q.n) AS mean FROM m JOIN q USING (k) GROUP BY 1), o AS (SELECT list_sort(list(mean)) AS v FROM r) SELECT round(v[13], 6) AS low, round(v[487], 6) AS high FROM o"


@query(TRADES + ", q AS (SELECT row_number() OVER (ORDER BY day) - 1 AS k, s, n FROM (SELECT day, sum(r) AS s, count(r) AS n FROM trades GROUP BY 1)), z AS (SELECT count(*) AS n FROM q)" + _BOOT.replace("{salt}", "cluster"))
def a10_cluster_interval(spark, d):
    return _metrics(A.cluster_bootstrap(trades(spark, d), "day", "r"))


@query(TRADES + ", q AS (SELECT ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT % 200 AS k, sum(r) AS s, count(r) AS n FROM trades GROUP BY 1), z AS (SELECT 200 AS n)" + _BOOT.replace("{salt}", "row"))
def a11_row_interval(spark, d):
    return _metrics(A.row_bootstrap(trades(spark, d), "id", "r", bags=200))


_MIX = "xor({u}, {u} >> 16) * 73244475 % 4294967296"


def _poisson_sql(reps):
    step = lambda name, of: f"{name} AS (SELECT * EXCLUDE u, {_MIX.format(u='u')} AS u FROM {of})"
    times = " + ".join(f"(u >= {int(x)})::INT" for x in A._POISSON)
    return f", p0 AS (SELECT symbol, r, rep, (id % 4294967296 * 2654435761 + rep * 40503001 + 12345) % 4294967296 AS u FROM trades, range({reps}) q(rep) WHERE r IS NOT NULL), {step('p1', 'p0')}, {step('p2', 'p1')}, p3 AS (SELECT symbol, r, rep, xor(u, u >> 16) AS u FROM p2), p4 AS (SELECT symbol, rep, count(*) AS n, sum(r * ({times})) / sum({times}) AS m FROM p3 GROUP BY 1, 2)"


@query(TRADES + _poisson_sql(500) + " SELECT symbol, max(n) AS n, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM p4 GROUP BY 1")
def a11_poisson_interval(spark, d):
    return _metrics(A.poisson_bootstrap(trades(spark, d), "id", "r", ["symbol"], share=0.95))


_X = "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 10 = 1 THEN 'inf'::DOUBLE ELSE r END"
_KNOWN = f"CASE WHEN isfinite({_X}) THEN {_X} END"


@query(TRADES + f", g AS (SELECT engine, CASE WHEN regime = 2 THEN 'UNKNOWN' ELSE CAST(regime AS VARCHAR) END AS st, count(*) AS n FROM trades GROUP BY 1, 2), s AS (SELECT engine, string_agg(st || ':' || n, ';' ORDER BY st) AS state_counts FROM g GROUP BY 1) SELECT engine, count(*) AS count, round(avg({_KNOWN}), 6) AS avg_x, round(quantile_cont({_KNOWN}, 0.5), 6) AS median_x, round(100.0 * count(*) FILTER (score > 50 AND id % 4 <> 0) / count(*) FILTER (id % 4 <> 0), 6) AS rate_high, round(100.0 * count(*) FILTER (symbol = 'view') / count(*), 6) AS view_pct, any_value(state_counts) AS state_counts FROM trades JOIN s USING (engine) GROUP BY 1")
def a15_rates(spark, d):
    x = F.when(c("id") % 9 == 0, None).when(c("id") % 10 == 1, F.lit(float("inf"))).otherwise(c("r"))
    rows = trades(spark, d).withColumns({"x": x, "high": F.when(c("id") % 4 != 0, c("score") > 50), "state": F.when(c("regime") != 2, c("regime").cast("string"))})
    return _metrics(A.rates(rows, ["engine"], averages=["x"], medians=["x"], flags=["high"], values={"view_pct": ("symbol", "view")}, states=["state"]))


@query(_L3 + ", q AS (SELECT symbol, string_agg(first_move || ':' || n, ';' ORDER BY first_move) AS first_move_counts FROM (SELECT symbol, first_move, count(*) AS n FROM z GROUP BY 1, 2) GROUP BY 1), p AS (SELECT symbol, string_agg(direction || ':' || n, ';' ORDER BY direction) AS direction_counts FROM (SELECT symbol, direction, count(*) AS n FROM z GROUP BY 1, 2) GROUP BY 1) SELECT symbol, count(*) AS count, " + ", ".join(f"round(avg((close - c{h}) / atr), 6) AS avg_close_{h}_atr, round(avg(CASE WHEN l{h} IS NOT NULL THEN greatest(0, close - l{h}) / atr ELSE 0 END), 6) AS avg_mfe_{h}_atr, round(avg(CASE WHEN h{h} IS NOT NULL THEN greatest(0, h{h} - close) / atr ELSE 0 END), 6) AS avg_mae_{h}_atr, round(100.0 * count(*) FILTER (c{h} < close) / count(c{h}), 6) AS rate_short_{h}" for h in (1, 4, 12)) + ", round(quantile_cont((close - c12) / atr, 0.5), 6) AS median_close_12_atr, round(100.0 * count(*) FILTER (first_move = 'SHORT_FIRST') / count(*), 6) AS short_first_pct, round(100.0 * count(*) FILTER (first_move = 'ADVERSE_FIRST') / count(*), 6) AS adverse_first_pct, round(100.0 * count(*) FILTER (direction = 'STRONG_SHORT_FOLLOWTHROUGH') / count(*), 6) AS strong_pct, round(100.0 * count(*) FILTER (direction = 'BOTTOM_OR_WRONG_TIMING') / count(*), 6) AS wrong_timing_pct, any_value(first_move_counts) AS first_move_counts, any_value(direction_counts) AS direction_counts FROM z JOIN q USING (symbol) JOIN p USING (symbol) GROUP BY 1")
def a16_diagnostics(spark, d):
    return _metrics(A.diagnostics(_direction(spark, d), ["symbol"], (1, 4, 12)))


@query(TRADES + f" SELECT CASE WHEN t + 172800 >= {END - 432000} THEN 'PURGED_NEAR_HOLDOUT' WHEN regime = 0 THEN 'NO_CONTROLS' WHEN score < 20 THEN 'SCORE_TOO_LOW' ELSE 'ELIGIBLE' END AS reason, count(*) AS n FROM trades GROUP BY 1")
def a28_attrition(spark, d):
    return N.attrition(trades(spark, d), {"PURGED_NEAR_HOLDOUT": c("t") + 2 * DAY >= END - 5 * DAY, "NO_CONTROLS": c("regime") == 0, "SCORE_TOO_LOW": c("score") < 20})


@query(_E6.replace("turn >= 8000", "turn >= 0").replace("47 PRECEDING) = 48", "0 PRECEDING) = 1") + ", k AS (SELECT " + ", ".join(f'coalesce(ready AND {p}, false) AS "{n}"' for n, p in _FLAGS.items()) + " FROM j), u AS (SELECT unnest([" + ", ".join(f"CASE WHEN \"{n}\" THEN '{n}' END" for n in _FLAGS) + "]) AS family, " + " + ".join(f'"{n}"::INT' for n in _FLAGS) + " AS held FROM k) SELECT family, count(*) AS events, count(*) FILTER (held > 1) AS overlapping FROM u WHERE family IS NOT NULL GROUP BY 1")
def a28_overlaps(spark, d):
    return N.overlap_counts(E.families(bars(spark, d), "purchase", min_turnover=0.0, day=24, warm_up=1), list(E.FAMILIES))


@query(TRADES + " SELECT unnest(['symbols', 'days', 'times']) AS name, unnest([count(DISTINCT symbol), count(DISTINCT day), count(DISTINCT t)]) AS n FROM trades")
def a30_distinct_counts(spark, d):
    return N.distinct_counts(trades(spark, d), {"symbols": c("symbol"), "days": c("day"), "times": c("t")})


@query(TRADES + ", m AS (SELECT count(r) AS n, avg(r) AS x, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS pf FROM trades) SELECT n >= 1000 AS enough, x > 0 AS positive, pf >= 1.1 AS profitable, x > 5 AS large, n >= 1000 AND x > 0 AND pf >= 1.1 AND x > 5 AS passed FROM m")
def a29_gates(spark, d):
    return A.gates(A.metrics(trades(spark, d), []), {"enough": c("resolved") >= 1000, "positive": c("expectancy") > 0, "profitable": c("profit_factor") >= 1.1, "large": c("expectancy") > 5})


_STREAK = TRADES + ", k AS (SELECT *, sum(CASE WHEN r >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS island FROM trades), x AS (SELECT symbol, island, count(*) FILTER (r < 0) AS run FROM k GROUP BY 1, 2)"


@query(_STREAK + " SELECT symbol, max(run) AS longest_loss_streak FROM x GROUP BY 1")
def w24_loss_streak(spark, d):
    return A.loss_streaks(trades(spark, d), ["symbol"], ["t", "id"], "r", span())


_COMP = TRADES + ", k AS (SELECT *, sum(ln(1 + r * 0.5 / 100)) OVER (PARTITION BY symbol ORDER BY t_exit, id ROWS UNBOUNDED PRECEDING) AS e FROM trades), p AS (SELECT *, greatest(max(e) OVER (PARTITION BY symbol ORDER BY t_exit, id ROWS UNBOUNDED PRECEDING), 0) AS peak FROM k)"


@query(_COMP + " SELECT symbol, count(*) AS trades, count(*) FILTER (r > 0) AS wins, round((exp(sum(ln(1 + r * 0.5 / 100))) - 1) * 100, 4) AS return_pct, round((1 - exp(-max(peak - e))) * 100, 4) AS max_drawdown_pct FROM p GROUP BY 1")
def w25_compounded(spark, d):
    out = A.compounded(trades(spark, d), ["symbol"], ["t_exit", "id"], "r", 0.5, F.floor(c("t_exit") / DAY))
    return out.withColumns({k: F.round(k, 4) for k in ("return_pct", "max_drawdown_pct")})


# order, universes, sets, cohorts


@query("SELECT event_type AS symbol, round(sum(value), 4) AS turnover FROM events GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 3")
def o1_top_universe(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").groupBy(c("event_type").alias("symbol")).agg(F.sum("value").alias("turnover"))
    return N.top_universe(t, "turnover", 3).withColumn("turnover", F.round("turnover", 4))


_O4 = TRADES + ", b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k1 FROM trades), x AS (SELECT id, 0 AS list FROM b WHERE k1 <= 75), y AS (SELECT id, 1 AS list FROM (SELECT id, row_number() OVER (ORDER BY r DESC, id) AS k FROM trades WHERE id NOT IN (SELECT id FROM x)) WHERE k <= 15), z AS (SELECT id, 2 AS list FROM (SELECT id, row_number() OVER (ORDER BY regime DESC, id) AS k FROM trades WHERE id NOT IN (SELECT id FROM x UNION ALL SELECT id FROM y)) WHERE k <= 10)"


@query(_O4 + " SELECT id, CAST(list AS BIGINT) AS list FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z)")
def o4_quota_shortlist(spark, d):
    rows = trades(spark, d).select("id", "score", "r", c("regime").cast("double").alias("pressure"))
    return S.quota_shortlist(rows, "id", [("score", 75), ("r", 15), ("pressure", 10)], 100).select("id", "list")


_O6 = TRADES + ", s AS (SELECT id, symbol || '-' || id AS symbol, score, r AS turnover, CASE WHEN score > 90 THEN 'ENTRY_READY' WHEN score > 60 THEN 'WATCH' WHEN score > 40 THEN 'ODD' ELSE 'IGNORE' END AS status FROM trades)"


@query(_O6 + " SELECT id, row_number() OVER (ORDER BY CASE status WHEN 'ENTRY_READY' THEN 1 WHEN 'WATCH' THEN 2 WHEN 'IGNORE' THEN 3 ELSE 4 END, score DESC, turnover DESC, symbol) AS place FROM s QUALIFY place <= 500")
def o6_result_order(spark, d):
    status = F.when(c("score") > 90, "ENTRY_READY").when(c("score") > 60, "WATCH").when(c("score") > 40, "ODD").otherwise("IGNORE")
    rows = trades(spark, d).select("id", F.concat_ws("-", "symbol", "id").alias("symbol"), "score", c("r").alias("turnover"), status.alias("status"))
    return N.ranked_results(rows, ["ENTRY_READY", "WATCH", "IGNORE"], 500).select("id", "place")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def o7_top_groups(spark, d):
    return N.top_groups(spark.read.parquet(f"{d}/events.parquet"), "user_id", 5)


@query(TRADES + ", m AS (SELECT engine || '-' || regime || '-' || symbol AS name, count(*) AS n, round(avg(r), 9) AS score FROM trades GROUP BY 1) SELECT name, round(score, 6) AS score FROM m WHERE n >= 150 ORDER BY m.score DESC, name DESC LIMIT 1")
def o8_leader(spark, d):
    m = trades(spark, d).groupBy(F.concat_ws("-", "engine", "regime", "symbol").alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("r"), 9).alias("score"))
    return _metrics(N.leader(m, "name", "n", "score", 150))


@query(TRADES + " SELECT id, engine, CAST(NULL AS DOUBLE) AS score FROM trades WHERE engine = 'E0' UNION ALL SELECT id, NULL, score FROM trades WHERE engine = 'E1'")
def u1_union(spark, d):
    rows = trades(spark, d)
    return N.union_all([rows.where("engine = 'E0'").select("id", "engine"), rows.where("engine = 'E1'").select("id", "score")])


@query(TRADES + " SELECT symbol, day FROM trades WHERE engine = 'E0' INTERSECT SELECT symbol, day FROM trades WHERE engine = 'E1' AND score > 80")
def u3_common_keys(spark, d):
    rows = trades(spark, d).withColumn("k", F.concat_ws("|", "symbol", "day"))
    own = N.common_keys(rows.where("engine = 'E0'"), rows.where("engine = 'E1' AND score > 80"), "k")
    return own.select(F.split("k", "[|]")[0].alias("symbol"), F.split("k", "[|]")[1].cast("long").alias("day"))


_ID = "'{\"end\":1706659200,\"rules\":{\"cooldown\":\"6h\",\"top\":\"3\"},\"start\":1704067200,\"symbols\":[' || string_agg('\"' || symbol || '\"', ',' ORDER BY symbol) || ']}'"


@query(f"SELECT count(*) AS symbol_count, {_ID} AS identity, sha256({_ID}) AS cohort_id FROM (SELECT DISTINCT event_type || '_' || user_id AS symbol FROM events)")
def c1_frozen_cohort(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat_ws("_", "event_type", "user_id").alias("symbol"))
    return N.freeze_cohort(e, START, END, {"top": "3", "cooldown": "6h"})


_CAL = f"c AS (SELECT 'BLOCK_' || (i + 1) AS name, {START} + i * 432000 AS a, {START} + (i + 1) * 432000 AS b FROM range(4) q(i) UNION ALL SELECT 'OOS1', {START + 4 * 432000 + 86400}, {START + 4 * 432000 + 86400 + 259200} UNION ALL SELECT 'OOS2', {START + 4 * 432000 + 86400 + 259200 + 86400}, {START + 4 * 432000 + 86400 + 259200 + 86400 + 172800})"


@query(TRADES + f", {_CAL} SELECT name, a AS start, b AS \"end\", count(t.id) AS n, round(avg(t.r), 6) AS mean_r FROM c LEFT JOIN trades t ON t.t >= c.a AND t.t < c.b GROUP BY 1, 2, 3")
def c2_block_calendar(spark, d):
    blocks = N.block_calendar(spark, START, 4, 5, 1, [("OOS1", 3), ("OOS2", 2)])
    rows = trades(spark, d).select("id", "t", "r").join(F.broadcast(blocks), (c("t") >= c("start")) & (c("t") < c("end")), "right")  # a handful of blocks
    return _metrics(rows.groupBy("name", "start", "end").agg(F.count("id").alias("n"), F.avg("r").alias("mean_r")))


@query(TRADES + ", m AS (SELECT count(*) AS signals, count(*) FILTER (r > 0) AS wins FROM trades), e AS (SELECT 'signals' AS name, CAST(count(*) AS DOUBLE) AS expected FROM events UNION ALL SELECT 'wins', 1.0 UNION ALL SELECT 'other', 2.0) SELECT name, expected, CAST(CASE name WHEN 'signals' THEN signals WHEN 'wins' THEN wins END AS DOUBLE) AS observed, coalesce(abs(CASE name WHEN 'signals' THEN signals WHEN 'wins' THEN wins END - expected) <= 1e-5, false) AS agrees FROM e, m")
def c4_replication(spark, d):
    m = A.metrics(trades(spark, d), []).select("signals", "wins")
    signals = spark.read.parquet(f"{d}/events.parquet").agg(F.lit("signals").alias("name"), F.count("*").cast("double").alias("expected"))
    return N.replication_check(m, signals.union(spark.createDataFrame([("wins", 1.0), ("other", 2.0)], "name string, expected double")))


@query("SELECT event_type, ('0x' || substr(sha256(event_type || '_' || user_id), 1, 12))::BIGINT % 8 AS part, count(*) AS n FROM events GROUP BY 1, 2")
def c6_hash_partition(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("part", S.hash_partition(F.concat_ws("_", "event_type", "user_id"), 8))
    return e.groupBy("event_type", "part").agg(F.count("*").alias("n"))


_LOOK = TRADES + ", s AS (SELECT DISTINCT symbol || '|' || day AS b, day FROM trades), o AS (SELECT symbol || '|' || day AS b, day, r AS edge, r - 0.5 AS short FROM trades WHERE day % 40 <> 0 AND score > 30), y AS (SELECT day, sum(edge) AS e, sum(short) AS sh, count(*) AS n FROM o GROUP BY 1), f AS (SELECT sum(n) AS events, count(*) AS days, sum(e) / sum(n) AS me, sum(sh) / sum(n) - 0.2 AS mn, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END) AS pd FROM y), g AS (SELECT (SELECT count(*) FROM s) AS snapshots, (SELECT count(DISTINCT o.b) FROM o) AS settled, f.* FROM f)"
_LATER, _EARLY = END + 3 * DAY, END + DAY


@query(_LOOK + " SELECT 'late' AS look, CASE WHEN settled < 0.8 * snapshots THEN 'OUTCOMES_INCOMPLETE' WHEN events < 100 OR days < 10 THEN 'SAMPLE_TOO_SMALL' WHEN me > 0 AND mn > 0 AND pd >= 0.6 THEN 'SUPPORTIVE' ELSE 'NOT_CONFIRMED' END AS status, snapshots, settled, CASE WHEN settled >= 0.8 * snapshots AND events >= 100 AND days >= 10 THEN CAST(events AS BIGINT) END AS events, round(CASE WHEN settled >= 0.8 * snapshots AND events >= 100 AND days >= 10 THEN me END, 6) AS mean_edge FROM g UNION ALL SELECT 'early', 'ACCUMULATING', snapshots, settled, NULL, NULL FROM g")
def t11_first_look(spark, d):
    rows = trades(spark, d).withColumn("batch_id", F.concat_ws("|", "symbol", "day"))
    outcomes = rows.where("day % 40 <> 0 AND score > 30").select("batch_id", "day", c("r").alias("edge"), (c("r") - 0.5).alias("short"))
    looks = [N.first_look(rows.select("batch_id").distinct(), outcomes, now, END, delay=216_000, coverage=0.8, least_rows=100, least_days=10, cost_pct=0.2).withColumn("look", F.lit(k)) for k, now in (("late", _LATER), ("early", _EARLY))]
    return _metrics(N.union_all(looks).select("look", "status", "snapshots", "settled", "events", "mean_edge"))


# scalar functions


@query("SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / nullif(user_id, 0) * 1.00001 END, 6) AS share, round(least(greatest(value, 10), 100), 6) AS clamped, round(ln(value) , 6) AS log_value, floor(value / 0.05) AS steps, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS finite_value, strftime(ts, '%Y') || '-Q' || quarter(ts) AS quarter, isoyear(ts) * 100 + week(ts) AS iso_week, ('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT AS prefix, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scalar_functions(spark, d):
    e = B.with_utc(spark.read.parquet(f"{d}/events.parquet"))
    value = F.when(c("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(c("value"))
    iso_year = F.year(F.date_add(F.to_date("ts"), 4 - F.weekday(F.to_date("ts")) - 1))
    out = e.select(
        "event_id", (ratio(finite(value), c("user_id").cast("double")) * 1.00001).alias("share"), clamp(c("value"), 10, 100).alias("clamped"), ln(c("value")).alias("log_value"), F.floor(c("value") / 0.05).cast("double").alias("steps"), finite(value).alias("finite_value"),
        F.concat(F.date_format("ts", "yyyy"), F.lit("-Q"), F.quarter("ts").cast("string")).alias("quarter"), (iso_year * 100 + F.weekofyear("ts")).cast("long").alias("iso_week"), F.conv(F.substring(F.sha2(c("event_id").cast("string"), 256), 1, 8), 16, 10).cast("long").alias("prefix"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    return _metrics(out)
