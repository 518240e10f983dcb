"""Registered queries of the streaming forms: each runs its stream over all ticks to the end and gives its rows as a table, beside the DuckDB SQL of the batch result.

The last three get their rows in parts, one after the other, and go on from the checkpoint of the part before."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import bars as B
from tidewatch.operators import features as W
from tidewatch.plans.catalog import _JOINED, _RET, BARS, STEP, W_, _out, _signals, bars, query
from tidewatch.plans.scores import _TICKS, _bars_sql, walk
from tidewatch.sources.candles import kept, shared_folder
from tidewatch.streaming import capture as C
from tidewatch.streaming import live as T
from tidewatch.streaming import settle as S

c = F.col


def _stream(spark, rows):
    """A table as a stream: written to a folder whose files are read as they come."""
    path = shared_folder(spark, "stream-in")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _run(spark, stream):
    return T.run_to_end(stream, spark, shared_folder(spark, "stream-out"))


_MARK = ", e AS (SELECT max(epoch_ms(ts)) AS ms FROM events)"


@query(BARS + _MARK + " SELECT symbol, t, round(open, 6) AS open, round(close, 6) AS close, volume, round(amount, 6) AS amount FROM bars, e WHERE (t + 14400) * 1000 <= ms")
def t1_closed_bar_stream(spark, d):
    ticks = B.ticks(spark.read.parquet(f"{d}/events.parquet"))
    return _out(_run(spark, T.closed_bars(_stream(spark, ticks), "4 hours", "0 seconds")), "symbol", "ts", "open", "close", "volume", "amount")


@query(BARS + ", m AS (SELECT max(t) AS ms FROM bars) SELECT symbol, (t // 86400) * 86400 AS slot, min(t) AS t, round(arg_min(close, t), 6) AS close FROM bars, m WHERE (t // 86400) * 86400 + 86400 <= ms GROUP BY 1, 2")
def t3_captured_slots(spark, d):
    out = _run(spark, T.captured(_stream(spark, bars(spark, d)), "1 day", "0 seconds"))
    return _out(out, "symbol", "slot", "ts", "close").withColumn("slot", F.unix_seconds("slot"))


@query(BARS + f", e AS (SELECT symbol, t FROM (SELECT symbol, t, {_RET} AS ret FROM bars) WHERE ret <= -30), s AS (SELECT symbol, list_sort(list(t)) AS ts FROM e GROUP BY 1) SELECT symbol, unnest(list_reduce(list_transform(ts, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 172800 THEN list_concat(a, x) ELSE a END)) AS t FROM s")
def t4_stateful_cooldown(spark, d):
    events = bars(spark, d).withColumn("ret", W.returns(4)).where("ret <= -30").select("symbol", "ts")
    return _out(_run(spark, T.cooled_down(_stream(spark, events), 172_800, "60 days")), "symbol", "ts")


@query(BARS + f" SELECT symbol, t, sha256(symbol || '|' || t) AS signal_id, 'OPEN' AS status FROM (SELECT symbol, t, {_RET} AS ret FROM bars) WHERE ret <= -30")
def t5_signal_register(spark, d):
    signals = bars(spark, d).withColumn("ret", W.returns(4)).where("ret <= -30").select("symbol", "ts")
    twice = signals.union(signals)  # each arrives twice
    return _out(_run(spark, T.registered(_stream(spark, twice), "60 days")), "symbol", "ts", "signal_id", "status")


_T6 = BARS + _JOINED + f", z AS (SELECT max(t) AS now FROM bars), h AS (SELECT symbol, t, count(*) AS n, min(CASE WHEN low <= entry * 0.6 THEN bt END) AS dn, min(CASE WHEN high >= entry * 1.4 THEN bt END) AS up FROM j GROUP BY 1, 2) SELECT s.symbol, s.t, coalesce(n, 0) AS bars, CASE WHEN up IS NOT NULL AND up <= coalesce(dn, 9e18) THEN 'CLOSED_STOP' WHEN dn IS NOT NULL THEN 'CLOSED_TARGET' WHEN s.t + 172800 <= now AND coalesce(n, 0) >= 0.95 * 12 THEN 'CLOSED_TIME' WHEN s.t + 172800 <= now THEN 'POSTPONED' ELSE 'OPEN' END AS status FROM s LEFT JOIN h USING (symbol, t), z"  # noqa: F541


@query(_T6)
def t6_settlement(spark, d):
    s, b = _signals(spark, d)
    joined = _run(spark, T.settled(_stream(spark, s.select("symbol", "ts")), _stream(spark, b.select("symbol", "ts", "high", "low", "close")), "48 HOURS", "60 days"))
    now = b.agg(F.max(F.unix_seconds("ts")).alias("now")).first().now
    return _out(T.settlement(joined, s, STEP, 12, now, move=0.4), "symbol", "ts", "bars", "status")


PARTS = 3
_PART = f"least({PARTS - 1}, ((x - (SELECT min(x) FROM {{0}})) * {PARTS}) // ((SELECT max(x) FROM {{0}}) - (SELECT min(x) FROM {{0}}) + 1))"


def _in_parts(spark, rows, x):
    """Rows with `part`, the third of the range of x (seconds) that they lie in."""
    low, high = rows.agg(F.min(x), F.max(x)).first()
    if low is None:
        return rows.withColumn("part", F.lit(0).cast("long"))
    return rows.withColumn("part", F.least(F.lit(PARTS - 1), F.floor((x - low) * PARTS / (high - low + 1))).cast("long"))


def _delivered(spark, rows, columns, use, parts=PARTS + 1):
    """Writes the parts one after the other into a folder and calls `use` with the folder's stream after each."""
    rows, path = kept(rows, shared_folder(spark, "parts")), shared_folder(spark, "stream-in")
    for k in range(parts):
        rows.where(c("part") == k).select(*columns).write.mode("append").parquet(path)
        use(spark.readStream.schema(rows.select(*columns).schema).parquet(path))


_LATE = "CASE WHEN (t // 14400) % 10 = 3 THEN 129600 ELSE 0 END"
_T6S = (
    f"WITH {_TICKS}, {_bars_sql('bars', STEP)}, s AS (SELECT symbol, t, close AS entry FROM (SELECT *, {_RET} AS ret FROM bars) WHERE ret <= 0), k AS (SELECT *, t + 14400 + {_LATE} AS known FROM bars), e AS (SELECT max(known) AS clock FROM k), a AS (SELECT s.*, a, t + 172800 + 14400 + 86400 * (a - 1) AS due FROM s, range(1, 4) AS r(a)),"
    " h AS (SELECT a.symbol, a.t, a.a, a.due, any_value(entry) AS entry, count(b.t) AS n, min(CASE WHEN b.low <= entry * (1 - 0.08) THEN b.t END) AS dn, min(CASE WHEN b.high >= entry * (1 + 0.08) THEN b.t END) AS up FROM a LEFT JOIN k b ON b.symbol = a.symbol AND b.t > a.t AND b.t <= a.t + 172800 AND b.known <= a.due GROUP BY 1, 2, 3, 4),"
    " v AS (SELECT *, CASE WHEN up IS NOT NULL AND up <= coalesce(dn, up) THEN 'CLOSED_STOP' WHEN dn IS NOT NULL THEN 'CLOSED_TARGET' WHEN n >= 0.95 * 12 THEN 'CLOSED_TIME' WHEN a = 3 THEN 'ABANDONED' END AS status FROM h),"
    " f AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY a) AS r FROM v WHERE status IS NOT NULL)"
    " SELECT symbol, t, due AS checked_t, CAST(a AS INTEGER) AS attempt, n AS bars, status FROM f, e WHERE r = 1 AND due <= clock"
)


@query(_T6S)
def t6_settled_by_timers(spark, d):
    b = walk(spark, d, STEP)
    s = b.withColumn("ret", W.returns(4)).where("ret <= 0").select("symbol", "ts", c("close").alias("entry"))
    t = F.unix_seconds("ts")
    known = t + STEP + F.when(F.floor(t / STEP) % 10 == 3, 129_600).otherwise(0)
    nothing = F.lit(None).cast("double")
    one = s.select("symbol", "ts", (t + STEP).alias("x"), "entry", nothing.alias("high"), nothing.alias("low"))
    two = b.select("symbol", "ts", known.alias("x"), nothing.alias("entry"), "high", "low")
    rows = _in_parts(spark, one.unionByName(two).withColumn("known_at", F.timestamp_seconds("x")), c("x"))
    out, log = shared_folder(spark, "settled"), shared_folder(spark, "log")
    rules = S.Rules(step=STEP, horizon=172_800, move=0.08)

    def settle(stream):
        T.append_to(spark, S.settled_stream(stream.where("entry IS NOT NULL"), stream.where("entry IS NULL"), rules, "0 seconds"), out, log, S.STATE_STORE)

    _delivered(spark, rows, ("symbol", "ts", "known_at", "entry", "high", "low"), settle, PARTS)
    done = spark.read.schema("symbol string, ts timestamp, checked_at timestamp, attempt int, bars long, status string").parquet(out)
    return done.select("symbol", F.unix_seconds("ts").alias("t"), F.unix_seconds("checked_at").alias("checked_t"), "attempt", "bars", "status")


_TWICE = BARS + ", b AS (SELECT symbol, t AS x, t, close FROM bars), p AS (SELECT *, " + _PART.format("b") + " AS part FROM b), d AS (SELECT symbol, t, close, part FROM p UNION ALL SELECT symbol, t, 2 * close, part + 1 FROM p)"


@query(_TWICE + ", g AS (SELECT *, (t // 86400) * 86400 AS slot, row_number() OVER (PARTITION BY symbol, t // 86400 ORDER BY part, t, close) AS r FROM d WHERE t % 86400 <= 28800) SELECT symbol, slot, t, round(close, 6) AS close FROM g WHERE r = 1")
def t3_once_per_slot(spark, d):
    first = _in_parts(spark, bars(spark, d).select("symbol", "ts", "close"), F.unix_seconds("ts"))
    again = first.withColumns({"close": c("close") * 2, "part": c("part") + 1})
    out, log = shared_folder(spark, "captures"), shared_folder(spark, "log")
    _delivered(spark, first.unionByName(again), ("symbol", "ts", "close"), lambda stream: C.deliver(stream, C.once_per_slot(out, 86_400, 28_800), log))
    return _out(C.captures(spark, out), "symbol", "slot", "ts", "close").withColumn("slot", F.unix_seconds("slot"))


_T7 = (
    BARS + ", b AS (SELECT symbol, t AS x, t, t + 14400 AS known, CASE WHEN (t // 14400 + length(symbol)) % 6 = 0 THEN NULL ELSE close END AS close FROM bars WHERE (t // 14400) % 13 <> 7), p AS (SELECT *, " + _PART.format("b") + " + CASE WHEN (t // 14400) % 5 = 0 AND ((t // 14400) % 10 = 0 OR length(symbol) % 2 = 0) THEN 1 ELSE 0 END AS part FROM b),"
    " k AS (SELECT a.part, max(q.known) AS clock FROM (SELECT DISTINCT part FROM p) a LEFT JOIN p q ON q.part < a.part GROUP BY 1), j AS (SELECT p.*, coalesce(t + 14400 + 7200 <= clock, false) AS late, coalesce(close <= 0, true) AS faulty FROM p JOIN k USING (part)),"
    " s AS (SELECT t AS slot, count(DISTINCT CASE WHEN NOT late AND NOT faulty THEN symbol END) AS usable, count(*) FILTER (NOT late) AS rows, count(*) FILTER (NOT late AND faulty) AS faulty, count(*) FILTER (late) AS late_rows FROM j GROUP BY 1),"
    " g AS (SELECT unnest(range((SELECT min(slot) FROM s), (SELECT max(slot) FROM s) + 1, 14400)) AS slot), n AS (SELECT count(DISTINCT symbol) AS n FROM b), w AS (SELECT slot, coalesce(usable, 0) AS usable, coalesce(rows, 0) AS rows, coalesce(faulty, 0) AS faulty, coalesce(late_rows, 0) AS late_rows, n FROM g LEFT JOIN s USING (slot), n)"
    " SELECT slot, usable, rows, faulty, late_rows, round(usable / n, 6) AS coverage, CASE WHEN rows = 0 AND late_rows = 0 THEN 'MISSED' WHEN rows = 0 THEN 'LATE_ONLY' WHEN faulty / rows > 0.2 THEN 'INVALID_ERRORS' WHEN usable / n < 0.7 THEN 'INVALID_COVERAGE' ELSE 'VALID' END AS status FROM w"
)


@query(_T7)
def t7_late_rows_by_slot(spark, d):
    t, size = F.unix_seconds("ts"), F.length("symbol")
    slot = F.floor(t / STEP)
    b = bars(spark, d).where(slot % 13 != 7).select("symbol", "ts", F.when((slot + size) % 6 != 0, c("close")).alias("close"), F.timestamp_seconds(t + STEP).alias("known_at"))
    held_back = (slot % 5 == 0) & ((slot % 10 == 0) | (size % 2 == 0))
    rows = _in_parts(spark, b, t).withColumn("part", c("part") + held_back.cast("long"))
    out, log = shared_folder(spark, "slots"), shared_folder(spark, "log")
    _delivered(spark, rows, ("symbol", "ts", "close", "known_at"), lambda stream: C.deliver(stream, C.split_late(out, STEP, 7_200), log))
    symbols = b.agg(F.count_distinct("symbol")).first()[0]
    report = C.slot_report(spark, out, STEP, max(1, symbols))
    return report.select(F.unix_seconds("slot").alias("slot"), "usable", "rows", "faulty", "late_rows", F.round("coverage", 6).alias("coverage"), "status")
