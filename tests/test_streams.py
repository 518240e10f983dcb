"""Stateful settlement and replay-safe captures: crashes, restarts, late and repeated deliveries."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.sources.candles import shared_folder
from tidewatch.streaming import capture as C
from tidewatch.streaming import live as T
from tidewatch.streaming import settle as S

HOUR = 3600
RULES = S.Rules(step=HOUR, horizon=4 * HOUR, move=0.1, again=2 * HOUR, attempts=3)
_ROW = "symbol string, ts timestamp, known_at timestamp, entry double, high double, low double"


def _rows(spark, rows):
    """(symbol, hour, hour known, entry or None, high, low)"""
    df = spark.createDataFrame(rows, "symbol string, h long, k double, entry double, high double, low double")
    return df.select("symbol", F.timestamp_seconds(F.col("h") * HOUR).alias("ts"), F.timestamp_seconds(F.col("k") * HOUR).alias("known_at"), "entry", "high", "low")


def _bar(symbol, h, high, low, known=None):
    return (symbol, h, float(h + 1 if known is None else known), None, high, low)


def _signal(symbol, h, entry):
    return (symbol, h, float(h + 1), entry, None, None)


FLAT = [_bar("flat", h, 101.0, 99.0) for h in range(100, 130)]
CASES = [
    _signal("flat", 105, 100.0), _signal("flat", 118, 100.0), _signal("target", 100, 100.0), *[_bar("target", h, 101.0, 99.0 - 4 * (h - 100)) for h in range(100, 110)], _signal("stop", 100, 100.0), _bar("stop", 102, 120.0, 80.0),
    # one bar is published late: the second look closes it; where one never comes, the third look gives up
    _signal("late", 100, 100.0), *[_bar("late", h, 101.0, 99.0, 105.5 if h == 103 else None) for h in range(101, 105)],
    _signal("gone", 100, 100.0), *[_bar("gone", h, 101.0, 99.0) for h in (101, 102, 104)],
]
EXPECTED = [("flat", 105, 110, 1, 4, "CLOSED_TIME"), ("flat", 118, 123, 1, 4, "CLOSED_TIME"), ("gone", 100, 109, 3, 3, "ABANDONED"), ("late", 100, 107, 2, 4, "CLOSED_TIME"), ("stop", 100, 105, 1, 1, "CLOSED_STOP"), ("target", 100, 105, 1, 4, "CLOSED_TARGET")]


def test_settlement_survives_crashes_and_restarts(spark, monkeypatch):
    rows = _rows(spark, FLAT + CASES).withColumn("k", F.unix_seconds("known_at") / HOUR)
    source, out, log, flag = (shared_folder(spark, n) for n in ("in", "out", "log", "flag"))

    whole = S.Settler

    class Breaks(S.Settler):
        """Fails at its expired timers while the flag file exists."""

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if os.path.exists(flag):
                raise RuntimeError("lost on purpose")
            yield from whole.handleExpiredTimer(self, key, timerValues, expiredTimerInfo)

    def run():
        stream = spark.readStream.schema(_ROW).parquet(source)
        T.append_to(spark, S.settled_stream(stream.where("entry IS NOT NULL"), stream.where("entry IS NULL"), RULES, "0 seconds"), out, log, S.STATE_STORE)

    rows.where("k <= 103").drop("k").write.parquet(source)
    run()
    # the second part meets a processor that fails, then the healthy one goes on from the checkpoint
    rows.where("k > 103 AND k <= 107").drop("k").write.mode("append").parquet(source)
    open(flag, "w").close()
    monkeypatch.setattr(S, "Settler", Breaks)
    with pytest.raises(Exception, match="lost on purpose"):
        run()
    monkeypatch.undo()
    run()
    rows.where("k > 107").drop("k").write.mode("append").parquet(source)
    run()
    run()  # nothing new, nothing closes twice
    got = spark.read.parquet(out).select("symbol", (F.unix_seconds("ts") / HOUR).cast("int"), (F.unix_seconds("checked_at") / HOUR).cast("int"), "attempt", "bars", "status")
    assert sorted(map(tuple, got.collect())) == EXPECTED


def _deliveries(spark, rows):
    """(symbol, minute, close, minute known)"""
    df = spark.createDataFrame(rows, "symbol string, m long, close double, k long")
    return df.select("symbol", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "close", F.timestamp_seconds(F.col("k") * 60).alias("known_at"))


def test_captures_are_written_once(spark):
    path = shared_folder(spark, "captures")
    sink = C.once_per_slot(path, HOUR, 600)
    first = _deliveries(spark, [("a", 3, 1.0, 4), ("a", 5, 2.0, 6), ("b", 20, 3.0, 21), ("a", 61, 4.0, 62)])
    second = _deliveries(spark, [("a", 2, 9.0, 65), ("b", 62, 5.0, 65), ("c", 0, 6.0, 65)])
    sink(first, 0)
    sink(second, 1)
    expected = [("a", 3, 1.0), ("a", 61, 4.0), ("b", 62, 5.0), ("c", 0, 6.0)]  # b's first row is off cadence, a's second delivery late
    held = lambda: sorted((r.symbol, int(r.ts.timestamp()) // 60, r.close) for r in C.captures(spark, path).withColumn("ts", F.col("ts")).collect())
    assert held() == expected
    for batch, number in ((first, 0), (second, 1), (second, 1)):  # delivered again, in any number
        sink(batch, number)
        assert held() == expected


def test_a_crash_between_write_and_commit(spark):
    path, source, log = (shared_folder(spark, n) for n in ("captures", "in", "log"))
    _deliveries(spark, [("a", 3, 1.0, 4), ("b", 4, 2.0, 5)]).drop("known_at").write.parquet(source)
    own = C.once_per_slot(path, HOUR, 600)
    failing = {"on": True}

    def sink(batch, number):
        own(batch, number)
        if failing["on"]:
            raise RuntimeError("lost after the write")

    stream = lambda: spark.readStream.schema("symbol string, ts timestamp, close double").parquet(source)
    with pytest.raises(Exception, match="lost after the write"):
        C.deliver(stream(), sink, log)
    failing["on"] = False
    _deliveries(spark, [("a", 3, 7.0, 9), ("c", 4, 3.0, 9)]).drop("known_at").write.mode("append").parquet(source)
    C.deliver(stream(), sink, log)
    C.deliver(stream(), sink, log)
    assert sorted((r.symbol, r.close) for r in C.captures(spark, path).collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_late_rows_are_kept_apart_and_counted(spark):
    path = shared_folder(spark, "slots")
    sink = C.split_late(path, HOUR, 600)
    nan = float("nan")
    batches = [
        _deliveries(spark, [("a", 0, 1.0, 10), ("b", 1, 1.0, 10), ("a", 60, 1.0, 64)]),
        _deliveries(spark, [("b", 60, nan, 125), ("a", 2, 5.0, 126), ("a", 120, 1.0, 131)]),  # slot 0 closed at minute 60, judged by the clock of minute 64: within the grace
        _deliveries(spark, [("b", 3, 5.0, 140), ("a", 65, 5.0, 141), ("a", 300, 0.0, 305)]),  # slot 0 is late now, slot 1 closed at 120 and is late by 11 minutes
        _deliveries(spark, [("a", 240, 1.0, 310), ("b", 240, 1.0, 310), ("a", 185, 1.0, 311)]),  # slot 3 (180-240) is late at clock 305
    ]
    for number, batch in enumerate(batches):
        sink(batch, number)
    report = lambda: [tuple(r)[1:] for r in C.slot_report(spark, path, HOUR, 2).orderBy("slot").select("slot", "usable", "rows", "faulty", "late_rows", "status").collect()]
    expected = [(2, 3, 0, 1, "VALID"), (1, 2, 1, 1, "INVALID_ERRORS"), (1, 1, 0, 0, "INVALID_COVERAGE"), (0, 0, 0, 1, "LATE_ONLY"), (2, 2, 0, 0, "VALID"), (0, 1, 1, 0, "INVALID_ERRORS")]
    assert report() == expected
    sink(batches[1], 1)  # replayed: judged by the clock before it
    assert report() == expected
    newest = C.newest_valid(C.slot_report(spark, path, HOUR, 2)).first()
    assert (int(newest.newest_valid.timestamp()) // 60, newest.valid, newest.invalid_errors, newest.late_only, newest.missed) == (240, 2, 2, 1, 0)
    assert C.slot_report(spark, shared_folder(spark, "nothing"), HOUR, 2).count() == 0
