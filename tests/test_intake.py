"""Hand-made cases of intake, labels, zones and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import events, intake, labels, matching, scores, zones
from tidewatch.sources import candles

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
H = 3600


def bars(spark, rows, step=H, symbol="a"):
    made = [(symbol, T0 + dt.timedelta(seconds=step * k), *map(float, r)) for k, r in rows]
    return spark.createDataFrame(made, "symbol string, ts timestamp, open double, high double, low double, close double")


FLAT = (100, 100.2, 99.8, 100)


def barrier(spark, rows, entry=100.0, stop=101.0, hold=8):
    b = bars(spark, rows)
    s = spark.createDataFrame([("a", T0, entry, stop)], "symbol string, ts timestamp, entry double, stop double")
    return labels.censored_barrier(s, b, H, hold).first()


def test_stop_and_target_in_one_bar_is_a_stop(spark):
    row = barrier(spark, [(0, (100, 101.3, 97.8, 100)), *((k, FLAT) for k in range(1, 8))])
    assert row.state == "SL_SAME_BAR" and row.net_r < -1


def test_a_missing_bar_censors_unless_the_exit_came_before(spark):
    gap = [(k, FLAT) for k in range(8) if k != 4]
    assert barrier(spark, gap).state == "CENSORED_GAP"
    assert barrier(spark, [(k, (100, 100, 97, 98) if k == 2 else r) for k, r in gap]).state == "TP2R_FIRST"
    assert barrier(spark, [(k, FLAT) for k in range(5)]).state == "CENSORED_INCOMPLETE_HORIZON"
    assert barrier(spark, [(k, FLAT) for k in range(8)]).state == "TIME_EXIT"


def test_plans_that_cannot_start(spark):
    assert barrier(spark, [(0, (101.5, 102, 101, 101))]).state == "GAP_BEYOND_STOP"
    assert barrier(spark, [(1, FLAT)]).state == "NO_NEXT_OPEN"
    assert barrier(spark, [(0, FLAT)], stop=99.0).state == "INVALID_PLAN"
    worse = barrier(spark, [(0, FLAT), (1, (103, 104, 103, 103))])
    assert worse.state == "SL_FIRST" and worse.gross_r == pytest.approx(-3.0) and worse.hold_bars == 2


def confirm(spark, closes, horizon=0):
    rows = [(0, (100, 110, 95, 99))] + [(k + 1, (c, c + 1, c - 1, c)) for k, c in enumerate(closes) if c is not None]
    e = spark.createDataFrame([("a", T0, 95.0, 105.0)], "symbol string, ts timestamp, low double, prev_high double")
    return tuple(events.confirmation(e, bars(spark, rows), H, 6, horizon).select("status", "lag").first())


def test_confirmations(spark):
    assert confirm(spark, [98, 94, 90]) == ("CONFIRMED", 2)
    assert confirm(spark, [98, 106, 90]) == ("RECLAIMED", 2)
    assert confirm(spark, [98] * 8) == ("NONE", None)
    assert confirm(spark, [98, None, 94, 90]) == ("DATA_GAP", 2)
    assert confirm(spark, [98, 97]) == ("NOT_MATURED", 3)
    assert confirm(spark, [94, 90], horizon=4) == ("NOT_MATURED", 1)


def test_payloads_keep_the_first_of_a_time(spark):
    text = '[["1704067200","1","2","0.5","1.5","9","9"],["1704067200000","7","8","6","7","1","1"],["1704070800","x","2","1","1","1","1"]]'
    landed = spark.createDataFrame([("a", text, 2), ("a", text.replace('"1.5"', '"1.75"'), 1)], "symbol string, payload string, ingest_seq int")
    assert [(r.open, r.close) for r in candles.parse_rows(landed).collect()] == [(1.0, 1.75)]


def test_checked_reads_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "symbol string, t long, E01 boolean")
    path = str(tmp_path / "f")
    candles.write_features(rows, path, ["t", "symbol", "E01"], ["E01"], kind="parquet")
    assert candles.read_checked(spark, path, "t long, symbol string, E01 int", ["symbol", "t"], ["E01"]).columns == ["t", "symbol", "E01"]
    twice = str(tmp_path / "g")
    rows.union(rows).select("symbol", "t", F.lit(3).alias("E01")).write.parquet(twice)
    with pytest.raises(ValueError, match="2 duplicate keys, 4 rows"):
        candles.read_checked(spark, twice, "symbol string, t long, E01 int", ["symbol", "t"], ["E01"])


def test_a_bar_in_the_holdout_fails(spark):
    b = bars(spark, [(k, FLAT) for k in range(6)])
    windows = spark.createDataFrame([("a", T0, T0 + dt.timedelta(hours=5))], "symbol string, start timestamp, end timestamp")
    t = int(T0.timestamp())
    assert matching.within_windows(b, windows, H, t + 6 * H).count() == 6
    with pytest.raises(Exception, match="holdout"):
        matching.within_windows(b, windows, H, t + 3 * H).collect()


def test_eligible_rows_and_first_look(spark):
    b, t = bars(spark, [(k, FLAT) for k in range(50)]), int(T0.timestamp())
    at = lambda **kw: [(int(r.ts.replace(tzinfo=dt.timezone.utc).timestamp()) - t) // H for r in intake.eligible_rows(b, t + 5 * H, t + 40 * H, 10 * H, **kw).orderBy("ts").collect()]
    assert at(warm_up=10, every=4) == [13, 17, 21, 25, 29] and at(warm_up=0, cadence_hours=12) == [12, 24]
    snaps = spark.createDataFrame([("x",), ("y",)], "batch_id string")
    outs = spark.createDataFrame([("x", 1, 0.5, 0.6)], "batch_id string, day long, edge double, short double")
    look = lambda s, now, **kw: intake.first_look(s, outs, now, 100, delay=10, coverage=kw.get("coverage", 0.5), least_rows=kw.get("least", 1), least_days=1, cost_pct=0.2).first()
    assert look(snaps, 105).status == "ACCUMULATING" and look(snaps, 105).mean_edge is None
    assert look(snaps, 200).status == "SUPPORTIVE" and look(snaps, 200, coverage=0.9).status == "OUTCOMES_INCOMPLETE" and look(snaps, 200, least=5).status == "SAMPLE_TOO_SMALL"
    assert look(snaps.where("false"), 200).status == "INCONCLUSIVE_NO_SNAPSHOTS"


def watch(spark, later):
    rows = [(0, FLAT)] + [(k + 1, r) for k, r in enumerate(later)]
    s = spark.createDataFrame([("a", T0, 100.0, 100.5, 2.0)], "symbol string, ts timestamp, lower double, upper double, atr double")
    return zones.break_watch(s, bars(spark, rows), H).first()


def test_a_broken_support_is_watched(spark):
    broke = (100, 100.1, 98, 98.5)
    assert watch(spark, [FLAT, FLAT, broke]).watch_state == "NO_BREAK"
    assert watch(spark, [broke]).watch_state == "CENSORED_NO_WATCH"
    back = watch(spark, [broke, (99, 101, 99, 100.8), (100.8, 101, 100.7, 100.9)])
    assert back.watch_state == "RECLAIMED" and back.watch_bars == 2
    ready = watch(spark, [broke, (99.5, 100.0, 98, 98.2)])
    assert (ready.watch_state, ready.ready_reason, ready.retest_attempts) == ("SHORT_READY", "FAILED_RECLAIM_TOUCH", 1)
    drift = watch(spark, [broke, *((98.5 - k / 5, 99.0 - k / 5, 98.2 - k / 5, 98.6 - k / 5) for k in range(6))])
    assert drift.ready_reason == "PERSISTENT_NO_RECLAIM_LOWER_HIGH" and drift.watch_bars == 6


def test_tables_of_points(spark):
    row = spark.range(1).select(scores.at_least(F.lit(7), (10, 3), (5, 2)).alias("a"), scores.at_most(F.lit(None).cast("double"), (1, 9)).alias("b"), scores.reasons({"X": F.lit(True), "Y": F.lit(None).cast("boolean")}).alias("c"), scores.gate_tier(F.lit(True), F.lit(True), F.lit(2.0), F.lit(18.0)).alias("d"), scores.vote_tier(F.lit(3), F.lit(True), F.lit(True)).alias("e")).first()
    assert tuple(row) == (2.0, 0.0, "X", "A+", "B")


def test_ledgers_and_pairs(spark):
    snaps = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "r")], "k string, payload string")
    outs = spark.createDataFrame([("a", "p"), ("b", "other")], "k string, text string").select("k", F.sha2("text", 256).alias("digest"))
    assert {r.k: r.link for r in intake.linked_ledger(snaps, outs, "k", "payload", "digest").collect()} == {"a": "LINKED", "b": "CHANGED", "c": "OPEN"}
    rows = spark.createDataFrame([(1, "A", 1.0), (1, "B", 3.0), (2, "A", 1.0), (2, "B", None)], "o long, policy string, r double")
    assert tuple(intake.policy_pair_summary(intake.policy_pairs(rows, ["o"], "policy", "A", "B", "r")).first()) == (1, 2.0, 100.0)
    twice = spark.createDataFrame([("a", 2.0), ("b", None)], "k string, x double").agg(F.max("x").alias("x"))
    expected = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "name string, expected double")
    assert {r.name: r.agrees for r in intake.replication_check(twice, expected).collect()} == {"x": True, "y": False}
