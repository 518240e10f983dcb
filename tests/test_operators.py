import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import bars, events, features, labels, matching, selection

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def frame(spark, rows):
    made = [("a", T0 + dt.timedelta(hours=k), *map(float, r), 1.0, 100.0) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, amount double")


def test_features_do_not_see_the_future(spark):
    base = [(100 + k % 7, 103 + k % 5, 97 - k % 3, 100 + k % 4) for k in range(60)]
    other = base[:40] + [(500, 600, 400, 450)] * 20
    outs = []
    for rows in (base, other):
        f = features.with_swings(features.with_atr(frame(spark, rows)).withColumns({"ema": features.ema(20), "ret": features.returns(4), "vol": features.volume_ratio(), "vwap": features.vwap()}))
        outs.append([tuple(r) for r in f.orderBy("ts").limit(40).collect()])
    assert outs[0] == outs[1]


def test_cooldown_is_greedy(spark):
    rows = frame(spark, [(1, 1, 1, 1)] * 10)
    kept = events.cooldown(rows, ["symbol"], 3 * 3600).orderBy("ts").collect()
    assert [int((r.ts.replace(tzinfo=dt.timezone.utc) - T0).total_seconds() // 3600) for r in kept] == [0, 3, 6, 9]


def test_stop_before_target_in_one_bar(spark):
    b = frame(spark, [(100, 100, 100, 100), (100, 101.3, 97.8, 100), (100, 100, 100, 100)])
    s = b.limit(1).select("symbol", "ts", F.lit(100.0).alias("entry"), F.lit(101.0).alias("stop"))
    row = labels.triple_barrier(s, b, 86_400).first()
    assert row.outcome == "STOP" and row.net_r < -1


def test_horizon_label_needs_contiguous_bars(spark):
    b = frame(spark, [(100, 101, 99, 100)] * 8)
    gap = b.where(F.hour("ts") != 5)
    got = {r.h: r.short_3 for r in labels.horizon_labels(gap, 3600, (3,)).select(F.hour("ts").alias("h"), "short_3").collect()}
    assert got[1] == 0.0 and got[2] is None and got[7] is None


def test_controls_are_other_symbols_at_the_same_time(spark):
    pool = spark.createDataFrame([("b", T0, 1.0), ("c", T0, 2.0), ("a", T0, 0.0), ("d", T0 + dt.timedelta(hours=1), 0.0)], "symbol string, ts timestamp, x double")
    got = matching.matched_controls(pool.where("symbol = 'a'"), pool, {"x": 1.5}, F.abs(F.col("c_x") - F.col("p_x"))).collect()
    assert [(r.p_symbol, r.control_rank) for r in got] == [("b", 1)]


def test_empty_tables(spark):
    none = frame(spark, [(1, 1, 1, 1)]).where("false")
    assert bars.on_grid(none, 3600).count() == 0
    assert events.families(none, "a").count() == 0
    assert selection.dedupe(none, ["symbol"], [F.col("ts")]).count() == 0


def test_stream_of_bars_equals_batch(spark, tmp_path):
    from tidewatch.streaming import live

    ticks = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=7 * k), float(k % 5 + 1)) for k in range(60)], "symbol string, ts timestamp, price double")
    ticks.write.parquet(str(tmp_path / "in"))
    q = live.closed_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), "1 hour", "0 seconds").writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = {tuple(r) for r in spark.table("closed").select("symbol", "ts", "open", "close", "volume").collect()}
    batch = {tuple(r) for r in bars.from_ticks(ticks, 3600).select("symbol", "ts", "open", "close", "volume").collect()}
    assert streamed and streamed <= batch
