import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import cohorts, sequences

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
HOUR = 3600


def frame(spark, rows):
    made = [("a", T0 + dt.timedelta(hours=k), *map(float, r)) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, "symbol string, ts timestamp, open double, high double, low double, close double")


def signal(bars, entry=100.0, stop=101.0):
    return bars.orderBy("ts").limit(1).select("symbol", "ts", F.lit(entry).alias("entry"), F.lit(stop).alias("stop"))


def laddered(spark, *later):
    b = frame(spark, [(100, 100, 100, 100), *later])
    r = sequences.ladder(signal(b), b, 86_400, cost_bps=0.0).first()
    return r.state, r.gross_r


def test_ladder_states(spark):
    flat = (99.5, 99.6, 99.2, 99.5)
    assert laddered(spark, (100, 101.2, 97.0, 100)) == ("SL_FIRST", -1.0)
    assert laddered(spark, (102, 102, 101.5, 102)) == ("SL_FIRST", -2.0)  # a gap fills at the open
    assert laddered(spark, (100, 100.5, 98.9, 99), (99, 100, 98.5, 99)) == ("TP1_THEN_BE", 0.5)
    assert laddered(spark, (100, 100.5, 97.9, 99)) == ("TP2_FULL", 1.5)
    assert laddered(spark, flat, flat) == ("TIME_EXIT", 0.5)
    assert laddered(spark, (99, 99.5, 98.9, 99), (99, 99.5, 98.5, 99)) == ("TP1_TIME_EXIT", 1.0)
    assert laddered(spark) == ("UNRESOLVED", None)


def test_first_after_loses_to_an_earlier_or_equal_bar(spark):
    b = frame(spark, [(100, 100, 100, 100), (100, 103, 100, 100), (100, 100, 95, 96)])
    low, high = F.col("bar_low") < 96, F.col("bar_high") > 102
    assert sequences.first_after(signal(b), b, 86_400, low, high).first().hit_t is None
    assert sequences.first_after(signal(b), b, 86_400, low).first().hit_t == int(T0.timestamp()) + 2 * HOUR
    assert sequences.first_after(signal(b), b, 86_400, high, high).first().hit_t is None


def test_limit_fill_marks_gaps(spark):
    b = frame(spark, [(100, 100, 100, 100), (100, 101, 99, 100), (104, 105, 103, 104)])
    s = signal(b).withColumn("limit_price", F.lit(102.0))
    r = sequences.limit_fill(s, b, HOUR, 4).first()
    assert (r.fill_state, r.wait_bars) == ("FILLED_GAP", 1)
    assert sequences.limit_fill(s, b, HOUR, 1).first().fill_state == "NO_FILL"


def test_slipped_entries_need_whole_paths(spark):
    rows = [(100, 100, 100, 100), (100, 101, 99, 100), (100, 101, 99, 98)]
    b = frame(spark, rows)
    out = {(r.delay, r.slip_bps): r for r in sequences.slipped_entries(signal(b), b, HOUR, 2, [1, 2], [0.0, 10.0], [(5.0, 5.0)], fee_bps=5.0).collect()}
    assert len(out) == 4 and out[1, 0.0].reason == "HORIZON_CLOSE"
    assert abs(out[1, 0.0].net_pct - (2 - 0.05 - 0.049)) < 1e-9
    assert out[1, 10.0].net_pct < out[1, 0.0].net_pct
    assert sequences.slipped_entries(signal(b), b, HOUR, 3, [1], [0.0], [(5.0, 5.0)]).count() == 0


def test_after_stop_and_reentry(spark):
    b = frame(spark, [(100, 100, 100, 100), (100, 102, 97, 101), (101, 101, 99.5, 99.8), (99.7, 99.9, 98.9, 99)])
    r = sequences.after_stop(signal(b), b, 86_400, 86_400).first()
    assert (r.post_stop_class, r.bars_after, r.extra_adverse_r) == ("FALSE_STOP_THEN_1R", 2, 0.0)
    again = sequences.reentry(signal(b), b, 86_400, 86_400).first()
    assert (again.reentry, again.reentry_stop) == (99.7, 100.7)
    calm = frame(spark, [(100, 100, 100, 100)] * 3)
    assert sequences.after_stop(signal(calm), calm, 86_400, 86_400).count() == 0


def test_plan_reason(spark):
    rows = [(100.0, 99.0, 1.0, "INVALID_PLAN"), (None, 99.0, 1.0, "INVALID_PLAN"), (100.0, 110.0, 9.0, "SKIP_STOP_PCT"), (100.0, 103.0, 1.0, "SKIP_RISK_TOO_WIDE"), (100.0, 100.5, 1.0, "SKIP_COST_R"), (100.0, 101.0, 1.0, None)]
    df = spark.createDataFrame(rows, "e double, s double, a double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", sequences.plan_reason(F.col("e"), F.col("s"), F.col("a"))).collect())


def test_walk_forward_never_trains_on_what_it_tests(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "t")
    folds = cohorts.walk_forward(df, "t", 0, 3, 40, 10, 5)
    spans = {(r.fold, r.role): (r.lo, r.hi) for r in folds.groupBy("fold", "role").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert spans[1, "train"] == (10, 49) and spans[1, "test"] == (55, 64)


def test_edge_states_without_training_rows(spark):
    df = spark.createDataFrame([(0, "test", "x", 1, 1.0)], "fold long, role string, e string, g int, r double")
    r = cohorts.edge_states(df, "e", "g", "r", min_engine=1, min_regime=1, min_pf=1.0).first()
    assert (r.engine_state, r.regime_state, r.expected_r) == ("SHADOW", "INSUFFICIENT", None)


def test_slot_health_counts_missed_and_late(spark):
    made = [("a", T0 + dt.timedelta(hours=h)) for h in (0, 0.2, 1.9, 3)]
    r = cohorts.slot_health(spark.createDataFrame(made, "symbol string, ts timestamp"), ["symbol"], HOUR, 1800, 0.5).first()
    assert (r.expected, r.present, r.missed, r.late, r.duplicates, r.healthy) == (4, 3, 1, 1, 1, True)


def test_three_stages(spark):
    def run(*later):
        b = frame(spark, [(100, 100, 100, 100), *later])
        r = sequences.three_stages(signal(b), b, 86_400).first()
        return r.stages, r.state, None if r.gross_r is None else round(r.gross_r, 9)

    assert run((100, 101.5, 95, 100)) == (0, "STOP", -1.0)  # the stop goes first in one bar
    assert run((100, 100, 98.9, 99), (99, 100.2, 98.5, 100)) == (1, "BREAK_EVEN", 0.4)
    assert run((100, 100, 97.9, 98), (98, 99.2, 97.5, 98)) == (2, "TRAILED", 1.3)
    assert run((100, 100, 95, 96)) == (3, "RUNNER", 2.2)
    assert run() == (None, "UNRESOLVED", None)


def test_fill_then_barrier_starts_after_the_fill(spark):
    b = frame(spark, [(100, 100, 100, 100), (100, 103, 90, 100), (100, 101, 100, 100), (100, 100, 95, 96)])
    s = signal(b, stop=104.0).withColumn("limit_price", F.lit(102.0))
    r = sequences.fill_then_barrier(s, b, 2 * HOUR, 86_400).first()
    assert (r.state, r.gross_r, r.target_t - r.fill_t) == ("TARGET", 2.0, 2 * HOUR)
    assert sequences.fill_then_barrier(s.withColumn("limit_price", F.lit(103.5)), b, 2 * HOUR, 86_400).first().state == "NO_FILL"


def test_plan_ladder_without_atr(spark):
    plan = sequences.plan_ladder(F.col("e"), F.col("a"), F.col("atr"), F.col("s"))
    rows = spark.createDataFrame([(100.0, 101.0, None, 90.0), (100.0, 101.0, 2.0, None)], "e double, a double, atr double, s double").withColumns(plan).orderBy("atr").collect()
    assert (rows[0].plan_stop, rows[0].risk_ok) == (None, False)
    assert (rows[1].plan_stop, rows[1].room_r, rows[1].tp1, rows[1].risk_ok) == (102.0, 5.0, 96.0, True)
