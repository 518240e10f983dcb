import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import features, models, setups

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def frame(spark, rows):
    made = [("a", T0 + dt.timedelta(hours=k), *map(float, r)) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, "symbol string, ts timestamp, open double, high double, low double, close double")


def test_setups_do_not_see_the_future(spark):
    base = [(100 + k % 7, 104 + k % 5, 95 - k % 4, 97 + k % 6) for k in range(60)]
    outs = []
    for rows in (base, base[:40] + [(20, 25, 10, 15)] * 20):
        f = setups.with_supply_zone(setups.with_breakdown(features.with_atr(frame(spark, rows)), n=5), drop=0.1)
        outs.append([tuple(r) for r in f.orderBy("ts").limit(40).collect()])
    assert outs[0] == outs[1]
    assert any(r[-1] is not None for r in outs[0])


def test_setup_class_prefers_reversals_and_takes_nulls(spark):
    c, n = F.lit, F.lit(None)
    on, off = c(True), c(False)
    row = spark.range(1).select(
        setups.setup_class(on, on, on, on, on, on, c(30), c(20), c(0.5), c(1.0)).alias("a"), setups.setup_class(off, on, on, off, off, on, c(30), c(10), n.cast("double"), c(1.0)).alias("b"),
        setups.setup_class(*(n.cast("boolean") for _ in range(6)), c(0), c(0), n.cast("double"), n.cast("double")).alias("c"),
    ).first()
    assert tuple(row) == ("LIQUIDITY_REVERSAL", "TREND_CONTINUATION", "UNCLASSIFIED")


def test_path_classes(spark):
    def kind(*rows):
        b = frame(spark, [(100, 100, 100, 100), *rows])
        s = b.orderBy("ts").limit(1).select("symbol", "ts", F.lit(100.0).alias("entry"), F.lit(10.0).alias("atr"))
        return setups.path_class(s, b, 3600, 1, 3).first().path_class

    assert kind((100, 100, 92, 93), (93, 95, 90, 91), (91, 92, 88, 89)) == "PERSISTENT_SHORT"
    assert kind((100, 100, 92, 93), (93, 105, 93, 104), (104, 105, 94, 95)) == "SHORT_THEN_REVERSE"
    assert kind((100, 101, 99, 100), (100, 100, 95, 96), (96, 96, 85, 86)) == "DELAYED_SHORT"
    assert kind((100, 107, 99, 106), (106, 107, 99, 104), (104, 106, 101, 105)) == "WRONG_WAY_EARLY"


def test_reclaim_needs_bars_in_a_row(spark):
    b = frame(spark, [(100, 100, 100, 100), (100, 102, 100, 102), (100, 102, 99, 99), (100, 103, 100, 102), (100, 103, 100, 103)])
    s = b.orderBy("ts").limit(1).select("symbol", "ts", F.lit(101.0).alias("zone"))
    r = setups.reclaim_after(s, b, 86_400, "zone", 2).first()
    assert (r.reclaim_t, r.highest_above) == (int(T0.timestamp()) + 4 * 3600, 2.0)


def test_logistic_folds_learn_and_fall_back(spark):
    rows = [(k, float(k % 10), None if k % 9 == 0 else float(k % 3), int(k % 10 >= 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "t long, x double, z double, y int").withColumn("empty", F.lit(None).cast("double")).withColumn("one", F.lit(1))
    folds = models.expanding_folds(df, "t", [100, 200, 400], 10)
    assert folds.where("fold = 0 AND role = 'test'").agg(F.min("t"), F.max("t")).first() == (110, 199)
    scored, weights = models.walk_forward_scores(folds, 2, ["x", "z", "empty"], ["y", "one"])
    assert scored.count() == 90 + 190
    assert scored.where((F.col("p_y") > 0.5) != (F.col("y") == 1)).count() == 0
    assert scored.where("p_one != 1").count() == 0
    assert {w[2] for w in weights} == {"x", "z"}
    top = models.importance(spark.createDataFrame(weights, "fold int, label string, feature string, weight double")).orderBy(F.desc("mean_abs_weight")).first()
    assert top.feature == "x" and top.folds == 2
