"""Prices that round to 0: every quotient is that of doubles, as in the SQL, and no job stops."""

import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.columns import ln, quotient, rounded
from tidewatch.operators import events, features, setups, signals

DAY = 86_400


@pytest.fixture(scope="module")
def fallen(spark):
    """A price that halves down to 0.0001 and is 0 from bar 24 on, beside one that goes on."""
    rows = [(s, k * 14_400, p, p, p, p, 5.0, 5000 * p) for k in range(140) for s, p in (("a", 0.0 if k >= 24 else round(100 / 2**k, 4) or 0.0001), ("b", 50.0 + k % 7))]
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double, amount double").withColumn("ts", F.timestamp_seconds("t")).drop("t").cache()


def test_quotients_and_logarithms_of_zero(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (6.0, 4.0)], "a double, b double").select(quotient(F.col("a"), F.col("b")).alias("q"), ln(F.col("a")).alias("l")).collect()
    assert [str(x.q) for x in rows] == ["inf", "-inf", "nan", "None", "None", "1.5"]
    assert [str(x.l) for x in rows[:4]] == ["0.0", "nan", "-inf", "None"]


def test_structure_of_a_price_of_zero(fallen):
    rows = features.with_structure(features.with_atr(fallen)).where("symbol = 'a' AND close = 0 AND atr > 0").collect()
    assert rows and all(x.atr_pct == math.inf for x in rows)
    back = {x.ts.timestamp(): x.r for x in fallen.withColumn("r", features.returns(1)).where("symbol = 'a'").collect()}
    assert back[24 * 14_400] == -100 and math.isnan(back[25 * 14_400])


def test_zones_pressure_and_families_of_a_price_of_zero(fallen):
    ranged = features.with_atr(fallen)
    assert setups.with_supply_zone(ranged).count() == 280
    votes = setups.pressure(F.min("low").over(features.rows(-19, 0)), F.col("atr"), features.returns(4))
    assert ranged.withColumns(votes).agg(F.sum("pressure")).first()[0] is not None
    assert events.families(fallen, "b", min_turnover=0.0, day=24, warm_up=48).agg(*(F.count_if(k).alias(k) for k in events.FAMILIES)).first() is not None
    assert events.failed_breakouts(fallen).agg(F.max("volatility")).first() is not None and events.exhaustion(fallen, "b", 14_400).agg(F.max("prior18")).first() is not None


def test_signal_rows_of_a_price_of_zero(fallen):
    from tidewatch.operators.bars import resample

    rows = signals.signal_rows(fallen, resample(fallen, DAY), DAY, 14_400)
    assert rows.agg(F.max("ret4"), F.max("supply_distance")).first() is not None and rows.count() == 280


def test_prefilter_ages_count_bars_that_were_left_out(spark):
    from tidewatch.operators.scores import with_prefilter

    # 40 bars, a break, then 14 bars without range, which have no row, and a last bar
    closes = {n: 100.0 for n in range(1, 41)} | {41: 90.0, 57: 90.0}
    zero = ("ema20", "ret4", "ret12", "ret24", "turnover", "volume_ratio", "low_spread12")
    flags = ("macro_bear", "ema_bear", "lower_high", "lower_low")
    rows = spark.createDataFrame([("a", n, p) for n, p in closes.items()], "symbol string, bar_no int, close double").withColumns(
        {"ts": F.timestamp_seconds(F.col("bar_no") * 14_400), "high": F.col("close") + 1, "low": F.col("close") - 1, "atr": F.lit(1.0), "market_state": F.lit("NEUTRAL")} | {k: F.lit(0.0) for k in zero} | {k: F.lit(False) for k in flags}
    )
    last = {x.bar_no: (x.proxy_broken, x.proxy_bars_ago) for x in with_prefilter(rows).collect()}
    assert last[41] == (True, 0) and last[57] == (False, None)
    near = rows.withColumn("bar_no", F.when(F.col("bar_no") == 57, 56).otherwise(F.col("bar_no")))
    assert {x.bar_no: x.proxy_bars_ago for x in with_prefilter(near).collect()}[56] == 15


def test_rounding_of_halves_as_sql_over_doubles(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [42.25 / 5 * 1.00001, -42.25 / 5 * 1.00001, 0.5e-6, 1.0000005, 2.5, 1e305, math.inf, -math.inf, 123456789012.12346]
    got = [x.v for x in spark.createDataFrame([(v, k) for k, v in enumerate(values)], "x double, k int").select(rounded(F.col("x")).alias("v"), "k").orderBy("k").collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchall()[0][0] for v in values]
    assert got[0] == 8.450085
