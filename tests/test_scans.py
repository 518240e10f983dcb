"""Scans in chunks and levels against the plain form over whole symbols."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import features as W
from tidewatch.operators import matching as J
from tidewatch.operators import scans, stats


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = random.Random(1), []
    for symbol, n in (("a", 1600), ("b", 3)):
        price = 100.0
        for k in range(n):
            if r.random() < 0.05:
                continue
            open_, price = price, price * (1 + r.gauss(0, 0.01))
            rows.append((symbol, 3600 * (k + 400_000), open_, max(open_, price) * 1.002, min(open_, price) * 0.998, price, r.random(), 1.0))
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double, amount double").withColumn("ts", F.timestamp_seconds("t")).drop("t").cache()


def same(a, b, tolerance=1e-9):
    rows_a, rows_b = (sorted(map(tuple, x.select(sorted(x.columns)).collect()), key=str) for x in (a, b))
    assert len(rows_a) == len(rows_b)
    for x, y in zip(rows_a, rows_b):
        assert x == pytest.approx(y, rel=tolerance, abs=tolerance, nan_ok=True) if all(not isinstance(v, str) and v is not None for v in x) else all(p == q or p == pytest.approx(q, rel=tolerance, abs=tolerance) for p, q in zip(x, y))


def test_chunks_with_halos_equal_whole_symbols(bars):
    def features(b):
        return W.with_atr(W.with_swings(b)).withColumns({"ret": W.returns(4), "vwap": W.vwap(), "ahead": F.min("low").over(W.rows(1, 5))}).select("symbol", "ts", "atr", "swing_low", "ret", "vwap", "ahead", *(c for c in b.columns if c.startswith("_")))

    plain = features(bars)
    chunked = scans.in_chunks(bars, features, back=40, ahead=6, chunk=8)  # about 200 chunks
    same(plain, chunked)


def test_positions_and_means_over_the_whole_history(bars):
    w = Window.partitionBy("symbol").orderBy("ts")
    placed = scans.with_position(bars, span=86_400)
    same(placed.select("symbol", "ts", "position"), bars.select("symbol", "ts", (F.row_number().over(w) - 1).alias("position")))
    closes = {s: [r.close for r in bars.where(F.col("symbol") == s).orderBy("ts").collect()] for s in ("a", "b")}
    for made in (scans.with_ema(bars, (20, 100), span=2 * 86_400), scans.with_history(bars, (20, 100), {"close": "c"}, span=5 * 86_400)):
        for s, values in closes.items():
            got, e20, e100 = made.where(F.col("symbol") == s).orderBy("ts").select("ema20", "ema100").collect(), None, None
            for x, g in zip(values, got):
                e20, e100 = (x if e is None else x * a + e * (1 - a) for e, a in ((e20, 2 / 21), (e100, 2 / 101)))
                assert (g.ema20, g.ema100) == pytest.approx((e20, e100), rel=1e-10)


def test_means_of_one_minute_bars(spark):
    """Many bars in a span of time, a fast mean among slow ones, gaps longer than a span, and the last two values of a sparse column."""
    r, minute, rows = random.Random(4), 28_000_000, []
    for k in range(20_000):
        minute += 1 if r.random() < 0.999 else r.choice((60, 50_000))
        rows.append((minute, 100.0 if k < 5000 else 100 + 10 * r.random(), float(k) if r.random() < 0.01 else None))
    df = spark.createDataFrame(rows, "m long, close double, mark double").select(F.lit("s").alias("symbol"), F.timestamp_seconds(F.col("m") * 60).alias("ts"), "close", "mark").repartition(3)
    got = scans.with_history(df, (2, 20, 100, 1000), {"mark": "marks"}).orderBy("ts").collect()
    means, marks = {}, []
    for k, ((_, close, mark), g) in enumerate(zip(rows, got, strict=True)):
        means = {s: close if k == 0 else close * 2 / (s + 1) + means[s] * (1 - 2 / (s + 1)) for s in (2, 20, 100, 1000)}
        marks = [*marks, mark][-2:] if mark is not None else marks
        assert g.position == k and g.last_marks == marks
        assert [g[f"ema{s}"] for s in means] == pytest.approx(list(means.values()), rel=1e-9)
    with pytest.raises(ValueError):
        scans.with_history(df, (1, 20), {})


def test_running_totals_and_overlaps(spark, bars):
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    moved = bars.withColumn("r", F.col("close") - F.col("open"))
    plain = moved.withColumn("equity", F.sum("r").over(w)).withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(0.0))).withColumn("drawdown", F.col("peak") - F.col("equity")).select("symbol", "ts", "equity", "peak", "drawdown")
    same(plain, scans.running(moved, ["symbol"], ["ts"], "r", span_of=F.floor(F.unix_seconds("ts") / 50_000)).select("symbol", "ts", "equity", "peak", "drawdown"))
    r = random.Random(2)
    trades = [(k, t, t + r.randint(1, 400_000)) for k, t in enumerate(sorted(r.randint(0, 2_000_000) for _ in range(300)))]
    got = {x.k: x.open_trades for x in J.overlaps(spark.createDataFrame([("s", *t) for t in trades], "symbol string, k long, a long, b long"), "a", "b", ["symbol"]).collect()}
    assert got == {k: sum(j != k and p <= a and q > a for j, p, q in trades) for k, a, b in trades}


def test_percentiles_are_exact(spark):
    r = random.Random(3)
    groups = {"many": [r.gauss(0, 1) for _ in range(2000)], "ties": [float(r.choice((1, 1, 1, 2, 5))) for _ in range(500)], "one": [7.0], "two": [1.0, 2.0]}
    rows = spark.createDataFrame([(g, x) for g, values in groups.items() for x in [*values, None]], "g string, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    exact = {x.g: x.q for x in rows.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {x.g: x.q for x in scans.percentiles(rows, ["g"], "x", shares, cuts=8).collect()}
    assert got.keys() == exact.keys() and all(got[g] == pytest.approx(exact[g]) for g in got)
    whole = scans.percentiles(rows, [], "x", [0.5]).first().q[0]
    assert whole == pytest.approx(statistics.median(x for v in groups.values() for x in v))
    assert scans.percentiles(rows.where("false"), ["g"], "x", [0.5]).count() == 0


def test_tail_mean_of_ties(spark):
    rows = spark.createDataFrame([("k", float(x)) for x in [-3, -2, -2, -2, *range(36)]], "k string, x double")
    out = stats.tail_risk(rows, ["k"], "x", share=0.075).first()
    assert out.shortfall == pytest.approx((-3 - 2 - 2) / 3) and out.exceedances == 4


def test_intervals_and_streaks(spark):
    rows = spark.createDataFrame([(k, k // 10, float(k % 7) - 2) for k in range(400)], "id long, day long, r double").withColumn("s", F.lit("x"))
    low, high = stats.row_bootstrap(rows, "id", "r", reps=200, bags=100).first()
    mean = statistics.mean(float(k % 7) - 2 for k in range(400))
    assert low < mean < high and high - low < 1
    assert stats.cluster_bootstrap(rows.where("day < 3"), "day", "r").first() == (None, None)
    assert stats.loss_streaks(rows, ["s"], ["id"], "r", F.floor(F.col("id") / 3)).first().longest_loss_streak == 2


def test_the_mean_of_a_first_bar_is_its_price_to_the_last_bit(spark):
    closes = [round(3 + 1.37 * k, 2) for k in range(60)]
    df = spark.createDataFrame([(f"s{k}", d * 86_400, x + d) for k, x in enumerate(closes) for d in (40, 41, 75)], "symbol string, t long, close double").withColumn("ts", F.timestamp_seconds("t"))
    got = scans.with_history(df, (20, 50, 100), {}).collect()
    first = [g for g in got if g.position == 0]
    assert len(first) == 60 and all(g.close == g.ema20 == g.ema50 == g.ema100 for g in first)
    assert all(g.ema20 < g.close for g in got if g.position > 0)
