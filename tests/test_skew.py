"""Operators that hold no symbol, timestamp or key in one task, against plain forms: crowded timestamps, dense events, long runs, ties, row bootstraps and folds by rank."""

import random
import statistics
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import events as E
from tidewatch.operators import features as W
from tidewatch.operators import matching as J
from tidewatch.operators import models as M
from tidewatch.operators import scans, stats

T0 = 1_700_000_000


@pytest.mark.parametrize("parts, calipers", [(1, {"a": 0.5, "b": 15.0}), (4, {"a": 0.5}), (3, {"a": 0.0, "b": 15.0}), (1, {})])
def test_controls_at_a_crowded_time(spark, parts, calipers):
    r = random.Random(parts)
    rows = [(f"s{k}", T0 + 3600 * (k % 50 == 0), round(r.gauss(0, 1), 1), r.uniform(-60, 60)) for k in range(400)]
    rows += [("nan", T0, float("nan"), 0.0), ("inf", T0, float("inf"), 0.0), ("null", T0, None, 0.0), ("edge1", T0, 0.3, 1.0), ("edge2", T0, 0.8, 16.0), ("far", T0, -0.2, -14.0)]
    df = spark.createDataFrame(rows, "symbol string, t long, a double, b double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    cases, pool = df.where("symbol LIKE '%7' OR symbol LIKE 'edge%' OR symbol IN ('nan', 'inf', 'null')"), df.where("symbol NOT LIKE '%7'")
    distance = F.abs(F.col("c_b") - F.col("p_b"))
    got = {(x.c_symbol, x.p_symbol, x.control_rank) for x in J.matched_controls(cases, pool, calipers, distance, parts=parts).collect()}
    want, lists = set(), [[tuple(x) for x in d.select("symbol", "ts", "a", "b").collect()] for d in (cases, pool)]
    for symbol, ts, a, b in lists[0]:
        own = {"a": a, "b": b}
        fits = []
        for other, at, x, y in lists[1]:
            if other != symbol and at == ts and all(own[c] is not None and {"a": x, "b": y}[c] is not None and abs(own[c] - {"a": x, "b": y}[c]) <= width for c, width in calipers.items()):
                fits.append((abs(b - y), other))
        want |= {(symbol, other, k) for k, (_, other) in enumerate(sorted(fits)[:3], 1)}
    assert got == want and len(want) > 30


def test_as_of_over_spans(spark):
    r = random.Random(1)
    left = [(r.choice(("a", "b", None)), T0 + r.randint(0, 100_000), k) for k in range(600)]
    right = [(r.choice(("a", "b", None)), T0 + 500 * k + r.randint(0, 400), float(k)) for k in range(30, 160)]
    a = spark.createDataFrame(left, "symbol string, t long, id int").withColumn("ts", F.timestamp_seconds("t"))
    b = spark.createDataFrame(right, "symbol string, t long, v double").withColumn("at", F.timestamp_seconds("t")).drop("t")
    rows = lambda **o: sorted((x.id, -1.0 if x.v is None else x.v) for x in J.as_of(a, b, ["symbol"], "ts", "at", ["v"], **o).collect())
    plain = sorted((k, max(((t, v) for s, t, v in right if s == symbol and t <= at), default=(0, -1.0))[1]) for symbol, at, k in left)
    assert rows(span=500) == plain == rows()


def test_runs_over_spans(spark):
    r, rows, run, want = random.Random(2), [], 0, {}
    for k in range(1500):
        ok = r.random() < (0.99 if k < 900 else 0.6)
        run = run + 1 if ok else 0
        rows.append((T0 + 60 * k + 7 * (k // 300) * 3600, ok if k % 7 or ok else None))
        want[rows[-1][0]] = run
    df = spark.createDataFrame(rows, "t long, ok boolean").select(F.lit("s").alias("symbol"), F.timestamp_seconds("t").alias("ts"), "ok")
    for span in (600, 86_400 * 30):
        got = {x.t: x.run for x in W.with_runs(df, F.col("ok"), span=span).select(F.unix_seconds("ts").alias("t"), "run").collect()}
        assert got == want


def _kept(times, seconds):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] >= seconds:
            out.append(t)
    return out


def test_cooldown_equals_the_plain_fold(spark):
    r = random.Random(3)
    by_key = {("a", 1): [T0 + 60 * k for k in range(20_000)], ("a", 2): [T0 + r.randint(0, 4_000_000) for _ in range(3000)], ("b", 1): [T0, T0, T0 + 3_599, T0 + 3_600, T0 + 90_000_000], ("c", 9): [T0 + 5]}
    rows = [(*k, t) for k, times in by_key.items() for t in times]
    df = spark.createDataFrame(rows, "x string, y int, t long").withColumn("ts", F.timestamp_seconds("t")).repartition(5)
    for cooldowns in (1, 3, 16):
        got = {}
        for x in E.cooldown(df, ["x", "y"], 3_600, cooldowns=cooldowns).collect():
            got.setdefault((x.x, x.y), set()).add(x.t)
        assert got == {k: set(_kept(times, 3_600)) for k, times in by_key.items()}
    assert E.cooldown(df.where("false"), ["x"], 60).count() == 0


def test_a_million_dense_events(spark):
    df = spark.range(1_000_000).select(F.lit("s").alias("symbol"), F.timestamp_seconds(F.lit(T0) + 60 * F.col("id")).alias("ts"))
    began = time.time()
    out = E.cooldown(df, ["symbol"], 172_800).select(F.unix_seconds("ts").alias("t")).orderBy("t").collect()
    assert [x.t for x in out] == _kept(range(T0, T0 + 60_000_000, 60), 172_800)
    assert time.time() - began < 120


def test_auc_by_ranges(spark):
    r = random.Random(4)
    groups = {"ties": [(float(r.randint(0, 5)), r.random() < 0.3) for _ in range(2000)], "many": [(r.gauss(0, 1), r.random() < 0.5) for _ in range(1500)], None: [(1.0, True), (0.5, False), (None, False)], "one": [(1.0, True)]}
    rows = spark.createDataFrame([(g, x, y) for g, values in groups.items() for x, y in values], "g string, x double, y boolean")
    got = {x.g: x.auc for x in stats.auc(rows, ["g"], "x", F.col("y"), cuts=8).collect()}
    for g, values in groups.items():
        good, bad = [x for x, y in values if y], [-1e9 if x is None else x for x, y in values if not y]
        assert got[g] == (pytest.approx(sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))) if bad else None)
    whole = stats.auc(rows.where("g = 'ties'"), [], "x", F.col("y"), cuts=4).first().auc
    assert whole == pytest.approx(got["ties"])


@pytest.mark.parametrize("kind", ["lognormal", "mostly zero", "one outlier"])
def test_row_bootstrap_of_skewed_samples(spark, kind):
    r = random.Random(kind)
    draw = {"lognormal": lambda k: r.lognormvariate(0, 1.5), "mostly zero": lambda k: 10.0 * (r.random() < 0.03), "one outlier": lambda k: 200.0 if k == 0 else r.gauss(0, 1)}[kind]
    values = [draw(k) for k in range(1500)]
    rows = spark.createDataFrame([(k, kind, x) for k, x in enumerate([*values, None])], "id long, g string, x double").repartition(7)
    got = stats.poisson_bootstrap(rows, "id", "x", ["g"], reps=1000, most_keys=1).first()
    means = sorted(statistics.fmean(r.choices(values, k=len(values))) for _ in range(1000))
    low, high = means[25], means[974]
    assert got.n == 1500
    assert got.low == pytest.approx(low, abs=0.15 * (high - low)) and got.high == pytest.approx(high, abs=0.15 * (high - low))
    again = stats.poisson_bootstrap(rows.coalesce(1), "id", "x", reps=1000).first()
    assert (again.low, again.high) == pytest.approx((got.low, got.high))


def test_folds_by_rank(spark):
    r = random.Random(6)
    times = [T0 + 86_400 * r.randint(0, 40) + r.randint(0, 5) for _ in range(800)] + [None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "id long, t long")
    ranks = {t: k for k, t in enumerate(sorted({t for t in times if t is not None}))}
    got = {x.id: (x.rank, x.rank_of) for x in scans.with_dense_rank(df, "t").collect()}
    assert got == {k: (ranks.get(t), len(ranks) if t is not None else None) for k, t in enumerate(times)}
    for folds in (1, 3, 7):
        out = M.rank_folds(df, "t", folds, first=0.4, embargo=2).collect()
        tested = [x.id for x in out if x.role == "test"]
        assert sorted(tested) == [k for k, t in enumerate(times) if t is not None and ranks[t] >= int(len(ranks) * 0.4)]
        for f in range(folds):
            first = min(ranks[times[x.id]] for x in out if x.fold == f and x.role == "test")
            assert max(ranks[times[x.id]] for x in out if x.fold == f and x.role == "train") == first - 3
    assert M.rank_folds(df.where("false"), "t", 3).count() == 0
    w = Window.orderBy("t")
    assert df.where("t IS NOT NULL").select((F.dense_rank().over(w) - 1).alias("k")).distinct().count() == len(ranks)


def test_dense_rank_broadcasts_no_rows(spark):
    from tidewatch.operators.scans import with_dense_rank

    # a range knows its size, so that a plain join would send it through the driver
    ranked = with_dense_rank(spark.range(50_000).selectExpr("id AS t"), "t")
    assert ranked.where("rank = t AND rank_of = 50000").count() == 50_000
    assert "Broadcast" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_training_rows_are_read_once_for_all_fits_of_a_fold(spark):
    from pyspark.sql import functions as F
    from tidewatch.operators.models import walk_forward_scores

    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    feature = F.udf(counted, "double").asNondeterministic()
    rows = spark.range(0, 400, 1, 4).selectExpr("id", "0 AS fold", "if(id < 300, 'train', 'test') AS role", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 7 > 3 AS INT) AS y", "CAST(id % 5 = 0 AS INT) AS z")
    scored, _ = walk_forward_scores(rows.withColumn("x", feature("x")), 1, ["x"], ["y", "z"])
    assert read.value <= 2 * 400
    assert scored.select("p_y", "p_z").count() == 100 and not spark.sparkContext._jsc.getPersistentRDDs()
