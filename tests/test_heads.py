"""Boosted heads against a plain booster in NumPy, the pressure votes' readiness and the policy of the fill bar."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import models as M
from tidewatch.operators import sequences as Q


def _plain_boost(x, y, test, trees=20, rate=0.3):
    """Stumps on the gradient of the logistic loss, cut at quantiles."""
    out, score = np.zeros(len(test)), np.zeros(len(x))
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-score))
        best = None
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19))):
                left = x[:, f] <= cut
                if 0 < left.sum() < len(x):
                    gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum()
                    if best is None or gain > best[0]:
                        best = (gain, f, cut, g[left].mean(), g[~left].mean())
        _, f, cut, a, b = best
        score += 4 * rate * np.where(x[:, f] <= cut, a, b)
        out += 4 * rate * np.where(test[:, f] <= cut, a, b)
    return out


def _auc(p, y):
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b))


def test_heads_match_a_plain_booster(spark):
    r = np.random.default_rng(1)
    n = 1500
    a, b, noise = r.normal(size=n), r.normal(size=n), r.normal(size=n)
    a[r.random(n) < 0.1] = np.nan
    r_ = np.where(np.isnan(a), 1.5, a) + 0.5 * r.normal(size=n)
    rows = [(k, "train" if k < 1000 else "test", float(a[k]), float(b[k]), float(noise[k]), float(r_[k]), float(b[k] + 0.3 * noise[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, role string, a double, b double, noise double, r double, q double")
    heads = {"from_a": F.col("r") > 0.3, "never": F.col("r") > 1e9, "half_known": F.when(F.col("id") % 2 == 0, F.col("q") > 0)}
    sets = {"a": ["a", "a_missing"], "all": ["a", "a_missing", "b", "noise"]}
    scored = M.boosted_heads(df, ["id"], heads, sets, trees=6)
    report = {(x.feature_set, x.head): x for x in M.head_report(scored).collect()}
    assert len(report) == 6 and report["a", "never"].auc is None and report["a", "half_known"].n == 250 and report["a", "never"].mean_p == 0
    filled = np.where(np.isnan(a), np.nanmedian(a[:1000]), a)
    whole = np.stack([filled, np.isnan(a).astype(float), b, noise], axis=1)
    for head, y, known in (("from_a", r_ > 0.3, np.ones(n, bool)), ("half_known", b + 0.3 * noise > 0, np.arange(n) % 2 == 0)):
        learn, held = known & (np.arange(n) < 1000), known & (np.arange(n) >= 1000)
        plain = _auc(_plain_boost(whole[learn], y[learn].astype(float), whole[held]), y[held].astype(int))
        assert report["all", head].auc == pytest.approx(plain, abs=0.03) and report["all", head].auc > 0.85
    assert abs(report["a", "half_known"].auc - 0.5) < 0.15 and report["a", "from_a"].auc > 0.85
    missing = scored.where("feature_set = 'a' AND head = 'from_a'").join(df.where("isnan(a)").select("id"), "id").agg(F.avg("p")).first()[0]
    assert missing > 0.6  # the flag tells what the median hides


def test_fill_bar_policies(spark):
    ts = lambda h: F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * F.col(h))
    signals = spark.createDataFrame([("s", 0, 100.0, 110.0, 105.0)], "symbol string, h long, entry double, stop double, limit_price double").withColumn("ts", ts("h")).drop("h")
    bars = spark.createDataFrame([("s", 1, 100.0, 111.0, 90.0, 100.0), ("s", 2, 100.0, 101.0, 94.0, 95.0)], "symbol string, h long, open double, high double, low double, close double").withColumn("ts", ts("h")).drop("h")
    state = lambda policy: Q.fill_then_barrier(signals, bars, 7200, 7200, fill_bar=policy).first().state
    assert [state(p) for p in ("none", "stop", "both")] == ["TARGET", "STOP", "STOP"]
    bars = bars.withColumn("high", F.least("high", F.lit(106.0)))
    assert [state(p) for p in ("none", "stop", "both")] == ["TARGET", "TARGET", "TARGET"]
    with pytest.raises(ValueError):
        state("some")
