"""The regularised logistic walk-forward and the importance of its features against plain Newton steps in NumPy."""

import numpy as np
import pytest

from tidewatch.operators import models as M


def _plain(x, y, decay=0.01):
    """Weighted logistic loss, averaged, with a penalty on the weights of z-scored features; classes weigh the same."""
    mean, std = x.mean(0), x.std(0, ddof=1)
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    share = y.mean()
    w = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w = w / w.sum()
    penalty = decay * np.diag([*np.ones(x.shape[1]), 0.0])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = z.T @ (w * (p - y)) + penalty @ beta
        beta = beta - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, gradient)
    return beta, lambda new: 1 / (1 + np.exp(-(np.hstack([(new - mean) / std, np.ones((len(new), 1))]) @ beta)))


def test_scores_weights_and_importance(spark):
    r = np.random.default_rng(3)
    n = 600
    x = r.normal(size=(n, 3)) * [1, 20, 0.1] + [0, 5, 1]
    labels = {"up": (x[:, 0] + r.normal(size=n) > 0.5).astype(int), "rare": (x[:, 1] / 20 + r.normal(size=n) > 1.5).astype(int)}
    t = np.arange(n)
    rows = [(int(k), *map(float, x[k]), int(labels["up"][k]), int(labels["rare"][k])) for k in t]
    df = spark.createDataFrame(rows, "t long, a double, b double, c double, up int, rare int")
    edges, gap = [200, 400, 600], 10
    scored, weights = M.walk_forward_scores(M.expanding_folds(df, "t", edges, gap), 2, ["a", "b", "c"], ["up", "rare"])
    got = {(s.fold, s.t): (s.p_up, s.p_rare) for s in scored.collect()}
    assert set(got) == {(k, int(i)) for k, (low, high) in enumerate(zip(edges, edges[1:])) for i in range(low + gap, high)}
    own = {}
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        for at, label in enumerate(("up", "rare")):
            beta, score = _plain(x[:low], labels[label][:low])
            p = score(x[low + gap : high])
            assert [got[k, i][at] for i in range(low + gap, high)] == pytest.approx(p.tolist(), abs=2e-3)
            for f, b in zip("abc", beta):
                own.setdefault((label, f), []).append(b)
    assert {(label, f) for _, label, f, _ in weights} == set(own)
    table = M.importance(spark.createDataFrame(weights, "fold int, label string, feature string, weight double")).collect()
    for s in table:
        values = own[s.label, s.feature]
        assert (s.folds, s.mean_weight, s.mean_abs_weight) == (2, pytest.approx(np.mean(values), abs=5e-3), pytest.approx(np.mean(np.abs(values)), abs=5e-3))
