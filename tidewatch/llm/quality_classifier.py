"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear scorer that minimises the non-negative unbiased risk
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) with the logistic loss. The class prior pi is estimated from the labelled rows. Features are shares and
counts of the text alone; they never see an id, a language, a source or a label.

Training uses at most `max_positive` positives and `max_unlabelled` unlabelled rows, those with the lowest hash of their id, and of each id one row, the one with the
greatest feature row; scoring covers every row.

Defined cases: a null or empty text has zero counts and gets a score like any other; a null doc_id counts as the text '' for the fold; ids labelled
twice count once, as positive if any row says so; without positives or unlabelled rows the score is the prior (0.5 without labels) for all; repeated rows
are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, fold_of, id_and_bytes, map_batches, without


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([_class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58))), _class(b"#*$%&|<>"), _class(b"!"), _class(b".,;:?'\"()-"), _class(b"{}[]_=~^`\\/+@"), _class(b" \t\r\n\x0b\x0c"), _class(b"\n"), _class(bytes(range(128, 256)))], axis=1)
N_FEATURES = 2 * 8 + 10


def features(text: bytes | None) -> np.ndarray:
    """The feature row of one text."""
    text = text or b""
    upper, lower, digit, symbol, excl, punct, other, space, newline, foreign = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    n, letters = max(1, len(text)), max(1.0, upper + lower)
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = np.array([upper / letters, digit / n, symbol / n, excl / n, punct / n, other / n, foreign / n, 1 - len(set(lines)) / max(1, len(lines))])
    pairs = len(set(zip(words, words[1:]))) / max(1, k - 1) if len(words) > 1 else 1.0
    whole = [np.log1p(len(words)), np.log1p(len(lines)), (n - space) / k / 10, len(set(words)) / k, pairs, np.log1p(max(map(len, lines), default=0)), len(lines) / k, float(not words), float(len(words) < 20), newline / k]
    return np.concatenate([shares, np.log1p(100 * shares), whole])


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> dict:
    """Full-batch Adam on the non-negative risk; where the negative part falls below zero its gradient is reversed."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale[scale < 1e-9] = 1
    p, u = ((np.clip((x - mean) / scale, -8, 8)) for x in (positive, unlabelled))
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    weight = np.zeros(p.shape[1])
    m, v = np.zeros_like(weight), np.zeros_like(weight)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = p @ weight, u @ weight
        negative_part = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_negative = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        grad = -grad_negative if negative_part < 0 else grad_negative - prior * (p.T @ sigmoid(-zp)) / len(p)
        grad = grad + decay * weight
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weight = weight - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "scale": scale, "weight": weight}


def score(model: dict, rows: np.ndarray) -> np.ndarray:
    z = np.clip((rows - model["mean"]) / model["scale"], -8, 8) @ model["weight"][:-1] + model["weight"][-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _feature_rows(documents: DataFrame) -> DataFrame:
    def batch(b: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": b.column("doc_id"), "x": [features(t.as_py()) for t in b.column("text")]}

    return map_batches(documents, batch, "doc_id long, x array<double>")


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, max_positive: int = 10_000, max_unlabelled: int = 20_000) -> dict:
    """The model from the rows outside fold 0. Only the bounded sample of features comes to the driver."""
    docs = id_and_bytes(documents, id_col, text_col).where(fold_of(F.col("doc_id"), folds) != 0)
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold_of(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    prior = marked.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    if prior is None:
        return {"constant": 0.5}
    lowest = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    positive = lowest(marked.where("y > 0"), max_positive).withColumn("is_positive", F.lit(True))
    unlabelled = lowest(docs.where("doc_id IS NOT NULL"), max_unlabelled).withColumn("is_unlabelled", F.lit(True))
    chosen = F.broadcast(positive.join(unlabelled, "doc_id", "full").fillna(False))  # at most max_positive + max_unlabelled ids
    # one feature row for each id, the greatest of its rows, so that an id on many rows neither fills the driver nor drowns the others
    each = _feature_rows(docs.join(chosen.select("doc_id"), "doc_id", "left_semi")).groupBy("doc_id").agg(F.max("x").alias("x"))
    rows = each.join(chosen, "doc_id").orderBy("doc_id").toPandas()
    if not len(rows) or not rows.is_positive.any() or not rows.is_unlabelled.any():
        return {"constant": float(prior)}
    x = np.stack(rows.x.to_numpy())
    return train(x[rows.is_positive.to_numpy()], x[rows.is_unlabelled.to_numpy()], float(min(max(prior, 0.01), 0.99)))


def classify(documents: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema("doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if "constant" in shared.value:
                values = np.full(b.num_rows, shared.value["constant"])
            else:
                values = score(shared.value, np.array([features(t.as_py()) for t in b.column("text")]).reshape(-1, N_FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values)], schema=schema)

    scored = id_and_bytes(documents, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: dict, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that the model accepts. Rows that share an id go only if all of them are rejected; rows with a null id stay."""
    judged = classify(documents, model, id_col=id_col, **options)
    return without(documents, judged.groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0 AND doc_id IS NOT NULL").select("doc_id"), id_col)
