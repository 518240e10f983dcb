"""Distributed models over walk-forward folds: regularised logistic, boosted trees for several targets, and the weight of each feature.

The driver loops over the folds, a small parameter; each fit and each score is a Spark ML job over its rows. Without enough rows, or with one class only, a
fold is scored by its training share (0.5 without rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.storagelevel import StorageLevel
from pyspark.sql import functions as F

from tidewatch.operators.scans import with_dense_rank
from tidewatch.operators.stats import auc


def flags(column: str, values: list[str]) -> dict[str, Column]:
    """One column of 0 and 1 for each value; null gives 0."""
    return {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values}


def expanding_folds(rows: DataFrame, t: str, edges: list[int], embargo: int) -> DataFrame:
    """Fold k trains on all before edge k and tests from edge k + embargo up to the next edge."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("fold"), F.lit(a).alias("_a"), F.lit(b).alias("_b")) for k, (a, b) in enumerate(zip(edges, edges[1:])))))
    laid = rows.withColumn("_f", cells).select("*", "_f.*").drop("_f")
    role = F.when(F.col(t) < F.col("_a"), "train").when((F.col(t) >= F.col("_a") + embargo) & (F.col(t) < F.col("_b")), "test")
    return laid.withColumn("role", role).where(F.col("role").isNotNull()).drop("_a", "_b")


def rank_folds(rows: DataFrame, t: str, folds: int, *, first: float = 0.4, embargo: int = 0) -> DataFrame:
    """Expanding folds over the distinct times of t (whole seconds): the first `first` of them only train, the others are cut into `folds` equal tests. Fold k trains on all times before its test but the last `embargo` of them, so each later row is tested exactly once whatever the table's span. Rows without a time are left out."""
    ranked = with_dense_rank(rows, t, name="_rank").where(F.col("_rank").isNotNull())
    edge = lambda k: F.when(k == folds, F.col("_rank_of")).otherwise(F.floor(F.col("_rank_of") * (F.lit(first) + F.lit(1 - first) * k / folds)))
    laid = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    low, high = edge(F.col("fold")), edge(F.col("fold") + 1)
    role = F.when(F.col("_rank") < low - embargo, "train").when((F.col("_rank") >= low) & (F.col("_rank") < high), "test")
    return laid.withColumn("role", role).where(F.col("role").isNotNull()).drop("_rank", "_rank_of")


def _fit(train: DataFrame, features: list[str], label: str, kind: str, balanced: bool, least: int):
    n, share = train.agg(F.count(label), F.avg(F.col(label).cast("double"))).first()
    if n < least or share in (0.0, 1.0):
        return None, 0.5 if share is None else float(share)
    weight = F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)) if balanced else F.lit(1.0)
    # a feature without any value in the fold is left out; Imputer has no median for it
    seen = train.agg(*(F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in features)).first()
    used = [c for c in features if seen[c]]
    if not used:
        return None, float(share)
    filled = [f"__filled_{k}" for k in range(len(used))]
    prepared = [Imputer(strategy="median", inputCols=used, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw")]
    if kind == "logistic":
        prepared += [StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True), LogisticRegression(featuresCol="__scaled", labelCol="__label", weightCol="__weight", regParam=0.01, elasticNetParam=0.0, standardization=False)]
    else:
        prepared.append(GBTClassifier(featuresCol="__raw", labelCol="__label", weightCol="__weight", maxIter=10, maxDepth=3, stepSize=0.1, seed=42))
    model = Pipeline(stages=prepared).fit(train.where(F.col(label).isNotNull()).withColumns({"__label": F.col(label).cast("double"), "__weight": weight, **{c: F.col(c).cast("double") for c in used}}))
    return (model, used), float(share)


def walk_forward_scores(folds: DataFrame, n_folds: int, features: list[str], labels: list[str], *, kind: str = "logistic", balanced: bool = True, least: int = 20) -> tuple[DataFrame, list[tuple[int, str, str, float]]]:
    """Test rows with p_<label> for each label, and (fold, label, feature, weight) of the logistic models."""
    scored, weights = [], []
    for k in range(n_folds):
        # all fits of a fold read its training rows many times
        train = folds.where((F.col("fold") == k) & (F.col("role") == "train")).select(*features, *labels).persist(StorageLevel.MEMORY_AND_DISK)
        out = folds.where((F.col("fold") == k) & (F.col("role") == "test"))
        for label in labels:
            fitted, share = _fit(train, features, label, kind, balanced, least)
            if fitted is None:
                out = out.withColumn(f"p_{label}", F.lit(share))
                continue
            model, used = fitted
            kept = [c for c in out.columns]
            applied = model.transform(out.withColumns({c: F.col(c).cast("double") for c in used}))
            out = applied.select(*kept, vector_to_array("probability")[1].alias(f"p_{label}"))
            if kind == "logistic":
                weights += [(k, label, c, float(x)) for c, x in zip(used, model.stages[-1].coefficients)]
        train.unpersist()
        scored.append(out)
    return reduce(DataFrame.unionByName, scored), weights


def importance(df_weights: DataFrame) -> DataFrame:
    """Mean signed and mean absolute weight of each feature over the folds."""
    return df_weights.groupBy("label", "feature").agg(F.count("*").alias("folds"), F.avg("weight").alias("mean_weight"), F.avg(F.abs("weight")).alias("mean_abs_weight"))


def head_matrix(folds: DataFrame, keep: list[str], heads: dict[str, Column], sets: dict[str, list[str]]) -> DataFrame:
    """One row for each row of one fold (column role): its label of each head (y_<head>, null where the head has none) and one vector for each feature set (x_<set>).

    Missing values take the median of the training rows, or 0 where these have none; a feature <name>_missing of a set says where <name> was missing. Medians are one aggregation.
    """
    names = sorted({f for s in sets.values() for f in s})
    plain = [f for f in names if not (f.endswith("_missing") and f[:-8] in names)]
    value = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    train = folds.where("role = 'train'")
    found = train.agg(*(F.percentile_approx(value(f), 0.5, 1000).alias(f"m{k}") for k, f in enumerate(plain))).first()
    filled = {f"__{f}": F.coalesce(value(f), F.lit(0.0 if m is None else float(m))) for f, m in zip(plain, found)}
    flags_ = {f"__{f}": value(f[:-8]).isNull().cast("double") for f in names if f not in plain}
    out = folds.select("role", *keep, *(F.when(p, 1.0).otherwise(F.when(p.isNotNull(), 0.0)).alias(f"y_{h}") for h, p in heads.items()), *(e.alias(n) for n, e in (filled | flags_).items()))
    return Pipeline(stages=[VectorAssembler(inputCols=[f"__{f}" for f in s], outputCol=f"x_{name}") for name, s in sets.items()]).fit(out).transform(out).select("role", *keep, *(f"y_{h}" for h in heads), *(f"x_{s}" for s in sets))


def boosted_heads(folds: DataFrame, keep: list[str], heads: dict[str, Column], sets: dict[str, list[str]], *, trees: int = 10, depth: int = 3, least: int = 20) -> DataFrame:
    """Test rows of one fold scored by boosted trees for every head and feature set: the columns of `keep`, feature_set, head, y and p.

    All models are fitted from one assembled matrix, which stays in memory or on disk for their time. A head without enough training rows or with one class only is scored by its training share.
    """
    matrix = head_matrix(folds, keep, heads, sets).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = matrix.where("role = 'train'"), matrix.where("role = 'test'")
    counts = train.agg(*(e for h in heads for e in (F.count(f"y_{h}").alias(f"n_{h}"), F.avg(f"y_{h}").alias(f"s_{h}")))).first()
    cells = []
    for s in sets:
        for h in heads:
            n, share = counts[f"n_{h}"], counts[f"s_{h}"]
            name = f"p_{s}_{h}"
            if n < least or share in (0.0, 1.0):
                test = test.withColumn(name, F.lit(0.5 if share is None else float(share)))
            else:
                weighted = train.where(F.col(f"y_{h}").isNotNull()).withColumn("__weight", F.when(F.col(f"y_{h}") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
                model = GBTClassifier(featuresCol=f"x_{s}", labelCol=f"y_{h}", weightCol="__weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=42).fit(weighted)
                model = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__p")
                test = model.transform(test).withColumn(name, vector_to_array("__p")[1]).drop("__p")
            cells.append(F.struct(F.lit(s).alias("feature_set"), F.lit(h).alias("head"), F.col(f"y_{h}").alias("y"), F.col(name).alias("p")))
    return test.select(*keep, F.inline(F.array(*cells)))


def head_report(scored: DataFrame) -> DataFrame:
    """Rows, positives, mean probability and AUC of each head and feature set."""
    known = scored.where("y IS NOT NULL")
    counts = known.groupBy("feature_set", "head").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positive"), F.round(F.avg("p"), 6).alias("mean_p"))
    return counts.join(auc(known, ["feature_set", "head"], "p", F.col("y") == 1), ["feature_set", "head"])
