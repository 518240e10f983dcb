"""Performance statistics over outcome rows: metrics, bins, distributions, tails, clusters, bootstraps, sweeps, funnels, gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.functions.columns import finite, trade_metrics, wilson
from tidewatch.operators.scans import percentiles, ranged, running


def metrics(trades: DataFrame, keys: list[str], r: str = "r") -> DataFrame:
    """Trade metrics for each key."""
    named = trade_metrics(F.col(r))
    return trades.groupBy(*keys).agg(*(c.alias(k) for k, c in named.items()))


def breakdowns(trades: DataFrame, dimensions: list[str], r: str = "r") -> DataFrame:
    """Metrics by each dimension alone and overall, in one pass of grouping sets: dimension, value and the metrics."""
    named = trade_metrics(F.col(r))
    sets = [[F.col(d)] for d in dimensions] + [[]]
    out = trades.groupingSets(sets, *(F.col(d) for d in dimensions)).agg(*(c.alias(k) for k, c in named.items()), *(F.grouping(d).alias(f"_g_{d}") for d in dimensions))
    name, value = F.lit("ALL"), F.lit("")
    for d in dimensions:
        name, value = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name), F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), *named)


def distribution(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Count, mean, extremes and exact linear-interpolated percentiles."""
    out = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))
    named = percentiles(rows, keys, x, [0.1, 0.25, 0.5, 0.75, 0.9])
    return out.join(named, keys, "left").select(*keys, "n", "mean", "least", "most", *(F.col("q")[i].alias(k) for i, k in enumerate(("p10", "p25", "p50", "p75", "p90"))))


def quartile_buckets(rows: DataFrame, x: str, r: str = "r") -> DataFrame:
    """Metrics for each quartile of x; the cuts are three numbers and are joined back as a one-row table."""
    cuts = percentiles(rows, [], x, [0.25, 0.5, 0.75])
    bucket = F.when(F.col(x) <= F.col("q")[0], "Q1").when(F.col(x) <= F.col("q")[1], "Q2").when(F.col(x) <= F.col("q")[2], "Q3").otherwise("Q4")
    return metrics(rows.where(F.col(x).isNotNull()).join(F.broadcast(cuts)).withColumn("bucket", bucket), ["bucket"], r)


def robust_means(rows: DataFrame, keys: list[str], x: str, share: float = 0.1) -> DataFrame:
    """Mean, mean without the outer shares, and mean with them set to the share's percentiles."""
    cuts = percentiles(rows, keys, x, [share, 1 - share]).select(*keys, F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    inside = F.col(x).between(F.col("_lo"), F.col("_hi"))
    return rows.join(cuts, keys).groupBy(*keys).agg(F.avg(x).alias("mean"), F.avg(F.when(inside, F.col(x))).alias("trimmed"), F.avg(F.least(F.greatest(F.col(x), F.col("_lo")), F.col("_hi"))).alias("winsorised"))


def tail_risk(rows: DataFrame, keys: list[str], x: str, share: float = 0.05) -> DataFrame:
    """Percentiles of the tails and the mean of the worst share of rows: those below the last of its ranks, and as many equal to it as are left."""
    last = F.ceil(F.col("_total") * share)
    cuts = percentiles(rows, keys, x, [0.01, 0.05, 0.95, last - 1])
    below = F.col(x) < F.col("q")[3]
    out = rows.where(F.col(x).isNotNull()).join(cuts, keys).groupBy(*keys).agg(F.first("q").alias("q"), F.count("*").alias("_total"), F.coalesce(F.sum(F.when(below, F.col(x))), F.lit(0.0)).alias("_worse"), F.count_if(below).alias("_n"), F.count_if(F.col(x) < -0.9).alias("exceedances"))
    shortfall = (F.col("_worse") + (last - F.col("_n")) * F.col("q")[3]) / last
    return out.select(*keys, *(F.col("q")[i].alias(k) for i, k in enumerate(("p01", "p05", "p95"))), shortfall.alias("shortfall"), "exceedances")


def by_cluster(rows: DataFrame, cluster: str, x: str) -> DataFrame:
    """Equal-weight mean over clusters, share of positive ones, and the extremes of the mean when one cluster is left out."""
    sums = rows.groupBy(cluster).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    total = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    left_out = (F.col("ts") - F.col("s")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0))
    return sums.join(F.broadcast(total)).agg(F.count("*").alias("clusters"), F.avg(F.col("s") / F.col("n")).alias("equal_mean"), F.count_if(F.col("s") > 0).alias("positive"), F.min(left_out).alias("least_without_one"), F.max(left_out).alias("most_without_one"))


def _drawn(sums: DataFrame, n: int, reps: int, salt: str) -> DataFrame:
    """95 % interval of sum(s) / sum(n) over n numbered groups (k, s, n) drawn with replacement. A draw is a hash of (salt, rep, draw), so results repeat; only the sums of the groups are drawn from."""
    spark = sums.sparkSession
    text = F.concat_ws("|", F.lit(salt), F.floor(F.col("id") / n).cast("string"), (F.col("id") % n).cast("string"))
    draws = spark.range(reps * n).select(F.floor(F.col("id") / n).alias("rep"), (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n).alias("k"))
    means = draws.join(sums, "k").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("mean"))
    ordered = means.agg(F.sort_array(F.collect_list("mean")).alias("m"))  # `reps` numbers
    return ordered.select(F.try_element_at("m", F.lit(int(0.025 * (reps - 1)) + 1)).alias("low"), F.try_element_at("m", F.lit(int(0.975 * (reps - 1)) + 1)).alias("high"))


def cluster_bootstrap(rows: DataFrame, cluster: str, x: str, reps: int = 500, least: int = 5) -> DataFrame:
    """95 % interval of the mean by drawing clusters (days) with replacement; nulls with fewer than `least` clusters."""
    sums = rows.groupBy(cluster).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    numbered = sums.withColumn("k", (F.row_number().over(Window.orderBy(cluster)) - 1).cast("long"))  # one row for each cluster
    n = numbered.count()
    if n < least:
        return rows.sparkSession.sql("SELECT CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high")
    return _drawn(numbered, n, reps, "cluster")


def row_bootstrap(rows: DataFrame, identity: str, x: str, reps: int = 500, bags: int = 1000) -> DataFrame:
    """95 % interval of the mean of single rows. Rows are dealt into `bags` by the hash of their identity, and bags are drawn: independent rows in random bags vary as single ones do, while the work stays at reps * bags whatever the table's size."""
    bag = F.conv(F.substring(F.md5(F.col(identity).cast("string")), 1, 8), 16, 10).cast("long") % bags
    sums = rows.where(F.col(x).isNotNull()).groupBy(bag.alias("k")).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    return _drawn(sums, bags, reps, "row")


#: A row is drawn k times with the odds of a Poisson number of mean one: the least 32-bit draws that give 1, 2, ... times.
_POISSON = np.ceil(2.0**32 * np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])).astype(np.uint64)


def _drawn_times(ids: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """How often each row is drawn in each repetition, from a 32-bit mixing of its number and the repetition's: rows down, repetitions across."""
    low, factor, shift = np.uint64(0xFFFFFFFF), np.uint64(73_244_475), np.uint64(16)
    u = (ids[:, None] * np.uint64(2_654_435_761) + reps * np.uint64(40_503_001) + np.uint64(12_345)) & low
    for _ in range(2):
        u = ((u ^ (u >> shift)) * factor) & low
    return np.searchsorted(_POISSON, u ^ (u >> shift), side="right")


def poisson_bootstrap(rows: DataFrame, identity: str, x: str, keys: list[str] | None = None, *, reps: int = 500, share: float = 0.95, most_keys: int = 256) -> DataFrame:
    """Interval of the mean of single rows by a bootstrap of rows: low, high and n by key.

    In each repetition a row counts as often as a Poisson number of mean one says, drawn from its `identity` (a whole number) and the repetition, which is what drawing n of n rows with
    replacement comes to. So all repetitions are made in one pass: a task adds up each repetition's weights and weighted values, `reps` numbers for each of at most `most_keys` keys at a
    time, and these sums are added. Results don't depend on partitions, but for rounding. Rows without a value or an identity don't count.
    """
    keys = keys or []
    own = rows.where(F.col(x).isNotNull() & F.col(identity).isNotNull()).select(F.pmod(F.col(identity).cast("long"), F.lit(1 << 32)).alias("_id"), F.col(x).cast("double").alias("_x"), *keys)
    kinds = "".join(f", `{k}` {own.schema[k].dataType.simpleString()}" for k in keys)
    ddl = f"_rep int, _w double, _wx double, _n long{kinds}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    piece = max(1, 500_000 // reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, sums = np.arange(reps, dtype=np.uint64), {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, (w, wx, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps), pa.int32()), pa.array(w), pa.array(wx), pa.array(np.full(reps, n), pa.int64()), *(pa.array([v] * reps, type=schema.field(k).type) for k, v in zip(keys, key))], schema=schema)

        for b in batches:
            ids, values = b.column("_id").to_numpy().astype(np.uint64), b.column("_x").to_numpy()
            groups: dict = {}
            for at, key in enumerate(zip(*(b.column(k).to_pylist() for k in keys))) if keys else ():
                groups.setdefault(key, []).append(at)
            for key, at in groups.items() if keys else [((), np.arange(len(ids)))]:
                if key not in sums:
                    if len(sums) == most_keys:
                        yield from out()
                        sums.clear()
                    sums[key] = (np.zeros(reps), np.zeros(reps), 0)
                w, wx, n = sums[key]
                for k in range(0, len(at), piece):
                    times = _drawn_times(ids[at[k : k + piece]], each)
                    w += times.sum(0)
                    wx += values[at[k : k + piece]] @ times
                sums[key] = (w, wx, n + len(at))
        yield from out()

    means = own.mapInArrow(run, ddl).groupBy(*keys, "_rep").agg((F.sum("_wx") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_mean"), F.sum("_n").alias("_n"))
    tail = (1 - share) / 2
    return means.groupBy(*keys).agg(F.percentile("_mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"), F.max("_n").alias("n")).select(*keys, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "n")


def wilson_by(rows: DataFrame, keys: list[str], won: Column) -> DataFrame:
    low, high = wilson(F.col("wins"), F.col("n"))
    return rows.groupBy(*keys).agg(F.count_if(won).alias("wins"), F.count("*").alias("n")).withColumns({"low": low, "high": high})


def auc(rows: DataFrame, keys: list[str], score: str, label: Column, *, cuts: int = 64) -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores, so ties share a rank. Scores of a key are cut into ranges by a sketch; ranges are counted first and each is summed on its own, so no task holds a key."""
    at = rows.groupBy(*keys, score).agg(F.count_if(label).alias("pos"), F.count_if(~label).alias("neg"))
    cut = ranged(at, keys, score, cuts)
    sums = cut.groupBy(*keys, "_range").agg(F.sum("neg").alias("_m"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_m").over(Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("a._range") == F.col("b._range")
    for key in keys:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    laid = cut.alias("a").join(before.alias("b"), same).select("a.*", "b._before")
    own = Window.partitionBy(*keys, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("neg").over(own), F.lit(0))
    return laid.withColumn("_won", F.col("pos") * (below + F.col("neg") / 2)).groupBy(*keys).agg((F.sum("_won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def block_stability(rows: DataFrame, block: str, r: str = "r") -> DataFrame:
    """Metrics by block, then how many are positive, and the worst and best expectancy."""
    return metrics(rows, [block], r).agg(F.count("*").alias("blocks"), F.count_if(F.col("expectancy") > 0).alias("positive"), F.count_if(F.col("profit_factor") > 1).alias("profitable"), F.min("expectancy").alias("worst"), F.max("expectancy").alias("best"))


def threshold_sweep(rows: DataFrame, score: str, thresholds: list[float], r: str = "r") -> DataFrame:
    """Metrics of the rows at or above each threshold; each row is repeated only for thresholds that it passes."""
    passed = F.explode(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: t <= F.col(score)))
    return metrics(rows.withColumn("threshold", passed), ["threshold"], r)


def named_cohorts(rows: DataFrame, predicates: dict[str, Column], r: str = "r") -> DataFrame:
    """Metrics for the rows that fulfil each named predicate and for those that don't."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(p, F.lit(False)).alias("holds")) for k, p in predicates.items())))
    return metrics(rows.withColumn("_p", pairs).select("*", "_p.*"), ["name", "holds"], r)


def funnel(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Rows that pass each predicate alone and all up to it."""
    through, out = F.lit(True), []
    for k, p in predicates.items():
        through = through & F.coalesce(p, F.lit(False))
        out += [F.count_if(F.coalesce(p, F.lit(False))).alias(f"alone_{k}"), F.count_if(through).alias(f"through_{k}")]
    return rows.agg(F.count("*").alias("rows"), *out)


def co_occurrence(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How often each pair of flags holds together; a flag with itself gives its own count."""
    held = F.filter(F.array(*(F.when(p, F.lit(k)) for k, p in flags.items())), lambda x: x.isNotNull())
    a = rows.withColumn("_held", held).withColumn("a", F.explode("_held"))
    return a.withColumn("b", F.explode("_held")).where("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"))


def contrast(rows: DataFrame, features: list[str], good: Column) -> DataFrame:
    """Medians of each feature among good and other rows, and their difference."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("_f"), good.alias("_good")).select("_f.*", "_good")
    keyed = long.select("feature", "x", F.when(F.col("_good"), "good").when(~F.col("_good"), "other").alias("_side")).where("_side IS NOT NULL")
    medians = percentiles(keyed, ["feature", "_side"], "x", [0.5])
    out = medians.groupBy("feature").agg(*(F.max(F.when(F.col("_side") == k, F.col("q")[0])).alias(k) for k in ("good", "other")))
    return long.select("feature").distinct().join(out, "feature", "left").withColumn("delta", F.col("good") - F.col("other"))


def horizon_summary(pairs: DataFrame, day: Column) -> DataFrame:
    """Mean case, control and edge, share of positive edges and of days with a positive mean edge."""
    by_day = pairs.withColumn("day", day).groupBy("day").agg(F.sum("case_outcome").alias("c"), F.sum("control_mean").alias("k"), F.sum("edge").alias("e"), F.count_if(F.col("edge") > 0).alias("p"), F.count("edge").alias("n"))
    return by_day.agg(F.sum("n").alias("pairs"), F.count("*").alias("days"), (F.sum("c") / F.sum("n")).alias("mean_case"), (F.sum("k") / F.sum("n")).alias("mean_control"), (F.sum("e") / F.sum("n")).alias("mean_edge"), (F.sum("p") / F.sum("n")).alias("positive_share"), F.avg((F.col("e") > 0).cast("double")).alias("positive_days"))


def gates(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named boolean checks of a metrics row and whether all hold."""
    every = F.lit(True)
    for p in checks.values():
        every = every & F.coalesce(p, F.lit(False))
    return row.select(*(F.coalesce(p, F.lit(False)).alias(k) for k, p in checks.items()), every.alias("passed"))


def best_thresholds(rows: DataFrame, fold: str, score: str, thresholds: list[float], least: int, r: str = "r") -> DataFrame:
    """For each fold the threshold of the best expectancy among the folds before it, applied to the fold itself."""
    passed = F.explode(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: t <= F.col(score)))
    own = rows.withColumn("threshold", passed).groupBy(fold, "threshold").agg(F.sum(r).alias("s"), F.count(r).alias("n"))
    w = Window.partitionBy("threshold").orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    before = own.withColumns({"bs": F.sum("s").over(w), "bn": F.sum("n").over(w)}).where(F.col("bn") >= least)
    chosen = before.groupBy(fold).agg(F.max_by(F.struct("threshold", "s", "n", "bn"), F.struct(F.col("bs") / F.col("bn"), F.col("threshold"))).alias("c"))
    return chosen.select(fold, "c.threshold", F.col("c.n").alias("trades"), (F.col("c.s") / F.col("c.n")).alias("expectancy"))


def rates(rows: DataFrame, keys: list[str], *, averages: list[str] = (), medians: list[str] = (), flags: list[str] = (), values: dict[str, tuple[str, str]] = {}, states: list[str] = ()) -> DataFrame:  # noqa: B006
    """Means and medians of what is known and finite, shares of flags and of enum values among what is known (percent), and the counts of each state as `A:3;B:4` in order."""
    known = lambda k: finite(F.col(k).cast("double"))
    share = lambda holds, of: 100 * F.count_if(holds) / F.nullif(F.count(of), F.lit(0))
    out = rows.groupBy(*keys).agg(F.count("*").alias("count"), *(F.avg(known(k)).alias(f"avg_{k}") for k in averages), *(share(F.col(k), k).alias(f"rate_{k}") for k in flags), *(share(F.col(k) == v, k).alias(name) for name, (k, v) in values.items()))
    for k in medians:
        own = percentiles(rows.withColumn("_known", known(k)), keys, "_known", [0.5]).select(*keys, F.col("q")[0].alias(f"median_{k}"))
        out = out.join(own, keys, "left") if keys else out.join(F.broadcast(own), F.lit(True), "left")
    for k in states:
        counted = rows.groupBy(*keys, F.coalesce(F.col(k).cast("string"), F.lit("UNKNOWN")).alias("_state")).agg(F.count("*").alias("_n"))  # few states
        own = counted.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_state", "_n"))), lambda s: F.concat_ws(":", s["_state"], s["_n"].cast("string"))), ";").alias(f"{k}_counts"))
        out = out.join(own, keys, "left") if keys else out.join(F.broadcast(own), F.lit(True), "left")
    return out


def diagnostics(rows: DataFrame, keys: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """The usual bundle of a cohort of direction labels: moves and shares at each horizon, first moves, direction classes."""
    return rates(
        rows, keys, averages=[f"{k}_{h}_atr" for h in horizons for k in ("close", "mfe", "mae")], medians=[f"close_{horizons[-1]}_atr"], flags=[f"short_{h}" for h in horizons],
        values={"short_first_pct": ("first_move", "SHORT_FIRST"), "adverse_first_pct": ("first_move", "ADVERSE_FIRST"), "strong_pct": ("direction", "STRONG_SHORT_FOLLOWTHROUGH"), "wrong_timing_pct": ("direction", "BOTTOM_OR_WRONG_TIMING")}, states=["first_move", "direction"],
    )


def compounded(trades: DataFrame, keys: list[str], order: list[str], r: str, risk_pct: float, span_of: Column) -> DataFrame:
    """Growth and deepest drawdown (percent) of an account that risks `risk_pct` of its equity on each trade, in order. Logs are summed in two levels, so no key is walked in one task."""
    logs = trades.withColumn("_log", F.log(F.greatest(1 + F.col(r) * risk_pct / 100, F.lit(1e-12))))
    out = running(logs, keys, order, "_log", span_of=span_of)
    return out.groupBy(*keys).agg(F.count("*").alias("trades"), F.count_if(F.col(r) > 0).alias("wins"), ((F.exp(F.sum("_log")) - 1) * 100).alias("return_pct"), ((1 - F.exp(-F.max("drawdown"))) * 100).alias("max_drawdown_pct"))


def loss_streaks(trades: DataFrame, keys: list[str], order: list[str], r: str, span_of: Column) -> DataFrame:
    """The longest run of losses in order: losses between two other trades share their number of other trades before."""
    marked = trades.where(F.col(r).isNotNull()).withColumn("_other", (F.col(r) >= 0).cast("double"))
    placed = running(marked, keys, order, "_other", span_of=span_of)
    runs = placed.groupBy(*keys, "equity").agg(F.count_if(F.col(r) < 0).alias("_run"))
    return runs.groupBy(*keys).agg(F.max("_run").alias("longest_loss_streak"))
