"""Cohort statistics of outcomes: paths, policies, variants, attribution, lifecycles, ledgers, slots and walk-forward folds.

All are one or two aggregations with map-side combine. Lists of levels, variants and folds are small parameters that fan rows out inside the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import profit_factor, ratio
from tidewatch.operators.features import rows
from tidewatch.operators.matching import forward_bars
from tidewatch.operators.scans import percentiles


def _share(condition: Column, of: Column) -> Column:
    return ratio(100.0 * F.count_if(condition), of)


def _with_quantiles(out: DataFrame, of: DataFrame, keys: list[str], shares: dict[str, tuple[float, ...]]) -> DataFrame:
    for column, q in shares.items():
        named = percentiles(of, keys, column, list(q)).select(*keys, *(F.col("q")[i].alias(f"{column}_q{int(100 * p)}") for i, p in enumerate(q)))
        out = out.join(named, keys, "left")
    return out


def path_summary(paths: DataFrame, point: str, levels: list[float]) -> DataFrame:
    """Quartiles of the best and the median of the worst move at each checkpoint, and how many paths reached each level."""
    reach = [(100 * F.avg((F.col("mfe") >= x).cast("double"))).alias(f"reach_{x:g}_pct") for x in levels]
    return _with_quantiles(paths.groupBy(point).agg(F.count("*").alias("n"), *reach), paths, [point], {"mfe": (0.25, 0.5, 0.75), "mae": (0.5,)})


def path_cohorts(paths: DataFrame, point: str, sides: list[str], levels: list[float]) -> DataFrame:
    """Long form by side, checkpoint and level: how many paths reach the level and how far these go on average."""
    cells = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(float(x)).alias("level"), F.col(s).alias("v")) for s in sides for x in levels))
    long = paths.select(point, F.inline(cells))
    reached = F.col("v") >= F.col("level")
    return long.groupBy("side", point, "level").agg(F.count("*").alias("n"), F.count_if(reached).alias("reached"), F.avg(F.when(reached, F.col("v"))).alias("mean_reached"))


def policy_metrics(opportunities: DataFrame, keys: list[str], filled: Column, r: Column, target: float = 2.0) -> DataFrame:
    """Results of a policy for each fill and for each opportunity, an unfilled one counting as zero."""
    fills = F.count_if(filled)
    return opportunities.groupBy(*keys).agg(
        F.count("*").alias("opportunities"), fills.alias("fills"), _share(filled, F.count("*")).alias("fill_pct"), _share(filled & (r >= target), fills).alias("target_pct"), _share(filled & (r <= -1), fills).alias("stop_pct"),
        F.avg(F.when(filled, r)).alias("per_fill"), (F.coalesce(F.sum(F.when(filled, r)), F.lit(0.0)) / F.count("*")).alias("per_opportunity"),
    )


def attribution(trades: DataFrame, dimensions: list[str], r: str, block: str, min_n: int, min_blocks: int) -> DataFrame:
    """Best and worst bucket of each dimension among those with enough trades in enough blocks, and their spread; a dimension without any has no row."""
    cells = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("bucket")) for c in dimensions))
    long = trades.select(F.col(block).alias("_block"), F.col(r).alias("_r"), F.inline(cells))
    # blocks first, so that a hot bucket is summed before it meets its other blocks
    by_block = long.groupBy("dimension", "bucket", "_block").agg(F.sum("_r").alias("s"), F.count("_r").alias("n"))
    buckets = by_block.groupBy("dimension", "bucket").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"), F.count("*").alias("blocks")).where((F.col("n") >= min_n) & (F.col("blocks") >= min_blocks))
    return buckets.groupBy("dimension").agg(F.count("*").alias("buckets"), F.max_by("bucket", "mean").alias("best"), F.min_by("bucket", "mean").alias("worst"), (F.max("mean") - F.min("mean")).alias("spread"))


def lifecycle(events: DataFrame, keys: list[str], state: str, wait: str, r: str) -> DataFrame:
    """Counts and shares of the states within the key, with the average wait and result."""
    counted = events.groupBy(*keys, state).agg(F.count("*").alias("n"), F.avg(wait).alias("average_wait"), F.avg(r).alias("average_r"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).select(*keys, state, "n", "share", "average_wait", "average_r")


def per_variant(trades: DataFrame, keys: list[str], variants: dict[str, Column]) -> DataFrame:
    """The same trades under several exits: one row for each variant and key."""
    cells = F.array(*(F.struct(F.lit(name).alias("variant"), r.alias("_r")) for name, r in variants.items()))
    return trades.select(*keys, F.inline(cells)).groupBy("variant", *keys).agg(F.count("_r").alias("n"), _share(F.col("_r") > 0, F.count("_r")).alias("positive_pct"), F.avg("_r").alias("expectancy"), F.sum("_r").alias("total"))


def target_hits(signals: DataFrame, bars: DataFrame, horizon: int, target_pct: float, stop_caps: list[float]) -> DataFrame:
    """How many signals of a symbol reach the target, how many without an adverse move of each cap before, quantiles of that move and of the minutes. Signals without later bars don't count."""
    own = Window.partitionBy("symbol", "ts")
    t = F.unix_seconds("bar_ts")
    joined = forward_bars(signals, bars, horizon).withColumn("_hit", F.min(F.when(F.col("bar_low") <= F.col("entry") * (1 - target_pct / 100), t)).over(own))
    up_to = t <= F.coalesce("_hit", t)
    each = joined.groupBy("symbol", "ts").agg(F.first("_hit").alias("hit_t"), ((F.max(F.when(up_to, F.col("bar_high"))) - F.first("entry")) / F.first("entry") * 100).alias("adverse")).withColumn("minutes", (F.col("hit_t") - F.unix_seconds("ts")) / 60)
    hit = F.col("hit_t").isNotNull()
    clean = [_share(hit & (F.col("adverse") < cap), F.count("*")).alias(f"clean_{cap:g}_pct") for cap in stop_caps]
    out = each.groupBy("symbol").agg(F.count("*").alias("n"), _share(hit, F.count("*")).alias("hit_pct"), *clean)
    return _with_quantiles(out, each, ["symbol"], {"adverse": (0.5, 0.75), "minutes": (0.5,)})


def ledger_summary(ledger: DataFrame, tier: str, r: str) -> DataFrame:
    """Closed trades of each tier; the profit factor is 999 without a loss and null without a gain either. Works in a stream too (complete or update mode)."""
    x = F.col(r)
    closed = ledger.where(x.isNotNull()).groupBy(tier)
    factor = F.when((F.count_if(x > 0) > 0) | (F.count_if(x < 0) > 0), profit_factor(x))
    return closed.agg(F.count("*").alias("closed"), F.count_if(x > 0).alias("positive"), _share(x > 0, F.count("*")).alias("positive_pct"), F.avg(x).alias("expectancy"), factor.alias("profit_factor"), F.sum(x).alias("total_r"))


def slot_health(captures: DataFrame, keys: list[str], step: int, grace: int, coverage: float) -> DataFrame:
    """Expected slots against captured ones: missed, late (first capture after the grace), duplicates and the newest valid capture. Missed slots are never filled from later data."""
    t = F.unix_seconds("ts")
    slots = captures.groupBy(*keys, (F.floor(t / step) * step).alias("slot")).agg(F.min(t).alias("first_t"), F.count("*").alias("n"))
    expected = F.floor((F.max("slot") - F.min("slot")) / step) + 1
    late = F.col("first_t") - F.col("slot") > grace
    return slots.groupBy(*keys).agg(
        expected.alias("expected"), F.count("*").alias("present"), (expected - F.count("*")).alias("missed"), F.count_if(late).alias("late"), (F.sum("n") - F.count("*")).alias("duplicates"),
        F.max(F.when(~late, F.col("first_t"))).alias("newest_valid_t"), (F.count_if(~late) / expected >= coverage).alias("healthy"),
    )


def walk_forward(trades: DataFrame, t: str, start: int, folds: int, train: int, test: int, embargo: int) -> DataFrame:
    """Each row once for every fold that uses it, with its role. Fold k trains on `train` seconds from start + k * test and tests on the `test` seconds after the embargo."""
    fold = F.explode(F.array(*(F.lit(k).cast("long") for k in range(folds))))
    laid = trades.withColumn("fold", fold)
    since = F.col(t) - F.lit(start) - F.col("fold") * test
    role = F.when((since >= 0) & (since < train), "train").when((since >= train + embargo) & (since < train + embargo + test), "test")
    return laid.withColumn("role", role).where(F.col("role").isNotNull())


def rolling_folds(rows: DataFrame, t: str, train: int, test: int, embargo: int, *, start: int | None = None) -> DataFrame:
    """Folds as in walk_forward, laid from the first time (or `start`) to the end of the data: as many as it takes for each row after the first training and embargo to be tested once. A row is repeated only for the folds that use it."""
    low, high = rows.agg(F.min(t), F.max(t)).first()
    if low is None:
        return rows.withColumns({"fold": F.lit(None).cast("long"), "role": F.lit(None).cast("string")})
    begin = low if start is None else start
    folds = max(1, -(-(high - begin - train - embargo + 1) // test))
    x, zero, last = F.col(t) - F.lit(begin), F.lit(0).cast("long"), F.lit(folds - 1).cast("long")
    first_train, last_train, tested = F.greatest(F.floor((x - train) / test) + 1, zero), F.least(F.floor(x / test), last), F.floor((x - train - embargo) / test)
    none = F.array().cast("array<bigint>")
    used = lambda folds, role: F.transform(folds, lambda k: F.struct(k.alias("fold"), F.lit(role).alias("role")))
    trains = F.when((x >= 0) & (first_train <= last_train), F.sequence(first_train, last_train)).otherwise(none)
    tests = F.when((tested >= 0) & (tested <= last), F.array(tested)).otherwise(none)
    return rows.withColumn("_f", F.explode(F.concat(used(trains, "train"), used(tests, "test")))).select("*", "_f.*").drop("_f")


def edge_states(folds: DataFrame, engine: str, regime: str, r: str, *, min_engine: int, min_regime: int, min_pf: float) -> DataFrame:
    """Test rows with the state of their engine and of engine and regime, and the expected result, all from the fold's training rows alone."""
    x, train = F.col(r), folds.where("role = 'train'")
    p, win, loss = F.avg((x > 0).cast("double")), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(F.avg(F.when(x <= 0, x)), F.lit(0.0))
    of_engine = train.groupBy("fold", engine).agg(F.count("*").alias("_n"), F.avg(x).alias("_x"), profit_factor(x).alias("_pf"), (p * win + (1 - p) * loss).alias("expected_r"))
    of_regime = train.groupBy("fold", engine, regime).agg(F.count("*").alias("_rn"), F.avg(x).alias("_rx"), profit_factor(x).alias("_rpf"))
    tested = folds.where("role = 'test'").join(of_engine, ["fold", engine], "left").join(of_regime, ["fold", engine, regime], "left")
    active = (F.col("_n") >= min_engine) & (F.col("_x") > 0) & (F.col("_pf") >= min_pf)
    state = F.when(F.coalesce("_rn", F.lit(0)) < min_regime, "INSUFFICIENT").when((F.col("_rx") > 0) & (F.col("_rpf") >= 1), "ACTIVE").otherwise("SHADOW")
    return tested.withColumns({"engine_state": F.when(active, "ACTIVE").otherwise("SHADOW"), "regime_state": state}).drop("_n", "_x", "_pf", "_rn", "_rx", "_rpf")


def support_room(pivot: str, entry: Column, risk: Column, *, last: int = 6, lookback: int = 120, unknown: float = 5.0) -> Column:
    """Risks from the entry down to the nearest of the last pivots below it; `unknown` where there is none in the bounded lookback."""
    pivots = F.slice(F.reverse(F.collect_list(pivot).over(rows(1 - lookback, 0))), 1, last)
    return F.coalesce((entry - F.array_max(F.filter(pivots, lambda x: x < entry))) / risk, F.lit(unknown))
