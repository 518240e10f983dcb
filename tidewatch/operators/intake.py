"""First steps and bookkeeping of a study: eligible rows, liquidity, universes, result order, unions and views, frozen cohorts, block calendars, replication checks, ledgers and the first look."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import finite
from tidewatch.operators.features import by_symbol
from tidewatch.operators.scans import with_position


def eligible_rows(bars: DataFrame, start: int, end: int, horizon: int, *, warm_up: int = 100, every: int | None = None, cadence_hours: int | None = None) -> DataFrame:
    """Bars from which a signal may come: within the period and early enough for an outcome of `horizon` seconds, after `warm_up` bars of the symbol, and every n-th of the period's bars or those of a UTC cadence."""
    t = F.unix_seconds("ts")
    inside = with_position(bars, name="_at").where((t >= start) & (t <= end - horizon))
    if every is not None:
        first = inside.groupBy("symbol").agg(F.min("_at").alias("_first"))
        inside = inside.join(first, "symbol").where((F.col("_at") - F.col("_first")) % every == 0)
    if cadence_hours is not None:
        inside = inside.where(F.floor(t / 3600) % cadence_hours == 0)
    return inside.where(F.col("_at") >= warm_up).select(*bars.columns)


def liquid(turnover: Column, spread_bps: Column, *, min_turnover: float = 500_000, max_spread: float = 50.0) -> Column:
    """Enough turnover, or else a narrow known spread."""
    return F.coalesce(turnover >= min_turnover, F.lit(False)) | F.coalesce(spread_bps <= min(20.0, max_spread), F.lit(False))


def resolved(state: Column, net: Column, terminal: tuple[str, ...] = ("TP2R_FIRST", "SL_FIRST", "SL_SAME_BAR", "TIME_EXIT")) -> Column:
    """A trade whose state is terminal and whose result is a finite number."""
    return F.coalesce(state.isin(*terminal), F.lit(False)) & finite(net).isNotNull()


def fresh(signal: Column, now: Column, max_age_minutes: float = 90.0, ahead_minutes: float = 5.0) -> Column:
    """Signals at most so old, or so little ahead of the clock."""
    age = (F.unix_seconds(now) - F.unix_seconds(signal)) / 60
    return (age >= -ahead_minutes) & (age <= max_age_minutes)


def as_of_ticker(bars: DataFrame, back: int = 24) -> DataFrame:
    """What a ticker may say about the past: the last price and its change over `back` bars. Live-only fields stay null, so that nothing known later leaks into history."""
    change = (F.col("close") / F.lag("close", back).over(by_symbol()) - 1) * 100
    unknown = F.lit(None).cast("double")
    return bars.select("symbol", "ts", F.col("close").alias("last_price"), change.alias("change_pct"), *(unknown.alias(k) for k in ("turnover_24h", "funding_rate", "spread_bps")))


def top_universe(tickers: DataFrame, by: str, n: int) -> DataFrame:
    """The n symbols of the highest turnover; ties by symbol."""
    return tickers.orderBy(F.col(by).desc_nulls_last(), "symbol").limit(n)


def ranked_results(results: DataFrame, statuses: list[str], n: int, *, status: str = "status", score: str = "score", turnover: str = "turnover") -> DataFrame:
    """The first n results in report order: status rank, score, turnover, symbol. `place` counts from 1 over these n rows."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in statuses)), F.col(status)).cast("int"), F.lit(0))
    keys = [F.when(rank == 0, len(statuses) + 1).otherwise(rank), F.col(score).desc_nulls_last(), F.col(turnover).desc_nulls_last(), F.col("symbol")]
    top = results.orderBy(*keys).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("long"))  # over n rows


def top_groups(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def leader(table: DataFrame, name: str, n: str, score: str, least: int) -> DataFrame:
    """The name with the best score among those with enough rows; ties to the later name. No row if none has."""
    enough = table.where((F.col(n) >= least) & F.col(score).isNotNull())
    return enough.agg(F.max(F.struct(score, name)).alias("_best")).where("_best IS NOT NULL").select(f"_best.{name}", f"_best.{score}")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Partial results as one; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def only_listed(rows: DataFrame, listed: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows of the listed symbols."""
    return rows.join(listed.select(key).distinct(), key, "left_semi")


def relabelled(rows: DataFrame, prefix: str, new: str, keep: list[str]) -> DataFrame:
    """Columns of one version under the names of another; the kept ones stay, structs lose one level."""
    flat = [F.col(f"{c}.{f}").alias(f"{c}_{f}") if f else F.col(c) for c, kind in rows.dtypes for f in (rows.schema[c].dataType.names if kind.startswith("struct") else [None])]
    out = rows.select(*flat)
    return out.withColumnsRenamed({c: new + c.removeprefix(prefix) for c in out.columns if c.startswith(prefix) and c not in keep})


def side_by_side(rows: DataFrame, views: dict[str, dict[str, Column]], keys: list[str]) -> DataFrame:
    """Several views of one table in long form: each view's columns under common names, with the name of the view."""
    cells = F.array(*(F.struct(F.lit(v).alias("view"), *(x.alias(k) for k, x in named.items())) for v, named in views.items()))
    return rows.select(*keys, F.inline(cells))


def policy_pairs(rows: DataFrame, keys: list[str], policy: str, a: str, b: str, r: str) -> DataFrame:
    """Opportunities that both policies filled, with the difference of their results."""
    both = rows.where(F.col(policy).isin(a, b)).groupBy(*keys).agg(*(F.max(F.when(F.col(policy) == p, F.col(r))).alias(n) for p, n in ((a, "r_a"), (b, "r_b"))))
    return both.where("r_a IS NOT NULL AND r_b IS NOT NULL").withColumn("delta", F.col("r_b") - F.col("r_a"))


def policy_pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("both_filled"), F.avg("delta").alias("mean_delta"), (100 * F.count_if(F.col("delta") > 0) / F.nullif(F.count("*"), F.lit(0))).alias("better_pct"))


def linked_ledger(snapshots: DataFrame, outcomes: DataFrame, key: str, payload: str, digest: str) -> DataFrame:
    """Each snapshot with its outcome: LINKED if the outcome names the snapshot's own SHA-256, CHANGED if another, OPEN without an outcome."""
    s = snapshots.withColumn("_own", F.sha2(F.col(payload), 256))
    joined = s.join(outcomes.select(key, F.col(digest).alias("_named")), key, "left")
    state = F.when(F.col("_named").isNull(), "OPEN").when(F.col("_named") == F.col("_own"), "LINKED").otherwise("CHANGED")
    return joined.withColumn("link", state).drop("_own", "_named")


def freeze_cohort(rows: DataFrame, start: int, end: int, rules: dict[str, str], key: str = "symbol") -> DataFrame:
    """One row that names a study: its period, its sorted symbols, its rules and the SHA-256 of their canonical JSON. Holds the list of symbols, which is the cohort itself."""
    symbols = rows.select(key).distinct().agg(F.array_sort(F.collect_list(key)).alias("symbols"))
    identity = F.to_json(F.struct(F.lit(end).alias("end"), F.struct(*(F.lit(v).alias(k) for k, v in sorted(rules.items()))).alias("rules"), F.lit(start).alias("start"), F.col("symbols")))
    return symbols.select(F.size("symbols").cast("long").alias("symbol_count"), identity.alias("identity"), F.sha2(identity, 256).alias("cohort_id"))


def block_calendar(spark: SparkSession, start: int, blocks: int, days: int, embargo_days: int, windows: list[tuple[str, int]]) -> DataFrame:
    """Blocks of equal length in a row, then named windows, each after an embargo: name, start and end in seconds (half open)."""
    laid = spark.range(blocks).select(F.concat(F.lit("BLOCK_"), (F.col("id") + 1).cast("string")).alias("name"), (F.lit(start) + F.col("id") * days * 86_400).alias("start"), (F.lit(start) + (F.col("id") + 1) * days * 86_400).alias("end"))
    at, rows = start + blocks * days * 86_400, []
    for name, length in windows:
        at += embargo_days * 86_400
        rows.append((name, at, at + length * 86_400))
        at += length * 86_400
    return laid.union(spark.createDataFrame(rows, "name string, start long, end long")) if rows else laid


def replication_check(observed: DataFrame, expected: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Each expected figure (name, expected) against the observed one of a one-row table, and whether they agree."""
    long = observed.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("observed")) for c in observed.columns))))
    joined = expected.join(long, "name", "left")
    return joined.withColumn("agrees", F.coalesce(F.abs(F.col("observed") - F.col("expected")) <= tolerance, F.lit(False)))


def attrition(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows by the first reason that rejects them; those that none rejects are ELIGIBLE."""
    reason = F.lit("ELIGIBLE")
    for name, holds in reversed(list(reasons.items())):
        reason = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def overlap_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Rows with each flag, and how many of them carry another flag too."""
    carried = F.filter(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)), lambda x: x.isNotNull())
    long = rows.withColumn("_held", carried).select(F.explode("_held").alias("family"), (F.size("_held") > 1).alias("_more"))
    return long.groupBy("family").agg(F.count("*").alias("events"), F.count_if("_more").alias("overlapping"))


def distinct_counts(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """How many distinct values each column has: values are made distinct before they are counted, so no set of them is held anywhere."""
    cells = F.array(*(F.struct(F.lit(k).alias("name"), x.cast("string").alias("_v")) for k, x in columns.items()))
    return rows.select(F.inline(cells)).where("_v IS NOT NULL").distinct().groupBy("name").agg(F.count("*").alias("n"))


def first_look(snapshots: DataFrame, outcomes: DataFrame, now: int, end: int, *, delay: int, coverage: float, least_rows: int, least_days: int, cost_pct: float) -> DataFrame:
    """One row with the state of a prospective study and, only once it may be looked at, its figures. Before `end + delay` nothing is computed from results.

    snapshots: batch_id; outcomes: batch_id, day, edge and short (results of matched events, null otherwise).
    """
    counts = snapshots.agg(F.count("*").alias("snapshots")).join(F.broadcast(outcomes.select("batch_id").distinct().join(snapshots.select("batch_id").distinct(), "batch_id", "left_semi").agg(F.count("*").alias("settled"))))
    by_day = outcomes.where("edge IS NOT NULL").groupBy("day").agg(F.sum("edge").alias("e"), F.sum("short").alias("s"), F.count("*").alias("n"))
    figures = by_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("*").alias("days"), (F.sum("e") / F.sum("n")).alias("mean_edge"), (F.sum("s") / F.sum("n") - cost_pct).alias("mean_net"), F.avg((F.col("e") > 0).cast("double")).alias("positive_days"))
    out = counts.join(F.broadcast(figures))
    early, supportive = F.lit(now < end + delay), (F.col("mean_edge") > 0) & (F.col("mean_net") > 0) & (F.col("positive_days") >= 0.6)
    status = (
        F.when(early, "ACCUMULATING").when(F.col("snapshots") == 0, "INCONCLUSIVE_NO_SNAPSHOTS").when(F.col("settled") < coverage * F.col("snapshots"), "OUTCOMES_INCOMPLETE")
        .when((F.col("events") < least_rows) | (F.col("days") < least_days), "SAMPLE_TOO_SMALL").when(supportive, "SUPPORTIVE").otherwise("NOT_CONFIRMED")
    )
    shown = status.isin("SUPPORTIVE", "NOT_CONFIRMED")
    return out.select(status.alias("status"), "snapshots", "settled", *(F.when(shown, F.col(k)).alias(k) for k in ("events", "days", "mean_edge", "mean_net", "positive_days")))

