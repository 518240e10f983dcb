"""Joins of the event study: as-of, benchmark, matched controls, forward bars, blocks, overlaps, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], *, span: int | None = None) -> DataFrame:
    """For each left row the latest right row at or before it: both sides in one sorted window, one shuffle, no range join.

    With `span` (seconds), a key is cut into spans of time that hand their last right row on, so that no task holds a key; only one row for each span is ordered by key.
    """
    picked = F.struct(F.col(right_ts).alias("as_of_ts"), *columns)
    a = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(picked.alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_left"), picked.alias("_right"))
    both = a.unionByName(b)
    upto = lambda *by: Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    if span is None:
        return both.withColumn("_found", F.last("_right", ignorenulls=True).over(upto(*keys))).where("_side = 1").select("_left.*", "_found.*")
    cut = lambda t: F.floor((F.unix_seconds(t) if dict(both.dtypes)["_t"] == "timestamp" else F.col(t)) / span)
    within = both.withColumn("_span", cut("_t")).withColumn("_own", F.last("_right", ignorenulls=True).over(upto(*keys, "_span"))).where("_side = 1")
    # the newest right row of each span; spans that hold left rows only look for the one before
    ends = b.select(*keys, cut("_t").alias("_span"), "_t", "_right").groupBy(*keys, "_span").agg(F.max_by("_right", "_t").alias("_end"))
    asked = within.select(*keys, "_span").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    spans = ends.unionByName(asked).groupBy(*keys, "_span").agg(F.first("_end", ignorenulls=True).alias("_end"))
    handed = spans.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    same = F.col("w._span") == F.col("h._span")
    for key in keys:
        same = same & F.col(f"w.{key}").eqNullSafe(F.col(f"h.{key}"))
    return within.alias("w").join(handed.alias("h"), same, "left").select("w._left", F.coalesce("w._own", "h._before").alias("_found")).select("_left.*", "_found.*")


def matched_controls(cases: DataFrame, pool: DataFrame, calipers: dict[str, float], distance: Column, top: int = 3, *, allowed: Column | None = None, per: tuple[str, ...] = (), parts: int = 1) -> DataFrame:
    """The `top` nearest rows of the pool at each case's timestamp: another symbol, within all calipers. `distance` may use c_ columns of the case and p_ columns of the pool.

    `allowed` adds a condition on c_ and p_ columns, such as that the control doesn't carry the case's own family; `per` names further columns that tell cases apart.
    A band join: the first two calipers cut their columns into cells of their width, and a case, of which there are few, meets the pool's rows of its own and the
    neighbouring cells, so a crowded timestamp is many keys. `parts` cuts a crowded cell further, by a hash of the pool's symbol. Ranks are cut to `top` before they are shuffled and after.
    A column that is null, infinite or not a number matches nothing.
    """
    c = cases.select(*(F.col(x).alias(f"c_{x}") for x in cases.columns))
    p = pool.select(*(F.col(x).alias(f"p_{x}") for x in pool.columns))
    close, keys = F.lit(True) if allowed is None else allowed, ["_part"]
    for column, width in calipers.items():
        close = close & (F.abs(F.col(f"c_{column}") - F.col(f"p_{column}")) <= width)
    one = F.lit(1).cast("long")
    for k, (column, width) in enumerate([x for x in calipers.items() if x[1] > 0][:2]):
        # a trifle wider than the caliper, so that rounding can't put a match two cells away
        at = lambda side, column=column, width=width: F.col(f"{side}_{column}") / F.lit(width * (1 + 1e-9))
        finite = lambda side, at=at: F.abs(at(side)) < 1e15
        c = c.where(finite("c")).withColumn(f"_cell{k}", F.explode(F.sequence(F.floor(at("c")) - one, F.floor(at("c")) + one)))
        p = p.where(finite("p")).withColumn(f"_cell{k}", F.floor(at("p")))
        keys.append(f"_cell{k}")
    c = c.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))
    p = p.withColumn("_part", F.pmod(F.xxhash64("p_symbol"), F.lit(parts)).cast("int") if parts > 1 else F.lit(0))
    same = F.col("c_ts") == F.col("p_ts")
    for key in keys:
        same = same & (c[key] == p[key])
    joined = c.join(p, same & (F.col("c_symbol") != F.col("p_symbol")) & close).drop(*keys)
    w = Window.partitionBy("c_symbol", "c_ts", *(f"c_{x}" for x in per)).orderBy("distance", "p_symbol")
    return joined.withColumn("distance", distance).withColumn("control_rank", F.row_number().over(w).cast("long")).where(F.col("control_rank") <= top)


def paired_edges(matches: DataFrame, outcome: str) -> DataFrame:
    """Case outcome less the mean of its controls' outcomes."""
    means = matches.groupBy("c_symbol", "c_ts").agg(F.first(f"c_{outcome}").alias("case_outcome"), F.avg(f"p_{outcome}").alias("control_mean"), F.count(f"p_{outcome}").alias("controls"), F.array_join(F.array_sort(F.collect_list("p_symbol")), ";").alias("control_symbols"))
    return means.withColumn("edge", F.col("case_outcome") - F.col("control_mean"))


def forward_bars(signals: DataFrame, bars: DataFrame, horizon: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Each signal with its symbol's bars in (ts, ts + horizon], with their prices as bar_<name> and the columns of `more` as they are. Time buckets of one horizon give an equi-join: a signal meets two of them."""
    bucket = lambda c: F.floor(F.unix_seconds(c) / horizon)
    s = signals.withColumn("_bucket", F.explode(F.array(bucket("ts"), bucket("ts") + 1)))
    b = bars.select("symbol", F.col("ts").alias("bar_ts"), *(F.col(x).alias(f"bar_{x}") for x in ("open", "high", "low", "close")), *more, bucket("ts").alias("_bucket"))
    gap = F.unix_seconds("bar_ts") - F.unix_seconds("ts")
    return s.join(b, ["symbol", "_bucket"]).where((gap > 0) & (gap <= horizon)).drop("_bucket")


def overlaps(trades: DataFrame, entry: str, exit_: str, keys: list[str], span: int = 86_400) -> DataFrame:
    """How many trades of the key are open when each one is entered, itself not counted: a running sum over entries and exits within spans of time, on top of what the spans before leave open."""
    steps = trades.select(*trades.columns, F.col(entry).alias("_t"), F.lit(1).alias("_step")).unionByName(trades.select(*trades.columns, F.col(exit_).alias("_t"), F.lit(-1).alias("_step"))).withColumn("_span", F.floor(F.col("_t") / span))
    left = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = steps.groupBy(*keys, "_span").agg(F.sum("_step").alias("n")).select(*keys, "_span", left.alias("_left"))
    w = Window.partitionBy(*keys, "_span").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    within = steps.withColumn("_open", F.sum("_step").over(w)).where("_step = 1").join(before, [*keys, "_span"])
    return within.withColumn("open_trades", (F.col("_left") + F.col("_open") - 1).cast("long")).drop("_t", "_step", "_span", "_open", "_left")


def assign_blocks(rows: DataFrame, ts: Column, start: int, seconds: int) -> DataFrame:
    """The index of the half-open block of fixed length that holds each row."""
    return rows.withColumn("block", F.floor((F.unix_seconds(ts) - start) / seconds))


def differences(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """Rows of either side that are missing on the other or differ by more than the tolerance."""
    left, right = (df.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in columns), F.lit(True).alias(f"_{side}")) for df, side in ((a, "a"), (b, "b")))
    joined = left.join(right, keys, "full")
    off = F.lit(False)
    for c in columns:
        off = off | (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > tolerance) | (F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull())
    return joined.where(F.col("_a").isNull() | F.col("_b").isNull() | off).withColumn("problem", F.when(F.col("_a").isNull(), "UNEXPECTED").when(F.col("_b").isNull(), "MISSING").otherwise("DIFFERS")).drop("_a", "_b")


def within_windows(bars: DataFrame, windows: DataFrame, step: int, holdout: int | None = None) -> DataFrame:
    """Bars inside any window (symbol, start, end) of their symbol: the windows' slots, then a semi-join. A bar at or after the holdout (seconds) fails the job when it is read."""
    if holdout is not None:
        bars = bars.withColumn("ts", F.when(F.unix_seconds("ts") < holdout, F.col("ts")).otherwise(F.raise_error(F.lit("a bar lies in the holdout")).cast("timestamp")))
    slots = windows.select("symbol", F.explode(F.sequence(F.unix_seconds("start"), F.unix_seconds("end"), F.lit(step).cast("long"))).alias("_s")).select("symbol", F.timestamp_seconds("_s").alias("ts")).distinct()
    return bars.join(slots, ["symbol", "ts"], "left_semi")
