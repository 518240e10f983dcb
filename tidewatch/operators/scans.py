"""Scans and order statistics that hold no symbol, key or table in one task: positions, windows in chunks with halos, running sums in two levels, exact exponential means and exact percentiles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 30 * 86_400


def with_position(bars: DataFrame, *, key: str = "symbol", ts: str = "ts", span: int = SPAN, name: str = "position") -> DataFrame:
    """The number of each bar within its key, from 0 on in time order: numbered within spans of time, after the counts of the spans before. Only one row for each span is ordered by key."""
    keyed = bars.withColumn("_span", F.floor(F.unix_seconds(ts) / span))
    own = F.row_number().over(Window.partitionBy(key, "_span").orderBy(ts)) - 1
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = keyed.groupBy(key, "_span").agg(F.count("*").alias("n")).select(key, "_span", before.alias("_before"))
    return keyed.withColumn("_own", own).join(offsets, [key, "_span"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_span", "_own", "_before")


def in_chunks(bars: DataFrame, features: Callable[[DataFrame], DataFrame], *, back: int, ahead: int = 0, chunk: int = 8192) -> DataFrame:
    """`features` over chunks of a symbol's bars, each with the `back` bars before and the `ahead` bars after it, so that a long symbol spreads over many tasks.

    Gives what `features` gives over whole symbols as long as its frames reach no further than that. Within it, column symbol is a pair of symbol and chunk.
    """
    placed = with_position(bars, name="_at")
    reached = F.sequence(F.greatest(F.floor((F.col("_at") - ahead) / chunk), F.lit(0)), F.floor((F.col("_at") + back) / chunk))
    spread = placed.withColumn("_chunk", F.explode(reached)).withColumn("symbol", F.struct(F.col("symbol").alias("name"), F.col("_chunk").alias("chunk")))
    own = features(spread).where(F.floor(F.col("_at") / chunk) == F.col("symbol.chunk"))
    return own.withColumn("symbol", F.col("symbol.name")).drop("_at", "_chunk")


def running(rows: DataFrame, keys: list[str], order: list[str], x: str, *, span_of: Column) -> DataFrame:
    """Running total of x, its peak (0 at least) and the drawdown. `span_of` cuts a key along its order; spans are summed first and give each other their offsets."""
    own = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("_span", span_of).withColumn("_sum", F.sum(x).over(own)).withColumn("_top", F.max("_sum").over(own))
    spans = within.groupBy(*keys, "_span").agg(F.sum(x).alias("total"), F.max("_sum").alias("top"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("_offset", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    placed = placed.withColumn("_peak", F.max(F.col("_offset") + F.col("top")).over(before)).select(*keys, "_span", "_offset", "_peak")
    out = within.join(placed, [*keys, "_span"]).withColumns({"equity": F.col("_offset") + F.col("_sum"), "peak": F.greatest(F.col("_offset") + F.col("_top"), F.coalesce("_peak", F.lit(0.0)), F.lit(0.0))})
    return out.withColumn("drawdown", F.col("peak") - F.col("equity")).drop("_span", "_sum", "_top", "_offset", "_peak")


def with_ema(bars: DataFrame, spans: tuple[int, ...], price: str = "close", *, span: int = SPAN) -> DataFrame:
    """Exponential means ema<span> over a symbol's whole history, seeded with its first bar."""
    return with_history(bars, spans, {}, price, span=span).drop("position")


def carried(bars: DataFrame, columns: dict[str, str], *, inclusive: bool = True, span: int = SPAN) -> DataFrame:
    """The last value of each column up to a bar (before it, if not inclusive) that isn't null, under a new name. Spans of time hand their last value on."""
    end = 0 if inclusive else -1
    own = Window.partitionBy("symbol", "_span").orderBy("ts").rowsBetween(Window.unboundedPreceding, end)
    placed = bars.withColumn("_span", F.floor(F.unix_seconds("ts") / span))
    within = placed.withColumns({f"_own_{new}": F.last(c, ignorenulls=True).over(own) for c, new in columns.items()})
    ends = placed.groupBy("symbol", "_span").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"_end_{new}") for c, new in columns.items()))
    before = Window.partitionBy("symbol").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("symbol", "_span", *(F.last(f"_end_{new}", ignorenulls=True).over(before).alias(f"_before_{new}") for new in columns.values()))
    out = within.join(handed, ["symbol", "_span"]).withColumns({new: F.coalesce(f"_own_{new}", f"_before_{new}") for new in columns.values()})
    return out.drop("_span", *(f"_{k}_{new}" for k in ("own", "before") for new in columns.values()))


def with_history(bars: DataFrame, spans: tuple[int, ...], lasts: dict[str, str], price: str = "close", *, span: int = SPAN) -> DataFrame:
    """What a bar owes to its symbol's whole history, in one pass: `position` from 0 on, exponential means ema<span>, and for each column of `lasts` its last two values that aren't null, as arrays last_<name>, the newest last.

    Spans of time are folded on their own, in runs short enough for their weights to be doubles however many bars a span holds, and hand their ends on; only one row
    for each span is ordered by symbol, and a span takes on just those before it whose weight reaches 1e-650: below it not even the greatest double counts beside the least. Work is linear in the bars.
    Very high prices are scaled by a power of two within a run, so that no weight takes them to infinity; a mean that was infinite stays so.
    """
    if min(spans, default=2) < 2:
        raise ValueError("an exponential mean needs a span of at least 2")
    keep = {s: 1 - 2 / (s + 1) for s in spans}
    run = min((int(345 / -math.log(q)) for q in keep.values()), default=1)
    placed = bars.withColumn("_span", F.floor(F.unix_seconds("ts") / span))
    w = Window.partitionBy("symbol", "_span").orderBy("ts")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_k", F.row_number().over(w) - 1).withColumns({"_run": F.floor(c_("_k") / run), "_step": c_("_k") % run})
    # the last two values so far: each value that isn't null knows the one before it
    paired = numbered.withColumns({f"_p_{n}": F.when(c_(col).isNotNull(), F.struct(F.last(col, ignorenulls=True).over(earlier).alias("older"), c_(col).alias("newer"))) for col, n in lasts.items()}) if lasts else numbered
    in_run = Window.partitionBy("symbol", "_span", "_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    # weights reach 1e150 in a run; prices stay below 1e100, or below 1e154 where they are scaled
    scaled = paired.withColumn("_scale", F.when(F.max(F.abs(price)).over(Window.partitionBy("symbol", "_span", "_run")) > 1e100, 2.0**-512).otherwise(1.0))
    summed = scaled.withColumns({f"_r{s}": F.pow(F.lit(q), c_("_step")) * F.sum((1 - q) * (c_(price) * c_("_scale")) * F.pow(F.lit(q), -c_("_step"))).over(in_run) / c_("_scale") for s, q in keep.items()} | {f"_l_{n}": F.last(f"_p_{n}", ignorenulls=True).over(upto) for n in lasts.values()})
    # the ends of the runs before, which are all whole
    ended = summed.withColumns({f"_t{s}": F.collect_list(F.when(c_("_step") == run - 1, c_(f"_r{s}"))).over(earlier) for s in spans})
    within = ended.withColumns({f"_e{s}": c_(f"_r{s}") + F.pow(F.lit(q), c_("_step") + 1) * F.aggregate(f"_t{s}", F.lit(0.0), _decayed(q**run)) for s, q in keep.items()})
    ends = within.groupBy("symbol", "_span").agg(F.count("*").alias("n"), F.min_by(price, "_k").alias("first"), *(F.max_by(f"_e{s}", "_k").alias(f"e{s}") for s in spans), *(F.max_by(f"_l_{n}", "_k").alias(f"l_{n}") for n in lasts.values()))
    order = Window.partitionBy("symbol").orderBy("_span")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = ends.withColumns({"_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "_seed": F.first("first").over(order.rowsBetween(Window.unboundedPreceding, 0))} | {f"_d{s}": F.lag(f"e{s}").over(order) for s in spans} | {f"_o_{n}": F.last(F.col(f"l_{n}.newer"), ignorenulls=True).over(before) for n in lasts.values()})
    # a span's row carries the end of the span before, at the position where that ended
    handed: dict[str, Column] = {}
    for s, q in keep.items():
        near = Window.partitionBy("symbol").orderBy("_before").rangeBetween(-math.ceil(-650 * math.log(10) / math.log(q)), 0)
        ends_before = F.collect_list(F.when(c_(f"_d{s}").isNotNull(), F.struct(c_("_before").alias("at"), c_(f"_d{s}").alias("e")))).over(near)
        endless = F.max(F.abs(f"_d{s}")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == float("inf")
        handed[f"_c{s}"] = F.when(endless, float("inf")).otherwise(F.aggregate(ends_before, c_("_seed") * F.pow(F.lit(q), c_("_before")), _weighted(q)))
    for n in lasts.values():
        handed[f"_b_{n}"] = F.last(F.when(c_(f"l_{n}").isNotNull(), F.struct(F.coalesce(c_(f"l_{n}.older"), c_(f"_o_{n}")).alias("older"), c_(f"l_{n}.newer").alias("newer"))), ignorenulls=True).over(before)
    carries = counted.withColumns(handed).select("symbol", "_span", "_before", *handed)
    out = within.join(carries, ["symbol", "_span"])
    # the first bar's mean is its price to the last bit, so that neither lies below the other
    position = c_("_before") + c_("_k")
    named = {"position": position.cast("long")} | {f"ema{s}": F.when(position == 0, c_(price)).when(c_(f"_c{s}") == float("inf"), float("inf")).otherwise(F.pow(F.lit(q), c_("_k") + 1) * c_(f"_c{s}") + c_(f"_e{s}")) for s, q in keep.items()}
    for n in lasts.values():
        own, old = F.col(f"_l_{n}"), F.col(f"_b_{n}")
        named[f"last_{n}"] = F.array_compact(F.when(own.isNull(), F.array(old["older"], old["newer"])).otherwise(F.array(F.coalesce(own["older"], old["newer"]), own["newer"])))
    return out.withColumns(named).drop("_span", "_k", "_run", "_step", "_scale", "_before", *(f"_{k}{s}" for k in "rtec" for s in spans), *(f"_{k}_{n}" for k in "plb" for n in lasts.values()))


def _decayed(share: float) -> Callable[[Column, Column], Column]:
    return lambda total, x: total * share + x


def _weighted(keep: float) -> Callable[[Column, Column], Column]:
    return lambda total, x: total + x["e"] * F.pow(F.lit(keep), F.col("_before") - x["at"])


def c_(name: str) -> Column:
    return F.col(name)


def with_dense_rank(rows: DataFrame, t: str, *, span: int = 86_400, name: str = "rank") -> DataFrame:
    """The number of distinct values of t (whole seconds) below each row's own, over the whole table, as dense ranks from 0 on, with their count as <name>_of.

    Distinct values are numbered within spans, and one row for each span is put in order: a row a day by default, whatever the table's size. Both joins merge: distinct times or rows that look small by their file are never broadcast through the driver.
    """
    values = rows.where(F.col(t).isNotNull()).select(F.col(t).alias("_v"), F.floor(F.col(t) / span).alias("_span")).distinct()
    own = F.row_number().over(Window.partitionBy("_span").orderBy("_v")) - 1
    counts = values.groupBy("_span").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(F.lit(0))
    before = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), f"{name}_of": F.sum("_n").over(whole)}).drop("_n")
    ranked = values.withColumn("_own", own).join(before.hint("merge"), "_span").select("_v", (F.col("_before") + F.col("_own")).cast("long").alias(name), F.col(f"{name}_of").cast("long").alias(f"{name}_of"))
    return rows.join(ranked.hint("merge"), rows[t] == F.col("_v"), "left").drop("_v")


def ranged(values: DataFrame, keys: list[str], x: str, cuts: int = 64) -> DataFrame:
    """Rows with `_range`, the number of the range of x within their key that they lie in, from an approximate sketch; nulls lie in the first."""
    bounds = values.groupBy(*keys).agg(F.percentile_approx(F.col(x).cast("double"), [k / cuts for k in range(1, cuts)], 10 * cuts).alias("_bounds"))
    joined = values.alias("a").join(bounds.alias("b"), _same("a", "b", keys), "left").select("a.*", "b._bounds") if keys else values.join(F.broadcast(bounds), F.lit(True))
    at = F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")), lambda b: b < F.col(x).cast("double")))
    return joined.withColumn("_range", F.when(F.col(x).isNull(), 0).otherwise(at)).drop("_bounds")


def percentiles(rows: DataFrame, keys: list[str], x: str, shares: list[float | Column], *, cuts: int = 64) -> DataFrame:
    """Exact percentiles with linear interpolation, as array q by key; keys without values are left out. A Column in place of a share gives a rank from 0 on, in terms of _total.

    An approximate sketch cuts each key's values into ranges, ranges are counted, and only those that hold a wanted rank are looked into. Equal values count
    as one row with a weight, so neither a hot key nor a hot value comes together in one task as rows.
    """
    values = rows.select(*keys, F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL").groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    marks = [k / cuts for k in range(1, cuts)]
    bounds = values.groupBy(*keys).agg(F.percentile_approx("_x", marks, 10 * cuts).alias("_bounds"))
    ranged = _joined(values, bounds, keys).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("_x")))).drop("_bounds")
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m"))
    own = Window.partitionBy(*keys)
    laid = sizes.withColumns({"_before": F.sum("_m").over(own.orderBy("_range")) - F.col("_m"), "_total": F.sum("_m").over(own)})
    # ranks needed, counted from 0
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (p if isinstance(p, Column) else F.lit(float(p)) * (F.col("_total") - 1)).cast("double").alias("h")) for k, p in enumerate(shares))))
    wanted = laid.select(*keys, "_total").distinct().withColumn("_w", at).select(*keys, F.col("_w.k").alias("_k"), F.col("_w.h").alias("_h"))
    ranks = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
    holds = ranks.alias("r").join(laid.alias("l"), _same("r", "l", keys) & (F.col("r._rank") >= F.col("l._before")) & (F.col("r._rank") < F.col("l._before") + F.col("l._m"))).select(*(F.col(f"r.{k}").alias(k) for k in keys), F.col("l._range").alias("_range"), F.col("l._before").alias("_before"), F.struct(F.col("r._k").alias("k"), F.col("r._h").alias("h"), F.col("r._rank").alias("rank")).alias("_want"))
    wants = holds.groupBy(*keys, "_range").agg(F.first("_before").alias("_before"), F.collect_list("_want").alias("_wants"))
    inside = ranged.join(F.broadcast(wants) if not keys else wants, [*keys, "_range"])
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_x"))
    hit = inside.withColumn("_to", F.col("_before") + upto).withColumn("_from", F.col("_to") - F.col("_n")).withColumn("_want", F.explode(F.filter("_wants", lambda w: (w["rank"] >= F.col("_from")) & (w["rank"] < F.col("_to")))))
    weight = F.when(F.ceil("_want.h") == F.floor("_want.h"), 1.0).otherwise(1 - F.abs(F.col("_want.h") - F.col("_want.rank")))
    each = hit.groupBy(*keys, F.col("_want.k").alias("_k")).agg(F.sum(F.col("_x") * weight).alias("_q"))
    listed = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_q"))), lambda s: s["_q"]).alias("q"))
    return listed


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _joined(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the one row of their key; a table without keys has one row in all."""
    return rows.join(per_key, keys) if keys else rows.join(F.broadcast(per_key), F.lit(True))
