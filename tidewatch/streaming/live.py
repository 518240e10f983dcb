"""Structured Streaming forms: closed bars, cadence capture, cooldown, signal register and settlement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def closed_bars(ticks: DataFrame, step: str, late: str) -> DataFrame:
    """Tumbling bars of a tick stream; in append mode a bar appears once the watermark has passed its end, so the current bar is never used."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", step)).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").cast("double").alias("volume"), F.sum("price").alias("amount")).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "amount")


def captured(bars: DataFrame, slot: str, late: str) -> DataFrame:
    """The first bar of each symbol and cadence slot, once the watermark has passed the slot: a slot is captured once, whatever arrives again. Missed slots stay missing."""
    first = F.min_by(F.struct("ts", "close"), "ts")
    return bars.withWatermark("ts", late).groupBy("symbol", F.window("ts", slot)).agg(first.alias("_first")).select("symbol", F.col("window.start").alias("slot"), F.col("_first.ts").alias("ts"), F.col("_first.close").alias("close"))


def registered(signals: DataFrame, late: str) -> DataFrame:
    """Signals by a SHA-256 of symbol and time, each once, with status OPEN."""
    keyed = signals.withColumn("signal_id", F.sha2(F.concat_ws("|", "symbol", F.unix_seconds("ts").cast("string")), 256))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["signal_id"]).withColumn("status", F.lit("OPEN"))


def settled(signals: DataFrame, bars: DataFrame, horizon: str, late: str) -> DataFrame:
    """Each signal with the later bars of its symbol up to the horizon: an interval join with watermarks on both sides."""
    s = signals.withWatermark("ts", late).alias("s")
    b = bars.withColumnRenamed("ts", "bar_ts").withWatermark("bar_ts", late).alias("b")
    return s.join(b, F.expr(f"s.symbol = b.symbol AND b.bar_ts > s.ts AND b.bar_ts <= s.ts + INTERVAL {horizon}")).select("s.symbol", "s.ts", "b.bar_ts", "b.high", "b.low", "b.close")


def cooled_down(events: DataFrame, seconds: int, late: str) -> DataFrame:
    """Greedy cooldown by symbol; the state is the time of the last kept event and expires with the watermark.

    Rows of a micro-batch are put in time order; one older than the last kept event is dropped.
    """

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ts")
        kept = []
        for t in rows["ts"]:
            at = int(t.timestamp())
            if last is None or at - last >= seconds:
                kept.append(t)
                last = at
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (last + seconds) * 1000))
        yield pd.DataFrame({"symbol": [key[0]] * len(kept), "ts": kept})

    slim = events.select("symbol", "ts").withWatermark("ts", late)
    return slim.groupBy("symbol").applyInPandasWithState(keep, "symbol string, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Runs a stream over all that its source holds, into Parquet files of `folder`, and gives these back as a table."""
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def append_to(spark: SparkSession, stream: DataFrame, path: str, log: str, settings: dict[str, str] | None = None) -> None:
    """Runs a stream over all that its source holds now and appends its rows to a folder; called again with the same log it goes on where it stopped. `settings` hold for the start of this stream alone."""
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    query.awaitTermination()


def settlement(joined: DataFrame, signals: DataFrame, step: int, horizon_bars: int, now: int, *, move: float, most_missing: float = 0.05) -> DataFrame:
    """Outcome of each signal (entry) from its later bars: CLOSED_TARGET or CLOSED_STOP at the first of -/+ `move`, CLOSED_TIME once the horizon is over with enough bars, POSTPONED if too many are missing, else OPEN."""
    t = F.unix_seconds("bar_ts")
    seen = joined.join(signals.select("symbol", "ts", "entry"), ["symbol", "ts"]).groupBy("symbol", "ts").agg(F.count("*").alias("bars"), F.min(F.when(F.col("low") <= F.col("entry") * (1 - move), t)).alias("_down"), F.min(F.when(F.col("high") >= F.col("entry") * (1 + move), t)).alias("_up"))
    out = signals.join(seen, ["symbol", "ts"], "left")
    over = F.unix_seconds("ts") + step * horizon_bars <= now
    enough = F.coalesce("bars", F.lit(0)) >= (1 - most_missing) * horizon_bars
    never = F.lit(2**62)
    status = F.when(F.col("_up").isNotNull() & (F.col("_up") <= F.coalesce("_down", never)), "CLOSED_STOP").when(F.col("_down").isNotNull(), "CLOSED_TARGET").when(over & enough, "CLOSED_TIME").when(over, "POSTPONED").otherwise("OPEN")
    return out.select("symbol", "ts", F.coalesce("bars", F.lit(0)).alias("bars"), status.alias("status"))
