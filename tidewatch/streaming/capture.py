"""Replay-safe capture sinks: each micro-batch owns a folder named by its number, so a batch that is delivered again, or was cut off between write and commit, replaces its own rows and nothing else.

A sink is the function of `foreachBatch`. What earlier batches have settled is read from their folders; later folders, which only a replay can meet, don't count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Sink = Callable[[DataFrame, int], None]


def _written(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before one; none where nothing is written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def _write(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def slot_of(ts: str | Column, step: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / step) * step)


CAPTURED = "symbol string, slot timestamp, ts timestamp, close double"


def once_per_slot(path: str, step: int, tolerance: int) -> Sink:
    """Keeps the first delivery of each symbol and slot for good: the earliest row of the first batch that has one. Rows that stand more than `tolerance` seconds into their slot are off cadence and skipped."""

    def sink(batch: DataFrame, number: int) -> None:
        slot = slot_of("ts", step)
        on_time = batch.select("symbol", slot.alias("slot"), "ts", "close").where(F.unix_seconds("ts") - F.unix_seconds("slot") <= tolerance)
        first = on_time.groupBy("symbol", "slot").agg(F.min(F.struct("ts", "close")).alias("_f")).select("symbol", "slot", "_f.*")
        taken = _written(batch.sparkSession, path, CAPTURED, number).select("symbol", "slot")
        _write(first.join(taken, ["symbol", "slot"], "left_anti"), path, number)

    return sink


def captures(spark: SparkSession, path: str) -> DataFrame:
    return _written(spark, path, CAPTURED).drop("batch")


DELIVERED = "symbol string, ts timestamp, slot timestamp, close double, known_at timestamp, late boolean"


def split_late(path: str, step: int, grace: int) -> Sink:
    """Judges every row against the clock as it stood before its batch, the greatest `known_at` delivered by then: a row whose slot had closed by more than `grace` seconds is late. On-time rows, late rows and clocks are tables of their own; nothing is dropped."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        clock = _written(spark, f"{path}/clock", "at timestamp", number).agg(F.max("at").alias("_clock"))
        slot = slot_of("ts", step)
        closed = F.unix_seconds(slot) + step + grace
        judged = batch.crossJoin(F.broadcast(clock)).select("symbol", "ts", slot.alias("slot"), "close", "known_at", F.coalesce(closed <= F.unix_seconds("_clock"), F.lit(False)).alias("late"))
        _write(judged.where("NOT late"), f"{path}/on_time", number)
        _write(judged.where("late"), f"{path}/late", number)
        # the clock last: without it the batch counts as not delivered
        _write(batch.agg(F.max("known_at").alias("at")).where("at IS NOT NULL"), f"{path}/clock", number)

    return sink


def slot_report(spark: SparkSession, path: str, step: int, symbols: int, *, coverage: float = 0.70, errors: float = 0.20) -> DataFrame:
    """Every slot from the first to the last one delivered: how many symbols came on time with a usable price, how many rows were late, the share of faulty rows, and the status.

    VALID; INVALID_ERRORS where more than `errors` of the on-time rows are faulty (no price above zero); INVALID_COVERAGE where fewer than `coverage` of the `symbols` are usable;
    LATE_ONLY where all came too late; MISSED where nothing came. Late rows never fill a slot.
    """
    faulty = F.coalesce(F.isnan("close") | (F.col("close") <= 0), F.lit(True))
    on_time = _written(spark, f"{path}/on_time", DELIVERED).groupBy("slot").agg(F.count_distinct(F.when(~faulty, F.col("symbol"))).alias("usable"), F.count("*").alias("rows"), F.count_if(faulty).alias("faulty"))
    late = _written(spark, f"{path}/late", DELIVERED).groupBy("slot").agg(F.count("*").alias("late_rows"))
    seen = on_time.join(late, "slot", "full")
    ends = seen.agg(F.unix_seconds(F.min("slot")).alias("a"), F.unix_seconds(F.max("slot")).alias("b"))
    grid = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("s")).select(F.timestamp_seconds("s").alias("slot"))
    zero = F.lit(0).cast("long")
    whole = grid.join(seen, "slot", "left").select("slot", *(F.coalesce(c, zero).alias(c) for c in ("usable", "rows", "faulty", "late_rows")))
    share, covered = F.col("faulty") / F.col("rows"), F.col("usable") / F.lit(symbols)
    status = F.when((F.col("rows") == 0) & (F.col("late_rows") == 0), "MISSED").when(F.col("rows") == 0, "LATE_ONLY").when(share > errors, "INVALID_ERRORS").when(covered < coverage, "INVALID_COVERAGE").otherwise("VALID")
    return whole.withColumns({"coverage": covered, "status": status})


def newest_valid(report: DataFrame) -> DataFrame:
    """The newest valid slot and how many slots have each status."""
    return report.agg(F.max(F.when(F.col("status") == "VALID", F.col("slot"))).alias("newest_valid"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("VALID", "INVALID_ERRORS", "INVALID_COVERAGE", "LATE_ONLY", "MISSED")))


def deliver(stream: DataFrame, sink: Sink, log: str) -> None:
    """Feeds a sink with all that the source holds now; called again with the same log it goes on where it stopped."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
