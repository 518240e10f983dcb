"""Candle payloads, catalogues and tickers as tables, and the checked sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.columns import finite, first_number
from tidewatch.operators.bars import integrity

FIELDS = ("open", "high", "low", "close", "volume", "amount")
PAYLOAD = "STRUCT<time ARRAY<BIGINT>, open ARRAY<STRING>, high ARRAY<STRING>, low ARRAY<STRING>, close ARRAY<STRING>, vol ARRAY<STRING>, amount ARRAY<STRING>>"
ROWS = "ARRAY<ARRAY<STRING>>"


def epoch(t: Column) -> Column:
    """Seconds or milliseconds since 1970 as a timestamp."""
    return F.timestamp_seconds(F.when(F.abs(t) > 100_000_000_000, t / 1000).otherwise(t))


def _finish(rows: DataFrame) -> DataFrame:
    """Whole bars, each time once: the first of the payload stays, and of several payloads that with the lowest ingest_seq."""
    numbers = {k: finite(F.col(k).try_cast("double")) for k in FIELDS}
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    first = F.min_by(F.struct(*FIELDS), F.struct("_seq", "_pos", *FIELDS))
    return rows.withColumns(numbers).where(whole & F.col("ts").isNotNull()).groupBy("symbol", "ts").agg(first.alias("_bar")).select("symbol", "ts", "_bar.*")


def _sequence(landed: DataFrame) -> Column:
    return (F.col("ingest_seq") if "ingest_seq" in landed.columns else F.lit(0)).cast("long").alias("_seq")


def parse_columns(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads that hold parallel arrays, as bars."""
    p = landed.select("symbol", _sequence(landed), F.from_json(payload, PAYLOAD).alias("p"))
    zipped = F.arrays_zip(F.col("p.time").alias("t"), *(F.col(f"p.{'vol' if k == 'volume' else k}").alias(k) for k in FIELDS))
    return _finish(p.select("symbol", "_seq", F.posexplode(zipped).alias("_pos", "z")).select("symbol", "_seq", "_pos", epoch(F.col("z.t")).alias("ts"), *(F.col(f"z.{k}").alias(k) for k in FIELDS)))


def parse_rows(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads that hold an array of rows [time, open, high, low, close, volume, amount], as bars."""
    z = landed.select("symbol", _sequence(landed), F.posexplode(F.from_json(payload, ROWS)).alias("_pos", "z"))
    return _finish(z.select("symbol", "_seq", "_pos", epoch(F.col("z")[0].try_cast("bigint")).alias("ts"), *(F.col("z")[i + 1].alias(k) for i, k in enumerate(FIELDS))))


def quarantine(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected ones."""
    ok = integrity(bars)
    return bars.where(ok), bars.where(~ok)


def catalogue(contracts: DataFrame, quote: str, denied: DataFrame) -> DataFrame:
    """Contracts with the reason for which each is rejected (null: accepted)."""
    marked = contracts.join(denied.select("asset").distinct().withColumn("_denied", F.lit(True)), "asset", "left")
    reason = F.when(F.col("quote") != quote, "QUOTE").when(F.col("state") != 0, "STATE").when(~F.col("perpetual"), "NOT_PERPETUAL").when(F.col("_denied"), "ASSET_TYPE")
    return marked.withColumn("reject_reason", reason).drop("_denied")


def tickers(raw: DataFrame) -> DataFrame:
    """Snapshots with several key spellings (a map column `fields`) as typed columns; the spread only where ask >= bid."""
    at = lambda *keys: first_number(*(F.element_at("fields", F.lit(k)) for k in keys))
    out = raw.select("symbol", at("last", "lastPrice").alias("last"), at("bid", "bid1").alias("bid"), at("ask", "ask1").alias("ask"), at("volume", "volume24").alias("volume"), at("funding", "fundingRate").alias("funding"))
    middle = (F.col("ask") + F.col("bid")) / 2
    return out.withColumn("spread_bps", F.when((F.col("ask") >= F.col("bid")) & (middle > 0), (F.col("ask") - F.col("bid")) / middle * 1e4))


def combine(chunks: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The last arrival of each bar within [lo, hi]."""
    w = Window.partitionBy("symbol", "ts").orderBy(F.col("ingest_seq").desc())
    return chunks.where(F.col("ts").between(lo, hi)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_checked(spark: SparkSession, path: str, schema: StructType | str, keys: list[str], flags: list[str] = ()) -> DataFrame:
    """A feature table with a declared schema; duplicate keys or flags outside 0 and 1 fail the read."""
    df = spark.read.schema(schema).parquet(path)
    bad_flag = F.lit(False)
    for f in flags:
        bad_flag = bad_flag | ~F.coalesce(F.col(f).cast("int").isin(0, 1), F.lit(False))
    seen = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(bad_flag).alias("_bad"))
    wrong = seen.agg(F.count_if(F.col("_n") > 1).alias("duplicates"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("flags")).first()
    if wrong.duplicates or wrong.flags:
        raise ValueError(f"{path}: {wrong.duplicates} duplicate keys, {wrong.flags} rows with flags outside 0 and 1")
    return df


def write_features(df: DataFrame, path: str, fields: list[str], flags: list[str], kind: str = "csv") -> None:
    """Features in a fixed column order, flags as 0 and 1, gzip."""
    own = [F.col(c).cast("int").alias(c) if c in flags else F.col(c) for c in fields]
    df.select(*own).write.mode("errorifexists").option("compression", "gzip").option("header", True).format(kind).save(path)


def write_registry(events: DataFrame, path: str, order: list[str]) -> None:
    """An event registry as gzipped JSON lines, each file in time order."""
    events.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("compression", "gzip").json(path)


def read_registry(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, or of a local session without one in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, path: str) -> DataFrame:
    """Rows written once and read from there."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_once(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Writes a new table; an existing one is an error."""
    df.write.mode("errorifexists").options(**options).format(kind).save(path)


def not_yet_loaded(expected: DataFrame, accepted: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that neither table has."""
    return expected.join(accepted.select(*keys).union(rejected.select(*keys)), keys, "left_anti")


def gather_reports(spark: SparkSession, path: str, schema: str, nested: str) -> DataFrame:
    """Rows of a nested array in all JSON reports below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(path).select(F.inline(nested))
