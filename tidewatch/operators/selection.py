"""Sorting, top-k, sampling, deduplication, cohorts and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= k)


def capped_top(rows: DataFrame, keys: list[str], cluster: str, order: list[Column], cap: int, k: int) -> DataFrame:
    """At most `cap` rows of a cluster, then the first k of the key; the cap only drops rows, so two ranks suffice."""
    capped = rows.withColumn("_in_cluster", F.row_number().over(Window.partitionBy(*keys, cluster).orderBy(*order))).where(F.col("_in_cluster") <= cap).drop("_in_cluster")
    return top_per_group(capped, keys, order, k)


def hash_sample(rows: DataFrame, keys: list[str], identity: list[str], n: int, salt: str) -> DataFrame:
    """The n rows of each key with the lowest SHA-256 of salt and identity."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), *(F.col(c).cast("string") for c in identity)), 256)
    return top_per_group(rows.withColumn("digest", digest), keys, [F.col("digest")], n)


def quota_shortlist(rows: DataFrame, identity: str, lists: list[tuple[str, int]], total: int) -> DataFrame:
    """Fills a shortlist from ranked lists (score column, quota) in turn, no row twice. Each list is a bounded top-n, so nothing is ranked as a whole."""
    chosen = None
    for k, (score, quota) in enumerate(lists):
        rest = rows if chosen is None else rows.join(chosen.select(identity), identity, "left_anti")
        best = rest.orderBy(F.col(score).desc_nulls_last(), identity).limit(quota).withColumn("list", F.lit(k).cast("long"))
        chosen = best if chosen is None else chosen.unionByName(best)
    return chosen.orderBy("list", identity).limit(total)


def dedupe(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a fixed order, so results repeat."""
    return top_per_group(rows, keys, order, 1).drop("position")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cohort_check(expected: DataFrame, found: DataFrame, key: str, *, most: int | None = None) -> DataFrame:
    """MISSING and UNEXPECTED keys, and, where `most` is given, DUPLICATE ones, which are found on more than that many rows."""
    missing = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("MISSING"))
    extra = found.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("UNEXPECTED"))
    out = missing.unionByName(extra)
    if most is None:
        return out
    often = found.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, F.lit("DUPLICATE").alias("problem"))
    return out.unionByName(often)


def fingerprint(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """An order-insensitive digest of each key's rows: two sums of halves of their hashes and the count, which combine on the map side."""
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)
    half = lambda a: F.conv(F.substring("_d", a, 8), 16, 10).cast("long")
    return rows.withColumn("_d", digest).groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(half(1)).alias("low"), F.sum(half(9)).alias("high"))


def chronological_split(rows: DataFrame, t: Column, first: int, last: int, share: float, embargo: int) -> DataFrame:
    """discovery before the cut, purged within the embargo before it, holdout from it on."""
    cut = first + int((last - first) * share)
    return rows.withColumn("split", F.when(t >= cut, "holdout").when(t >= cut - embargo, "purged").otherwise("discovery"))


def hash_partition(key: Column, n: int) -> Column:
    """A deterministic part of a key from its SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("long"), F.lit(n))
