"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs: a table of (url, blocked), or, without one, the URLs that the rules decide. Features are lengths, depth, digit
ratios, character entropy, parameter counts and suffix statistics, the smoothed share of blocked URLs under the last one and the last two labels of the host
among the labelled ones. A training row's own label is taken out of its shares. Training takes at most `max_training` distinct labelled URLs, those with the lowest hash, each weighted by its number of rows; suffix
statistics and verdicts cover all.

Defined cases: a null URL or one without `://` has an empty host and path, matches no rule and is judged like any other; if the labels hold
one class only, or none, the verdict is that class (allow without labels); repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the production rules: (host/path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, _, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    kinds = F.transform(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), lambda c: n - F.length(F.replace(u, c, F.lit(""))))
    entropy = F.aggregate(kinds, F.lit(0.0), lambda a, k: a - (k / n) * F.log2(k / n))
    count = lambda pattern, of: F.regexp_count(of, F.lit(pattern)).cast("double")
    return {
        "url_length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": count("/[^/]+", path), "labels": count("[^.]+", host), "digit_ratio": count("[0-9]", u) / n, "host_digits": count("[0-9]", host), "hyphens": count("-", host),
        "parameters": count("[?&][^=&#]+=", u), "fragment": u.contains("#").cast("double"), "percent": count("%", u), "https": u.startswith("https:").cast("double"), "entropy": entropy,
    }


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def judge(pages: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_training: int = 20_000, trees: int = 12, depth: int = 4, smoothing: float = 20.0, suffix_rows: int = 50_000) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score (probability of block) for each row."""
    parts = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).withColumns({"rule": rule, "says": says})
    if labelled is None:
        marked = rows.where("says IS NOT NULL").select("url", "host", "path", (F.col("says") == "block").cast("double").alias("label"))
    else:
        marked = parts(labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", F.col("blocked").cast("double").alias("label")))
    totals = marked.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first()
    out = ["page_id", "host", "path", "rule"]
    if not totals.n or totals.mean in (0.0, 1.0):
        method = F.lit("block" if totals.mean == 1.0 else "allow")
        return rows.select(*out, F.coalesce("says", method).alias("verdict"), F.lit(float(totals.mean or 0.0)).alias("score"))

    def with_suffixes(df: DataFrame, own_n: Column, own_label: Column) -> DataFrame:
        """The share of blocked URLs under each suffix and how many there are, without the row's own ones."""
        for labels in (1, 2):
            seen = marked.groupBy(_suffix(F.col("host"), labels).alias(f"suffix{labels}")).agg(F.sum("label").alias("_s"), F.count("*").alias("_n"))
            if small[labels]:
                seen = F.broadcast(seen)
            n, s = F.coalesce("_n", F.lit(0)) - own_n, F.coalesce("_s", F.lit(0.0)) - own_n * own_label
            joined = df.withColumn(f"suffix{labels}", _suffix(F.col("host"), labels)).join(seen, f"suffix{labels}", "left")
            df = joined.withColumns({f"blocked{labels}": (s + smoothing * totals.mean) / (n + smoothing), f"seen{labels}": F.log1p(n)}).drop("_s", "_n")
        return df

    small = {k: marked.select(_suffix(F.col("host"), k)).distinct().limit(suffix_rows + 1).count() <= suffix_rows for k in (1, 2)}
    features = _features(F.col("url"), F.col("host"), F.col("path"))
    names = [*features, "blocked1", "seen1", "blocked2", "seen2"]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    distinct = marked.groupBy("url", "label").agg(F.count("*").cast("double").alias("weight"))
    sample = parts(distinct.orderBy(F.xxhash64("url"), "url", "label").limit(max_training))
    training = assembler.transform(with_suffixes(sample, F.col("weight"), F.col("label")).withColumns(features)).select("features", "label", "weight").repartition(2).cache()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=32, weightCol="weight").fit(training)
    training.unpersist()
    undecided = assembler.transform(with_suffixes(rows, F.lit(0), F.lit(0.0)).withColumns(features))
    scored = model.transform(undecided).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*out, F.coalesce("says", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
