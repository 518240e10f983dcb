"""Katz backoff of any order in Spark tables.

The same model as language_model, which lays pairs of words out in packed buckets, but with the order as a parameter, words as text and every level a table of
its own: table k holds each training n-gram of k words with its discounted probability, weight k each history with its backoff weight. A token is
evaluated recursively: by table k if its n-gram is there, else by the history's weight times the evaluation one word shorter; a history that never
occurs has weight one. Distinct n-grams are evaluated once and joined back to the documents' tokens.

Rows of these tables take a multiple of the packed form's disk and time, so the registered query uses that form. Keys that hold over a thousandth of a
table's rows are broadcast in lookups; counts are combined before they are shuffled.

Defined cases: as in language_model.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ASCII_LOWER, checkpoint, fold_of
from tidewatch.llm.language_model import K, TAKEN, discounts

START, END = "\t", "\n"  # words hold no white space


class Model(NamedTuple):
    order: int
    tokens: int
    words: int
    unknown: float
    counts: DataFrame  # g, c: words and how often they occur
    tables: dict[int, DataFrame]  # k -> g, h, p
    weights: dict[int, DataFrame]  # k -> h, log_weight, n (k from 2 on)


def events(documents: DataFrame, order: int, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row for each distinct n-gram of each document: row, doc_id, held_out, g<order> (the words, the last one to be predicted) and n."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.expr(ASCII_LOWER.format(f"coalesce(cast(`{text_col}` as string), '')")).alias("text"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    padded = F.concat(F.array(*(F.lit(START) for _ in range(order - 1))), words, F.array(F.lit(END)))
    laid = rows.select("row", "doc_id", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), padded.alias("w"))
    gram = F.transform(F.sequence(F.lit(1), F.size("w") - (order - 1)), lambda i: F.array_join(F.slice("w", i, order), " "))
    return checkpoint(laid.select("row", "doc_id", "held_out", F.explode(gram).alias("g")).groupBy("row", "doc_id", "held_out", "g").agg(F.count("*").alias("n")))


def _shorter(gram: Column, words: int) -> Column:
    """The last `words` words of an n-gram."""
    return F.substring_index(gram, " ", -words)


def _history(gram: Column) -> Column:
    """All words but the last."""
    return F.regexp_extract(gram, "(?s)^(.*) [^ ]*$", 1)


def _kept(c: Column, d: list[float]) -> Column:
    """d(c) c."""
    out = c - TAKEN
    for r, x in enumerate(d, 1):
        out = F.when(c == r, r * x).otherwise(out)
    return out


def _of_counts(counts: DataFrame) -> list[int]:
    row = counts.agg(*(F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2))).first()
    return [int(row[f"n{r}"]) for r in range(1, K + 2)]


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """Rows with the row of the table that has their key, or nulls. Keys of over 1 / share of all rows are broadcast."""
    hot = F.broadcast(table.where(F.col(n) * share > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(n) * share <= total), key, "left")
    return rows.join(hot, key).unionByName(rest)


def fit(grams: DataFrame, order: int) -> Model:
    """The model of the events of training rows."""
    top = grams.where("NOT held_out").groupBy("g").agg(F.sum("n").alias("c"))
    counts = {order: checkpoint(top)}
    for k in range(order - 1, 0, -1):
        counts[k] = checkpoint(counts[k + 1].groupBy(_shorter(F.col("g"), k).alias("g")).agg(F.sum("c").alias("c")))
    total = counts[1].agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).first()
    tokens = int(total.tokens or 0)
    d = {k: discounts(_of_counts(counts[k])) for k in counts}
    tables = {1: checkpoint(counts[1].select("g", F.lit("").alias("h"), (_kept(F.col("c"), d[1]) / max(1, tokens)).alias("p")))}
    mass = tables[1].agg(F.sum("p")).first()[0] or 0.0
    unknown = max(1e-12, 1 - mass) if tokens else 1.0
    weights: dict[int, DataFrame] = {}
    for k in range(2, order + 1):
        own = counts[k].select("g", _history(F.col("g")).alias("h"), "c", _shorter(F.col("g"), k - 1).alias("s"))
        lower = tables[k - 1].select(F.col("g").alias("s"), F.col("p").alias("p_lower"))
        with_lower = own.join(lower, "s")
        by_h = with_lower.groupBy("h").agg(F.sum("c").alias("c_h"), F.sum(_kept(F.col("c"), d[k])).alias("kept"), F.sum("p_lower").alias("lower"), F.count("*").alias("n"))
        by_h = checkpoint(by_h.select("h", "c_h", F.log10(((F.col("c_h") - F.col("kept")) / F.col("c_h")) / F.greatest(1 - F.col("lower"), F.lit(1e-12))).alias("log_weight"), "n"))
        weights[k] = by_h.select("h", "log_weight", "n")
        n_rows = by_h.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        tables[k] = checkpoint(looked_up(own.select("g", "h", "c"), by_h.select("h", "c_h", "n"), "h", "n", n_rows).select("g", "h", (_kept(F.col("c"), d[k]) / F.col("c_h")).alias("p")))
    return Model(order, tokens, int(total.words or 0), unknown, counts[1], tables, weights)


def evaluated(distinct: DataFrame, model: Model) -> DataFrame:
    """g and log_p, its log10 probability, for distinct n-grams g of the model's order."""
    out, total = distinct.select("g", F.lit(None).cast("double").alias("log_p"), F.lit(0.0).alias("owed")), max(1, distinct.count())
    for k in range(model.order, 0, -1):
        own = out.withColumns({"s": _shorter(F.col("g"), k), "h": _history(_shorter(F.col("g"), k)) if k > 1 else F.lit("")})
        waits, done = own.where("log_p IS NULL"), own.where("log_p IS NOT NULL")
        held = model.tables[k].select(F.col("g").alias("s"), "p", F.lit(1).alias("one"))
        hit = waits.join(held, "s", "left")
        if k == 1:
            met = hit.withColumn("log_p", F.col("owed") + F.log10(F.coalesce("p", F.lit(model.unknown))))
        else:
            hit = looked_up(hit.drop("one"), model.weights[k], "h", "n", total)
            met = hit.withColumn("log_p", F.col("owed") + F.log10("p")).withColumn("owed", F.when(F.col("p").isNull(), F.col("owed") + F.coalesce("log_weight", F.lit(0.0))).otherwise(F.col("owed")))
        out = checkpoint(done.select("g", "log_p", "owed").unionByName(met.select("g", "log_p", "owed")))
    return out.select("g", "log_p")


def score(documents: DataFrame, order: int = 3, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row for each document, as language_model.score gives it, by a model of this order."""
    grams = events(documents, order, id_col=id_col, text_col=text_col, folds=folds)
    model = fit(grams, order)
    log_p = evaluated(grams.select("g").distinct(), model)
    words = model.counts.select(F.col("g").alias("w"), "c")
    per_gram = log_p.withColumn("w", _shorter(F.col("g"), 1)).join(words, "w", "left").select("g", "log_p", F.coalesce("c", F.lit(0)).alias("c"))
    joined = grams.join(per_gram, "g")
    base = F.log10((F.col("c") + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
    total = F.sum(F.col("n") * F.col("log_p")) if model.tokens else F.lit(0.0)
    return joined.groupBy("row", "doc_id", "held_out").agg(F.sum("n").alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.sum(F.col("n") * base).alias("base_score"), total.alias("score")).drop("row")
