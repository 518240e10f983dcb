"""Secret scan with multipart credential linking, in DataFrame functions only.

Three strong kinds are always reported: assignments of a password or key (assign), access identifiers (access) and long hexadecimal runs (hex).
Three weak kinds alone prove nothing: a bare run of 40 base64 characters (weak_secret), a role or session identifier (weak_id) and a service
URL (endpoint). They are linked by an interval join: within one document, parts whose starts lie at most `scope` code points apart share a
scope. A weak secret is reported if an identifier or an endpoint shares its scope, a weak identifier if a secret does, an endpoint if both
an identifier and a secret do.

Positions are code points, ends exclusive. Matches of a kind are leftmost and do not overlap.

Defined cases: a null text counts as empty; repeated rows and rows with a null doc_id are scanned one by one, each within its own text; other
columns are ignored. Work in a text is linear in its spans; a very long text with many parts is dealt over scope buckets in the join, so no
pair further apart than a scope is compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import checkpoint

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> pattern, in the order in which spans of one start are listed
STRONG = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
WEAK = {"weak_secret": r"[A-Za-z0-9/+]{40,}", "weak_id": r"(ASIA|AROA|AIDA)[A-Z0-9]{16,}", "endpoint": r"(https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"}
_ORDER = {k: i for i, k in enumerate((*STRONG, *WEAK))}
_SPAN = "struct<start:long,ord:int,end:long,kind:string>"
SCOPE = 300


def _keeps(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6
    if kind == "weak_secret":
        return (F.length(match) == 40) & match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
    if kind == "weak_id":
        return F.length(match) == 20
    return F.lit(True)


#: kind -> (whether letters count in either case, texts of which any match holds one): a search for these is far cheaper than a pattern.
_ANCHORS = {
    "assign": (True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    "access": (False, ("AKIA",)),
    "weak_id": (False, ("ASIA", "AROA", "AIDA")),
    "endpoint": (False, ("://",)),
}
_PART = 64


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, also where fn uses it in lambdas."""
    return F.transform(F.array(value), fn)[0]


def may_hold(text: Column, kind: str) -> Column:
    """False only for texts without a match of the kind."""
    if kind not in _ANCHORS:
        return text.rlike(r"[A-Za-z0-9/+]{24}")  # hex and weak_secret are such runs; Catalyst evaluates the shared test once
    either_case, anchors = _ANCHORS[kind]
    held = F.lower(text) if either_case else text
    return reduce(or_, (F.contains(held, F.lit(a)) for a in anchors))


def spans_of(text: Column, kind: str, pattern: str) -> Column:
    """The spans of one kind: texts between the matches and the matches themselves are laid end to end.

    Positions are summed within parts of 64 pieces and then over the parts, so that work grows with the number of matches and not with its square.
    """
    piece_length = lambda p: (F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).cast("long")
    none = F.array().cast(f"array<{_SPAN}>")

    def within(part: Column, offset: Column) -> Column:
        start = F.struct(offset.alias("at"), none.alias("spans"))

        def step(acc: Column, piece: Column) -> Column:
            begin = acc["at"] + F.length(piece["gap"])
            end = begin + F.coalesce(F.length(piece["hit"]), F.lit(0))
            span = F.struct(begin.alias("start"), F.lit(_ORDER[kind]).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"))
            keep = piece["hit"].isNotNull() & _keeps(kind, piece["hit"])
            return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(part, start, step, lambda acc: acc["spans"])

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, p: a + piece_length(p)))
        offsets = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return let(offsets, lambda at: F.flatten(F.transform(parts, lambda part, k: within(part, at[k]))))

    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    parts = let(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _PART).cast("int")), lambda k: F.slice(p, k * _PART + 1, _PART)))
    return F.when(may_hold(text, kind), F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)).otherwise(none)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cells(spans: DataFrame, scope: int) -> DataFrame:
    """Each span once for each bucket of `scope` code points that it touches."""
    return spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s.start") / scope), F.floor((F.col("s.end") - 1) / scope))))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """row and the array of weak spans that complementary parts in their scope confirm. A bucket holds a bounded number of spans, so pairs stay few."""
    spans = parts.select("row", F.explode("parts").alias("s"))
    strong, weak = spans.where(F.col("s.ord") < len(STRONG)), spans.where(F.col("s.ord") >= len(STRONG))
    # a strong span that a weak one repeats is no second part
    covers = _cells(strong, scope).select("row", "bucket", F.col("s.start").alias("from"), F.col("s.end").alias("to"))
    repeats = _cells(weak, scope).join(covers, ["row", "bucket"]).where("from < s.end AND s.start < to").select("row", "s")
    own = weak.join(repeats, ["row", "s"], "left_anti")
    role = F.when(F.col("s.kind").isin("access", "weak_id"), "id").when(F.col("s.kind") == "endpoint", "endpoint").otherwise("secret")
    placed = lambda df: df.select("row", "s", role.alias("role"), F.floor(F.col("s.start") / scope).alias("bucket"))
    near = placed(strong.union(own)).select("row", F.col("s.start").alias("other_start"), F.col("role").alias("other"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    met = placed(own).join(near, ["row", "bucket"]).where((F.abs(F.col("s.start") - F.col("other_start")) <= scope) & (F.col("role") != F.col("other")))
    has = {r: F.max(F.col("other") == r) for r in ("id", "secret", "endpoint")}
    seen = met.groupBy("row", "s", "role").agg(*(v.alias(f"has_{k}") for k, v in has.items()))
    reported = F.when(F.col("role") == "secret", F.col("has_id") | F.col("has_endpoint")).when(F.col("role") == "id", F.col("has_secret")).otherwise(F.col("has_id") & F.col("has_secret"))
    return seen.where(reported).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("linked"))


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each document: doc_id, strong (array of spans) and linked (weak spans that are confirmed)."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), *(spans_of(F.col("text"), k, p).alias(k) for k, p in (STRONG | WEAK).items()))
    strong = F.array_sort(F.concat(*STRONG))
    base = checkpoint(found.select("row", "doc_id", strong.alias("strong"), F.concat(*WEAK).alias("weak")))
    parts = base.where(F.size("weak") > 0).select("row", F.concat("strong", "weak").alias("parts"))
    return base.join(_linked(parts, scope), "row", "left").select("row", "doc_id", "strong", F.coalesce("linked", F.array().cast(f"array<{_SPAN}>")).alias("linked"))


def report(documents: DataFrame, **options) -> DataFrame:
    """The scan as counts, the digest of the strong spans and the list of all spans."""
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long")
    return scan(documents, **options).select("doc_id", *(count(k).alias(f"n_{k}") for k in STRONG), F.sha2(listed(F.col("strong")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("strong", "linked"))).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


_CELL = 4096


def _masked_few(text: Column, spans: Column, mask: str) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def _masked_many(rows: DataFrame, mask: str) -> DataFrame:
    """row and masked of texts with many spans: the text is cut into cells, each cell masks its part of the spans, and the cells are joined again."""
    before = F.max("s.end").over(Window.partitionBy("row").orderBy("s.start", "s.end").rowsBetween(Window.unboundedPreceding, -1))
    spans = rows.select("row", F.explode("spans").alias("s")).select("row", "s.start", F.greatest("s.start", F.coalesce(before, F.lit(0))).alias("from"), F.col("s.end").alias("to"), before.alias("before")).where("from < to")
    cell = F.explode(F.sequence(F.floor(F.col("from") / _CELL), F.floor((F.col("to") - 1) / _CELL)))
    cut = spans.withColumn("cell", cell).select(
        "row", F.col("cell").cast("int").alias("cell"),
        F.struct(F.greatest(F.col("from") - F.col("cell") * _CELL, F.lit(0)).cast("int").alias("from"), F.least(F.col("to") - F.col("cell") * _CELL, F.lit(_CELL)).cast("int").alias("to"), ((F.col("start") >= F.coalesce("before", F.lit(0))) & (F.floor(F.col("from") / _CELL) == F.col("cell"))).alias("first")).alias("piece"),
    ).groupBy("row", "cell").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    texts = rows.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{_CELL}}}"), F.lit(0))).alias("cell", "part")).join(cut, ["row", "cell"], "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, p: F.struct(p["to"].alias("at"), F.concat(acc["out"], F.substring("part", acc["at"] + 1, p["from"] - acc["at"]), F.when(p["first"], F.lit(mask)).otherwise("")).alias("out"))
    masked = F.when(F.col("pieces").isNull(), F.col("part")).otherwise(F.aggregate("pieces", start, step, lambda acc: F.concat(acc["out"], F.substring("part", acc["at"] + 1, F.lit(_CELL)))))
    cells = texts.select("row", F.struct("cell", masked.alias("out")).alias("c")).groupBy("row").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    return cells.select("row", F.array_join("cells.out", "").alias("masked"))


def redact(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", few: int = 256, **options) -> DataFrame:
    """The documents with each reported span replaced by the mask; overlapping spans share one mask.

    Spans come back by doc_id and the text's hash and length, so rows that repeat an id keep to the spans of their own text. Texts with over `few`
    spans are masked cell by cell, which gives the same texts.
    """
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.length(text).alias("length"))
    found = scan(documents.select(key.alias("doc_id"), text.alias("text")), **options)
    spans = found.select(F.col("doc_id").alias("key"), F.array_sort(F.concat("strong", "linked")).alias("spans")).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    keyed = documents.select(F.struct(*(F.col(c) for c in documents.columns)).alias("doc"), key.alias("key"), text.alias("text"))
    joined = keyed.alias("d").join(spans.alias("s"), F.col("d.key").eqNullSafe(F.col("s.key")), "left").select("doc", "text", "spans")
    short = joined.where(F.col("spans").isNull() | (F.size("spans") <= few)).select("doc", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_masked_few(F.col("text"), F.col("spans"), mask)).alias("masked"))
    long = spans.where(F.size("spans") > few).select(F.col("key").alias("row"), "spans")
    rows = keyed.alias("d").join(long.select("row").alias("l"), F.col("d.key").eqNullSafe(F.col("l.row"))).select("doc", "row", "text")
    many = _masked_many(rows.select("row", "text").dropDuplicates(["row"]).join(long, "row"), mask)
    out = short.union(rows.join(many, "row").select("doc", "masked"))
    return out.select(*(F.col("masked").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in documents.columns))
