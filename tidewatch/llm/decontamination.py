"""Benchmark decontamination with a Wu-Manber search over words.

Words are the runs of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. Every run of `window` words of a benchmark item is a
pattern; an item of fewer words is one pattern. For each length of pattern, a table of shifts, indexed by the hash of a block of two words, tells how far
the search may jump; a collision only shortens a jump. Where a block may end a pattern, the search stops, the hash of the window there selects the test
strings, and direct comparison of the words confirms an occurrence.

Only the tables of shifts reach driver and tasks as a whole: at most `slots` bytes for each of the `window` lengths. Patterns stay a table, which joins the
windows where the search stopped; it is broadcast while it has at most `broadcast_patterns` rows, and joins by shuffle beyond that. Where the
patterns are so many that the tables are full, the search stops more often, and results stay the same.

Defined cases: a null or empty text has no words and no hits; benchmark rows with a null id or text are left out; repeated benchmark rows count
once; repeated documents are judged one by one; a null doc_id stays null; an empty benchmark leaves all clean; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, checkpoint, id_and_bytes, without

_KEEP = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEEP).split()


def _block(words: list[bytes], end: int, size: int, mask: int) -> int:
    """The slot of the block that ends before position `end`."""
    return xxhash.xxh64_intdigest(b" ".join(words[end - size : end])) & mask


def shifts_of(words: list[bytes], mask: int) -> Iterator[tuple[int, int]]:
    """(slot, shift) of each block of one pattern."""
    n, size = len(words), min(2, len(words))
    for end in range(size, n + 1):
        yield _block(words, end, size, mask), n - end


def stops(words: list[bytes], length: int, table: bytes) -> Iterator[int]:
    """Where a pattern of this length may start. `table` has the shift of each slot; its size is a power of two."""
    size, mask, end, n = min(2, length), len(table) - 1, length, len(words)
    digest = xxhash.xxh64_intdigest
    while end <= n:
        shift = table[digest(b" ".join(words[end - size : end])) & mask]
        if shift:
            end += shift
        else:
            yield end - length
            end += 1


_PATTERNS = "length int, key long, words binary, item string"


def _patterns(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The distinct patterns of each item: their length, the hash of their words and the words themselves."""
    schema = arrow_schema(_PATTERNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, cell in zip(b.column("item").to_pylist(), b.column("text")):
                words = words_of(cell.as_py())
                for start in range(max(1, len(words) - window + 1)) if words else ():
                    own = words[start : start + window]
                    line = b" ".join(own)
                    rows.append((len(own), _signed(line), line, item))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    return checkpoint(items.mapInArrow(run, _PATTERNS).distinct())


#: Into how many tasks the documents of one window are dealt where patterns join by shuffle.
_PARTS = 8


def _signed(line: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(line)).view(np.int64))


def _tables(patterns: DataFrame, slots: int) -> dict[int, bytes]:
    """The table of shifts of each length of pattern, reduced by Spark to one number for each slot."""
    schema = arrow_schema("length int, slot int, shift int")
    mask = slots - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, slot, shift) for n, line in zip(b.column("length").to_pylist(), b.column("words")) for slot, shift in shifts_of(line.as_py().split(b" "), mask)]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    least = patterns.select("length", "words").distinct().mapInArrow(run, "length int, slot int, shift int").groupBy("length", "slot").agg(F.min("shift").alias("shift")).toArrow()
    out = {}
    lengths, slot, shift = (least.column(k).to_numpy() for k in ("length", "slot", "shift"))
    for n in np.unique(lengths).tolist():
        table = np.full(slots, n - min(2, n) + 1, np.uint8)
        table[slot[lengths == n]] = shift[lengths == n]
        out[n] = table.tobytes()
    return out


_SCANNED = "row string, doc_id long, n_words long, found array<struct<start:long,length:int,key:long,words:binary>>"


def _scanning(tables):
    schema = arrow_schema(_SCANNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words, found = words_of(cell.as_py()), []
                for length, table in tables.value.items():
                    for start in stops(words, length, table):
                        line = b" ".join(words[start : start + length])
                        found.append({"start": start, "length": length, "key": _signed(line), "words": line})
                n += 1
                rows.append((f"{task}-{n}", doc_id, len(words), found))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, hit_share: int = 20, slots: int = 1 << 20, broadcast_patterns: int = 1_000_000) -> DataFrame:
    """One row for each document: words, words hit, items that occur, and contaminated (any hit and hit_share * n_hit >= n_words). `slots` is a power of two."""
    sc = documents.sparkSession.sparkContext
    patterns = _patterns(benchmark, item_col, item_text_col, window)
    scanned = checkpoint(id_and_bytes(documents, id_col, text_col).mapInArrow(_scanning(sc.broadcast(_tables(patterns, slots))), _SCANNED))
    # windows, each once however many items hold it, confirm the stops; items are looked up for each document's distinct windows
    windows = patterns.select("key", "words").distinct()
    stopped = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    if patterns.count() <= broadcast_patterns:
        hits = stopped.join(F.broadcast(windows), ["key", "words"])
        held = lambda df: df.join(F.broadcast(patterns.select("key", "words", "item")), ["key", "words"])
    else:
        # a window that very many documents hold meets them in several tasks
        parts = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
        dealt = stopped.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(_PARTS)).cast("int"))
        hits = dealt.join(parts(windows), ["key", "words", "part"])
        held = lambda df: df.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(_PARTS)).cast("int")).join(parts(patterns.select("key", "words", "item")), ["key", "words", "part"])
    hits = checkpoint(hits.select("row", "start", "length", "key", "words"))
    # spans in order; a word counts once however many spans hold it
    start = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("covered"))

    def step(acc, s):
        end = s["start"] + s["length"]
        return F.struct(F.greatest(acc["reach"], end).alias("reach"), (acc["covered"] + F.greatest(end - F.greatest(s["start"], acc["reach"]), F.lit(0))).alias("covered"))

    of_items = held(hits.select("row", "key", "words").distinct()).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_row = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans")).join(of_items, "row")
    counted = by_row.select("row", F.aggregate("spans", start, step, lambda acc: acc["covered"]).alias("hit"), "items")
    both = scanned.select("row", "doc_id", "n_words").join(counted, "row", "left")
    n_hit, items = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (hit_share * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns. Rows whose doc_id is null stay; rows with one doc_id stay or go together."""
    return without(documents, contamination(documents, benchmark, **options).where("contaminated").select("doc_id").distinct(), options.get("id_col", "doc_id"))
