"""Ranked lexical search over blocks of documents with a range-maximum sparse table for each posting list.

One pass over the documents keeps, for each, its number of terms and the postings (term, occurrences) of the terms that any item asks for; documents,
terms and document frequencies are counted over all rows. A block of documents then gets its posting lists, each posting with its exact share of a score,
and a sparse table that names the greatest posting of any range of a list in two lookups. The search of an item starts from the block as one interval.
The sum of its terms' range maxima bounds every document in an interval; the best intervals are taken first, each is split at the document with the
greatest single share, which is scored exactly, and halves whose bound can't reach the item's k-th best are dropped. The k best of an item go on
from block to block of a task, so later blocks start with a high floor. Documents in a block are ordered by their strongest term, which keeps alike
documents in one interval and bounds tight.

A task holds one block (`block` documents and their postings) and k rows of each item. The items' terms reach the tasks in batches of at most `most_pairs` pairs
of item and term (one item at least), each batch with its own pass, so what is broadcast doesn't grow with the items. The last step keeps the k best
for each item and part, then for each item.

All arithmetic is exact in 64-bit integers: a document of n terms among N documents with L terms has m = 50 + 50 * n * N div L, a term with tf occurrences
weighs floor(1000 * ln((2N + 2) / (2 df + 1))) times 10^9 * tf div (1000 * tf + 20 * m).

Defined cases: terms are runs of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A null or empty text has no terms; such documents count
nowhere. Rows of one item_id are one item with the terms of all; a null item_id is an item too. Repeated documents are ranked each by itself; equal
scores go by ascending doc_id, nulls last. Items without terms, or whose terms occur nowhere, and empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import arrow_schema, checkpoint, id_and_bytes
from tidewatch.llm.decontamination import words_of

_IDS, _TFS = np.dtype("<u4"), np.dtype("<u4")


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's occurrences in a document count, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Posting lists of a block's documents, one after the other, and one sparse table over them; ranges never leave a list."""

    def __init__(self, rows: list[tuple], weights: np.ndarray, norm: tuple[int, int]):
        """`rows` are (doc_id, n, ids, tfs); `norm` is (N, L)."""
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        ids, tfs = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in (2, 3))
        m = 50 + np.array([50 * r[1] * norm[0] // norm[1] for r in rows], np.int64)
        shares = weights[ids] * share(tfs, np.repeat(m, sizes))
        # documents by their strongest term
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        best = np.repeat(np.maximum.reduceat(shares, starts), sizes)
        lead = np.minimum.reduceat(np.where(shares == best, ids, len(weights)), starts)
        order = np.argsort(lead, kind="stable")
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        self.doc_ids = [rows[k][0] for k in order]
        self.n = len(rows)
        # lists by term, each by document; a key is term * n + document
        keys = ids * self.n + np.repeat(rank, sizes)
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.shares = keys[by_key], shares[by_key]
        self.lengths = np.bincount(ids, minlength=len(weights))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.table = [np.arange(len(keys), dtype=np.int32)]
        width = 1
        while 2 * width <= self.lengths.max():
            left, right = self.table[-1][:-width], self.table[-1][width:]
            self.table.append(np.where(self.shares[left] >= self.shares[right], left, right))
            width *= 2
        # one array, so that lookups of different widths are one operation
        self.offsets = np.concatenate([[0], np.cumsum([len(level) for level in self.table])])[:-1]
        self.table = np.concatenate(self.table)

    def greatest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and share of the greatest posting in each [low, high); an empty range has share 0."""
        length = high - low
        level = np.frexp(np.maximum(length, 1))[1] - 1
        at = self.offsets[level]
        left, right = self.table[at + np.where(length > 0, low, 0)], self.table[at + np.where(length > 0, high - (1 << level), 0)]
        arg = np.where(self.shares[left] >= self.shares[right], left, right)
        return arg, np.where(length > 0, self.shares[arg], 0)

    def search(self, terms: np.ndarray, best: Best, width: int = 64) -> None:
        """Offers every document that can be among the best. Takes up to `width` intervals at once, best bounds first."""
        terms = terms[self.lengths[terms] > 0]
        if not len(terms):
            return
        base = (terms * self.n)[:, None]

        def measured(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Bounds of intervals and the documents to split them at."""
            arg, most = self.greatest(low, high)
            lead = most.argmax(0)
            columns = np.arange(most.shape[1])
            return most.sum(0), self.keys[arg[lead, columns]] - base[lead, 0]

        low, high = self.starts[terms][:, None], self.starts[terms + 1][:, None]
        bound, split = measured(low, high)
        while True:
            keep = bound >= max(best.floor, 1)
            if not keep.any():
                return
            if not keep.all():
                low, high, bound, split = low[:, keep], high[:, keep], bound[keep], split[keep]
            if len(bound) > width:
                cut = np.argpartition(-bound, width)
                now, rest = cut[:width], cut[width:]
                waiting = low[:, rest], high[:, rest], bound[rest], split[rest]
                low, high, split = low[:, now], high[:, now], split[now]
            else:
                waiting = None
            at = np.searchsorted(self.keys, base + split)
            there = np.minimum(at, len(self.keys) - 1)
            hit = (at < high) & (self.keys[there] == base + split)
            best.offer(np.where(hit, self.shares[there], 0).sum(0), split, self.doc_ids)
            low, high = np.concatenate([low, at + hit], 1), np.concatenate([at, high], 1)
            bound, split = measured(low, high)
            if waiting is not None:
                low, high, bound, split = (np.concatenate([a, b], -1) for a, b in zip((low, high, bound, split), waiting))


class Best:
    """The k best documents of an item: highest scores, equal ones by ascending id, nulls last."""

    def __init__(self, k: int):
        self.k, self.heap, self.floor, self._n = k, [], 0, 0

    def offer(self, scores: np.ndarray, documents: np.ndarray, ids: list) -> None:
        for k in np.flatnonzero(scores >= max(self.floor, 1)).tolist():
            doc_id = ids[documents[k]]
            self._n += 1
            # the least entry of the heap is the worst: lowest score, then null, then greatest id
            entry = (int(scores[k]), doc_id is not None, _Descending(doc_id), self._n)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)
            if len(self.heap) == self.k:
                self.floor = self.heap[0][0]


class _Descending:
    """Orders values the other way round."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return self.value is not None and other.value is not None and other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


_POSTINGS = "n long, ids binary, tfs binary"


def _postings(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, and the postings of the vocabulary's terms by their number, of each document that has a term."""
    ddl = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {_POSTINGS}"
    schema = arrow_schema(ddl)
    known = documents.sparkSession.sparkContext.broadcast({term: k for k, term in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for b in batches:
            rows = []
            for doc_id, cell in zip(b.column("doc_id").to_pylist(), b.column("text")):
                if words := words_of(cell.as_py()):
                    counts = Counter(map(number, words))
                    counts.pop(None, None)
                    ids = sorted(counts)
                    rows.append((doc_id, len(words), np.array(ids, _IDS).tobytes(), np.array([counts[t] for t in ids], _TFS).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return documents.mapInArrow(run, ddl)


def _frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""
    schema = arrow_schema("term int, df long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for cell in b.column("ids"):
                counts[np.frombuffer(cell.as_buffer(), _IDS)] += 1
        term = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(counts[term])], schema=schema)

    found = postings.select("ids").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def _asked(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """The distinct (item, term) pairs."""
    own = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    ddl = f"item {own.schema['item'].dataType.simpleString()}, term binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(item, term) for item, cell in zip(b.column("item").to_pylist(), b.column("text")) for term in set(words_of(cell.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*pairs) if pairs else [[], []], schema)], schema=schema)

    return own.mapInArrow(run, ddl).distinct()


def _batches(asked: DataFrame, most_pairs: int) -> tuple[DataFrame, int]:
    """The pairs with their batch: as few batches as keep each within `most_pairs`, or with one item."""
    batches = 1
    while True:
        dealt = asked.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)))
        sizes = dealt.groupBy("batch", "item").agg(F.count(F.lit(1)).alias("pairs")).groupBy("batch").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("items"))
        if not sizes.where((F.col("pairs") > most_pairs) & (F.col("items") > 1)).limit(1).count():
            return dealt, batches
        batches *= 2


def rank(documents: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = 8192, most_pairs: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = documents.sparkSession
    own = id_and_bytes(documents, id_col, text_col)
    asked, batches = _batches(checkpoint(_asked(items, item_col, item_text_col)), most_pairs)
    ddl = f"item_id {asked.schema['item'].dataType.simpleString()}, doc_id {own.schema['doc_id'].dataType.simpleString()}, score long"
    found, norm = spark.createDataFrame([], ddl), None
    for batch in range(batches):
        queries: dict = {}
        vocabulary: dict[bytes, int] = {}
        for item, term in zip(*(c.to_pylist() for c in asked.where(F.col("batch") == batch).select("item", "term").toArrow().columns)):
            queries.setdefault(item, []).append(vocabulary.setdefault(bytes(term), len(vocabulary)))
        if not queries:
            continue
        postings = checkpoint(_postings(own, list(vocabulary)))
        if norm is None:
            norm = tuple(postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())
            if not norm[0]:
                break
        weights = np.array([weight(norm[0], df) for df in _frequencies(postings, len(vocabulary)).tolist()], np.int64)
        found = found.unionByName(_searched(postings, weights, {item: np.array(sorted(terms)) for item, terms in queries.items()}, norm, k, block, ddl))
    # k best of each part, then of all
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(postings: DataFrame, weights: np.ndarray, queries: dict, norm: tuple[int, int], k: int, block: int, ddl: str) -> DataFrame:
    """The k best documents of each item in each task."""
    schema = arrow_schema(ddl)
    shared = postings.sparkSession.sparkContext.broadcast((weights, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        best = {item: Best(k) for item in queries}

        def settle(rows: list[tuple]) -> None:
            index = Block(rows, weights, norm)
            for item, terms in queries.items():
                index.search(terms, best[item])

        held: list[tuple] = []
        for b in batches:
            for doc_id, n, ids, tfs in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids"), b.column("tfs")):
                if len(ids.as_buffer() or b""):
                    held.append((doc_id, n, np.frombuffer(ids.as_py(), _IDS), np.frombuffer(tfs.as_py(), _TFS)))
                    if len(held) == block:
                        settle(held)
                        held = []
        if held:
            settle(held)
        for item, own in best.items():
            rows = [(item, entry[2].value, entry[0]) for entry in own.heap]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return postings.mapInArrow(run, ddl)
