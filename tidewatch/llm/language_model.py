"""Katz backoff language model over word pairs, counted and evaluated in partitioned tables. ngram_tables has the model of any order.

P(w|h) = d(c) c(h,w) / c(h) if the pair occurs in the training texts, else alpha(h) P1(w); P1(w) = d1(c) c(w) / N if the word occurs, else the unigram mass that
discounting leaves, which is the probability of the unknown word. A history that never occurs backs off with weight one. d is the Good-Turing
discount of counts up to five; counts above lose a hundredth of one occurrence, so that every history has mass to back off with. alpha(h) is
exactly the mass that h leaves over the unigram mass of the words not seen after h. Where counts of counts don't allow Good-Turing
discounts, the largest usable cut-off below five is taken, and at last an absolute discount of one half.

Work is laid out so that nothing grows with the corpus in one place:

1. word counts, by Spark's aggregation; only their sum, their counts of counts and the words that hold over 1 / hot_share of all tokens, fewer than hot_share of them, come to the driver;
2. each batch of documents gives its distinct pairs with the documents that hold them, by bucket of the word (of the pair, where the word is hot);
   a bucket holds about `bucket_tokens` tokens. Buckets count pairs and words and give each batch its documents' sums back, each history its part
   of the backoff table, and the pairs of scored documents that are unseen;
3. the backoff table is settled by bucket of the history, where the unseen pairs wait for it; hot histories, fewer than hot_share, are settled apart and
   their unseen pairs spread by batch;
4. each batch adds up its documents.

Words are known by 64 bits of their hash and histories by 48, so of V words about V / 2**49 share a history with another.

Defined cases: a null text counts as empty and has the end token only; a null doc_id counts as the text '' for the split; repeated rows count and are
scored one by one; without training rows N and V are zero, base_score follows its formula and score is zero for all; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, checkpoint, id_and_bytes

K = 5
TAKEN = 0.01  # what a count above K loses
END, START = b"", b" "  # no word is either
_M48 = np.uint64((1 << 48) - 1)


def _pack(*arrays: np.ndarray) -> bytes:
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    body, at, out = zlib.decompress(blob[4 + n :]), 0, []
    for item in blob[4 : 4 + n].decode().split(";"):
        kind, size = item.split(",")
        out.append(np.frombuffer(body, kind, int(size), at))
        at += out[-1].nbytes
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the counts."""
    top = a.max(initial=0)
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def is_training(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != 0


def discounts(n: list[int]) -> list[float]:
    """d_1 .. d_K from the counts of counts n_1 .. n_{K+1}."""
    for k in range(K, 0, -1):
        if not n[0] or any(not x for x in n[: k + 1]):
            continue
        tail = (k + 1) * n[k] / n[0]
        d = [((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail) if tail < 1 else -1 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return d + [(r - TAKEN) / r for r in range(k + 1, K + 1)]
    return [(r - 0.5) / r for r in range(1, K + 1)]


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) c for each count."""
    small = np.array([0.0, *(r * x for r, x in enumerate(d, 1))])
    return np.where(counts > K, counts - TAKEN, small[np.minimum(counts, K).astype(np.int64)])


_COUNTS = "w long, n long"


def _word_counts(folds: int):
    schema = arrow_schema(_COUNTS)

    def give(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array([_hash(w) for w in counts], np.uint64).view(np.int64)), pa.array(np.array(list(counts.values()), np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if is_training(doc_id, folds):
                    counts.update((cell.as_py() or b"").lower().split())
                    counts[END] += 1
                if len(counts) > 400_000:
                    yield give(counts)
                    counts = Counter()
        yield give(counts)

    return run


_PAIRS = "bucket int, batch long, blob binary"


class _Batch:
    """Documents of one map batch, until their pairs are dealt out to buckets."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.end, self.start = self.ids[END], self.ids[START]
        self.docs: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.n = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        self.docs.append(np.array([self.start, *map(self.ids.__getitem__, (text or b"").lower().split()), self.end], np.int64))
        self.doc_ids.append(doc_id)
        self.n += len(self.docs[-1]) - 1

    def full(self) -> bool:
        return self.n >= 3_000_000 or len(self.docs) >= 1 << 16

    def blobs(self, key: int, buckets: int, hot: np.ndarray, folds: int) -> Iterator[tuple[int, int, bytes]]:
        hashes = np.array([_hash(w) for w in self.ids], np.uint64)
        lengths = np.array([len(d) - 1 for d in self.docs])
        train = np.array([is_training(d, folds) for d in self.doc_ids], np.uint8)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        yield key % buckets, key, b"D" + _pack(np.array([d or 0 for d in self.doc_ids], np.int64), known, lengths.astype(np.int64), train)
        bits = max(1, int(len(hashes) - 1).bit_length())
        key_of = [(d[1:] << (bits + 16)) | (d[:-1] << 16) | k for k, d in enumerate(self.docs)]
        rows = np.sort(np.concatenate(key_of))
        new = np.concatenate([[True], rows[1:] != rows[:-1]])
        at = np.nonzero(new)[0]
        times, rows = np.diff(np.append(at, len(rows))), rows[at]
        word, history, doc = rows >> (bits + 16), (rows >> 16) & ((1 << bits) - 1), rows & 65535
        own = (_mix(hashes) % np.uint64(buckets)).astype(np.int64)
        is_hot = np.isin(hashes, hot)
        bucket = own[word]
        spread = np.nonzero(is_hot[word])[0]
        if len(spread):
            bucket[spread] = (_mix(hashes[word[spread]] ^ _mix(hashes[history[spread]] & _M48)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
        for b in range(buckets):
            take = order[edges[b] : edges[b + 1]]
            if not len(take):
                continue
            w, h = word[take], history[take]
            pair = np.nonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]))[0]
            first = np.nonzero(np.concatenate([[True], w[pair][1:] != w[pair][:-1]]))[0]
            six = (hashes[h[pair]] & _M48).view(np.uint8).reshape(-1, 8)[:, :6].ravel()
            yield b, key, b"P" + _pack(hashes[w[pair][first]], _small(np.diff(np.append(first, len(pair)))), six, _small(np.diff(np.append(pair, len(take)))), doc[take].astype(np.uint16), _small(times[take]), train)


def _pairs(buckets: int, hot: list[int], folds: int):
    schema = arrow_schema(_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, held = TaskContext.get().partitionId() << 24, _Batch()
        hot_words = np.array(hot, np.int64).view(np.uint64)
        for batch in batches:
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.add(doc_id, cell.as_py())
                if held.full():
                    for row in held.blobs(key, buckets, hot_words, folds):
                        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema)], schema=schema)
                    key, held = key + 1, _Batch()
        if held.docs:
            for row in held.blobs(key, buckets, hot_words, folds):
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema)], schema=schema)

    return run


_OUT = "kind string, part int, batch long, blob binary"


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[tuple]]]:
    """(value, rows) of each run of equal values."""
    held, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for k, value in enumerate(batch.column(column).to_pylist()):
            if rows and value != held:
                yield held, rows
                rows = []
            held = value
            rows.append(tuple(batch.column(c)[k].as_py() for c in names))
    if rows:
        yield held, rows


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each pair a, b; first row of each group)."""
    mixed = _mix(a) ^ (b * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed)
    a, b, mixed = a[order], b[order], mixed[order]
    if len(a) > 1 and ((mixed[1:] == mixed[:-1]) & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]))).any():
        order = order[np.lexsort((b, a))]
        a, b = a[np.lexsort((b, a))], b[np.lexsort((b, a))]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _counted(n_train: int, d1: list[float], unknown: float, hot: dict[int, int], hot_histories: list[int], buckets: int):
    """Over pair blobs sorted by bucket. Hot histories leave their part of the backoff table apart (hback), and their unseen pairs go to buckets by batch."""
    schema = arrow_schema(_OUT)
    end = np.uint64(_hash(END))
    hot_keys = np.array(sorted(np.array(list(hot), np.int64).view(np.uint64).tolist()), np.uint64)
    by_hash = {int(np.int64(k).view(np.uint64)): n for k, n in hot.items()}
    hot_counts = np.array([by_hash[int(k)] for k in hot_keys], np.float64)
    hot_h = np.unique(np.array(hot_histories, np.int64).view(np.uint64) & _M48)

    def one(kind: str, part: int, batch: int, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((kind, part, batch, blob), schema)], schema=schema)

    def bucket_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, words, pairs_of, hists, sizes, docs, times, trains = [], [], [], [], [], [], [], []
        for _, key, blob in rows:
            if blob[:1] == b"D":
                yield one("head", 0, key, blob[1:])
                continue
            w, per, six, n_docs, doc, n, train = _unpack(blob[1:])
            h = np.zeros((len(six) // 6, 8), np.uint8)
            h[:, :6] = six.reshape(-1, 6)
            for to, x in zip((keys, words, pairs_of, hists, sizes, docs, times, trains), (key, w, per.astype(np.int64), h.view(np.uint64).ravel(), n_docs.astype(np.int64), doc, n, train)):
                to.append(x)
        rows.clear()
        if not keys:
            return
        seen = [np.bincount(np.repeat(np.arange(len(s)), s), weights=n * t[d], minlength=len(s)) for s, n, t, d in zip(sizes, times, trains, docs)]
        word = np.concatenate([np.repeat(w, per) for w, per in zip(words, pairs_of)])
        history, own = np.concatenate(hists), np.concatenate(seen)
        group, first = _same(word, history)
        c_pair = np.bincount(group, weights=own)
        distinct, inverse = np.unique(word, return_inverse=True)
        c_word = np.bincount(inverse, weights=own)
        if len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys, distinct), len(hot_keys) - 1)
            is_hot = hot_keys[at] == distinct
            c_word[is_hot] = hot_counts[at[is_hot]]
        p1 = np.where(c_word > 0, discounted(c_word, d1) / max(1, n_train), unknown)
        # the backoff table's part: over the training pairs of this bucket
        train_pairs = np.nonzero(c_pair > 0)[0]
        c = c_pair[train_pairs]
        h, of = np.unique(history[first[train_pairs]], return_inverse=True)
        by_count = [np.bincount(of, weights=c == r, minlength=len(h)) for r in range(1, K + 1)] + [np.bincount(of, weights=c > K, minlength=len(h))]
        columns = [h, np.bincount(of, weights=c, minlength=len(h)), *by_count, np.bincount(of, weights=p1[inverse[first[train_pairs]]], minlength=len(h))]
        home = np.where(np.isin(h, hot_h), -1, (_mix(h) % np.uint64(buckets)).astype(np.int64))
        for b in np.unique(home):
            k = home == b
            yield one("back" if b >= 0 else "hback", int(b), 0, _pack(columns[0][k], *(_small(x[k].astype(np.int64)) for x in columns[1:-1]), columns[-1][k]))
        yield one("stat", 0, 0, _pack(np.array([(c == r).sum() for r in range(1, K + 2)], np.int64)))
        # what each batch's documents gain here
        at = 0
        log_word = np.where((c_word > 0) & (distinct != end), np.log10(np.maximum(c_word, 1)), 0.0)
        log_base = np.log10(c_word + 0.1)
        for key, s, doc, n, train in zip(keys, sizes, docs, times, trains):
            pair = np.repeat(np.arange(at, at + len(s)), s)
            at += len(s)
            c, w, n, size = c_pair[group[pair]], inverse[pair], n.astype(np.float64), len(train)
            add = lambda x: np.bincount(doc, weights=n * x, minlength=size)
            rest = add(np.where(c > K, np.log10(np.maximum(c - TAKEN, 0.5)), 0.0) - log_word[w])
            sums = [add(c_word[w] > 0), *(add(c == r) for r in range(1, K + 1))]
            here = np.nonzero(np.bincount(doc, minlength=size))[0]
            yield one("doc", 0, key, _pack(here.astype(np.uint16), add(log_base[w])[here], rest[here], *(_small(x[here].astype(np.int64)) for x in sums)))
            miss = np.nonzero(c == 0)[0]
            if len(miss):
                hm = history[pair[miss]]
                home = (_mix(hm) + np.where(np.isin(hm, hot_h), np.uint64(key), np.uint64(0))) % np.uint64(buckets)
                for b in np.unique(home):
                    k = home == b
                    yield one("miss", int(b), key, _pack(hm[k], doc[miss][k], _small(n[miss][k].astype(np.int64)), np.log10(p1[w[miss][k]])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "bucket"):
            yield from bucket_rows(rows)

    return run


def _left(d2: list[float]) -> np.ndarray:
    """What discounting leaves of each count class."""
    return np.array([(1 - d) * r for r, d in enumerate(d2, 1)] + [TAKEN])


def _settled(d2: list[float], of_hot: tuple[np.ndarray, np.ndarray]):
    """Over the backoff parts and unseen pairs sorted by history bucket: what the documents gain by backing off. `of_hot` has the hot histories and their weights."""
    schema = arrow_schema("batch long, blob binary")
    left = _left(d2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "part"):
            parts = [_unpack(blob) for kind, _, _, blob in rows if kind == "back"]
            h, log_weight = (np.concatenate(x) for x in zip(backoff_weights(parts, left), of_hot))
            order = np.argsort(h)
            h, log_weight = h[order], log_weight[order]
            for kind, _, key, blob in rows:
                if kind != "miss":
                    continue
                hm, doc, n, log_p1 = _unpack(blob)
                at = np.minimum(np.searchsorted(h, hm), max(0, len(h) - 1))
                weight = np.where(h[at] == hm, log_weight[at], 0.0) if len(h) else np.zeros(len(hm))
                gain = np.bincount(doc, weights=n * (weight + log_p1))
                here = np.unique(doc)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([b"M" + _pack(here, gain[here])], pa.binary())], schema=schema)

    return run


def backoff_weights(parts: list[list[np.ndarray]], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(histories, log10(c(h) alpha(h))) from the parts of the buckets."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0)
    columns = [np.concatenate(x) for x in zip(*parts)]
    h, of = np.unique(columns[0], return_inverse=True)
    total, *by_count, p1 = (np.bincount(of, weights=x, minlength=len(h)) for x in columns[1:])
    free = sum(x * a for x, a in zip(by_count, left))  # c(h) times the mass that discounting leaves
    return h, np.log10(free / np.maximum(1 - p1, 1e-12))


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _summed(n_train: int, n_words: int, n_docs: int, d2: list[float]):
    schema = arrow_schema(_RESULT)
    classes = np.log10([r * d for r, d in enumerate(d2, 1)])
    start = np.log10(n_docs) if n_docs else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "batch"):
            doc_ids, known, lengths, train = next(_unpack(b[1:]) for _, b in rows if b[:1] == b"H")
            n = len(doc_ids)
            base, score, n_known = np.zeros(n), np.full(n, -start), np.zeros(n, np.int64)
            for _, blob in rows:
                if blob[:1] == b"M":
                    here, gain = _unpack(blob[1:])
                    score[here] += gain
                elif blob[:1] == b"S":
                    here, log_base, rest, seen, *by_count = _unpack(blob[1:])
                    base[here] += log_base
                    n_known[here] += seen
                    score[here] += rest + sum(x * c for x, c in zip(by_count, classes))
            base -= lengths * np.log10(n_train + 0.1 * (n_words + 1))
            if not n_train:
                score[:] = 0.0
            ids = pa.array(doc_ids, mask=known == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(train == 0), pa.array(lengths), pa.array(n_known), pa.array(np.full(n, n_train)), pa.array(base), pa.array(score)], schema=schema)

    return run


def score(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, bucket_tokens: int = 3_000_000, hot_share: int = 200) -> DataFrame:
    """One row for each document: its tokens, how many are known, and its log10 probability under the base and the Katz model."""
    docs = id_and_bytes(documents, id_col, text_col)
    words = docs.mapInArrow(_word_counts(folds), _COUNTS).groupBy("w").agg(F.sum("n").alias("n"))
    words = checkpoint(words)
    hot = (words.agg(F.sum("n")).first()[0] or 0) // hot_share
    counts = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct"), *(F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, K + 2)), F.collect_list(F.when(F.col("n") > hot, F.struct("w", "n"))).alias("hot"), F.sum(F.when(F.col("w") == int(np.uint64(_hash(END)).view(np.int64)), F.col("n"))).alias("docs")).first()
    n_train, n_docs = int(counts.tokens or 0), int(counts.docs or 0)
    of_counts = [counts[f"n{r}"] for r in range(1, K + 2)]
    d1 = discounts(of_counts)
    hot_words = {r.w: r.n for r in counts.hot}
    buckets = max(4, -(-n_train // bucket_tokens))
    unknown = max(1e-12, (n_train - _mass(d1, of_counts, n_train, counts.distinct)) / n_train) if n_train else 1.0
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = docs.mapInArrow(_pairs(buckets, list(hot_words), folds), _PAIRS).repartition(max(partitions, buckets), "bucket").sortWithinPartitions("bucket")
    start = int(np.uint64(_hash(START)).view(np.int64))
    found = checkpoint(pairs.mapInArrow(_counted(n_train, d1, unknown, hot_words, [*hot_words, *([start] if n_docs > hot else [])], buckets), _OUT))
    d2 = discounts(np.sum([_unpack(r.blob)[0] for r in found.where("kind = 'stat'").select("blob").toLocalIterator()] or [[0] * (K + 1)], axis=0).tolist())
    # the hot histories' parts: at most hot_share entries from each bucket, a bucket at a time
    of_hot = backoff_weights([_unpack(r.blob) for r in found.where("kind = 'hback'").select("blob").toLocalIterator()], _left(d2))
    backed = found.where("kind IN ('back', 'miss')").repartition(max(partitions, buckets), "part").sortWithinPartitions("part").mapInArrow(_settled(d2, of_hot), "batch long, blob binary")
    own = found.where("kind IN ('head', 'doc')").select("batch", F.concat(F.when(F.col("kind") == "head", F.lit("H")).otherwise("S").cast("binary"), F.col("blob")).alias("blob"))
    return own.union(backed).repartition(partitions, "batch").sortWithinPartitions("batch").mapInArrow(_summed(n_train, counts.distinct, n_docs, d2), _RESULT)


def _mass(d1: list[float], of_counts: list[int], n_train: int, distinct: int) -> float:
    """What the discounted counts of all training words sum to."""
    small = sum(r * n for r, n in zip(range(1, K + 1), of_counts))
    above = distinct - sum(of_counts[:K])
    return sum(r * n * d for r, n, d in zip(range(1, K + 1), of_counts, d1)) + (n_train - small) - TAKEN * above
