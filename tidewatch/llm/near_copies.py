"""Near copies by the Jaccard similarity of word shingles: the second pass of the pipeline's near-dedup stage, for copies that differ in more bits than SimHash fingerprints link.

Each distinct text has a MinHash signature over its set of `words`-word shingles, cut into bands. Texts that share a band meet the smallest text of that band's bucket, so a
bucket of n texts gives n - 1 candidates and never all its pairs, and every candidate is verified by the exact similarity of the two sets. With 12
bands of 5 rows, a pair of similarity 0.8 shares a band with a probability of 0.99.

Sets of shingles are made only for texts that are candidates. A text that many others meet is repeated for every `chunk` of them, and a task holds its set and
one other at a time. Texts go by a digest of 128 bits, so copies of a text count as one.

Defined cases: words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer words is one shingle, and texts without words (null, empty) link to nothing
here. Rows with a null id take no part. Repeated rows count once; an id with several texts joins their classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, checkpoint, id_and_bytes
from tidewatch.llm.simhash import components, joined_by

_MULTIPLIERS = np.random.default_rng(8).integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NO_HASHES = np.zeros(0, np.uint64)


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    own = (text or b"").lower().split()
    if not own:
        return _NO_HASHES
    line = b" ".join(own)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist())), np.uint64, len(own) - words + 1))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """The least value of the set under each of `size` mixings, taken over pieces of the set so that memory stays bounded."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            piece = hashes[at : at + 4096, None] * _MULTIPLIERS[:size]
            piece ^= piece >> np.uint64(29)
            out = np.minimum(out, (piece * _MULTIPLIERS[-1]).min(0))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _texts(documents: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, digest of the text and the keys of its bands, for texts with words."""
    ddl = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, digest binary, keys array<long>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, cell in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = cell.as_py()
                hashes = shingles(text, words)
                if len(hashes):
                    least = signature(hashes, bands * rows).reshape(bands, rows)
                    keys = np.fromiter((xxhash.xxh64_intdigest(least[k].tobytes(), k) for k in range(bands)), np.uint64, bands).view(np.int64)
                    out.append((doc_id, xxhash.xxh3_128_digest(text), keys))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return documents.mapInArrow(run, ddl)


def _sets(documents: DataFrame, words: int) -> DataFrame:
    """digest and set of shingles of each row."""
    schema = arrow_schema("digest binary, hashes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column("text"):  # one text at a time: a set may be as large as its text
                text = cell.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(text)], pa.binary()), pa.array([shingles(text, words).tobytes()], pa.binary())], schema=schema)

    return documents.mapInArrow(run, "digest binary, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """The pairs (centre, other) whose sets are similar enough."""
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    dealt = pairs.join(sizes, "centre").select("centre", "other", F.pmod(F.xxhash64("other"), F.col("chunks")).alias("chunk"))
    centres = dealt.select("centre", "chunk").distinct().select("centre", "chunk", F.lit(0).alias("role"), F.col("centre").alias("digest"))
    rows = centres.unionByName(dealt.select("centre", "chunk", F.lit(1).alias("role"), F.col("other").alias("digest"))).join(sets, "digest")
    schema = arrow_schema("a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, _NO_HASHES
        for b in batches:
            found = []
            for centre, part, role, digest, hashes in zip(*(b.column(c).to_pylist() for c in ("centre", "chunk", "role", "digest")), b.column("hashes")):
                values = np.frombuffer(hashes.as_py(), np.uint64)
                if role == 0:
                    at, own = (centre, part), values
                elif at == (centre, part) and jaccard(own, values) >= similarity:
                    found.append((centre, digest))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], schema=schema)

    return rows.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "role").select("centre", "chunk", "role", "digest", "hashes").mapInArrow(run, "a binary, b binary").distinct()


def classes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 12, rows: int = 5, chunk: int = 500) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) of every document that has a near copy; links are pairs of a similarity of at least `similarity`, or equal texts."""
    own = id_and_bytes(documents, id_col, text_col).where("doc_id IS NOT NULL")
    marked = checkpoint(_texts(own, bands, rows, words))
    texts = marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"))
    banded = checkpoint(texts.select("digest", F.explode("keys").alias("key")))
    buckets = banded.groupBy("key").agg(F.min("digest").alias("centre"), F.count("*").alias("n")).where("n > 1")
    total = banded.count()
    pairs = checkpoint(joined_by(banded, buckets, "key", "n", max(1, total)).where("digest <> centre").select("centre", F.col("digest").alias("other")).distinct())
    wanted = pairs.select(F.col("centre").alias("digest")).union(pairs.select(F.col("other").alias("digest"))).distinct()
    # a row for each text that is a candidate
    whole = own.join(marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(wanted, "digest").select("doc_id").distinct(), "doc_id", "left_semi")
    sets = checkpoint(_sets(whole, words).join(wanted, "digest", "left_semi").dropDuplicates(["digest"]))
    links = _verified(pairs, sets, similarity, chunk)
    # an id joins its texts, a text its ids, links join texts: all as one graph over text digests
    ids = marked.select("doc_id", "digest").distinct()
    shared = ids.join(ids.groupBy("doc_id").agg(F.min("digest").alias("a"), F.count("*").alias("m")).where("m > 1"), "doc_id").select("a", F.col("digest").alias("b"))
    roots = components(links.union(shared))
    placed = ids.join(roots, ids.digest == roots.vertex, "left").withColumn("root", F.coalesce("root", "digest"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    return joined_by(placed.select("doc_id", "root"), least, "root", "n", max(1, total)).select("doc_id", "component_id").distinct()
