"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits over word shingles. Two fingerprints link when at most four bits differ. It is cut into three segments of 22, 21 and 21
bits. Each fits the perfect binary Golay code [23, 12, 7], whose decoder maps any 23 bits to the one codeword within three errors. The keys of a
segment are the codeword indices of itself and of its one-bit neighbours; there are one or six, and two segments that differ in up to two bits
share one.

Pigeonhole over four errors in three segments leaves two cases, and each has its own kind of key:

* some segment has no error, so of the other two one has two errors at most: the exact segment with a key of the other (six ordered pairs);
* no segment is free of errors, so two segments have one error each: a key of either. One error flips the parity of a segment, so
  the side of even parity gives its own codeword only, the side of odd parity gives all its keys, and only opposite parities meet.

Fingerprints that share a key are compared in full. A bucket gives edges of a spanning forest of its links, never all pairs of a group. A bucket
of more than `block` fingerprints is cut into ceil(count / block) blocks and dealt out as pairs of blocks to other tasks; a pair holds at most 2 * `block`
fingerprints, so no task holds a bucket as a whole. Components come from
alternating large-star and small-star steps over the edges.

Defined cases: a null text counts as empty; without words the fingerprint is zero and links like any other; repeated rows and rows with a null
doc_id take part by their text; component_id is the smallest doc_id that is not null (null if there is none). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, checkpoint, id_and_bytes, without

#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 4
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the polynomial of the [23, 12, 7] code


def _remainders() -> np.ndarray:
    """The syndrome of each single bit of 23."""
    out = []
    for bit in range(23):
        value = 1 << bit
        for k in range(22, 10, -1):
            if value >> k & 1:
                value ^= _GENERATOR << (k - 11)
        out.append(value)
    return np.array(out, dtype=np.int32)


class Golay:
    """Decodes arrays of 23-bit words to codeword indices of 12 bits."""

    def __init__(self) -> None:
        bits = _remainders()
        self.low, self.high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
        for table, first in ((self.low, 0), (self.high, 12)):
            for k in range(int(np.log2(len(table)))):
                table[1 << k : 2 << k] = table[: 1 << k] ^ bits[first + k]
        self.error = np.zeros(1 << 11, np.int32)
        for i in range(23):
            self.error[bits[i]] = 1 << i
            for j in range(i):
                self.error[bits[i] ^ bits[j]] = 1 << i | 1 << j
                for k in range(j):
                    self.error[bits[i] ^ bits[j] ^ bits[k]] = 1 << i | 1 << j | 1 << k

    def index(self, words: np.ndarray) -> np.ndarray:
        words = words.astype(np.int32)
        return (words ^ self.error[self.low[words & 4095] ^ self.high[words >> 12]]) >> 11

    def keys(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct indices of each word and its one-bit neighbours, as (row, index)."""
        flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int32)
        near = np.sort(self.index(words.astype(np.int32)[:, None] ^ flips), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(new)
        return row, near[row, column]


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Bit k is one if it is set in over half of the shingles' hashes."""
    return int(_fingerprints([text], width)[0])


def _fingerprints(texts: list[bytes | None], width: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    hashes: list[int] = []
    counts, rows = [], []

    def settle() -> None:
        if not rows:
            return
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.int64), axis=0, dtype=np.int32)
        out[rows] = ((2 * sums > np.array(counts)[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        hashes.clear(), counts.clear(), rows.clear()

    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        n = len(words)
        if not n:
            continue
        line = b" ".join(words)
        if n <= width:
            own = [digest(line, 42)]
        else:
            ends, at = [], -1
            for w in words:
                at += len(w) + 1
                ends.append(at)
            starts = [0, *(e + 1 for e in ends)]
            own = [digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :])]
        hashes.extend(own)
        counts.append(len(own))
        rows.append(i)
        if len(hashes) > 200_000:
            settle()
    settle()
    return out


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and the 64-bit fingerprint as a signed long, for each row."""
    schema = arrow_schema("doc_id long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text")
            values = np.concatenate([_fingerprints([x.as_py() for x in column[k : k + 500]], width) for k in range(0, len(column), 500)]) if len(column) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values.view(np.int64))], schema=schema)

    return id_and_bytes(documents, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


_KEYED = "key long, fp long, side int"
_KEYED_SCHEMA = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("side", pa.int32())])
_PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _keys_of(fps: np.ndarray, golay: Golay) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, row of fps, side). Side 0 meets itself; sides 1 and 2 meet each other."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
    near = [golay.keys(p, w) for p, (_, w) in zip(parts, SEGMENTS)]
    kind = 0
    for a in range(3):
        for b in range(3):
            if a != b:
                row, index = near[b]
                yield (np.int64(kind) << 40) | parts[a][row] << 12 | index, row, np.zeros(len(row), np.int32)
                kind += 1
    odd = [np.array([bin(x).count("1") & 1 for x in range(1 << 12)], np.int64)]
    parity = [odd[0][p & 4095] ^ odd[0][p >> 12] for p in parts]
    own = [golay.index(p).astype(np.int64) for p in parts]
    n = len(fps)
    lists = []
    for s in range(3):
        row, index = near[s]
        stays = parity[s][row] == 1
        even = np.nonzero(parity[s] == 0)[0]
        row, index = np.concatenate([row[stays], even]), np.concatenate([index[stays].astype(np.int64), own[s][even]])
        order = np.argsort(row, kind="stable")
        lists.append((row[order], index[order], np.bincount(row, minlength=n)))
    for a, b in ((0, 1), (0, 2), (1, 2)):
        (row_a, index_a, _), (_, index_b, count_b) = lists[a], lists[b]
        times = count_b[row_a]
        row = np.repeat(row_a, times)
        first = np.concatenate([[0], np.cumsum(count_b)])[row_a]
        at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        tag = parity[a][row] ^ parity[b][row]
        yield (np.int64(kind) << 40) | np.repeat(index_a, times) << 13 | index_b[at] << 1 | tag, row, (1 + parity[a][row]).astype(np.int32)
        kind += 1


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for key, row, side in _keys_of(fps, golay):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64)), pa.array(side)], schema=_KEYED_SCHEMA)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)  # of unsigned values; for signed ones it would count the bits of the absolute value


def _forest(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges that connect whatever links join: within left, or between left and right. A breadth-first walk compares each one once with what is left."""
    edges: list[tuple[int, int]] = []
    if right is None:
        waiting = left
        while len(waiting):
            front, waiting = waiting[:1], waiting[1:]
            while len(front) and len(waiting):
                at, front = front[0], front[1:]
                near = _differing(waiting, at) <= RADIUS
                if near.any():
                    found = waiting[near]
                    edges.extend((int(at), int(x)) for x in found)
                    front, waiting = np.concatenate([front, found]), waiting[~near]
        return edges
    unseen = [left, right]
    while len(unseen[0]) and len(unseen[1]):
        fronts = [unseen[0][:1], unseen[1][:0]]
        unseen[0] = unseen[0][1:]
        while len(fronts[0]) or len(fronts[1]):
            s = 0 if len(fronts[0]) else 1
            at, fronts[s] = fronts[s][0], fronts[s][1:]
            near = _differing(unseen[1 - s], at) <= RADIUS
            if near.any():
                found = unseen[1 - s][near]
                edges.extend((int(at), int(x)) for x in found)
                fronts[1 - s], unseen[1 - s] = np.concatenate([fronts[1 - s], found]), unseen[1 - s][~near]
    return edges


_EDGES = "a long, b long, key long, part long, side int"


def _bucket_edges(block: int):
    """Over rows sorted by key: edges of small buckets; rows of larger ones again, with their block (part) of the key."""
    schema = arrow_schema(_EDGES)

    def table(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(rows, schema)], schema=schema)

    def finish(key: int, fps: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
        fps = fps.view(np.uint64)
        return _forest(fps, None) if side[0] == 0 else _forest(fps[side == 1], fps[side == 2])

    def deal(key: int, first: int, fps: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        """The fingerprints from number `first` of the key on, each in its own block."""
        n = len(fps)
        return table([fps, np.full(n, None), np.full(n, key), (first + np.arange(n)) // block, side])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_key, held_n, large = None, 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if held_n > 1 and not large:
                edges = finish(held_key, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                if edges:
                    a, b = zip(*edges)
                    yield table([_signed(a), _signed(b), [None] * len(a), [None] * len(a), [None] * len(a)])

        for batch in batches:
            key, fp, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "side"))
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
            sizes = np.diff(cuts)
            interior = np.ones(len(sizes), bool)
            interior[0] = interior[-1] = False
            pairs = cuts[:-1][interior & (sizes == 2)]
            if len(pairs):
                near = (_differing(fp[pairs].view(np.uint64), fp[pairs + 1].view(np.uint64)) <= RADIUS) & ((side[pairs] == 0) | (side[pairs] != side[pairs + 1]))
                a, b = fp[pairs][near], fp[pairs + 1][near]
                if len(a):
                    yield table([a, b, [None] * len(a), [None] * len(a), [None] * len(a)])
            edges: list[tuple[int, int]] = []
            for k in np.nonzero(~interior | (sizes > 2))[0]:
                lo, hi = cuts[k], cuts[k + 1]
                if not interior[k] or hi - lo > block:
                    if key[lo] != held_key:
                        yield from close()
                        held, held_key, held_n, large = [], key[lo], 0, False
                    held.append((fp[lo:hi], side[lo:hi]))
                    held_n += hi - lo
                    if held_n > block:
                        large = True
                    if large:
                        fps, sides = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                        yield deal(int(held_key), held_n - len(fps), fps, sides)
                        held = []
                else:
                    edges += finish(int(key[lo]), fp[lo:hi], side[lo:hi])
            if edges:
                a, b = zip(*edges)
                yield table([_signed(a), _signed(b), [None] * len(a), [None] * len(a), [None] * len(a)])
        yield from close()

    return run


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, part): the edges of each pair of blocks."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    at = None

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            fps, side = np.concatenate([x for x, _ in held]).view(np.uint64), np.concatenate([x for _, x in held])
            edges = _forest(fps, None) if side[0] == 0 else _forest(fps[side == 1], fps[side == 2])
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(a)), pa.array(_signed(b))], schema=_PAIR_SCHEMA)

    for batch in batches:
        key, part, fp, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "a", "side"))
        if not len(key):
            continue
        cuts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))[0] + 1, [len(key)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if (key[lo], part[lo]) != at:
                yield from close()
                held, at = [], (key[lo], part[lo])
            held.append((fp[lo:hi], side[lo:hi]))
    yield from close()


def _pairs_of_blocks(large: DataFrame) -> DataFrame:
    """Rows of large buckets (key, part, a, side), each for all pairs of blocks that hold its own; part is then the pair's number."""
    blocks = F.broadcast(large.groupBy("key").agg((F.max("part") + 1).alias("blocks")))
    other = large.join(blocks, "key").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return other.select("key", (F.least("part", "other") * F.col("blocks") + F.greatest("part", "other")).alias("part"), "a", "side")


def edges_between(fps: DataFrame, *, block: int = 4096) -> DataFrame:
    """Edges a, b over distinct fingerprints; their components are those of all links."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.mapInArrow(_keyed, _KEYED).repartition(n, "key").sortWithinPartitions("key")
    found = checkpoint(keyed.mapInArrow(_bucket_edges(block), _EDGES))
    dealt = _pairs_of_blocks(found.where("key IS NOT NULL").select("key", "part", "a", "side")).repartition(n, "key", "part").sortWithinPartitions("key", "part")
    return found.where("key IS NULL").select("a", "b").union(dealt.mapInArrow(_block_edges, "a long, b long")).distinct()


def joined_by(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """Rows with the one row of their key. Keys that hold over 1 / share of all rows (column n of per_key counts them), of which there are fewer than `share`, are broadcast, so that none comes together in one task."""
    hot = F.broadcast(per_key.where(F.col(n) * share > total))
    return rows.join(hot, key).union(rows.join(hot.select(key), key, "left_anti").join(per_key.where(F.col(n) * share <= total), key))


def _spread(edges: DataFrame, least: DataFrame, parts: int = 8) -> DataFrame:
    """Edges with the one row of their u. A vertex of very many neighbours meets them in `parts` tasks, as its row is repeated for each part of them."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
    return dealt.join(least.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), ["u", "part"]).drop("part")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """vertex and root (the smallest vertex that it reaches), for each vertex of an edge. Vertices may be of any type that has an order."""
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    measured = lambda: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = measured()
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _spread(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _spread(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpoint(small)
        now = measured()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "vertex")
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, block: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row."""
    prints = checkpoint(fingerprints(documents, id_col=id_col, text_col=text_col, width=width))
    # a fingerprint is named by its smallest doc_id, so that the root of a component is its id; one without any comes last
    name = F.struct(F.col("first").isNull().alias("no_id"), "first", "fp").alias("name")
    first = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).select("fp", "n", name))
    total = int(first.agg(F.sum("n")).first()[0] or 0)
    found = checkpoint(edges_between(first.select("fp"), block=block))
    by_fp = lambda side: first.select(F.col("fp").alias(side), F.col("name").alias(f"{side}_name"))
    edges = found.join(by_fp("a"), "a").join(by_fp("b"), "b").select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))
    roots = components(edges)
    classes = first.join(roots, first.name == roots.vertex, "left").select("fp", "n", F.coalesce(F.col("root.first"), F.col("name.first")).alias("component_id"))
    return joined_by(prints, classes, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component stays: the one whose id is component_id. Rows with a null id stay; so do all rows that repeat the id that stays."""
    return without(documents, near_duplicates(documents, id_col=id_col, **options).where("doc_id <> component_id").select("doc_id").distinct(), id_col)
