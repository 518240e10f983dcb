"""Token-id files coded by a static range asymmetric numeral system.

Documents are encoded by a tokenizer file, an end id follows each, and their ids are stored in ascending order of doc_id. One frequency table over
all ids is shared by all blocks. A block holds whole documents of about `block_ids` ids and decodes on its own: its ids are dealt over interleaved
lanes, checkpoints give the state of all lanes every `interval` steps with the checksum of the ids up to the next one, so that parts of it decode
in parallel too (`read_parts`), and a checksum guards the whole. A folder has `blocks` (one row for each block: bucket, block, first position in its bucket, ids and lengths of its documents, payload)
and `frequencies`. Spark's writer commits both, so a lost executor leaves no half file.

Where the tokenizer file has the form of `encodes_by_words`, white space always separates tokens, and each worker keeps the ids of words that it has
met; a word is encoded by the tokenizers library once. The store has a bound and starts anew when it is full, which costs time only. Texts of any other
file go to the library as a whole.

Defined cases: a null text counts as empty and has the end id only; a null doc_id sorts first; documents that share a doc_id follow each other in the
order of their ids, or of a hash of these and then their ids where they are so many that they get several buckets; an empty table gives no blocks and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, checkpoint, id_and_bytes, shared_folder

SCALE, LOW = 20, 31
LANES, INTERVAL, BLOCK_IDS = 4096, 128, 1 << 20
_HEAD = struct.Struct("<4sQIIQII")
_MARK = struct.Struct("<IQI")
_MAGIC = b"TKR2"


def normalised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least one for each id that occurs."""
    total, size = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.int64)
    out = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total))), 0).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    rest = size - int(out.sum())
    at = 0
    while rest:  # spare slots go to the most frequent ids, missing ones come from them
        k = order[at % len(order)]
        step = 1 if rest > 0 else -1
        if out[k] > 1 or step > 0 and out[k]:
            change = step * max(1, min(abs(rest), int(out[k]) // 8))
            out[k] += change
            rest -= change
        at += 1
    return out


class Coder:
    """Encodes and decodes blocks of ids by one frequency table."""

    def __init__(self, frequencies: np.ndarray, lanes: int = LANES, interval: int = INTERVAL) -> None:
        self.freq = frequencies.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - SCALE)
        self.lanes, self.interval = lanes, interval
        self._slots: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> bytes:
        n, lanes = len(ids), self.lanes
        steps = -(-n // lanes)
        states = np.full(lanes, 1 << LOW, np.uint64)
        words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
        marks: dict[int, np.ndarray] = {}
        scale, half, mask = np.uint64(SCALE), np.uint64(32), np.uint64(0xFFFFFFFF)
        freq, first, limit = self.freq[ids], self.first[ids], self.limit[ids]
        for t in range(steps - 1, -1, -1):
            lo, hi = t * lanes, min(n, (t + 1) * lanes)
            x, f = states[: hi - lo], freq[lo:hi]
            over = np.nonzero(x >= limit[lo:hi])[0]
            if len(over):
                words[t] = (x[over] & mask).astype(np.uint32)
                x[over] >>= half
            q = x // f
            x[:] = (q << scale) + (x - q * f) + first[lo:hi]
            if t % self.interval == 0:
                marks[t] = states.copy()
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.uint64)
        stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
        raw, size = ids.astype("<u4").tobytes(), 4 * lanes * self.interval
        heads = (_MARK.pack(t, int(offsets[t]), zlib.crc32(raw[k * size : (k + 1) * size])) + marks[t].astype("<u8").tobytes() for k, t in enumerate(sorted(marks)))
        body = b"".join(heads) + stream.astype("<u4").tobytes()
        return _HEAD.pack(_MAGIC, n, lanes, self.interval, len(stream), len(marks), zlib.crc32(body)) + body

    @staticmethod
    def parts(payload: bytes) -> int:
        """How many checkpoints a block has."""
        return _HEAD.unpack_from(payload)[5]

    @staticmethod
    def part_size(payload: bytes) -> int:
        """How many ids lie between two checkpoints."""
        return _HEAD.unpack_from(payload)[2] * _HEAD.unpack_from(payload)[3]

    def decode(self, payload: bytes, part: int | None = None) -> np.ndarray:
        """All ids, or those from checkpoint `part` up to the next one. Each part starts from its own checkpoint and is held against its checksum."""
        magic, n, lanes, interval, n_words, n_marks, crc_body = _HEAD.unpack_from(payload)
        body = memoryview(payload)[_HEAD.size :]
        if magic != _MAGIC or zlib.crc32(body) != crc_body:
            raise ValueError("the block is damaged")
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        size = _MARK.size + 8 * lanes
        stream = np.frombuffer(body, "<u4", n_words, n_marks * size)
        chosen = range(n_marks) if part is None else [part]
        return np.concatenate([np.zeros(0, np.uint32), *(self._part(body[k * size : (k + 1) * size], stream, n, lanes, interval) for k in chosen)])

    def _part(self, mark: memoryview, stream: np.ndarray, n: int, lanes: int, interval: int) -> np.ndarray:
        t0, at, crc = _MARK.unpack_from(mark)
        states = np.frombuffer(mark, "<u8", lanes, _MARK.size).astype(np.uint64)
        end = min(-(-n // lanes), t0 + interval)
        out = np.empty(min(n, end * lanes) - t0 * lanes, np.uint32)
        scale, half, mask, low = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1), np.uint64(1 << LOW)
        for t in range(t0, end):
            lo, hi = t * lanes, min(n, (t + 1) * lanes)
            x = states[: hi - lo]
            slot = x & mask
            ids = self._slots[slot]
            out[lo - t0 * lanes : hi - t0 * lanes] = ids
            x[:] = self.freq[ids] * (x >> scale) + slot - self.first[ids]
            need = np.nonzero(x < low)[0]
            if len(need):
                x[need] = (x[need] << half) | stream[at : at + len(need)]
                at += len(need)
        if zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("the ids don't match their checksum")
        return out


_SAFE = re.compile(r"[\x21-\x7e¡-įı-ɏ]+")
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_chars() -> list[str]:
    """The characters that byte-level pre-tokenizers write for bytes: printable ones for themselves, the rest from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
    return [rest.get(b, chr(b)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


def _lowered(text: bytes) -> bytes:
    """A-Z in lower case, unless a combining mark could join a letter first or a special token could stand in the text."""
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


class _Words(dict):
    """Ids of words as bytes; a missing word is encoded when it is met. What is still in use moves on from the older generation."""

    def __init__(self, coder: WordCoder, old: dict | None = None) -> None:
        super().__init__()
        self.coder, self.old = coder, old or {}

    def __missing__(self, word: bytes) -> bytes:
        out = self.old.get(word)
        if out is None:
            if word.isalpha():  # ASCII letters only
                out = self.coder.piece(word.decode().lower())
            elif word[-1:] in _ENDS and word[:-1].isalpha():
                out = self[word[:-1]] + self[word[-1:]]
            else:
                out = self.odd(word, word.decode())
        self[word] = out
        return out

    def odd(self, word: bytes, text: str) -> bytes:
        """Words with digits, marks or letters beyond ASCII."""
        if b"<|" in word or not (word.isascii() and text.isprintable() or _SAFE.fullmatch(text)):
            return self.coder.library(text)
        if text.isalpha():
            return self.coder.piece(text.lower())
        if word[-1:] in _ENDS and text[:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        pieces = _PRE.findall(text.lower())
        return self.coder.piece(pieces[0]) if len(pieces) == 1 else b"".join([self[p.encode()] for p in pieces])


_ENDS = frozenset((b".", b",", b";", b":", b"!", b"?"))


#: The only form of tokenizer whose words can be encoded apart: what normalises and pre-tokenises it, as its file says.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZER = [{"type": "Split", "pattern": {"Regex": _PRE.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
_WORD_END = "</w>"


def encodes_by_words(path: str) -> bool:
    """Whether the tokenizer file has the form whose words can be encoded apart."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model = made["model"]
    own = (made.get("normalizer") or {}).get("normalizers"), (made.get("pre_tokenizer") or {}).get("pretokenizers")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    return own == (_NORMALIZER, _PRE_TOKENIZER) and plain and model.get("end_of_word_suffix") == _WORD_END and all(t["content"].startswith("<|") for t in made.get("added_tokens") or [])


class WordCoder:
    """Ids of texts by a tokenizer file: through a bounded store of words where its form allows that, else by the library, text by text."""

    _kept: dict[str, WordCoder] = {}

    def __init__(self, path: str, most: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.tokenize = self.tokenizer.model.tokenize
        self.names = [np.array([k], self.kind).tobytes() for k in range(n)]
        self.by_words = encodes_by_words(path)
        self.most, self.words = most, _Words(self)

    @classmethod
    def of(cls, path: str) -> WordCoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def piece(self, piece: str) -> bytes:
        """A pre-token that normalisation leaves as it is goes to the tokenizer's model at once, as byte-level characters."""
        tokens = self.tokenize(piece if piece.isascii() else "".join([_BYTE_CHARS[b] for b in piece.encode()]))
        names = self.names
        return names[tokens[0].id] if len(tokens) == 1 else b"".join([names[t.id] for t in tokens])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.by_words:
            return [self.library((t or b"").decode()) for t in texts]
        if len(self.words) > self.most:
            self.words.old = {}
            self.words = _Words(self, self.words)
        get = self.words.__getitem__
        return [b"".join(map(get, _lowered(t or b"").split())) for t in texts]


_IDS = "bucket int, doc_id long, ids binary"
_BLOCKS = "bucket int, block int, start long, doc_ids array<long>, lengths array<long>, payload binary"
_DEALT = "bucket int, block int, part int, payload binary"
_PARTS = "bucket int, block int, part int, start long, ids array<int>"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Places:
    """Numbers buckets in the order of the file from `cuts`, ids that cut the rows into equal shares, and the share of null ids, which come first.

    An id that is several of the cuts is on so many rows that it gets as many buckets of its own, as null ids do by their share: a hash of the row's token ids picks one.
    """

    def __init__(self, cuts: list[int], nulls: int = 0) -> None:
        times = Counter(cuts)
        self.bounds, self.nulls, self.below, self.own, number = sorted(times), max(1, nulls), [], {}, max(1, nulls)
        for b in self.bounds:
            self.below.append(number)
            number += 1
            if times[b] > 1:
                self.own[b] = (number, times[b])
                number += times[b]
        self.below.append(number)

    def of(self, doc_id: int | None, ids: bytes) -> int:
        if doc_id is None:
            return self._part(ids, self.nulls)
        if doc_id in self.own:
            first, parts = self.own[doc_id]
            return first + self._part(ids, parts)
        return self.below[bisect_left(self.bounds, doc_id)]

    @staticmethod
    def _part(ids: bytes, parts: int) -> int:
        return xxhash.xxh64_intdigest(ids) * parts >> 64 if parts > 1 else 0


def token_ids(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, places: Places | None = None, buckets: int = 1) -> DataFrame:
    """bucket (by `places`), doc_id and the ids as bytes, for each row. Each task adds the counts of its ids, as a row of a bucket below -1."""
    schema, places = arrow_schema(_IDS), places or Places([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = WordCoder.of(tokenizer)
        end = np.array([end_id], coder.kind).tobytes()
        counts = np.zeros(max(coder.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = [x + end for x in coder.encode([c.as_py() for c in part.column("text")])]
                counts += np.bincount(np.frombuffer(b"".join(ids), coder.kind), minlength=len(counts))
                in_buckets = [places.of(d, x) for d, x in zip(part.column("doc_id").to_pylist(), ids)]
                yield pa.RecordBatch.from_arrays([pa.array(in_buckets, pa.int32()), part.column("doc_id"), pa.array(ids, pa.binary())], schema=schema)
        row = (-2 - TaskContext.get().partitionId() % buckets, None, counts.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema)], schema=schema)

    return id_and_bytes(documents, id_col, text_col).mapInArrow(run, _IDS)


def _counted():
    """Over the counts of tasks: the sum of each id."""
    schema = arrow_schema("id int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column("ids"):
                own = np.frombuffer(cell.as_py(), np.int64)
                total = own + (total if len(total) else 0)
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], schema=schema)

    return run


def _blocked(kind: str, frequencies, block_ids: int):
    schema = arrow_schema(_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies.value)
        bucket, block, start, doc_ids, parts, n = None, 0, 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if doc_ids:
                lengths = [len(p) // np.dtype(kind).itemsize for p in parts]
                payload = coder.encode(np.frombuffer(b"".join(parts), kind).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((bucket, block, start, doc_ids, lengths, payload), schema)], schema=schema)

        for batch in batches:
            for own, doc_id, cell in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = cell.as_py()
                if own != bucket or n >= block_ids:
                    yield from flush()
                    block, start = (block + 1, start + n) if own == bucket else (0, 0)
                    bucket, doc_ids, parts, n = own, [], [], 0
                doc_ids.append(doc_id)
                parts.append(ids)
                n += len(ids) // np.dtype(kind).itemsize
        yield from flush()

    return run


def write(documents: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, buckets: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Writes the files of `documents` to the new folder `path`. Only bucket bounds and the counts of the vocabulary's ids come to the driver."""
    spark = documents.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, rows, with_id = documents.agg(F.percentile_approx(F.col(id_col), [k / n for k in range(1, max(2, n))], 100 * n), F.count(F.lit(1)), F.count(F.col(id_col))).first()
    places = Places((cuts or []) if n > 1 else [], n * (rows - with_id) // max(1, rows))
    coder = WordCoder.of(tokenizer)
    kind, n_ids = coder.kind.str, max(coder.tokenizer.get_vocab_size(), end_id + 1)
    ids = token_ids(documents, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id, places=places, buckets=n)
    # by number and not by hash, so that no task gets several buckets while another has none
    ordered = checkpoint(ids.repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids"))
    counts = np.zeros(n_ids, np.int64)
    for r in ordered.where("bucket < -1").mapInArrow(_counted(), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    table = normalised(counts)
    spark.createDataFrame([(SCALE, [int(x) for x in table])], "scale int, frequencies array<int>").write.parquet(f"{path}/frequencies")
    blocks = ordered.where("bucket >= -1").mapInArrow(_blocked(kind, spark.sparkContext.broadcast(table), block_ids), _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from its decoded block."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    table = spark.sparkContext.broadcast(np.array(spark.read.parquet(f"{path}/frequencies").first().frequencies, np.int64))
    sums = {r.bucket: r.n for r in blocks.groupBy("bucket").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    starts, at = {}, 0
    for b in sorted(sums):  # one entry for each bucket
        starts[b], at = at, at + sums[b]
    schema = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                raw = coder.decode(r["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(r["lengths"])
                begin = ends - r["lengths"]
                base = starts[r["bucket"]] + r["start"]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(base + begin, pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return blocks.mapInArrow(run, RESULT)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """bucket, block, part, start (within the block) and ids of each part between checkpoints; parts are dealt out and decoded apart."""
    table = spark.sparkContext.broadcast(np.array(spark.read.parquet(f"{path}/frequencies").first().frequencies, np.int64))
    schema, dealt = arrow_schema(_PARTS), arrow_schema(_DEALT)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").select("bucket", "block", "payload")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for part in range(Coder.parts(r["payload"])):
                    yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((r["bucket"], r["block"], part, r["payload"]), dealt)], schema=dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        for batch in batches:
            for r in batch.to_pylist():
                row = (r["bucket"], r["block"], r["part"], r["part"] * Coder.part_size(r["payload"]), coder.decode(r["payload"], r["part"]))
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema)], schema=schema)

    return blocks.mapInArrow(counted, _DEALT).repartition("bucket", "block", "part").mapInArrow(run, _PARTS)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
