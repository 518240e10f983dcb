"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text of up to `chunk` characters is one chunk and is encoded where it is read. A longer one is cut into overlapping chunks that are dealt out to
all tasks. Each chunk is pre-tokenised from its own start, which may lie within a pre-token; its overlap with the next one is extended until
it holds a change from a letter or mark to white space, which is a pre-token boundary wherever one starts. So both chunks of a pair have a boundary
in common, and from the first one on they agree. A chunk encodes its middle as one piece and the pre-tokens of its two overlaps
singly; stitching takes the left chunk's up to the common boundary and the right chunk's after it, and fails rather than guess if there were none. Decoding concatenates the bytes of the ids.

Defined cases: a null text counts as empty and has no ids; repeated rows and rows with a null doc_id are encoded one by one; other columns are
ignored. White space that only some libraries know (such as U+001C) is never taken for a sure boundary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema

CHUNK, OVERLAP = 32_768, 512
_SURE = regex.compile(r"[\p{L}\p{N}\p{P}\p{S}](?=[ \n])")


class Coder:
    """Encodes pieces and decodes ids by a rank file that is read once for each worker."""

    _kept: dict[tuple, Coder] = {}

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        top = max(table.values(), default=-1) + 1
        self.bytes: list[bytes] = [b""] * top
        for token, rank in table.items():
            self.bytes[rank] = token
        self.names = [str(k) for k in range(top)]

    @classmethod
    def of(cls, ranks: str, pattern: str) -> Coder:
        if (ranks, pattern) not in cls._kept:
            cls._kept[ranks, pattern] = cls(ranks, pattern)
        return cls._kept[ranks, pattern]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk. A chunk reaches at least `overlap` into the next one's range, and on past a sure boundary there."""
    start = reached = 0
    while True:
        following = max(start + chunk, reached)  # overlaps of one chunk stay apart
        sure = _SURE.search(text, following + 1) if following < len(text) else None
        if sure is None:
            yield start, len(text)
            return
        reached = min(len(text), max(following + overlap, sure.end() + 2))
        yield start, reached
        start = following


class _Piece:
    """What one chunk gives: the pre-tokens of its overlaps with their ids, and the ids between them."""

    @staticmethod
    def of(coder: Coder, text: str, start: int, head_end: int, tail_start: int) -> dict:
        bounds = [m.start() for m in coder.pattern.finditer(text)]
        head, tail, middle = [], [], []
        low = next((k for k, b in enumerate(bounds) if start + b >= head_end), len(bounds))
        high = max(low, next((k for k, b in enumerate(bounds) if start + b >= tail_start), len(bounds)))
        # the middle ends after a pre-token without white space at its end, else a cut could join blanks anew
        while low < high < len(bounds) and text[bounds[high] - 1].isspace():
            high -= 1
        end_of = lambda k: bounds[k] if k < len(bounds) else len(text)
        single = lambda lo, hi: [{"at": start + bounds[k], "ids": coder.encode(text[bounds[k] : end_of(k + 1)])} for k in range(lo, hi)]
        head = single(0, low)
        if high > low:
            middle = coder.encode(text[bounds[low] : end_of(high)])
        tail = single(high, len(bounds))
        return {"head": head, "middle_at": start + end_of(low), "middle": middle, "tail": tail}


_CHUNKS = "doc_id long, row string, k int, last boolean, start long, head_end long, tail_start long, text string"
_TOKENS = "array<struct<at:long,ids:array<int>>>"
_PIECES = f"doc_id long, row string, k int, last boolean, head {_TOKENS}, middle_at long, middle array<int>, tail {_TOKENS}"


def _chunked(chunk: int, overlap: int):
    schema = arrow_schema(_CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = cell.as_py()
                n += 1
                chunks = list(cut(text, chunk, overlap))
                for k, (start, end) in enumerate(chunks):
                    head_end = chunks[k - 1][1] if k else 0
                    tail_start = chunks[k + 1][0] if k + 1 < len(chunks) else len(text)
                    row = (doc_id, f"{task}-{n}", k, k + 1 == len(chunks), start, head_end, tail_start, text[start:end])
                    yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema)], schema=schema)

    return run


def _encoded(ranks: str, pattern: str):
    schema = arrow_schema(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks, pattern)
        for batch in batches:
            for r in batch.to_pylist():
                p = _Piece.of(coder, r["text"], r["start"], r["head_end"], r["tail_start"])
                row = (r["doc_id"], r["row"], r["k"], r["last"], p["head"], p["middle_at"], p["middle"], p["tail"])
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema)], schema=schema)

    return run


def stitched(pieces: Iterator[dict]) -> Iterator[tuple[dict, list[int], bool]]:
    """(piece, ids, whether the document ends) from the pieces of documents in order. A piece's tail is held back until the next one's head is seen."""
    tail: list[dict] = []
    for p in pieces:
        ids: list[int] = []
        tokens, middle = p["head"], p["middle"]
        if p["k"]:
            own = {t["at"] for t in tokens} | {p["middle_at"]}
            common = next((t["at"] for t in tail if t["at"] in own), None)
            if common is None:  # cut() sees to one; without it, any ids would be wrong
                raise ValueError(f"chunks {p['k'] - 1} and {p['k']} of a document have no pre-token boundary in common")
            for t in tail:
                if t["at"] < common:
                    ids += t["ids"]
            tokens = [t for t in tokens if t["at"] >= common]
        for t in tokens:
            ids += t["ids"]
        ids += middle
        tail = p["tail"]
        if p["last"]:
            for t in tail:
                ids += t["ids"]
            tail = []
        yield p, ids, p["last"]


class _Digest:
    def __init__(self, coder: Coder) -> None:
        self.coder, self.n, self.ids, self.decoded = coder, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        if ids:
            self.ids.update(((" " if self.n else "") + " ".join(map(self.coder.names.__getitem__, ids))).encode())
            self.decoded.update(self.coder.decode(ids))
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


IDS = "doc_id long, row string, k int, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _short(ranks: str, pattern: str, digest: bool):
    schema = arrow_schema(DIGESTS if digest else IDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, n, task = Coder.of(ranks, pattern), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for doc_id, cell in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    ids = coder.encode(cell.as_py())
                    n += 1
                    if digest:
                        d = _Digest(coder)
                        d.add(ids)
                        rows.append((doc_id, *d.row()))
                    else:
                        rows.append((doc_id, f"{task}-{n}s", 0, ids))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _long(ranks: str, pattern: str, digest: bool):
    schema = arrow_schema(DIGESTS if digest else IDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks, pattern)
        state = None
        for p, ids, ends in stitched(r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            if not digest:
                row = (p["doc_id"], p["row"], p["k"], ids)
            else:
                state = state or _Digest(coder)
                state.add(ids)
                if not ends:
                    continue
                row, state = (p["doc_id"], *state.row()), None
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema)], schema=schema)

    return run


def encode(documents: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """The ids of each document: one row for each piece (row names the document's row, k orders its pieces).

    With `digest`, one row for each document instead: n_tokens and the SHA-256 of the ids and of the bytes that they decode to.
    """
    out = DIGESTS if digest else IDS
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(_short(ranks, pattern, digest), out)
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.where(F.length("text") > chunk).mapInArrow(_chunked(chunk, overlap), _CHUNKS).repartition(n, "row", "k")
    pieces = chunks.mapInArrow(_encoded(ranks, pattern), _PIECES).repartition(n, "row").sortWithinPartitions("row", "k")
    return short.union(pieces.mapInArrow(_long(ranks, pattern, digest), out))


def decode(pieces: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The bytes of each piece; those of a document's pieces in order are its text."""
    schema = arrow_schema("doc_id long, row string, k int, bytes binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("k"), pa.array([coder.decode(x.as_py()) for x in b.column("ids")], type=pa.binary())], schema=schema)

    return pieces.mapInArrow(run, "doc_id long, row string, k int, bytes binary")
