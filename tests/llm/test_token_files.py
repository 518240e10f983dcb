"""Token files: blocks decoded from their checkpoints, damage, empty tables and tokenizers of another form."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_parts_decode_from_checkpoints():
    r = np.random.default_rng(0)
    ids = np.minimum(r.zipf(1.3, 10_000), 500) - 1
    coder = token_files.Coder(token_files.normalised(np.bincount(ids, minlength=500)), lanes=16, interval=32)
    payload = coder.encode(ids)
    assert (coder.decode(payload) == ids).all()
    n = coder.parts(payload)
    assert n == -(-len(ids) // (16 * 32)) and (np.concatenate([coder.decode(payload, k) for k in reversed(range(n))][::-1]) == ids).all()
    damaged = bytearray(payload)
    damaged[len(payload) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        coder.decode(bytes(damaged))
    assert len(coder.decode(coder.encode(np.zeros(0, np.int64)))) == 0


def test_read_parts_equals_read(spark, tmp_path):
    r = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(r.choice(("stone", "river,", "Été", "42", "x.")) for _ in range(r.randint(0, 4000)))) for k in range(12)], "doc_id long, text string")
    token_files.write(docs, PATH, str(tmp_path / "t"), buckets=2, block_ids=20_000)
    n = sum(x.n_tokens for x in token_files.read(spark, str(tmp_path / "t")).collect())
    parts = token_files.read_parts(spark, str(tmp_path / "t")).collect()
    assert sum(len(p.ids) for p in parts) == n
    coder, whole = token_files.WordCoder(PATH), []
    for p in sorted(parts, key=lambda p: (p.bucket, p.block, p.part)):
        whole += p.ids
    expected = [x for d in sorted(docs.collect()) for x in [*coder.tokenizer.encode(d.text, add_special_tokens=False).ids, 2]]
    assert whole == expected


def test_empty_table_and_repeated_rows(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(none, PATH, str(tmp_path / "e"), buckets=2)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0
    docs = spark.createDataFrame([(1, "a b", 1, "p"), (1, "a b", 2, "q"), (None, None, 3, "r")], "doc_id long, text string, start long, ids string")
    token_files.write(docs, PATH, str(tmp_path / "d"), buckets=2)
    rows = sorted(map(tuple, token_files.read(spark, str(tmp_path / "d")).collect()), key=lambda x: x[1])
    assert [x[:3] for x in rows] == [(None, 0, 1), (1, 1, 3), (1, 4, 3)] and rows[1][3] == rows[2][3]


def test_a_tokenizer_of_another_form_goes_to_the_library(tmp_path):
    made = json.load(open(PATH, encoding="utf-8"))
    made["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(made), encoding="utf-8")
    assert token_files.encodes_by_words(PATH) and not token_files.encodes_by_words(str(tmp_path / "cased.json"))
    coder = token_files.WordCoder(str(tmp_path / "cased.json"))
    assert np.frombuffer(coder.encode([b"Hello WORLD abc"])[0], coder.kind).tolist() == coder.tokenizer.encode("Hello WORLD abc", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["one id", "null ids", "both"])
def test_an_id_on_many_rows_spreads_over_buckets(spark, tmp_path, kind):
    r = random.Random(3)
    ids = [{"one id": 7, "null ids": None, "both": r.choice((7, None))}[kind] if k % 3 else k for k in range(600)]
    docs = spark.createDataFrame([(d, " ".join(r.choice(("stone", "river", "cloud")) for _ in range(r.randint(0, 30)))) for d in ids], "doc_id long, text string").repartition(3)
    token_files.write(docs, PATH, str(tmp_path / "h"), buckets=8)
    rows = sorted(token_files.read(spark, str(tmp_path / "h")).collect(), key=lambda x: x.start)
    assert [x.start for x in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert [x.doc_id for x in rows] == sorted((d for d in ids), key=lambda d: (d is not None, d or 0))
    coder = token_files.WordCoder(PATH)
    want = sorted((str(x.doc_id), zlib.crc32(np.array([*coder.tokenizer.encode(x.text, add_special_tokens=False).ids, 2], "<u4").tobytes())) for x in docs.collect())
    assert sorted((str(x.doc_id), x.ids_crc32) for x in rows) == want
    sizes = [x.n for x in spark.read.parquet(str(tmp_path / "h" / "blocks")).selectExpr("bucket", "size(doc_ids) AS n").groupBy("bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()]
    assert max(sizes) < 200 and len(sizes) >= 6
