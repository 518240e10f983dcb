"""Odd tables of the byte-level coder."""

import public_tokenizers

from tidewatch.llm import byte_bpe

ARGS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_empty_tables_repeated_rows_and_texts_without_a_boundary(spark):
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (None, None, 1, "x"), (2, "x" * 9000, 1, "x"), (3, " " * 5000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int, row string")
    out = byte_bpe.encode(docs, *ARGS, digest=True, chunk=100, overlap=10).collect()
    coder = byte_bpe.Coder.of(*ARGS)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == sorted((d or 0, len(coder.encode(t or ""))) for d, t, *_ in rows)
    none = docs.where("false")
    assert byte_bpe.encode(none, *ARGS, digest=True).count() == 0 and byte_bpe.decode(byte_bpe.encode(none, *ARGS), *ARGS).count() == 0
