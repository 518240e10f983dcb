"""Ranked search against a plain count over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import ranked_search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def plain(documents, items, k):
    docs = [(d, Counter(terms(t))) for d, t in documents if terms(t)]
    n_all, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in wanted.items():
        scored = []
        for doc_id, counts in docs:
            m = 50 + (50 * sum(counts.values()) * n_all) // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in asked if t in counts)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, r, doc_id, -score) for r, (score, _, doc_id) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, documents, items, **options):
    d = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, ranked_search.rank(d, spark.createDataFrame(items, "item_id long, text string"), **options).collect()), key=str)


def test_equals_a_plain_count(spark):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{k}" for k in range(300)])
    odds = 1 / np.arange(1, 301)
    documents = [(k, " ".join(rng.choice(vocabulary, rng.integers(1, 80), p=odds / odds.sum()))) for k in range(700)]
    items = [(k, " ".join(rng.choice(vocabulary, 12))) for k in range(25)]
    expected = plain(documents, items, 10)
    assert ranked(spark, documents, items, k=10, block=64) == expected
    # batches of items, and all documents as one block, change nothing
    assert ranked(spark, documents, items, k=10, block=10_000, most_pairs=40) == expected


def test_defined_cases(spark):
    documents = [(3, "ALPHA beta"), (1, "alpha, Beta!"), (1, "alpha beta"), (None, "alpha beta"), (4, None), (5, ""), (6, "..."), (7, "gamma " * 50_000), (8, "ÄÖ1 Äö1"), (9, "delta")]
    items = [(1, "alpha"), (2, "gamma GAMMA"), (3, None), (4, "nowhere"), (None, "delta"), (1, "beta"), (5, "äö1 Äö1"), (6, "")]
    got = ranked(spark, documents, items)
    assert got == plain(documents, items, 50)
    # equal scores by id, the null id last, repeated ids each by itself; rows of one item together
    assert [r[2] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[1])] == [1, 1, 3, None]
    assert {r[0] for r in got} == {1, 2, None, 5}
    # only A-Z is lower-cased
    assert ("ÄÖ1" in terms("ÄÖ1")) and not any(r[0] == 5 and r[2] != 8 for r in got)


def test_a_hot_text_and_ties_at_the_cut(spark):
    documents = [(k, "same words here") for k in range(400)] + [(k, "same") for k in range(400, 420)]
    got = ranked(spark, documents, [(1, "same words")], k=5, block=32)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [0, 1, 2, 3, 4]
    assert got == plain(documents, [(1, "same words")], 5)


@pytest.mark.parametrize("empty", ["documents", "items"])
def test_empty_tables(spark, empty):
    documents, items = ([], [(1, "a")]) if empty == "documents" else ([(1, "a")], [])
    assert ranked(spark, documents, items) == []


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 9, 9, 9), (2, "c", 9, 9, 9)], "doc_id long, text string, score int, item_id int, rank int")
    items = spark.createDataFrame([(7, "a", 1)], "item_id int, text string, doc_id int")
    rows = ranked_search.rank(d, items).collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in rows] == [(7, 1, 1)]


def test_greatest_of_a_range():
    rng = np.random.default_rng(1)
    rows = [(k, 9, np.sort(rng.choice(6, rng.integers(1, 6), replace=False)), rng.integers(1, 9, 6)) for k in range(90)]
    rows = [(d, n, ids, tfs[: len(ids)]) for d, n, ids, tfs in rows]
    index = ranked_search.Block(rows, np.arange(1, 7) * 100, (90, 90 * 9))
    for term in range(6):
        low, high = np.sort(rng.integers(index.starts[term], index.starts[term + 1] + 1, (2, 200)), axis=0)
        _, most = index.greatest(low, high)
        assert most.tolist() == [max(index.shares[a:b], default=0) for a, b in zip(low, high)]
