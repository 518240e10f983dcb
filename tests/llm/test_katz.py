"""Katz backoff against a plain recursion, for both forms, and that probabilities sum to one."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidewatch.llm import language_model, ngram_tables

SPACE = re.compile("[ \t-\r]+")


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in SPACE.split(lowered) if w] + ["</s>"]


def train(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


class Plain:
    """The model by dictionaries."""

    def __init__(self, docs, order):
        self.order = order
        self.counts = {k: Counter() for k in range(1, order + 1)}
        for doc_id, text in docs:
            if train(doc_id):
                w = ["<s>"] * (order - 1) + tokens(text)
                for i in range(order - 1, len(w)):
                    for k in range(1, order + 1):
                        self.counts[k][tuple(w[i - k + 1 : i + 1])] += 1
        of = lambda k: Counter(self.counts[k].values())
        self.d = {k: language_model.discounts([of(k)[r] for r in range(1, language_model.K + 2)]) for k in self.counts}
        self.n = sum(self.counts[1].values())
        self.follow = {k: {} for k in self.counts}
        for k, c in self.counts.items():
            for g in c:
                self.follow[k].setdefault(g[:-1], []).append(g)
        self.unknown = 1 - sum(self.kept(1, g) for g in self.counts[1]) / self.n

    def kept(self, k, g):
        c = self.counts[k][g]
        return c * self.d[k][c - 1] if c <= language_model.K else c - language_model.TAKEN

    def p(self, g):
        k = len(g)
        if self.counts[k][g]:
            return self.kept(k, g) / (self.n if k == 1 else sum(self.counts[k][x] for x in self.follow[k][g[:-1]]))
        if k == 1:
            return self.unknown
        seen = self.follow[k].get(g[:-1])
        if seen is None:
            return self.p(g[1:])
        left = 1 - sum(self.p(x) for x in seen)
        return left / (1 - sum(self.p(x[1:]) for x in seen)) * self.p(g[1:])

    def rows(self, docs):
        v = len(self.counts[1])
        for doc_id, text in docs:
            w = ["<s>"] * (self.order - 1) + tokens(text)
            own = w[self.order - 1 :]
            c = [self.counts[1][(x,)] for x in own]
            base = sum(math.log10((x + 0.1) / (self.n + 0.1 * (v + 1))) for x in c)
            yield (doc_id, not train(doc_id), len(own), sum(x > 0 for x in c), self.n, base, sum(math.log10(self.p(tuple(w[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(w))))


@pytest.fixture(scope="module")
def docs():
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(40)]
    text = lambda: " ".join(r.choice(vocabulary[: r.choice((4, 12, 40))]) for _ in range(r.randint(0, 60)))
    made = [(k, text()) for k in range(60)]
    return made + [(3, made[3][1]), (None, made[5][1]), (70, None), (71, "W1  w2\tW3\n"), (72, "never seen words é")]


def compared(rows, want):
    order = lambda x: (str(x[0]), x[2], round(x[6], 6))
    rows, want = sorted(map(tuple, rows), key=order), sorted(want, key=order)
    assert [x[:5] for x in rows] == [x[:5] for x in want]
    assert all(x[5:] == pytest.approx(y[5:], rel=1e-9) for x, y in zip(rows, want))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, row string")


def test_packed_pairs_equal_the_plain_model(spark, docs):
    want = list(Plain(docs, 2).rows(docs))
    for options in ({}, {"bucket_tokens": 50, "hot_share": 20}):
        compared(language_model.score(frame(spark, docs), **options).collect(), want)


@pytest.mark.parametrize("order", [2, 3])
def test_tables_of_any_order_equal_the_plain_model(spark, docs, order):
    compared(ngram_tables.score(frame(spark, docs), order).collect(), list(Plain(docs, order).rows(docs)))


def test_probabilities_sum_to_one(spark, docs):
    grams = ngram_tables.events(frame(spark, docs), 3)
    model = ngram_tables.fit(grams, 3)
    words = [r.g for r in model.tables[1].select("g").collect()]
    histories = [r.h for r in model.weights[3].select("h").orderBy("h").limit(4).collect()] + ["w1 unheard", "unheard w2"]
    asked = spark.createDataFrame([(f"{h} {w}",) for h in histories for w in [*words, "nowhere"]], "g string")
    sums = Counter()
    for r in ngram_tables.evaluated(asked, model).collect():
        sums[r.g.rsplit(" ", 1)[0]] += 10**r.log_p
    assert sums.keys() == set(histories) and all(s == pytest.approx(1, abs=1e-9) for s in sums.values())


def test_without_training_rows(spark):
    held = next(k for k in range(1000) if not train(k))
    for scored in (language_model.score(frame(spark, [(held, "a b")])), ngram_tables.score(frame(spark, [(held, "a b")]), 3)):
        row = scored.first()
        assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
    assert ngram_tables.score(frame(spark, [(1, "a")]).where("false")).count() == 0
