"""The pipeline against the five stages in plain Python, each on its own input."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from test_decontamination import plain
from test_near_copies import similarity
from test_secrets import expected

import corpus_pipeline
from tidewatch.llm import byte_bpe, quality_classifier, secrets, simhash

WORDS = "river stone cloud lantern meadow copper signal harbor timber violet orchard saddle".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    good = [prose(r, r.randint(60, 120)) for _ in range(120)]
    bad = [prose(r, 40).upper().replace(" ", "!! ") for _ in range(40)]
    items = [(k, prose(r, 20)) for k in range(5)]
    docs = [(k, t) for k, t in enumerate(good + bad)]
    docs += [(200 + k, good[k]) for k in range(10)] + [(220 + k, good[20 + k] + " tail") for k in range(5)]
    docs += [(240 + k, t + " " + prose(r, 60)) for k, t in items] + [(250, f"{good[60]} token = \"{'ab12' * 10}\" end"), (251, f"{good[61]} AKIA{'A1B2' * 4} {'Ab1/' * 10} end")]
    docs += [(None, good[70]), (3, good[3]), (260, None), (261, "")]
    labels = [(k, 1) for k in range(100)] + [(k, 0) for k in range(120, 155)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def rejected(docs, bad):
    return [(d, t) for d, t in docs if d is None or d not in bad]


def test_stages_equal_plain_ones(spark, tables):
    folder, docs, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_classifier.fit(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    best = {}
    for d, t in docs:
        p = float(quality_classifier.score(model, quality_classifier.features((t or "").encode())[None, :])[0])
        best[d] = max(p, best.get(d, 0.0))
    kept = rejected(docs, {d for d, p in best.items() if p < 0.3})
    assert len(kept) < len(docs) - 30 and all(d in {x for x, _ in kept} for d in range(120))
    # near duplicates: the smallest id of each component stays
    prints = [simhash.fingerprint(t and t.encode()) for _, t in kept]
    root = list(range(len(kept)))
    for _ in range(4):
        for i in range(len(kept)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    ids = {}
    for i, (d, _) in enumerate(kept):
        if d is not None:
            ids.setdefault(root[i], []).append(d)
    gone = {d for i, (d, _) in enumerate(kept) if d is not None and d != min(ids[root[i]])}
    kept = rejected(kept, gone)
    assert {200, 205, 209} <= gone
    # then the smallest id of each class of texts whose 5-word shingles are alike by 0.8 or more
    root = {d: d for d, t in kept if d is not None and (t or "").split()}
    for _ in range(3):
        for d, t in kept:
            for e, u in kept:
                if d in root and e in root and root[d] != root[e] and similarity(t, u) >= 0.8:
                    root[d] = root[e] = min(root[d], root[e])
    again = {d for d, first in root.items() if d != first}
    kept = rejected(kept, again)
    assert again | gone >= set(range(220, 225))
    kept = rejected(kept, {x[0] for x in plain(kept, items) if x[-1]})
    assert not {240, 241, 244} & {d for d, _ in kept}

    def masked(text):
        out, at = [], 0
        for _, a, b in expected(text)[1]:
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(out) + text[at:]

    coder = byte_bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(coder.bytes) if b}, special_tokens={})
    want = []
    for d, t in kept:
        t = masked(t) if t is not None else ""
        ids_ = library.encode_ordinary(t)
        want.append((d, len(ids_), hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(corpus_pipeline.STAGES) == 5 and secrets.SCOPE == 300


def test_filters_keep_the_documents_own_columns(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for out in (quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels)), simhash.deduplicate(docs)):
        assert out.columns == docs.columns and out.where("doc_id IS NULL").count() == 1
    none = docs.where("false")
    assert simhash.deduplicate(none).count() == 0 and quality_classifier.keep_good(none, quality_classifier.fit(none, labels)).count() == 0
    assert quality_classifier.fit(docs, labels.where("quality = 0")) == {"constant": 0.0}
