"""Recall and precision of the near-dedup stage at a Jaccard similarity of 0.8 over five words, and its defined cases."""

import random

import corpus_pipeline
from tidewatch.llm import near_copies, quality_classifier, simhash
from tidewatch.llm.decontamination import decontaminate

WORDS = [a + b for a in "river stone cloud lantern meadow copper signal harbor timber violet orchard saddle".split() for b in "abcdefghijkl"]
_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def prose(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def pairs(r, cases):
    """(text, changed text): words replaced at random places."""
    out = []
    for length, changes, n in cases:
        for _ in range(n):
            words = prose(r, length)
            other = list(words)
            for at in r.sample(range(length), changes):
                other[at] = "changed" + str(r.random())
            out.append((" ".join(words), " ".join(other)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], _SCHEMA).repartition(4)


def test_recall_and_precision(spark):
    r = random.Random(12)
    made = pairs(r, [(100, 1, 60), (100, 2, 60), (200, 2, 60), (200, 3, 60), (200, 4, 60), (1000, 20, 30), (300, 12, 60), (60, 6, 60)])
    docs = frame(spark, [row for k, (a, b) in enumerate(made) for row in ((2 * k, a), (2 * k + 1, b))])
    stays = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    fingerprints = {x.doc_id for x in simhash.deduplicate(docs).collect()}
    near = [k for k, (a, b) in enumerate(made) if similarity(a, b) >= 0.8]
    far = [k for k in range(len(made)) if k not in near]
    assert len(near) > 250 and len(far) > 60
    found = sum(2 * k + 1 not in stays for k in near) / len(near)
    alone = sum(2 * k + 1 not in fingerprints for k in near) / len(near)
    assert found >= 0.95 > 0.5 > alone
    assert all(2 * k in stays for k in range(len(made)))
    # what the second pass removes is similar; only fingerprints of 64 bits may link others
    assert all(2 * k + 1 in stays for k in far if 2 * k + 1 in fingerprints)


def test_classes_equal_brute_force_on_a_hot_group(spark):
    """One group of 300 near copies of one text, met by more than one chunk, exact copies, and an id with two texts."""
    r = random.Random(3)
    base = prose(r, 150)
    rows = []
    for k in range(300):
        words = list(base)
        words[r.randrange(150)] = f"own{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(prose(r, 40))) for k in range(40)]
    rows += [(2000, rows[310][1]), (2000, rows[311][1]), (2001, rows[320][1].upper() + " "), (2002, ""), (2003, None), (None, rows[0][1]), (2004, "two words"), (2005, "two  words")]
    got = {(x.doc_id, x.component_id) for x in near_copies.classes(frame(spark, rows), chunk=64).collect()}
    root = {d: d for d, _ in rows if d is not None}
    texts = [(d, t) for d, t in rows if d is not None and (t or "").split()]
    for _ in range(3):
        for i, (a, s) in enumerate(texts):
            for b, t in texts[:i]:
                if root[a] != root[b] and similarity(s, t) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    of = {}
    for d in root:
        of.setdefault(root[d], set()).add(d)
    want = {(d, root[d]) for d in root if len(of[root[d]]) > 1}
    assert {x for x in got if x[0] >= 1000} == {x for x in want if x[0] >= 1000}
    hot = {c for d, c in got if d < 300}
    assert len([d for d, _ in got if d < 300]) >= 290 and hot <= set(range(10))


def test_empty_and_clashing_columns(spark):
    none = frame(spark, []).where("false")
    assert near_copies.classes(none).count() == 0 and corpus_pipeline.near_duplicates(spark, none, "").count() == 0
    docs = spark.createDataFrame([(1, "a b c", 1, 1, 1, 1), (2, "a b c", 1, 1, 1, 1), (3, "!! ## %%", 1, 1, 1, 1)], "doc_id long, text string, _drop int, _bad int, gone_id int, component_id int")
    assert sorted(x.doc_id for x in simhash.deduplicate(docs).collect()) == [1, 3]
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [x.doc_id for x in decontaminate(docs, items).collect()] == [3]
    kept = quality_classifier.keep_good(docs, {"constant": 0.1})
    assert kept.count() == 0 and kept.columns == docs.columns


def test_an_id_on_many_rows_counts_once_in_the_fit(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, " ".join(prose(r, 30))) for k in range(1, 60)] + [(7, f"hot {k}") for k in range(3000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality_classifier, "train", lambda p, u, prior: seen.update(p=len(p), u=len(u)) or {"constant": prior})
    quality_classifier.fit(docs, labels)
    assert 0 < seen["p"] <= 30 and 30 < seen["u"] <= 59
