"""The search against a plain one, and the defined cases."""

import hashlib
import random
import re

from tidewatch.llm import decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, window=13):
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item, body in items:
            w = words(body)
            n = min(window, len(w))
            for s in range(len(w) - n + 1) if w else ():
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[s : s + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        yield (doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own))


def test_equals_a_plain_search(spark):
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(("ab", "Ab", "c", "é", "x1", "zz")) for _ in range(n))
    items = [(k, text(r.choice((1, 3, 12, 13, 14, 30)))) for k in range(12)] + [(3, text(20)), (5, "")]
    docs = [(k, text(r.randint(0, 60))) for k in range(40)]
    docs += [(100 + k, text(5) + "! " + items[k][1].upper() + " - " + text(300)) for k in range(12)] + [(0, docs[0][1]), (7, None), (None, docs[1][1])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, row string, n_words int")
    bench = spark.createDataFrame([*items, items[0], (None, "ab c")], "item_id long, text string")
    want = sorted(plain(docs, items), key=str)
    for options in ({}, {"slots": 2}, {"broadcast_patterns": 0}):
        assert sorted(map(tuple, decontamination.contamination(frame, bench, **options).collect()), key=str) == want
    clean = {r.doc_id for r in decontamination.decontaminate(frame, bench).collect()}
    bad = {w[0] for w in want if w[-1]}
    assert clean == {d for d, _ in docs if d not in bad or d is None} and decontamination.decontaminate(frame, bench).columns == frame.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contamination(docs.where("false"), bench).count() == 0
    row = decontamination.contamination(docs, bench.where("false")).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (3, 0, False)
