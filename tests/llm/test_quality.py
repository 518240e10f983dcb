"""The classifier against a plain twin, and each line rule."""

import random
import zlib

import numpy as np
import pytest

from tidewatch.llm import quality_classifier, quality_rules


def plain_train(positive, unlabelled, prior, steps=600, rate=0.05, decay=1e-4):
    """The non-negative risk, one row and one weight at a time where it matters."""
    mean, scale = unlabelled.mean(0), np.where(unlabelled.std(0) < 1e-9, 1, unlabelled.std(0))
    p, u = (np.array([[*np.clip((row - mean) / scale, -8, 8), 1.0] for row in x]) for x in (positive, unlabelled))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    loss = lambda z: np.log1p(np.exp(-abs(z))) + max(z, 0)  # noqa: E731  (of calling a row negative)
    for step in range(1, steps + 1):
        zp, zu = [float(w @ x) for x in p], [float(w @ x) for x in u]
        below = np.mean([loss(z) for z in zu]) - prior * np.mean([loss(z) for z in zp]) < 0
        s = lambda z: 1 / (1 + np.exp(-z))
        negative = sum(s(z) * x for z, x in zip(zu, u)) / len(u) - prior * sum(s(z) * x for z, x in zip(zp, p)) / len(p)
        gradient = (-negative if below else negative - prior * sum(s(-z) * x for z, x in zip(zp, p)) / len(p)) + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return mean, scale, w


def test_training_equals_a_plain_twin():
    r = np.random.default_rng(1)
    positive, unlabelled = r.normal(1, 1, (30, 4)), np.vstack([r.normal(1, 1, (40, 4)), r.normal(-1, 1, (20, 4))])
    model = quality_classifier.train(positive, unlabelled, 0.6, steps=60)
    mean, scale, w = plain_train(positive, unlabelled, 0.6, steps=60)
    assert model["weight"] == pytest.approx(w, rel=1e-8, abs=1e-10) and model["mean"] == pytest.approx(mean) and model["scale"] == pytest.approx(scale)


def test_scores_of_held_out_rows_and_of_odd_tables(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(("stone", "river", "cloud", "field")) + r.choice("abcdef") for _ in range(80)) + "."
    bad = lambda: " ".join(r.choice("#$%|*") * r.randint(1, 5) for _ in range(30))
    rows = [(k, good() if k % 3 else bad(), "x", 0.5) for k in range(600)]
    docs = spark.createDataFrame([*rows, rows[7], (None, good(), "x", 0.5), (9000, None, "x", 0.5), (9001, "w " * 300_000, "x", 0.5)], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(600)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.classify(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    held = [x for x in out if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out if x.doc_id is not None) and len(held) > 60
    a, b = [x.score for x in held if x.doc_id % 3], [x.score for x in held if not x.doc_id % 3]
    assert min(a) > max(b)
    assert quality_classifier.classify(docs.where("false"), model).count() == 0


@pytest.mark.parametrize(
    "line, fails",
    [("a plain line of words.", False), ("12 34 - 5", True), ("ab #### cd", True), ("home | news | sale | more", True), ("this! is! so! good!", True), ("one! two three four", False), ("ALL OF THIS IS IN CAPITALS HERE NOW", True), ("SHORT CAPITALS", False), ("click here to go on", True), ("© 2020 All rights reserved", True), ("nur ein Satz über Flüsse", False)],
)
def test_line_rules(line, fails):
    assert quality_rules.line_fails(line.encode(), line.encode().split()) is fails


def test_a_document_goes_by_what_its_lines_lose(spark):
    keep, drop = "a plain line of some words here.\n", "home | news | sale | more\n"
    distinct = "".join(f"line number {'x' * k} has its own words q{k} r{k} s{k}.\n" for k in range(20))
    rows = [(1, distinct), (2, distinct + drop * 2), (3, distinct + "".join(drop.replace("more", f"m{k}") for k in range(40))), (4, keep * 30), (1, distinct), (None, None), (6, "z " * 200_000)]
    docs = spark.createDataFrame([(d, t, 1, True) for d, t in rows], "doc_id long, text string, n_words int, kept boolean")
    got = quality_rules.clean(docs).collect()
    by_id = {x.doc_id: x for x in got}
    assert len(got) == len(rows) and by_id[1].kept and by_id[2].kept and not by_id[3].kept and by_id[4].base_failed and by_id[6].base_failed and by_id[None].n_words == 0
    assert by_id[2].lines_removed == 2 and by_id[2].n_dup_lines == 1 and by_id[2].text.strip() == distinct.strip()
    assert quality_rules.clean(docs.where("false")).count() == 0


def test_losing_just_as_much_as_allowed_is_kept():
    good = " ".join(chr(97 + k) * 10 for k in range(7))  # 70 characters in words
    loud = "ABCD EFGH IJKL MNOP QRST UVWX YZAB CD"  # 30 more, in a line of capitals
    judged = lambda text: quality_rules.judge(text.encode(), min_words=1, max_repeat=100, max_lost=0.3, with_text=False)
    assert judged(f"{good}\n{loud}")[1] == 100 and judged(f"{good}\n{loud}")[6] is True
    assert judged(f"{good}\n{loud}E")[6] is False
