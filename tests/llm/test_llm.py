import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tidewatch.llm import byte_bpe, decontamination, language_model, licenses, quality_classifier, quality_rules, secrets, simhash, token_files, url_filter

SCHEMA = "doc_id long, text string, n_tokens string"  # an extra column with a clashing name
WORDS = "river stone cloud lantern meadow copper signal harbor timber violet orchard saddle".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    a = prose(1, 80)
    rows = [(0, a), (1, a + " tail"), (2, prose(2, 120)), (3, None), (4, ""), (5, a), (None, prose(3, 60)), (2, prose(2, 120)), (6, "The " * 4000), (7, "é ß\x1c  'll\n\n x " * 50)]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)


def test_golay_keys_cover_four_errors():
    golay, r = simhash.Golay(), random.Random(0)
    for _ in range(200):
        v = r.getrandbits(64)
        u = v
        for bit in r.sample(range(64), r.randint(1, 4)):
            u ^= 1 << bit
        keys = []
        for f in (v, u):
            own = {}
            for key, _, side in simhash._keys_of(np.array([f], np.uint64), golay):
                for k, s in zip(key, side):
                    own.setdefault(int(k), set()).add(int(s))
            keys.append(own)
        assert any(k in keys[1] and (0 in s or s != keys[1][k]) for k, s in keys[0].items())


@pytest.mark.parametrize("block", [4096, 2])
def test_simhash_equals_brute_force(spark, docs, block):
    rows = simhash.near_duplicates(docs, block=block).collect()
    prints = [int(r.fingerprint, 16) for r in rows]
    words = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(prose(2, 120).split()[i : i + 4]) for i in range(117)]]
    assert sum(1 << k for k in range(64) if 2 * sum(w >> k & 1 for w in words) > len(words)) in prints
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if root[j] == root[i] and rows[j].doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)


def test_secret_links_need_complementary_parts(spark):
    key = "Ab1/" * 10
    rows = [(1, f"id AKIA{'A1B2' * 4} then {key} end"), (2, f"only {key} here"), (3, 'token = "abcdef" and secret: abc'), (4, None), (5, f"AKIA{'A1B2' * 4} " + "w " * 400 + key)]
    got = {r.doc_id: r for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_access, got[1].n_linked, got[2].n_linked, got[5].n_linked) == (1, 1, 0, 0)
    assert got[3].spans == "assign:0:15" and got[4].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[3] == '[SECRET]" and secret: abc' and key in clean[2] and key not in clean[1] and clean[4] is None


def test_bpe_chunks_equal_whole_texts(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = byte_bpe.Coder.of(path, public_tokenizers.PATTERN)
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice(["a", "'s", " ", "  ", "\n", "\n\n", " ", "é", "22", ".", "\x1c", "word", "日本"]) for _ in range(r.randint(0, 150)))
        cuts = list(byte_bpe.cut(text, 17, 5))
        parts = [{**byte_bpe._Piece.of(coder, text[s:e], s, cuts[k - 1][1] if k else 0, cuts[k + 1][0] if k + 1 < len(cuts) else len(text)), "k": k, "last": k + 1 == len(cuts)} for k, (s, e) in enumerate(cuts)]
        assert [x for _, ids, _ in byte_bpe.stitched(iter(parts)) for x in ids] == coder.encode(text)
    small, whole = (sorted(map(tuple, byte_bpe.encode(docs, path, public_tokenizers.PATTERN, digest=True, chunk=c).collect()), key=str) for c in (40, 10**9))
    assert small == whole and len(whole) == docs.count()
    back = byte_bpe.decode(byte_bpe.encode(docs.where("doc_id = 7"), path, public_tokenizers.PATTERN, chunk=40), path, public_tokenizers.PATTERN).orderBy("k").collect()
    assert b"".join(x.bytes for x in back).decode() == docs.where("doc_id = 7").first().text


def test_katz_is_normalised(spark, docs):
    rows = language_model.score(docs).collect()
    assert len(rows) == docs.count() and all(r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    d = language_model.discounts([5, 3, 2, 1, 1, 1])
    assert len(d) == language_model.K and all(0 < x < 1 for x in d)
    h, log_weight = language_model.backoff_weights([[np.array([7], np.uint64), np.array([4]), np.array([2]), *[np.array([0])] * 4, np.array([0]), np.array([0.25])]], np.array([0.5] * 6))
    assert h[0] == 7 and abs(10 ** log_weight[0] - 1.0 / 0.75) < 1e-12


def test_decontamination_equals_brute_force(spark):
    item = prose(9, 20)
    rows = [(1, "x y " + item.upper() + " z"), (2, prose(8, 200)), (3, None), (4, "tiny item"), (5, " ".join(item.split()[:12]))]
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (None, "x y"), (3, None)], "item_id long, text string")
    for block in ({}, {"slots": 4, "broadcast_patterns": 0}):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, **block).collect()}
        assert got == {1: (20, 1, True), 2: (0, 0, False), 3: (0, 0, False), 4: (2, 1, True), 5: (0, 0, False)}


def test_quality_rules(spark, docs):
    rows = [(1, prose(1, 60) + "."), (2, "buy now | sale | news | home\n" * 30), (3, None), (4, "word " * 100)]
    got = {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (60, False, True) and got[3] == (0, True, False) and got[4] == (100, True, False) and not got[2][2]
    words = prose(4, 30).split() * 2
    seen = [tuple(words[k : k + 3]) for k in range(58)]
    assert quality_rules.repeated_words([w.encode() for w in words]) == len({k + j for k in range(58) if seen.count(seen[k]) > 1 for j in range(3)})


def test_classifier_learns_from_positives_and_unlabelled(spark):
    good, bad = [(k, prose(k, 60) + ".") for k in range(200)], [(1000 + k, prose(k, 60).upper().replace(" ", "!! ")) for k in range(60)]
    docs = spark.createDataFrame(good + bad + [(5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k, _ in good[:120]] + [(k, 0) for k, _ in bad[:36]], "doc_id long, quality int")
    rows = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()
    # a prior estimated on so few labels shifts the scores, not their order
    assert min(r.score for r in rows if r.doc_id < 1000) > max(r.score for r in rows if 1000 <= r.doc_id < 5000) and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.fit(docs, labels.where("false")) == {"constant": 0.5}


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(docs, path, str(tmp_path / "t"), block_ids=500, buckets=3)
    rows = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    library, texts, at = Tokenizer.from_file(path), {}, 0
    for d in docs.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        texts.setdefault(d.doc_id, []).append(zlib.crc32(np.array(ids, "<u4").tobytes()))
    for r in rows:
        assert r.start == at and r.ids_crc32 in texts[r.doc_id]
        at += r.n_tokens
    assert len(rows) == docs.count() and [r.doc_id for r in rows][:1] == [None]


def test_licenses_and_urls(spark):
    rows = [(1, "Text.\nReleased under the  MIT LICENCE!\nEnd"), (2, licenses.TEXTS["MIT"].replace("<holder>", "A. Person").upper()), (3, None), (4, "MIT")]
    got = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("", "MIT"), 2: ("MIT", "MIT"), 3: ("", ""), 4: ("", "")}
    pages = spark.createDataFrame([(1, "https://A.example.NET/en/1"), (2, "http://x.net"), (3, None), (4, "no scheme"), (5, "https://b.example.com/de/x"), (6, "http://q.org/fr/")], "page_id long, url string")
    seen = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert seen[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and seen[2][2] is None  # net/ needs a path
    assert seen[3][:3] == ("", "", None) and seen[5][3] == "block" and seen[6][3] == "allow"


def test_empty_documents(spark, docs):
    none = docs.where("false")
    assert simhash.near_duplicates(none).count() == 0 and secrets.report(none).count() == 0 and quality_rules.clean(none).count() == 0 and language_model.score(none).count() == 0
    assert re.fullmatch("[0-9a-f]{16}", simhash.near_duplicates(docs.where("doc_id = 4")).first().fingerprint)
