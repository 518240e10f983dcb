"""The secret scan against a plain Python twin."""

import hashlib
import random
import re
import time

from tidewatch.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")


def base(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]


def weak(text):
    mixed = lambda s: len(s) == 40 and all(re.search(c, s) for c in ("[0-9]", "[A-Z]", "[a-z]"))
    out = [("weak_secret", m.start(), m.end()) for m in re.finditer("[A-Za-z0-9/+]{40,}", text) if mixed(m.group())]
    out += [("weak_id", m.start(), m.end()) for m in re.finditer("(ASIA|AROA|AIDA)[A-Z0-9]{16,}", text) if m.end() - m.start() == 20]
    return out + [("endpoint", m.start(), m.end()) for m in re.finditer(secrets.WEAK["endpoint"], text)]


def expected(text, scope=secrets.SCOPE):
    strong = base(text)
    free = [w for w in weak(text) if not any(s[1] < w[2] and w[1] < s[2] for s in strong)]
    role = lambda s: {"access": "id", "weak_id": "id", "endpoint": "endpoint"}.get(s[0], "secret")
    linked = []
    for w in free:
        near = {role(p) for p in strong + free if abs(p[1] - w[1]) <= scope} - {role(w)}
        if near & {"id", "endpoint"} if role(w) == "secret" else "secret" in near if role(w) == "id" else {"id", "secret"} <= near:
            linked.append(w)
    order = lambda s: (s[1], KINDS.index(s[0]))
    return sorted(strong, key=order), sorted(strong + linked, key=order), len(linked)


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def made(r, n):
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/+"
    part = {
        0: lambda: "AKIA" + "".join(r.choice("ABC123") for _ in range(r.choice((15, 16, 20)))),
        1: lambda: r.choice(("ASIA", "AIDA")) + "".join(r.choice("XYZ789") for _ in range(r.choice((16, 17)))),
        2: lambda: "".join(r.choice(chars) for _ in range(r.choice((39, 40, 40, 41)))),
        3: lambda: "https://db.example.org/q?a=1",
        4: lambda: r.choice(("Token: ", 'API_KEY="', "secret =", "PassWord:")) + "".join(r.choice("abc_.=") for _ in range(r.randint(4, 9))),
        5: lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((23, 24, 40)))),
        6: lambda: "wörd " * r.randint(1, 70),
        7: lambda: "é\n",
    }
    return " ".join(part[r.randrange(8)]() for _ in range(n))


def test_spans_and_links_equal_brute_force(spark):
    r = random.Random(3)
    key, edge = "Ab1/" * 10, "AKIA" + "A1B2" * 4
    texts = [made(r, r.randint(0, 40)) for _ in range(150)] + [None, "", made(r, 700)]
    texts += [edge + " " * (gap - len(edge)) + key for gap in (secrets.SCOPE - 1, secrets.SCOPE, secrets.SCOPE + 1)]
    rows = [(k, t, "x", "y", k) for k, t in enumerate(texts)] + [(0, texts[0], "x", "y", 0), (None, texts[1], "x", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, spans string, s long")
    got = secrets.report(docs).collect()
    want = []
    for k, t, *_ in rows:
        strong, spans, n = expected(t or "")
        count = [sum(s[0] == kind for s in strong) for kind in KINDS[:3]]
        want.append((k, *count, hashlib.sha256(listed(strong).encode()).hexdigest(), listed(spans), n))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[-1] for w in want) > 50
    at = len(texts) - 3
    assert [w[-1] for w in want[at : at + 3]] == [1, 1, 0]


def test_redact_masks_each_span_once(spark):
    r = random.Random(4)
    texts = [made(r, n) for n in (3, 30, 400)] + [None, "", "a" * 4090 + "token=abcdefgh" + "b" * 9000]
    rows = [(k, t, 1, 2) for k, t in enumerate(texts)] + [(0, texts[1], 1, 2), (None, texts[2], 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, masked int")

    def masked(t):
        if t is None:
            return None
        out, at = [], 0
        for _, a, b in expected(t)[1]:
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(out) + t[at:]

    want = sorted(((k, masked(t), a, b) for k, t, a, b in rows), key=str)
    for few in (256, 0):
        assert sorted(map(tuple, secrets.redact(docs, few=few).collect()), key=str) == want


def test_many_spans_in_one_text(spark):
    one = "0123456789abcdef01234567 "
    docs = spark.createDataFrame([(1, one * 200_000)], "doc_id long, text string")
    began = time.time()
    row = secrets.report(docs).first()
    assert row.n_hex == 200_000 and row.base_sha256 == hashlib.sha256(listed([("hex", k * 25, k * 25 + 24) for k in range(200_000)]).encode()).hexdigest()
    assert time.time() - began < 60


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.report(none).count() == 0 and secrets.redact(none).count() == 0
