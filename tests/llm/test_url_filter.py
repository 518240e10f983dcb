"""The training sample of the URL filter."""

import numpy as np
import xxhash

from tidewatch.llm import url_filter


def test_a_repeated_url_does_not_fill_the_sample(spark):
    urls = [f"https://site{k}.{'xyz' if k % 2 else 'org'}/page/{k}" for k in range(60)]
    first = min((u for u in urls if ".xyz" in u), key=lambda u: np.uint64(xxhash.xxh64_intdigest(u.encode(), 42)).astype(np.int64))
    labelled = spark.createDataFrame([(u, int(".xyz" in u)) for u in urls + [first] * 200], "url string, blocked int")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    seen = {r.page_id: r.verdict for r in url_filter.judge(pages, labelled, rules=(), max_training=50).collect()}
    assert seen == {k: "block" if ".xyz" in u else "allow" for k, u in enumerate(urls)}


def judged_by_rules(url, rules=url_filter.RULES):
    """A plain judge: host, path and the longest rule that fits."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = after[: min([after.index(c) for c in "?#" if c in after], default=len(after))]
    fits = [r for r, _ in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_rules_equal_a_plain_judge(spark):
    import random

    r = random.Random(5)
    made = lambda: r.choice(("http://", "https://", "HTTP://", "", "a://b://")) + r.choice(("net", "x.NET", "xnet", "example.net", "A.example.net", "b.example.com", "org", "q.org", "")) + r.choice(("", "/", "/en/x", "/de/", "/fr/é", "/en", "?/fr/", "#/", "/de/?a=1#b"))
    urls = [made() for _ in range(400)] + [None, "", "http://net", "http://net/"]
    pages = spark.createDataFrame([(k, u, "x", 1.0) for k, u in enumerate(urls)] + [(0, urls[0], "x", 1.0)], "page_id long, url string, host string, score double")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 1
    verdicts = dict(url_filter.RULES)
    for row in got:
        want = judged_by_rules(urls[row.page_id])
        assert (row.host, row.path, row.rule) == want
        assert row.verdict in ("allow", "block") and (row.rule is None or row.verdict == verdicts[row.rule])


def test_trees_rank_urls_that_they_have_not_seen(spark):
    import random

    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    good = lambda: f"https://{word(8)}.org/{word(5)}/{word(7)}"
    bad = lambda: f"http://{word(3)}{r.randint(100, 999)}-{word(4)}{r.randint(10, 99)}.org/{word(4)}?id={r.randint(0, 10**9)}&s={r.randint(0, 999)}"
    labelled = spark.createDataFrame([(good(), 0) for _ in range(300)] + [(bad(), 1) for _ in range(300)], "url string, blocked int")
    unseen = [good() for _ in range(60)] + [bad() for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(unseen)), "page_id long, url string")
    score = {row.page_id: row.score for row in url_filter.judge(pages, labelled, rules=()).collect()}
    won = sum((score[b] > score[a]) + 0.5 * (score[b] == score[a]) for a in range(60) for b in range(60, 120)) / 3600
    assert won > 0.95  # held-out AUC


def test_defined_cases(spark):
    pages = spark.createDataFrame([(1, "http://q.xyz/"), (2, None)], "page_id long, url string")
    labelled = spark.createDataFrame([("http://a.b/", 1), ("http://c.d/", 1)], "url string, blocked int")
    assert {row.verdict for row in url_filter.judge(pages, labelled, rules=()).collect()} == {"block"}
    assert {row.verdict for row in url_filter.judge(pages, labelled.where("false"), rules=()).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false")).count() == 0
