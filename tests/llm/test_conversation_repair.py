"""Conversation repair against a plain search over edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

from pyspark.sql import functions as F

from tidewatch.llm import conversation_repair
from tidewatch.llm.queries import damaged, op12_conversation_repair

_BLANK = re.compile(r"[^\x20\x09-\x0D]")
_STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_damage(rows):
    """(conv, turn, role, text) after the damage, and all ids."""
    out, ids = [], set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out, ids


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        said = _BLANK.findall(text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]

    @cache
    def best(at, state, inserts):
        """(cost, audit, repaired) of the rest; strings are compared whole."""
        options = []
        if at == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if role[0] in _STEPS[state]:
                    cost, audit, rest = best(at, _STEPS[state][role[0]], inserts + 1)
                    options.append((cost + 2, "I" + audit, (f"{role}:", *rest)))
        if at < len(rows):
            _, role, text = rows[at]
            cost, audit, rest = best(at + 1, state, 0)
            options.append((cost + 3, "D" + audit, rest))
            if faults[at] not in ("blank", "duplicate"):
                cut = faults[at] == "truncated"
                for edit, to, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if to[:1] in _STEPS[state]:
                        cost, audit, rest = best(at + 1, _STEPS[state][to[:1]], 0)
                        options.append((cost + price + cut, edit + audit, (f"{to}:{text}", *rest)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    cost, audit, repaired = best(0, "", 0)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()


def plain(rows, ids):
    by_conv = defaultdict(list)
    for conv, *row in rows:
        by_conv[conv].append(tuple(row))
    return sorted(((c, *plain_repair(by_conv[c])) for c in ids), key=str)


def repaired(rows, **options):
    return sorted(map(tuple, conversation_repair.report(conversation_repair.repair(rows, **options)).collect()), key=str)


def test_query_equals_a_plain_search(spark):
    path = "/root/testdata/sf0.01"
    source = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op12_conversation_repair(spark, path).collect()), key=str) == plain(*plain_damage(source))


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(400):
        for turn in rng.sample(range(30), rng.randint(0, 9)):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["ok.", "ok.", "cut", "Yes!", " \n", "", None, f"n{rng.random()}?", "tab\t.\t\n"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert repaired(df) == plain(whole, {r[0] for r in rows})
    hurt = conversation_repair.report(conversation_repair.repair(damaged(df), named_only=F.col("dropped")))
    assert sorted(map(tuple, hurt.collect()), key=str) == plain(*plain_damage(rows))


def test_long_and_hot_conversations(spark):
    """One conversation of a third of all rows and one signature of most conversations."""
    long = [(0, k, ("user", "assistant")[k % 2] if k % 7 else "user", f"{k}" + "." * (k % 5 > 0)) for k in range(900)]
    hot = [(c, k, role, f"{c} {k}.") for c in range(1, 300) for k, role in enumerate(("system", "user", "assistant", "assistant", "user"))]
    ids = {r[0] for r in long + hot}
    got = repaired(spark.createDataFrame(long + hot, "conv_id long, turn long, role string, text string"))
    assert len(got) == len(ids) and len({r[6:8] for r in got}) == 2
    assert [r for r in got if r[0]] == plain(hot, ids - {0})
    costs = {r[0]: r[6] for r in got}
    assert costs[0] == _forward_cost(long)


def _forward_cost(rows):
    """The cheapest cost by a plain forward pass, for rows without blanks and copies."""
    best = {"": 0}
    grow = lambda states: [states.update({to: min(states.get(to, 10**9), states[s] + 2)}) for _ in range(3) for s in list(states) for r, to in _STEPS[s].items() if r != "s"]
    for _, _, role, text in rows:
        grow(best)
        after = {}
        for state, cost in best.items():
            cut = not text.endswith(".")
            for to, price in [(state, 3), *[(to, (0 if r == role[0] else 2) + cut) for r, to in _STEPS[state].items() if r == role[0] or r != "s"]]:
                after[to] = min(after.get(to, 10**9), cost + price)
        best = after
    grow(best)
    return min(best.get("", 10**9), best.get("a", 10**9))


def test_defined_cases(spark):
    schema = "conv_id long, turn long, role string, text string, gone boolean, audit string, cost int, signature string"
    rows = [(1, 5, "user", "Hi.", False), (1, 5, "assistant", "Yes.", False), (2, 1, "user", "x.", True), (None, None, "user", "Hi.", False), (3, 1, "system", "S.", False), (4, None, "user", "a" * 3_000_000 + ".", False), (4, None, "assistant", "b.", False)]
    got = {r[0]: r[1:] for r in repaired(spark.createDataFrame([(*r, "z", 9, "q") for r in rows], schema), named_only=F.col("gone"))}
    assert got[1][5:7] == (4, "IKKI")  # at one turn, assistant comes before user
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[None][4:7] == (0, 2, "KI")
    assert got[3][5:7] == (3, "D")
    assert got[4][0] == 0
    assert repaired(spark.createDataFrame([], schema)) == []


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A?"), (1, 1, "user", "B?"), (1, 2, "tool", "C.")], "conv_id int, turn int, role string, text string")
    got = [(r.position, r.edit, r.role, r.text) for r in conversation_repair.repair(rows).collect() if r.position]
    assert got == [(1, "K", "user", "A?"), (2, "I", "assistant", ""), (3, "K", "user", "B?"), (4, "R", "assistant", "C.")]
