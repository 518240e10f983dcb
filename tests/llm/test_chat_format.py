"""Chat formatting: exact round trips, and a plain formatter in Python."""

import hashlib
import random

import pytest

from tidewatch.llm import chat_format
from tidewatch.llm.chat_format import CHAT, TEXT, Template
from tidewatch.llm.queries import op13_chat_format

_SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by_conv.items():
        turns = [t[2:] for t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def nasty(rng):
    parts = ["\\", "#", "##", "###", "####", "</turn>", "</turn>\n", "</turn", "<", "### User: ", "### Other ", ": ", ":", "ok", "é😀", " ", "\n", "\\###", "\\</turn>"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))


def test_round_trip_of_nasty_texts(spark):
    rng = random.Random(7)
    rows = [(conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", None, nasty(rng)]), rng.choice([None, nasty(rng)])) for conv in [*range(150), None] for turn in range(rng.randint(1, 6))]
    pieces = chat_format.segments(spark.createDataFrame(rows, _SCHEMA).repartition(4))
    for got in (chat_format.read(pieces, in_order=True), chat_format.read(pieces.repartition(6))):
        assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == plain(rows)


def test_query_holds_the_probe(spark):
    path = "/root/testdata/sf0.001"
    source = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    got = op13_chat_format(spark, path).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain([*source, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    probe = next(r for r in got if r.conv_id == -7)
    assert probe.formatted_chars == len("### User: ") + len("### Assistant: ") + 2 * (len(said) + 3 + len("</turn>\n"))


def test_machine_and_template(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A"), (2, 0, "user", "U"), (2, 1, "user", "V"), (2, 2, "assistant", "A"), (3, 0, "user", "U"), (4, 0, "user", "x"), (4, 1, "tool", "y"), (4, 2, "assistant", "z")]
    pieces = chat_format.segments(spark.createDataFrame(rows, _SCHEMA))
    assert {r.conv_id: r.legal for r in chat_format.read(pieces).collect()} == {1: True, 2: False, 3: False, 4: False}
    whole = {r.conv_id: r for r in chat_format.texts(pieces).collect()}
    assert whole[1].formatted == "### System: S</turn>\n### User: U</turn>\n### Assistant: A</turn>\n"
    assert [whole[1].formatted[s.start : s.end] for s in whole[1].loss_spans] == ["A"]
    assert whole[4].formatted == "### User: x</turn>\n### Other tool: y</turn>\n### Assistant: z</turn>\n"
    assert {(r.conv_id, r.seq // 3) for r in pieces.collect() if not r.legal} == {(2, 1), (3, 0), (4, 1), (4, 2)}
    other = Template(turns={"q": (("Q>", False), (TEXT, False), ("[end]", False)), "a": (("A>", False), (TEXT, True), ("[end]", False))}, other=("?", ">"), order={("start", "q"): "q", ("q", "a"): "start"}, goal=frozenset({"start"}), controls=("[end]", "Q>", "A>"), escape="^")
    rows = [(1, 0, "q", "[end]^Q>"), (1, 1, "a", "A>^^[end]"), (1, 2, "x>y", "z")]
    pieces = chat_format.segments(spark.createDataFrame(rows, _SCHEMA), other)
    got = chat_format.read(pieces, other).first()
    said = "A>^^[end]"
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (3, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    with pytest.raises(ValueError):
        Template(turns={"q": (("Q>", False), (TEXT, False), ("xx", False))}, other=("?", ">"), order={}, goal=frozenset(), controls=("xx",))


def test_long_empty_and_clashing(spark):
    text = "</turn>###\\" * 300_000
    rows = [(1, 0, "user", text, 5, True), (1, 1, "assistant", text, 5, True), (1, 1, "assistant", text, 5, True)]
    got = chat_format.read(chat_format.segments(spark.createDataFrame(rows, _SCHEMA + ", seq int, loss boolean"))).first()
    assert (got.n_turns, got.loss_chars) == (3, 2 * len(text))
    assert chat_format.read(chat_format.segments(spark.createDataFrame([], _SCHEMA))).count() == 0
    assert CHAT.unescaped(CHAT.escaped(text)) == text
