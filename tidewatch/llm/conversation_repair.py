"""Conversation structure repair over a suffix-shared word graph of signatures.

Every row of a conversation becomes one symbol: the initial of its role (s, u, a; x for any other), in capitals where its text is cut off, or d
where it must go (blank, or a copy of an earlier row). What the cheapest repair of the rest of a conversation costs depends on its remaining
symbols alone. So the graph's nodes are the distinct suffixes of all signatures, minimised from the end: each node leads by its first symbol to the
node of the shorter suffix, down to the one end that all share. Each node holds, for each state of the grammar (s?(ua)+)?, the cost to go and the
first edit of the best audit, whose rest is the successor's.

On Spark: signatures come from rows without their texts; conversations are then dealt by range of their reversed signatures, so that
conversations which share suffixes meet, in order, and a task walks the graph with one stack: what two neighbours share is kept, equal
signatures cost nothing, and a node that two ranges share is computed in both, at most once for each range. The last 32 symbols and then a hash of
the conversation make the ranges, so a signature that a third of all conversations have is spread over many tasks. Last, audits meet the rows in one
sorted stream that edits them. A task holds one row and, for one conversation, a byte a row (the signature, the audit, the stack's path); a
conversation is edited in order and its digest is one chain, so its rows are sorted, on disk where they are many, and stream through one task.

Costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant row 2; a cut-off row that stays adds 1. Equal costs take the
ASCII-least audit; from one node and state each edit leads to one state, so the first edit decides.

Defined cases: rows come by turn, nulls first, equal turns by role, then by the MD5 of the text; a null role or text counts as one space. A null conv_id is a
conversation of its own. Copies are rows of equal role and text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import arrow_schema, batches_of, checkpoint, rows_of

RE_ROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
_SPACES = " \t\n\x0b\f\r"
#: grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end
_ORDER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: where an inserted or reroled row leads, and its role
_FORCED = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_LEGAL = {"su", "ua", "au"}


def _closed(base: list[tuple]) -> tuple:
    """Adds insertions before the next row. An entry is (cost, edit, next state, inserted): inserted rows stay at the node. Two in a row lead back, so one from 2 or 3 is enough, and one before what 2 does from 0 or 1."""
    inserted = [(base[_FORCED[s]][0] + INSERT, "I", _FORCED[s], True) for s in (2, 3)]
    two, three = min(base[2], inserted[0]), min(base[3], inserted[1])
    begun = (two[0] + INSERT, "I", 2, True)
    return min(base[0], begun), min(base[1], begun), two, three


_NEVER = (float("inf"), "~", 0, False)
_END = _closed([(0, "", 0, False), _NEVER, _NEVER, (0, "", 3, False)])


def _node(symbol: str, rest: tuple) -> tuple:
    """The node of a suffix from its first symbol and the node of the rest."""
    base = []
    for state in range(4):
        options = [(rest[state][0] + DELETE, "D", state, False)]
        if symbol != "d":
            cut = CUT_OFF * symbol.isupper()
            options.append((rest[_FORCED[state]][0] + RE_ROLE + cut, "R", _FORCED[state], False))
            if (to := _ORDER[state].get(symbol.lower())) is not None:
                options.append((rest[to][0] + cut, "K", to, False))
        base.append(min(options))
    return _closed(base)


def _audit(stack: list[tuple]) -> tuple[int, str]:
    """Cost and edits along the path from the stack's last node to the end."""
    state, at, edits = 0, len(stack) - 1, []
    while True:
        _, edit, to, inserted = stack[at][state]
        if not edit:
            return int(stack[-1][0][0]), "".join(edits)
        edits.append(edit)
        state, at = to, at - (not inserted)


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def _slim(rows: DataFrame) -> DataFrame:
    """Rows in the order of the repair without their texts: initial, blank, cut_off and copy decide the symbol."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    slim = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "named_only", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut_off"))
    # partitions by conv_id serve this window as well
    nth = F.row_number().over(Window.partitionBy("conv_id", "named_only", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    return slim.repartition("conv_id").withColumn("nth", nth).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "nth").select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "named_only", "blank", (F.col("nth") > 1).alias("copy"), "cut_off")


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of faults and the signature of each conversation. Takes conv_id, turn, role, text and named_only."""
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_COUNTS}, signature string"
    schema = arrow_schema(ddl)

    def signed(slim: Iterator[tuple]) -> Iterator[tuple]:
        conv, signature = object(), None

        def out() -> tuple:
            gaps = high - low + 1 - distinct if distinct else 0
            return conv, gaps, blanks, copies, cuts, illegal, signature.decode()

        for own, turn, initial, named_only, blank, copy, cut in slim:
            if own != conv:
                if signature is not None:
                    yield out()
                conv, signature, before = own, bytearray(), None
                low = high = None
                distinct = blanks = copies = cuts = illegal = 0
            if named_only:
                continue
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
            illegal += before is not None and before + initial not in _LEGAL
            before = initial
            blanks, copies, cuts = blanks + blank, copies + (copy and not blank), cuts + (cut and not blank and not copy)
            kind = initial if initial in ("s", "u", "a") else "x"
            signature += ("d" if blank or copy else kind.upper() if cut else kind).encode()
        if signature is not None:
            yield out()

    return _slim(rows).mapInArrow(lambda batches: batches_of(signed(rows_of(batches)), schema), ddl)


def audits(signed: DataFrame) -> DataFrame:
    """The rows of `signatures` with cost and audit."""
    counts = [c for c in signed.columns if c not in ("conv_id", "signature")]
    from_end = checkpoint(signed.withColumn("signature", F.reverse("signature")))
    ddl = f"conv_id {signed.schema['conv_id'].dataType.simpleString()}, {_COUNTS}, cost long, audit string"
    schema = arrow_schema(ddl)

    def judged(rows: Iterator[tuple]) -> Iterator[tuple]:
        stack, path, found = [_END], "", (0, "")
        for *own, signature in rows:
            if signature != path:
                shared = _shared(path, signature)
                del stack[shared + 1 :]
                for symbol in signature[shared:]:
                    stack.append(_node(symbol, stack[-1]))
                path, found = signature, _audit(stack)
            yield *own, *found

    dealt = from_end.repartitionByRange(F.substring("signature", 1, 32), F.xxhash64("conv_id")).sortWithinPartitions("signature")
    return dealt.select("conv_id", *counts, "signature").mapInArrow(lambda batches: batches_of(judged(rows_of(batches)), schema), ddl)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def repair(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", named_only: Column | None = None) -> DataFrame:
    """The repaired rows. For each conversation first a head (position 0: the counts of faults, cost and audit), then its rows: position, edit (K, R or I), role, text; in order within their partition.

    `named_only` marks rows that only name their conversation and aren't part of it."""
    space = F.lit(" ")
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
        (F.lit(False) if named_only is None else F.coalesce(named_only, F.lit(False))).alias("named_only"),
    )
    heads = audits(signatures(rows))
    report = [c for c in heads.columns if c != "conv_id"]
    kind = rows.schema["conv_id"].dataType.simpleString()
    empty = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in report]
    members = rows.where("NOT named_only").select("conv_id", F.lit(1).alias("part"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text", *empty)
    first = heads.select("conv_id", F.lit(0).alias("part"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))], *report)
    stream = first.unionByName(members).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "digest").drop("turn", "digest")
    ddl = f"conv_id {kind}, position long, edit string, role string, text string, {_COUNTS}, cost long, audit string"
    schema = arrow_schema(ddl)
    blank = (None,) * len(report)

    def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, audit, at, state, position = None, "", 0, 0, 0

        def inserts() -> Iterator[tuple]:
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                position += 1
                yield conv, position, "I", _ROLE[state], "", *blank
                at, state = at + 1, _FORCED[state]

        for own, part, role, text, *head in rows:
            if part == 0:
                yield from inserts()
                conv, audit, at, state, position = own, head[-1], 0, 0, 0
                yield own, 0, None, None, None, *head
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                to = _FORCED[state] if edit == "R" else _ORDER[state][role[0]]
                position += 1
                yield own, position, edit, _ROLE[state] if edit == "R" else role, text, *blank
                state = to
        yield from inserts()

    return stream.mapInArrow(lambda batches: batches_of(edited(rows_of(batches)), schema), ddl)


def report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: counts of faults, cost, audit and repaired_sha256 (`role:text`, newline-joined). Takes `repair`'s rows as it leaves them, in order."""
    ddl = f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, {_COUNTS}, cost long, audit string, repaired_sha256 string"
    schema = arrow_schema(ddl)

    def digested(rows: Iterator[tuple]) -> Iterator[tuple]:
        head = None
        for own, position, _, role, text, *report in rows:
            if position == 0:
                if head is not None:
                    yield *head, digest.hexdigest()
                head, digest = (own, *report), hashlib.sha256()
            else:
                digest.update(f"{chr(10) * (position > 1)}{role}:{text}".encode())
        if head is not None:
            yield *head, digest.hexdigest()

    return repaired.mapInArrow(lambda batches: batches_of(digested(rows_of(batches)), schema), ddl)
