"""Chat formatting: a finite-state machine over roles emits the text segments of a declarative template, each with a loss flag.

A `Template` states, for every role, the pieces of a turn (literals and the text, each with its loss flag), the order of roles as a table of
(state, role) -> state, and the control strings that texts must not contain bare. Inside a text the escape character is doubled and every
control string gets the escape character before it, which `unescaped` takes back; so a text can say anything, the template's own marks too.

`segments` gives one row for each piece, so a conversation of any length never has to fit into a row: the formatted text is the concatenation of its
segments by `seq`. `read` is the way back: it parses turns out of the segments and collects what lies under the loss mask. Both stream over
rows sorted by conversation; a task holds one turn at a time. A conversation is one chain of states (and its digests are one chain of bytes), so its rows
meet in one task, which sorts them on disk where they are many.

Defined cases: rows come by turn, nulls first; equal turns by role, then text; repeated rows stay. A null text is empty, a null role is the empty
role. Turns that the machine rejects (an unknown role, a wrong order, no assistant at the end) are formatted all the same; `legal` marks them and
the machine goes on from the state that the role leads to. Roles without pieces of their own take the `other` form, under no loss. A null conv_id is
a conversation of its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, batches_of, rows_of

#: Stands for the text of a turn among its pieces.
TEXT = None


@dataclass(frozen=True)
class Template:
    """Pieces of a turn by role as (literal or TEXT, loss); the first is the header and the last the closing mark, which all roles share."""

    turns: dict[str, tuple[tuple[str | None, bool], ...]]
    #: header of roles without pieces: what stands before and after the role
    other: tuple[str, str]
    #: the machine: state and role to the next state; `goal` are the states in which a conversation may end
    order: dict[tuple[str, str], str]
    goal: frozenset[str]
    controls: tuple[str, ...]
    start: str = "start"
    escape: str = "\\"
    close: str = field(init=False)

    def __post_init__(self) -> None:
        closing = {pieces[-1][0] for pieces in self.turns.values()}
        heads = [pieces[0][0] for pieces in self.turns.values()] + [self.other[0]]
        if len(closing) != 1 or any(a is not b and a.startswith(b) for a in heads for b in heads):
            raise ValueError("turns must share their closing mark, and no header may begin another")
        object.__setattr__(self, "close", closing.pop())
        if any(self.escape in c for c in (*self.controls, self.close)) or any(self.close[:k] == self.close[-k:] for k in range(1, len(self.close))) or not any(self.close.startswith(c) for c in self.controls):
            raise ValueError("control strings must not hold the escape, and the closing mark must begin with one of them and not with its own end")

    def escaped(self, text: str, *more: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        for control in (*self.controls, *more):
            text = text.replace(control, self.escape + control)
        return text

    def unescaped(self, text: str, *more: str) -> str:
        return self._marks(*more).sub(lambda m: m.group()[len(self.escape) :], text) if self.escape in text else text

    def _marks(self, *more: str) -> re.Pattern:
        return re.compile(re.escape(self.escape) + "(?:" + "|".join(map(re.escape, (self.escape, *self.controls, *more))) + ")")

    def pieces(self, role: str, text: str) -> list[tuple[str, bool]]:
        own = self.turns.get(role) or ((self.other[0] + self.escaped(role, self.other[1]) + self.other[1], False), (TEXT, False), (self.close, False))
        return [(self.escaped(text) if piece is TEXT else piece, loss) for piece, loss in own]

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state and whether the machine allows it; after a fault it goes on where the role leads from elsewhere, or from the start."""
        if (state, role) in self.order:
            return self.order[state, role], True
        return next((to for (_, r), to in self.order.items() if r == role), self.start), False

    def ends(self) -> re.Pattern:
        """Finds escaped marks and bare closing marks."""
        return re.compile(self._marks().pattern + "|(" + re.escape(self.close) + ")")

    def turn(self, formatted: str) -> tuple[str, str]:
        """Role and text of a formatted turn without its closing mark."""
        for role, pieces in self.turns.items():
            if formatted.startswith(pieces[0][0]):
                return role, self.unescaped(formatted[len(pieces[0][0]) :])
        before, after = self.other
        bare = re.compile(self._marks(after).pattern + "|(" + re.escape(after) + ")")
        end = next(m.start() for m in bare.finditer(formatted, len(before)) if m.group(1))
        return self.unescaped(formatted[len(before) : end], after), self.unescaped(formatted[end + len(after) :])


_HEAD = {role: f"### {role.capitalize()}: " for role in ("system", "user", "assistant")}
#: A turn is `### Role: text</turn>` and a newline; only what assistants say is trained on.
CHAT = Template(
    turns={role: ((head, False), (TEXT, role == "assistant"), ("</turn>\n", False)) for role, head in _HEAD.items()},
    other=("### Other ", ": "),
    order={("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    goal=frozenset({"answered"}),
    controls=("###", "</turn>"),
)


def segments(conversations: DataFrame, template: Template = CHAT, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, seq (from 0), text, loss, legal: the pieces of all turns, in order within their partition. `legal` is the machine's verdict on the piece's turn, false too for a last turn in which no conversation may end."""
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, seq long, text string, loss boolean, legal boolean"
    schema = arrow_schema(ddl)

    def formatted(turns: Iterator[tuple]) -> Iterator[tuple]:
        conv, state, seq, held = object(), template.start, 0, None

        def out(last: bool) -> Iterator[tuple]:
            nonlocal seq
            role, text, legal = held
            for piece, loss in template.pieces(role, text):
                yield conv, seq, piece, loss, legal and not (last and state not in template.goal)
                seq += 1

        for own, _, role, text in turns:
            if held is not None:
                yield from out(own != conv)
            if own != conv:
                conv, state, seq = own, template.start, 0
            state, legal = template.step(state, role)
            held = role, text, legal
        if held is not None:
            yield from out(True)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(lambda batches: batches_of(formatted(rows_of(batches)), schema), ddl)


def read(formatted: DataFrame, template: Template = CHAT, *, in_order: bool = False) -> DataFrame:
    """What the segments say, one row for each conversation: conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (the unescaped text under the loss mask), formatted_chars, legal (all turns). Turns are parsed from the segments' texts alone. `in_order` says that each partition holds whole conversations by seq, as `segments` leaves them."""
    own = formatted.select("conv_id", "seq", "text", "loss", "legal")
    if not in_order:
        own = own.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    ddl = f"conv_id {own.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, legal boolean"
    schema = arrow_schema(ddl)
    ends = template.ends()

    def report(pieces: Iterator[tuple]) -> Iterator[tuple]:
        conv, counts = object(), None
        for own, _, text, loss, legal in pieces:
            if own != conv:
                if counts is not None:
                    yield conv, counts[0], turns.hexdigest(), counts[1], losses.hexdigest(), counts[2], counts[3]
                conv, counts, turns, losses, open_turn = own, [0, 0, 0, True], hashlib.sha256(), hashlib.sha256(), []
            counts[2] += len(text)
            counts[3] &= legal
            if loss:
                said = template.unescaped(text)
                counts[1] += len(said)
                losses.update(said.encode())
            at = 0
            for m in ends.finditer(text):  # a segment never ends within a mark
                if m.group(1):
                    role, said = template.turn("".join([*open_turn, text[at : m.start()]]))
                    turns.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                    at, open_turn = m.end(), []
            open_turn.append(text[at:])
        if counts is not None:
            yield conv, counts[0], turns.hexdigest(), counts[1], losses.hexdigest(), counts[2], counts[3]

    return own.mapInArrow(lambda batches: batches_of(report(rows_of(batches)), schema), ddl)


def texts(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted (the whole text) and loss_spans ([start, end) code points under the loss mask): for conversations that fit into a row each."""
    pieces = F.array_sort(F.collect_list(F.struct("seq", "text", "loss")))
    ends = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), lambda acc, p: F.struct((acc["at"] + F.length(p["text"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    return formatted.groupBy("conv_id").agg(pieces.alias("pieces")).select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), ends.alias("loss_spans"))
