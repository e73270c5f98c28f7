"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, the segments of a turn (literal marks, and the
text, each with a loss flag), and the machine: which role may follow which
state, and in which states a conversation may end.  ``segments`` runs the
machine over each conversation's turns and emits the text segments with their
loss flags; ``read_back`` parses the formatted text again.

Marks are control strings.  Each begins with an opening character (``<`` or
``[`` in ``TEMPLATE``) that occurs nowhere else in a mark.  Inside texts the
escape character is put behind every opening character and every escape
character is doubled, so no mark can occur in a text, and taking that back is
unambiguous from left to right.

Every turn is formatted, whatever the order: one that the machine does not
accept is flagged (``accepted`` is false) and the machine goes on from the
turn's role.  A role without a form of its own is written out in the marks of
``other``.  A conversation is valid if all its turns are accepted and it ends
in an end state.

Turns are dealt out and sorted by conversation and turn, and tasks pass over
them as a stream: what is held does not grow with a conversation.  Turns with
equal numbers are ordered by role, then text, nulls first, and rows that repeat
are turns of their own.  A null text is empty, a null role is the empty role,
and turns without a conversation id form one conversation.  An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from attrition.llm.common import plus

#: Stand for the turn's text, or its role, in a form.
TEXT, ROLE = 0, 1


@dataclass(frozen=True)
class Form:
    """The segments of a turn in order, each a mark, ``TEXT`` or ``ROLE``, and whether the text is learned."""

    parts: tuple[str | int, ...]
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Forms by role, the mark before a conversation, and the machine over roles.

    ``follows[state]`` lists the roles that are accepted in a state; a turn's
    role is the state after it, ``start`` the state before the first.  A form
    begins and ends with a mark, and has one between any two others; its first
    mark is its own.  Only ``other`` writes the role.
    """

    forms: Mapping[str, Form]
    other: Form
    follows: Mapping[str, tuple[str, ...]]
    ends: tuple[str, ...]
    opening: str = "<s>"
    start: str = ""
    escape: str = "\\"

    def __post_init__(self):
        marks = [self.opening, *(p for f in self._all() for p in f.parts if isinstance(p, str))]
        first = [self.opening, *(f.parts[0] for f in self._all())]
        ends = [f.parts[-1] for f in self._all()]
        gaps = [a for f in self._all() for a, b in zip(f.parts, f.parts[1:], strict=False) if not isinstance(a, str) and not isinstance(b, str)]
        if any(set(m[1:]) & self._openers or self.escape in m for m in marks):
            raise ValueError("a mark holds one opening character, its first, and no escape character")
        if gaps or not all(isinstance(p, str) and p for p in first + ends) or len(set(first)) < len(first):
            raise ValueError("a form begins with a mark of its own, ends with one, and has one between any two others")
        if ROLE not in self.other.parts or any(TEXT not in f.parts for f in self._all()):
            raise ValueError("every form writes the text, and the form of other roles the role")

    def _all(self) -> list[Form]:
        return [*self.forms.values(), self.other]

    @cached_property
    def _openers(self) -> set[str]:
        return {self.opening[0], *(p[0] for f in self._all() for p in f.parts if isinstance(p, str) and p)}

    @cached_property
    def _special(self) -> str:
        return "[" + re.escape("".join(sorted(self._openers | {self.escape}))) + "]"

    def escaped(self, text: str) -> str:
        """``text`` with the escape character behind each opening and each escape character."""
        return re.sub(self._special, lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        """What ``escaped`` was given."""
        return re.sub(f"({self._special}){re.escape(self.escape)}", r"\1", text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn, with their loss flags."""
        form = self.forms.get(role, self.other)
        held = {TEXT: (self.escaped(text), form.loss), ROLE: (self.escaped(role), False)}
        return [(p, False) if isinstance(p, str) else held[p] for p in form.parts]

    def accepts(self, state: str, role: str) -> bool:
        """Whether the machine has a transition for ``role`` from ``state``."""
        return role in self.follows.get(state, ())

    @cached_property
    def _turn(self) -> re.Pattern:
        """One whole turn in a formatted text."""
        plain = self._special.replace("[", "[^", 1)
        content = f"((?:{plain}++|{self._special}{re.escape(self.escape)})*+)"
        forms = ["".join(re.escape(p) if isinstance(p, str) else content for p in f.parts) for f in self._all()]
        return re.compile("|".join(f"(?:{f})" for f in forms))

    def read(self, formatted: str, at: int) -> tuple[str, str, int] | None:
        """Role and text of the turn that stands at ``at``, and where it ends; none if no whole turn does."""
        found = self._turn.match(formatted, at)
        if not found:
            return None
        group = 1
        for role, form in [*self.forms.items(), (None, self.other)]:
            contents = [p for p in form.parts if not isinstance(p, str)]
            if found[group] is not None:
                held = {p: self.unescaped(found[group + i]) for i, p in enumerate(contents)}
                return held.get(ROLE, role), held[TEXT], found.end()
            group += len(contents)
        return None


#: The default template's marks and order of roles.
TEMPLATE = Template(
    forms={
        "system": Form(("[SYS] ", TEXT, "[/SYS]")),
        "user": Form(("[INST] ", TEXT, "[/INST]")),
        "assistant": Form(("[ANS] ", TEXT, "</s>"), loss=True),
    },
    other=Form(("[ROLE] ", ROLE, "[/ROLE]", TEXT, "[/TEXT]")),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def segments(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``conv_id, place, role, accepted, segments`` for each turn, in order within each task.

    ``place`` numbers a conversation's turns from 0; ``segments`` holds ``text``
    and ``loss``.  A conversation's formatted text is its segments' texts, by
    place, one after the other; the opening mark is the first turn's.
    """
    turns = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    part = StructType([StructField("text", StringType()), StructField("loss", BooleanType())])
    more = [("place", LongType()), ("role", StringType()), ("accepted", BooleanType()), ("segments", ArrayType(part))]
    schema = StructType([turns.schema["conv_id"], *(StructField(n, t) for n, t in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, state = object(), 0, template.start
        for batch in batches:
            places, roles, accepted, ends, texts, losses = [], [], [], [0], [], []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv, role, text in zip(*columns, strict=True):
                if conv != now:
                    now, place, state = conv, 0, template.start
                role = role or ""
                own = template.turn(role, text or "")
                if not place:
                    own = [(template.opening, False), *own]
                places.append(place)
                roles.append(role)
                accepted.append(template.accepts(state, role))
                texts += [t for t, _ in own]
                losses += [loss for _, loss in own]
                ends.append(len(texts))
                place, state = place + 1, role
            parts = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(losses, pa.bool_())], names=["text", "loss"])
            arrays = [pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(accepted, pa.bool_())]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], names=schema.names)

    return turns.mapInArrow(run, schema)


class _Reading:
    """What has been read of one conversation: turns are digested as they are completed."""

    def __init__(self, template: Template):
        self.template, self.rest, self.opened = template, "", False
        self.n, self.chars, self.loss_chars, self.valid, self.state = 0, 0, 0, True, template.start
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            learned = self.template.unescaped(text)
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.rest += text
        if not self.opened:
            if not self.rest.startswith(self.template.opening):
                return
            self.opened, self.rest = True, self.rest[len(self.template.opening) :]
        at = 0
        while turn := self.template.read(self.rest, at):
            role, said, at = turn
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.valid &= self.template.accepts(self.state, role)
            self.n, self.state = self.n + 1, role
        self.rest = self.rest[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"not a formatted conversation: {self.rest[:80]!r}")
        valid = self.valid and self.state in self.template.ends
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


def read_back(parts: DataFrame, template: Template = TEMPLATE, ordered: bool = True) -> DataFrame:
    """What formatted conversations say: a row each with ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid``.

    Roles and texts are parsed from the formatted text alone, the learned text
    is what lies under the loss flags.  ``parts`` is what ``segments`` returned,
    in its order; rows that were stored and read again need ``ordered=False``.
    """
    if not ordered:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    parts = parts.select("conv_id", "segments")
    schema = plus(StructType([parts.schema["conv_id"]]), n_turns="long", turns_sha256="string", loss_chars="long", loss_sha256="string", formatted_chars="long")
    schema = schema.add("valid", BooleanType())
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reading, kind = None, None, None

        def ready(rows: list[tuple]) -> pa.RecordBatch:
            ids, *columns = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(list(ids), kind), *arrays], names=schema.names)

        for batch in batches:
            kind, rows = batch.schema.field("conv_id").type, []
            for conv, own in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                if reading is None or conv != now:
                    if reading is not None:
                        rows.append((now, *reading.row()))
                    now, reading = conv, _Reading(template)
                for part in own:
                    reading.feed(part["text"], part["loss"])
            yield ready(rows)
        if reading is not None:
            yield ready([(now, *reading.row())])

    return parts.mapInArrow(run, schema)
