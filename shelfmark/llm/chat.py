"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's rows are dealt to one task, ordered by turn, and pass through
as a stream: per row the machine takes one step and segments of text leave, each
with a flag that says whether its text counts in the loss. No conversation is
held as a whole, so a very long one costs time in its task but no memory.

A template marks turns by control strings. Inside texts and role names a control
string is escaped by a mark before it, and the mark by itself, so formatted text
reads back to the same turns.

Defined cases: rows of one conversation are ordered by turn, then role, then
text, nulls first; a null text or role is empty; a null conv_id is one
conversation of its own; repeated rows are turns of their own; a conversation in
wrong turn order is formatted all the same and marked invalid.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import bounded_batches


@dataclass(frozen=True)
class Template:
    """How turns are written; ``learned`` are the roles whose texts count in the loss."""

    opening: str = "### "
    naming: str = ": "
    closing: str = " </turn>\n"
    # What must not stand in a text as it is, longest first; the mark escapes itself too.
    controls: tuple[str, ...] = ("</turn>", "###")
    mark: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})

    def __post_init__(self):
        if not all(any(c in part for c in self.controls) for part in (self.opening, self.closing)):
            raise ValueError("opening and closing must hold a control string")

    def escaped(self, text: str) -> str:
        special = "|".join(map(re.escape, (self.mark, *self.controls)))
        return re.sub(special, lambda found: self.mark + found[0], text)

    def escaped_name(self, role: str) -> str:
        """A role as written: a name of its own, or the role after a mark, its separators escaped."""
        if role in self.names:
            return self.names[role]
        return self.mark + "=" + self.escaped(role).replace(self.naming[0], self.mark + self.naming[0])

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [
            (self.opening + self.escaped_name(role) + self.naming, False),
            (self.escaped(text), role in self.learned),
            (self.closing, False),
        ]

    def unescaped(self, text: str) -> str:
        special = "|".join(map(re.escape, (self.mark, self.naming[0], *self.controls)))
        return re.sub(f"{re.escape(self.mark)}({special})", r"\1", text)

    def reader(self) -> re.Pattern:
        """One turn: opening, name, text up to the first closing that no mark escapes."""
        mark = re.escape(self.mark)
        special = "|".join(map(re.escape, (self.mark, self.naming[0], *self.controls)))
        inside = rf"(?:{mark}(?:{special})|(?!{re.escape(self.closing)}).)*+"
        name = rf"(?:{mark}(?:=|{special})|(?!{re.escape(self.naming)})[^{mark}])*+"
        return re.compile(
            f"{re.escape(self.opening)}({name}){re.escape(self.naming)}({inside}){re.escape(self.closing)}", re.DOTALL
        )

    def role_of(self, name: str) -> str:
        by_name = {shown: role for role, shown in self.names.items()}
        return by_name[name] if name in by_name else self.unescaped(name.removeprefix(self.mark + "="))


# The roles that may follow each state; a valid conversation may end after any of them.
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
WRONG = "wrong"
ACCEPTED = ("system", "user", "assistant")


def step(state: str, role: str) -> str:
    """The state after a turn of ``role``; a wrong turn leads to a state without exit."""
    return MACHINE.get(state, {}).get(role, WRONG)


def _dealt(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    role = F.coalesce(F.col("role"), F.lit("")).alias("role")
    return (
        conversations.select("conv_id", "turn", role, text)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, position, segment, loss and state (of the machine after its turn), in order within each task.

    A conversation's formatted text is its segments by position.
    """
    template = template or Template()
    bounded_batches(conversations.sparkSession)
    source = _dealt(conversations)
    schema = T.StructType(
        [
            source.schema["conv_id"],
            T.StructField("position", T.LongType()),
            T.StructField("segment", T.StringType()),
            T.StructField("loss", T.BooleanType()),
            T.StructField("state", T.StringType()),
        ]
    )

    def format_turns(batches):
        now, state, position = (), "start", 0
        for batch in batches:
            rows: list[tuple] = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if (conv,) != now:
                    now, state, position = (conv,), "start", 0
                state = step(state, role)
                for segment, loss in template.segments(role, text):
                    rows.append((conv, position, segment, loss, state))
                    position += 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names=schema.names
            )

    return source.mapInArrow(format_turns, schema)


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, text, valid, and loss (start and end of every part that counts) of every conversation.

    For conversations that fit in a row; :func:`segments` has no such bound.
    """
    parts = segments(conversations, template)
    part = F.struct("position", "segment", "loss", "state")
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))

    def add(state, one):
        end = state["at"] + F.length(one["segment"])
        span = F.struct(state["at"].alias("start"), end.alias("end"))
        spans = F.when(one["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"),
        F.element_at("parts", -1)["state"].isin(*ACCEPTED).alias("valid"),
        F.aggregate("parts", start, add, lambda state: state["spans"]).alias("loss"),
    )


class Reader:
    """Reads one conversation's formatted text back, piece by piece."""

    def __init__(self, template: Template):
        self.template, self.pattern = template, template.reader()
        self.rest, self.turns, self.n_turns = "", hashlib.sha256(), 0
        self.loss, self.loss_chars, self.chars, self.state = hashlib.sha256(), 0, 0, "start"

    def add(self, segment: str, loss: bool, state: str) -> None:
        self.chars += len(segment)
        self.state = state
        if loss:
            learned = self.template.unescaped(segment)
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.rest += segment
        if segment == self.template.closing:
            at = 0
            while found := self.pattern.match(self.rest, at):
                role, text = self.template.role_of(found[1]), self.template.unescaped(found[2])
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n_turns += 1
                at = found.end()
            self.rest = self.rest[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("formatted text ends within a turn")
        valid = self.state in ACCEPTED
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid)


def digests(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, read back from its segments: turns, their digest, the learned text's, length, validity.

    ``parts`` come from :func:`segments`, in the order they leave it.
    """
    template = template or Template()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType(), T.BooleanType()]
    fields = [T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)]
    schema = T.StructType([parts.schema["conv_id"], *fields])

    def read(batches) -> Iterator[pa.RecordBatch]:
        now, reader, id_type = (), None, None

        def out(rows):
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, types, strict=True)], names=schema.names
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            rows = []
            for conv, segment, loss, state in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if (conv,) != now:
                    if reader:
                        rows.append((*now, *reader.row()))
                    now, reader = (conv,), Reader(template)
                reader.add(segment, loss, state)
            yield out(rows)
        if reader:
            yield out([(*now, *reader.row())])

    return parts.mapInArrow(read, schema)


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    # The contract's own conversation, with the template's control strings in its texts.
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], conversations.schema)
    return digests(segments(conversations.unionByName(own)))
