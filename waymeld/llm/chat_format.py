"""Chat formatting: a machine over roles checks turn order and emits text segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table


@dataclass(frozen=True)
class Turn:
    """What stands before and after a turn's text, and whether the text carries loss."""
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Declares the marks of each role, of any other role, and which role may follow which.

    `other` has a second opening part behind the role's name. A role of `turns` may
    have an empty opening if no other has; its turns are told by the absence of an opening.
    """
    turns: dict[str, Turn]
    other: tuple[str, str, str]
    follows: dict[str, tuple[str, ...]]
    last: tuple[str, ...]
    controls: tuple[str, ...] = field(default=())


INSTRUCT = Template(
    turns={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("", "</s>", True)},
    other=("[ROLE] ", " [/ROLE]", "</s>"),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    last=("assistant",),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"))


class Escaper:
    """Breaks every control string in a text by a backslash behind its first character, and mends it again.

    A text that holds such a broken string gets one more backslash, so each step can be undone.
    """

    def __init__(self, controls: tuple[str, ...]):
        ends = "|".join(f"(?<={re.escape(c[0])})" + r"\\*" + f"(?={re.escape(c[1:])})" for c in controls)
        self._places = re.compile(ends)

    def escape(self, text: str) -> str:
        return self._places.sub(lambda m: m[0] + "\\", text)

    def restore(self, text: str) -> str:
        return self._places.sub(lambda m: m[0][1:], text)


def check_order(previous: str, role: str, template: Template) -> bool:
    """One step of the machine: may `role` follow `previous` (empty at the start)?"""
    return role in template.follows.get(previous, ())


_COLUMNS = {"conv_id": pa.int64(), "turn_no": pa.int64(), "part": pa.int32(), "text": pa.string(), "loss": pa.bool_(), "valid": pa.bool_()}
SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, valid boolean"


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1_024):
            yield from batch.slice(at, 1_024).to_pylist()


def _batched(rows: Iterator[tuple], columns: dict[str, pa.DataType]):
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 2_048:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), columns.values())], names=list(columns))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), columns.values())], names=list(columns))


def format_turns(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments (conv_id, turn_no, part, text, loss, valid) of every conversation in `turns` (conv_id, turn, role, text).

    In order of (turn_no, part) the segment texts make the training text: opening
    mark, escaped text, closing mark. `valid` tells whether the turn may stand
    where it does; in the last segment of a conversation also whether it may end there.
    Rows of a conversation are streamed in order of turn, then role, then text, so a
    long conversation is never held.

    Null texts and roles are empty; a null turn comes first; rows with a null
    conversation make one conversation; repeated rows are turns like others; other
    columns are not passed on; an empty table gives no rows. Conversations in wrong
    order are formatted, too, and marked.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(batches):
        escaper = Escaper(template.controls)
        conv, no, previous, waiting = object(), 0, "", None
        for row in _rows(batches):
            if row["conv_id"] != conv:
                if waiting:
                    yield (*waiting[:-1], waiting[-1] and previous in template.last)
                conv, no, previous, waiting = row["conv_id"], 0, "", None
            if waiting:
                yield waiting
            role, ok = row["role"], check_order(previous, row["role"], template)
            known = template.turns.get(role)
            if known:
                opening, closing, loss = known.opening, known.closing, known.loss
            else:
                opening, closing, loss = template.other[0] + escaper.escape(role) + template.other[1], template.other[2], False
            yield conv, no, 0, opening, False, ok
            yield conv, no, 1, escaper.escape(row["text"]), loss, ok
            waiting = (conv, no, 2, closing, False, ok)
            no, previous = no + 1, role
        if waiting:
            yield (*waiting[:-1], waiting[-1] and previous in template.last)

    return rows.mapInArrow(lambda b: _batched(segments(b), _COLUMNS), SEGMENTS)


class Reader:
    """Reads turns back from the running text of a conversation, piece by piece."""

    def __init__(self, template: Template):
        self.template, self.escaper = template, Escaper(template.controls)
        self.marked = sorted(((t.opening, role) for role, t in template.turns.items() if t.opening), key=lambda x: -len(x[0]))
        self.bare = next((role for role, t in template.turns.items() if not t.opening), None)
        self.held = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """Turns (role, text) that are complete now. A piece ends with a whole turn or inside a text, never inside a mark."""
        self.held += piece
        found = []
        while turn := self._next():
            found.append(turn)
        return found

    def _next(self) -> tuple[str, str] | None:
        if not self.held:
            return None
        start, name_end, end = self.template.other
        if self.held.startswith(start):
            cut = self.held.find(name_end, len(start))
            if cut < 0:
                return None
            role, at, closing = self.escaper.restore(self.held[len(start):cut]), cut + len(name_end), end
        else:
            opening, role = next(((o, r) for o, r in self.marked if self.held.startswith(o)), ("", self.bare))
            at, closing = len(opening), self.template.turns[role].closing
        stop = self.held.find(closing, at)
        if stop < 0:
            return None
        text, self.held = self.held[at:stop], self.held[stop + len(closing):]
        return role, self.escaper.restore(text)


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, from the segments' texts and loss flags alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.

    Roles and texts are parsed from the running text; loss figures come from the
    flagged segments. Digests are fed turn by turn, so nothing of a conversation piles up.
    """
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "part")
    columns = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
               "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "valid": pa.bool_()}

    def conversations(batches):
        state, conv = None, None
        for row in _rows(batches):
            if state is None or row["conv_id"] != conv:
                if state:
                    yield state.result(conv)
                state, conv = _Tally(template), row["conv_id"]
            state.add(row)
        if state:
            yield state.result(conv)

    return ordered.mapInArrow(lambda b: _batched(conversations(b), columns),
                              "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


class _Tally:
    def __init__(self, template: Template):
        self.reader = Reader(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid = True
        self.open: list[str] = []

    def add(self, row: dict) -> None:
        self.chars += len(row["text"])
        self.valid &= row["valid"]
        if row["loss"]:
            text = self.reader.escaper.restore(row["text"])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.open.append(row["text"])
        if row["part"] == 2:  # the end of a turn's segments: marks are whole up to here
            for role, text in self.reader.feed("".join(self.open)):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode())
            self.open = []

    def result(self, conv) -> tuple:
        if self.open or self.reader.held:
            raise ValueError(f"conversation {conv}: the text ends inside a turn")
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


_OK = "</s>[INST] ok [/INST]"


@query("op5_chat_format", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_OK}'), (-1, 1, 'assistant', '{_OK}'))),
e AS (SELECT *, length(regexp_replace(text, '(<(\\\\*)/?s>|\\[(\\\\*)/?(INST|ROLE)\\]|<(\\\\*)</?SYS>>)', '\\1.', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 15 WHEN 'system' THEN 15 ELSE 19 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY 1""")
def op5_chat_format(spark, folder):
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{_OK}'), (-1L, 1L, 'assistant', '{_OK}') AS t(conv_id, turn, role, text)")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(turns)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
