"""Chat formatting: schema fingerprints choose the mapping that turns any layout of conversations into canonical turns.

**Layouts.** A layout is declared, not coded: the nested field paths it needs (``messages[].role``), those it may have, and
where turns, roles and texts come from. A schema's fingerprint is the SHA-256 of its sorted paths, as far as any layout
knows them; a registry leads from fingerprints to layouts. If a table's schema is in no registry (tables of several layouts
stacked by name), each row is looked up by the fingerprint of its paths that are not NULL. Columns no layout knows do not
count. Where known but foreign paths stand beside a layout, the layout with the most needed paths that are all there wins.
Rows that fit none have no turns; ``unmapped`` returns them.

**Template.** Each turn is ``<|im_start|>role LF text <|im_end|> LF``. Every mark begins with ``<|``. Inside texts and roles
the bar behind ``<`` gets one more backslash than it had (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), so they never
hold a mark and one backslash less gives them back; a line break in a role becomes ``<\\n``.

**Rows.** Turns are range partitioned by conversation, turn, role and a hash of the text, so that a conversation with a third
of all rows covers many tasks, and sorted; equal turns of a conversation come in the order of role and that hash. Each task
joins its turns to pieces of about ``PIECE`` characters: one for a conversation, more where it is longer or crosses the edge
of a task. A piece has its text and the spans of its assistant texts, which are the loss mask.

NULL texts and roles count as empty, a NULL turn comes first, the rows of a NULL conversation are one conversation, repeated
rows are repeated turns, an empty table has no pieces. Extra columns are not carried: their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField,
                               StructType)

from tablewright.session import settle, ship_package

PIECE = 1 << 22        # characters in a piece, about: whole turns, the last may be longer
BATCH = 1 << 24        # characters handed on at once

@dataclass(frozen=True)
class Layout:
    """Where canonical turns come from.

    ``turns`` are (role, paths) pairs for columns that hold one turn each: the texts of the paths that are not empty are joined
    by an empty line, a turn without any is left out unless its first path is needed. ``items`` is an array of structs with
    ``role`` and ``text`` paths inside; without ``items`` each row is one turn, at its ``turn``. ``names`` are (given, canonical)
    names of roles; others stay as they are.
    """

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "text"
    turn: str = "turn"
    names: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> Iterator[str]:
        for size in range(len(self.optional) + 1):
            for extra in combinations(self.optional, size):
                yield fingerprint((*self.needed, *extra))


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn")),
    Layout("content rows", ("content", "role", "turn"), text="content"),
    Layout("messages", ("messages[].content", "messages[].role"), items="messages", text="content"),
    Layout("message parts", ("messages[].content[].text", "messages[].role"), ("messages[].content[].type",), items="messages",
           text="content[].text"),
    Layout("from and value", ("conversations[].from", "conversations[].value"), ("system",), items="conversations",
           role="from", text="value", turns=(("system", ("system",)),), names=(("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt and completion", ("completion", "prompt"), ("system",),
           turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), ("system",),
           turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", ("answer", "question"), ("context",),
           turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def paths_of(kind: DataType, at: str = "") -> Iterator[str]:
    """The nested field paths of a type; array elements are ``[]``."""
    if isinstance(kind, StructType):
        for part in kind.fields:
            yield from paths_of(part.dataType, f"{at}.{part.name}" if at else part.name)
    elif isinstance(kind, ArrayType):
        yield from paths_of(kind.elementType, f"{at}[]")
    else:
        yield at


def column_of(path: str) -> str:
    return re.split(r"[.\[]", path)[0]


def registry(layouts: Iterable[Layout]) -> dict[str, Layout]:
    return {mark: layout for layout in reversed(tuple(layouts)) for mark in layout.fingerprints()}


def known_paths(df: DataFrame, layouts: Iterable[Layout]) -> list[str]:
    known = {p for layout in layouts for p in (*layout.needed, *layout.optional)}
    return sorted(known & set(paths_of(df.schema)))


def specific(layouts: Iterable[Layout], paths: Iterable[str]) -> list[Layout]:
    """The layouts whose needed paths are all among ``paths``, those that need most first."""
    paths = set(paths)
    return sorted((layout for layout in layouts if paths.issuperset(layout.needed)), key=lambda layout: -len(layout.needed))


def inner(value: Column, path: str) -> Column:
    """The text at a path below ``value``; the parts of an array are joined."""
    head, mark, rest = path.partition("[].")
    for name in head.split("."):
        value = value.getField(name)
    if mark:
        return F.array_join(F.transform(value, lambda part: F.coalesce(inner(part, rest), F.lit(""))), "")
    return value.cast("string")


def canonical_role(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    for given, name in names:
        role = F.when(role == given, name).otherwise(role)
    return F.coalesce(role, F.lit(""))


def turns_of(layout: Layout, columns: Iterable[str], keep_turn: bool) -> Column:
    """A row's turns as an array of (turn, role, text)."""
    columns = set(columns)

    def made(turn: Column, role: Column, text: Column) -> Column:
        return F.struct(turn.cast("bigint").alias("turn"), canonical_role(role, layout.names).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if not layout.items and not layout.turns:
        return F.array(made(F.col(layout.turn) if keep_turn else F.lit(0), F.col(layout.role).cast("string"),
                            F.col(layout.text).cast("string")))
    first = []
    for role, paths in layout.turns:
        paths = [p for p in paths if column_of(p) in columns]
        if paths:
            text = F.concat_ws("\n\n", *[F.nullif(F.col(p).cast("string"), F.lit("")) for p in paths])
            turn = made(F.lit(0), F.lit(role), text)
            first.append(F.array(turn) if paths[0] in layout.needed
                         else F.when(text == "", F.filter(F.array(turn), lambda _: F.lit(False))).otherwise(F.array(turn)))
    parts = list(first)
    if layout.items:
        parts.append(F.transform(F.filter(F.col(layout.items), lambda item: item.isNotNull()), lambda item: made(
            F.lit(0), inner(item, layout.role), inner(item, layout.text))))
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.transform(every, lambda item, place: made(place, item["role"], item["text"]))


def chosen(df: DataFrame, layouts: tuple[Layout, ...]) -> tuple[list[Layout], Column | None]:
    """The layouts a table may hold, and the column that says which (its number) a row has; None: the first, for all rows."""
    paths, marks = known_paths(df, layouts), registry(layouts)
    if layout := marks.get(fingerprint(paths)):
        return [layout], None
    fitting = specific(layouts, paths)
    if not fitting:
        raise ValueError(f"no layout for a table with the columns {', '.join(df.columns)}")
    if len(fitting) == 1:
        return fitting, None
    there = {p: F.col(column_of(p)).isNotNull() for p in paths}
    row = F.sha2(F.concat_ws("\n", *[F.when(there[p], F.lit(p)) for p in paths]).cast("binary"), 256)
    number = F.lit(None).cast("int")
    for place, layout in reversed(list(enumerate(fitting))):
        number = F.when(reduce(Column.__and__, [there[p] for p in layout.needed]), F.lit(place)).otherwise(number)
    for mark, layout in marks.items():
        if layout in fitting:
            number = F.when(row == mark, F.lit(fitting.index(layout))).otherwise(number)
    return fitting, number


def canonical(df: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The canonical turns (key, turn, role, text) of a table in any layout, or in several."""
    fitting, number = chosen(df, layouts)
    turns = [turns_of(layout, df.columns, layout.turn in df.columns) for layout in fitting]
    if number is None:
        every = turns[0]
    else:
        every = reduce(lambda rest, place: F.when(number == place, turns[place]).otherwise(rest), range(len(turns)), F.lit(None))
    rows = df.select(F.col(key), F.explode(every).alias("_turn"))
    return rows.select(key, "_turn.turn", "_turn.role", "_turn.text")


def unmapped(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The rows that no layout fits."""
    _, number = chosen(df, layouts)
    return df.filter(F.lit(False) if number is None else number.isNull())


@dataclass(frozen=True)
class Template:
    """The marks of a turn; each begins with ``<|``."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    learnt: tuple[str, ...] = ("assistant",)
    pattern: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        if not (self.start.startswith("<|") and self.end.startswith("<|")) or self.start == self.end:
            raise ValueError("marks are different and begin with <|")
        object.__setattr__(self, "pattern", re.compile(
            rf"{re.escape(self.start)}([^\n]*)\n(.*?){re.escape(self.end)}\n", re.DOTALL))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*+)\|"), F.lit(r"<\\$1|"))


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escaped_role(role: Column) -> Column:
    """A role without line breaks: ``<`` and backslashes and ``n`` get a backslash more, a line break is ``<\\n``."""
    return F.regexp_replace(F.regexp_replace(escaped(role), F.lit(r"<(\\++)n"), F.lit(r"<\\$1n")), F.lit("\n"), F.lit(r"<\\n"))


def unescaped_role(role: str) -> str:
    return unescaped(re.sub(r"<(\\+)n", lambda m: "\n" if len(m[1]) == 1 else f"<{m[1][1:]}n", role))


def formatted(turns: DataFrame, key: str = "conv_id", template: Template = Template(), piece: int = PIECE) -> DataFrame:
    """Pieces of formatted conversations: key, part, piece, whole, n_turns, formatted, loss_starts, loss_ends.

    A conversation's text is that of its pieces by part and piece; ``whole`` ones are alone. Spans count code points from the
    piece's begin and hold the texts of the ``learnt`` roles.
    """
    ship_package(turns.sparkSession)
    learnt = F.coalesce(F.col("role"), F.lit("")).isin(*template.learnt)
    rows = turns.select(
        F.col(key), "turn", F.col("role").alias("_role"), F.xxhash64("text").alias("_hash"), learnt.alias("_learnt"),
        escaped_role(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    order = [key, "turn", "_role", "_hash"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())     # equal rows may go to different tasks
    rows = rows.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").select(key, "role", "text", "_learnt")
    schema = StructType([
        turns.schema[key], StructField("part", IntegerType()), StructField("piece", LongType()), StructField("whole", BooleanType()),
        StructField("n_turns", LongType()), StructField("formatted", StringType()), StructField("loss_starts", ArrayType(LongType())),
        StructField("loss_ends", ArrayType(LongType()))])
    kind = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held = TaskContext.get().partitionId(), [], 0
        now, first, number = None, True, 0         # the conversation, whether it is the task's first, its pieces so far
        texts, starts, ends, size, open_ = [], [], [], 0, False

        def close(whole: bool) -> None:
            nonlocal texts, starts, ends, size, number, held
            done.append((now, part, number, whole, len(texts) // 5, "".join(texts), starts, ends))
            held += size
            texts, starts, ends, size, number = [], [], [], 0, number + 1

        def handed() -> pa.RecordBatch:
            nonlocal done, held
            columns = list(zip(*done))
            done, held = [], 0
            types = [kind["key"], pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            kind["key"] = batch.column(0).type
            for at, role, text, learn in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and at != now:
                    close(not first and number == 0)
                    first, number = False, 0
                elif size >= piece:
                    close(False)
                now, open_ = at, True
                begin = size + len(template.start) + len(role) + 1
                if learn:
                    starts.append(begin)
                    ends.append(begin + len(text))
                texts += (template.start, role, "\n", text, template.end + "\n")
                size = begin + len(text) + len(template.end) + 1
                if held >= BATCH:
                    yield handed()
        if open_:
            close(False)
        if done:
            yield handed()

    return rows.mapInArrow(run, schema)


class Reader:
    """A conversation read back from its pieces: its turns' digest and that of all text under the loss mask."""

    def __init__(self, template: Template):
        self.template = template
        self.turns, self.learnt = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.chars = self.size = 0

    def read(self, text: str, starts: list[int], ends: list[int]) -> None:
        at = 0
        for found in self.template.pattern.finditer(text):
            if found.start() != at:
                raise ValueError("text between turns")
            at = found.end()
            self.turns.update(f"{unescaped_role(found[1])}\n{unescaped(found[2])}\n".encode())
            self.n_turns += 1
        if at != len(text):
            raise ValueError("text behind the last turn")
        for start, end in zip(starts, ends):
            part = unescaped(text[start:end])
            self.learnt.update(part.encode())
            self.chars += len(part)
        self.size += len(text)

    def row(self, key) -> tuple:
        return key, self.n_turns, self.turns.hexdigest(), self.chars, self.learnt.hexdigest(), self.size


def digests(pieces: DataFrame, key: str = "conv_id", template: Template = Template()) -> DataFrame:
    """What reading the pieces gives back: one row for each conversation.

    Whole ones are read where they are made. The others (two for each task, and long ones) are dealt by conversation, sorted
    and streamed, piece after piece; a digest is sequential, but holds one piece at a time.
    """
    ship_package(pieces.sparkSession)
    own = pieces.schema[key]
    result = StructType([
        own, StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
        StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])
    rest = StructType([*result.fields, *(StructField(f"_{f.name}", f.dataType) for f in pieces.schema.fields if f.name != key)])
    carried = [f.name for f in pieces.schema.fields if f.name != key]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, whole, texts, starts, ends = (batch.column(c).to_pylist() for c in (key, "whole", "formatted", "loss_starts", "loss_ends"))
            rows = []
            for at, alone, *text in zip(keys, whole, texts, starts, ends):
                reader = Reader(template)
                if alone:
                    reader.read(*text)
                rows.append(reader.row(at) if alone else (at, *[None] * 5))
            digest = [pa.array(c, t) for c, t in zip(zip(*rows), (
                batch.column(key).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            keep = pa.array([None if w else n for n, w in enumerate(whole)], pa.int64())     # taking at NULL gives NULL
            yield pa.RecordBatch.from_arrays([*digest, *(batch.column(c).take(keep) for c in carried)], names=rest.names)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, kind = None, None, None
        for batch in batches:
            kind, rows = batch.column(0).type, []
            for at, *text in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or at != now:
                    if reader is not None:
                        rows.append(reader.row(now))
                    now, reader = at, Reader(template)
                reader.read(*text)
            yield batch_of(rows, kind)
        if reader is not None:
            yield batch_of([reader.row(now)], kind)

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names=result.names)

    read = settle(pieces.mapInArrow(near, rest))
    order = [key, "_part", "_piece"]
    parts = read.filter(F.col("_formatted").isNotNull()).repartition(key).sortWithinPartitions(*order)
    parts = parts.select(key, "_formatted", "_loss_starts", "_loss_ends")
    return read.filter(F.col("_formatted").isNull()).select(*result.names).union(parts.mapInArrow(far, result))
