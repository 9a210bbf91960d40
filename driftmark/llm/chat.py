"""Chat layouts: schema fingerprints choose mappings to canonical turns.

The fingerprint of a layout is a hash of those of its nested field paths that any
mapping reads, so fields that none knows do no harm. A table holds each mapping
under the fingerprint of its own paths; a layout is looked up in it by its
fingerprint. A layout that holds the paths of several mappings, whose fingerprint
is nobody's, takes the one with the most paths, and is filed in the table with
that answer. Canonical turns are rows of conversation,
turn, role and text. The template wraps each turn in control strings; those that
occur inside a role or a text are broken up by an escape that reading takes out
again. Assistant texts lie under the loss mask.

Rows are dealt by conversation and sorted within their partition, and both
formatting and reading back stream over them a turn at a time, so a
conversation of any length needs the memory of one batch. Offsets and hashes run
through a whole conversation, so one conversation is one task's work.

Edge cases: null roles and texts count as empty; turns are ordered by number
(nulls first), then role, then text, so ties and repeated rows have one order;
a null conversation id is a conversation of its own. A JSON record is unmatched,
gives one row with a null role and its raw text, and is counted by ``unmatched``,
if it is no JSON object (nested beyond the parser's depth included), has an
unknown layout, or its id or turn is neither null nor a whole number of 64 bits
(numbers in strings count, 1.5 and booleans don't). In tables such ids and turns
become null. Half surrogates in JSON texts become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.llm.common import column as column_of

TURNS = "conv_id long, turn long, role string, text string"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """Either one row a turn (``order``), a list of messages (``messages``), or fixed ``turns`` of (role, paths)."""

    name: str
    conv_id: str
    order: str | None = None
    messages: str | None = None
    role: str | None = None
    text: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        inner = f"{self.messages}[]." if self.messages else ""
        named = [self.conv_id, self.order, *(inner + x for x in (self.role, self.text) if x), *(p for _, ps in self.turns for p in ps)]
        return tuple(sorted({x for x in named if x}))


MAPPINGS = (
    Mapping("rows", "conv_id", order="turn", role="role", text="text"),
    Mapping("messages", "conv_id", messages="messages", role="role", text="content"),
    Mapping("from_value", "conv_id", messages="conversations", role="from", text="value"),
    Mapping("prompt_response", "conv_id", turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", "conv_id", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction_input", "conv_id", turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", "conv_id", turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system_prompt", "conv_id", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def schema_paths(schema: T.DataType, head: str = "") -> set[str]:
    """Nested field paths; ``[]`` stands for the elements of a list."""
    if isinstance(schema, T.StructType):
        return set().union(*[schema_paths(f.dataType, f"{head}.{f.name}" if head else f.name) for f in schema.fields]) if schema.fields else set()
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, head + "[]")
    return {head}


def record_paths(value, head: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*[record_paths(v, f"{head}.{k}" if head else k) for k, v in value.items()]) if value else set()
    if isinstance(value, list):
        return set().union(*[record_paths(v, head + "[]") for v in value]) if value else {head + "[]"}
    return {head}


class Registry:
    """Mappings under the fingerprints of the layouts they fit."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.known = frozenset(p for m in mappings for p in m.paths)
        self.table: dict[str, Mapping | None] = {}
        for m in mappings:
            self.table.setdefault(fingerprint(m.paths), m)

    def choose(self, paths: set[str]) -> Mapping | None:
        read = paths & self.known
        key = fingerprint(read)
        if key not in self.table:
            self.table[key] = max((m for m in self.mappings if read.issuperset(m.paths)), key=lambda m: len(m.paths), default=None)
        return self.table[key]


def _role(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.coalesce(known[c], c)


def canonical(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The turns of a table of any known layout."""
    m = Registry(mappings).choose(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping for fields {sorted(schema_paths(df.schema))}")
    number = lambda name: F.when(F.col(name).cast("double") == F.floor(F.col(name).cast("double")), F.col(name).cast("long")) if isinstance(df.schema[name].dataType, T.FractionalType) else F.col(name).try_cast("long")
    conv, text = number(m.conv_id).alias("conv_id"), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.order:
        return df.select(conv, number(m.order).alias("turn"), _role(F.col(m.role)).alias("role"), text(F.col(m.text)).alias("text"))
    if m.messages:
        rows = df.select(conv, F.posexplode(m.messages).alias("turn", "m"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("m")[m.role]).alias("role"), text(F.col("m")[m.text]).alias("text"))
    parts = [F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.concat_ws("\n", *[F.when(F.col(p) != "", F.col(p).cast("string")) for p in ps]).alias("text")) for i, (role, ps) in enumerate(m.turns)]
    return df.select(conv, F.explode(F.array(*parts)).alias("t")).select("conv_id", "t.*")


def whole(x) -> int | None:
    """A whole number of 64 bits, or null; anything else is an error."""
    if x is None:
        return None
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        raise ValueError(x)
    n = int(x)  # of a string too; a long one is an error
    if isinstance(x, float) and n != x or not -(2**63) <= n < 2**63:
        raise ValueError(x)
    return n


def _said(x) -> str:
    x = "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    try:
        x.encode()
    except UnicodeEncodeError:
        x = x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return x


def record_turns(record: dict, mapping: Mapping) -> list[tuple]:
    conv = whole(record.get(mapping.conv_id))
    role = lambda x: ROLES.get(_said(x), _said(x))
    if mapping.order:
        return [(conv, whole(record[mapping.order]), role(record[mapping.role]), _said(record[mapping.text]))]
    if mapping.messages:
        return [(conv, i, role(x.get(mapping.role)), _said(x.get(mapping.text))) for i, x in enumerate(record[mapping.messages]) if isinstance(x, dict)]
    return [(conv, i, r, "\n".join(_said(record[p]) for p in ps if _said(record[p]))) for i, (r, ps) in enumerate(mapping.turns)]


def turns_of(raw: str | None, registry: Registry) -> list[tuple]:
    """The turns of a JSON record, or one row with a null role."""
    try:
        record = json.loads(raw or "null")
        mapping = registry.choose(record_paths(record)) if isinstance(record, dict) else None
        return record_turns(record, mapping) if mapping else [(None, None, None, raw)]
    except (ValueError, OverflowError, RecursionError):
        return [(None, None, None, raw)]


def canonical_json(df: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The turns of JSON records that may each have another layout; unmatched ones give one row with a null role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(mappings)
        for batch in batches:
            rows = [t for raw in batch.column(0).to_pylist() for t in turns_of(raw, registry)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "role", "text"])

    return df.select(column_of(df, column).cast("string").alias("record")).mapInArrow(run, TURNS)


# --- the template -----------------------------------------------------------

ESCAPE = "␛"
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BREAK = re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_MEND = re.compile(f"{ESCAPE}(.)", re.S)
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.S)


def escape(text: str) -> str:
    """No control string is left; ``unescape`` gives the text back."""
    return _BREAK.sub(lambda m: ESCAPE + ESCAPE if m[0] == ESCAPE else f"{m[0]}{ESCAPE}.", text)


def unescape(text: str) -> str:
    return _MEND.sub(lambda m: "" if m[1] == "." else m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text lies."""
    head = f"<|{escape(role)}|>\n"
    body = escape(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


FORMATTED = "conv_id long, place long, formatted string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "place", "formatted", "loss_start", "loss_end"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now, place, at = object(), 0, 0
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if conv != now:
                now, place, at = conv, 0, 0
            said, start, end = format_turn(role or "", text or "")
            loss = (at + start, at + end) if role == "assistant" else (None, None)
            rows.append((conv, place, said, *loss))
            place, at = place + 1, at + len(said)
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    none = object()
    now, rows = none, []
    n = chars = at = 0
    turns = loss = None
    for batch in batches:
        for conv, said, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            if conv != now:
                if now is not none:
                    rows.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), at))
                now, n, chars, at, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for m in _TURN.finditer(said):
                n += 1
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            if start is not None:
                masked = unescape(said[start - at : end - at])
                chars += len(masked)
                loss.update(masked.encode("utf-8", "surrogatepass"))
            at += len(said)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows = []
    if now is not none:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((now, n, turns.hexdigest(), chars, loss.hexdigest(), at), types, strict=True)], names=names)


def format_chat(turns: DataFrame) -> DataFrame:
    """One row for each turn, in the order of its conversation: its part of the
    formatted text, and the loss span as offsets into the whole conversation."""
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format, FORMATTED)


def read_chat(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from rows as ``format_chat`` leaves them."""
    return formatted.mapInArrow(_read_back, DIGESTS)


def unmatched(turns: DataFrame) -> int:
    return turns.where("role is null").count()
