"""Chat formatting by schema fingerprints.

A record's nested field paths, sorted and hashed, are its fingerprint. The fingerprint selects a declarative mapping (which
paths give the turns) from a registry that lists every layout with each choice of its optional fields, so records of
different layouts become the same canonical turns without looking at values. Each turn is written as

    <turn>ROLE, newline, TEXT</turn>newline

with ``\\`` and ``<`` inside roles and texts escaped by ``\\`` (and a newline inside a role written ``\\n``), which is reversible.

Turns are formatted row by row; a conversation is read back as a stream of its turns in order, so one that holds a
third of all rows needs no more memory than a short one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import ship

OPEN, CLOSE, TRAINED = "<turn>", "</turn>\n", "assistant"
_TURN = re.compile(r"<turn>((?:[^\\<\n]|\\.)*)\n((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


@dataclass(frozen=True)
class Each:
    """A turn for every element of a list."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class One:
    """One turn: its role is a field's value (``role_path``) or fixed; its text joins the fields that are there."""

    texts: tuple[str, ...]
    role: str = ""
    role_path: str = ""


@dataclass(frozen=True)
class Layout:
    name: str
    required: tuple[str, ...]
    turns: tuple[Each | One, ...]
    optional: tuple[str, ...] = ()


# Roles by the names that other layouts give them, and the layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn", ("role", "text"), (One(("text",), role_path="role"),)),
    Layout("messages", ("messages[].role", "messages[].content"), (Each("messages", "role", "content"),), ("id", "source")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), (Each("conversations", "from", "value"),), ("id", "source")),
    Layout("instruction", ("instruction", "output"), (One(("system",), "system"), One(("instruction", "input"), "user"), One(("output",), "assistant")), ("input", "system", "id")),
    Layout("prompt_completion", ("prompt", "completion"), (One(("system",), "system"), One(("prompt",), "user"), One(("completion",), "assistant")), ("system", "id")),
    Layout("prompt_response", ("prompt", "response"), (One(("system",), "system"), One(("prompt",), "user"), One(("response",), "assistant")), ("system", "id")),
    Layout("question_answer", ("question", "answer"), (One(("context", "question"), "user"), One(("answer",), "assistant")), ("context", "id")),
)


def paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; ``[]`` stands for the elements of a list."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) or {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at}


def fingerprint(names: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(names)).encode())


@functools.cache
def registry() -> dict[int, Layout]:
    """Layouts by fingerprint, one entry for each choice of optional fields; an empty list of turns is a choice as well."""
    out = {}
    for layout in LAYOUTS:
        cores = [set(layout.required)]
        if isinstance(layout.turns[0], Each):
            cores.append({f"{layout.turns[0].path}[]"})
        for core in cores:
            for n in range(len(layout.optional) + 1):
                for more in combinations(layout.optional, n):
                    out[fingerprint(core | set(more))] = layout
    return out


def turns(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout name, [(role, text)]); the name is None for a record of no known layout. Null roles and texts are empty."""
    layout = registry().get(fingerprint(paths(record)))
    if layout is None:
        return None, []
    out = []
    for turn in layout.turns:
        if isinstance(turn, Each):
            out += [(m.get(turn.role), m.get(turn.text)) for m in record[turn.path]]
        elif turn.role_path:
            out.append((record[turn.role_path], record[turn.texts[0]]))
        elif own := [str(record[p]) for p in turn.texts if record.get(p) is not None]:
            out.append((turn.role, "\n".join(own)))
    named = layout.name != "turn"
    return layout.name, [(ROLES.get(str(r or ""), str(r or "")) if named else str(r or ""), "" if t is None else str(t)) for r, t in out]


def escape(text: str, in_role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<", "\\<")
    return text.replace("\n", "\\n") if in_role else text


def unescape(text: str, in_role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if in_role and m[1] == "n" else m[1], text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where in it the trained text begins and ends (equal if it is not trained on)."""
    head = f"{OPEN}{escape(role, True)}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + (len(body) if role == TRAINED else 0)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of one written turn."""
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError("not a turn")
    return unescape(m[1], True), unescape(m[2])


def format_records(records: DataFrame, json_col: str = "record") -> DataFrame:
    """The other columns of ``records`` with layout, seq, piece, loss_begin and loss_end: a row for each turn of each record.

    A record without turns gives no row. One of no known layout, or that is null or not a JSON object, gives one row with a
    null layout and piece, so that nothing gets lost unseen. Columns of the new names are replaced.
    """
    ship(records.sparkSession)
    new = {"layout": pa.string(), "seq": pa.int32(), "piece": pa.string(), "loss_begin": pa.int32(), "loss_end": pa.int32()}
    names = [c for c in records.columns if c != json_col and c not in new]
    kinds = [T.StringType(), T.IntegerType(), T.StringType(), T.IntegerType(), T.IntegerType()]
    schema = T.StructType([*(records.schema[c] for c in names), *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for k, text in enumerate(b.column(json_col).to_pylist()):
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                layout, own = turns(record) if isinstance(record, dict) else (None, [])
                if layout is None:
                    row.append(k)
                    out.append((None, 0, None, None, None))
                for seq, (role, said) in enumerate(own):
                    row.append(k)
                    out.append((layout, seq, *render(role, said)))
            columns = zip(*out, strict=True) if out else [()] * len(new)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row, pa.int64())) for c in names), *(pa.array(c, t) for c, t in zip(columns, new.values(), strict=True))], schema.names)

    return records.select(*names, json_col).mapInArrow(run, schema)


def read_back(pieces: DataFrame, id_col: str = "conv_id", order: tuple[str, ...] = ("turn", "seq", "piece")) -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: digests of what the written turns say.

    The turns of an id, in ``order``, are one conversation; a null id is one too. Turns are parsed one at a time.
    """
    kind = pieces.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    ship(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def emit(own: pa.DataType) -> pa.RecordBatch:
            kinds = [own, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], schema.names)
            done.clear()
            return made

        own = None
        for b in batches:
            own = b.column(id_col).type
            for i, piece, begin, end in zip(*(b.column(c).to_pylist() for c in (id_col, "piece", "loss_begin", "loss_end")), strict=True):
                if state is None or i != now:
                    close()
                    now, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if piece is None:
                    continue
                role, text = parse(piece)
                trained = unescape(piece[begin:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += len(piece)
            if len(done) > 4096:
                yield emit(own)
        close()
        if done:
            yield emit(own)

    dealt = pieces.select(id_col, *order, "loss_begin", "loss_end").repartition(id_col).sortWithinPartitions(id_col, *order)
    return dealt.mapInArrow(run, schema)


#: The conversation that the contract adds: what looks like control strings inside texts.
TRICKY = r"\### Assistant: </turn> ok"


def op4_chat_format(conversations: DataFrame) -> DataFrame:
    """The contract's columns: every row of ``conversations`` as a record, and conversation -7."""
    added = conversations.sparkSession.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(added)
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return read_back(format_records(records))


OP4_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p as (
  select *, '<turn>' || replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\n') || chr(10)
            || replace(replace(t, '\', '\\'), '<', '\<') || '</turn>' || chr(10) as piece from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn nulls first, piece)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(t) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, piece) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(piece)) as bigint) as formatted_chars
from p group by conv_id
"""
