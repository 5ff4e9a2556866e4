"""Chat layouts to canonical turns by schema fingerprint, and a reversible chat template.

A layout is declared once: the nested field paths it needs and how they become turns.  Its
fingerprint is the hash of those paths.  An input is matched by hashing the paths it has
among a layout's paths, so further columns do not matter; of several matching layouts the
one with the most paths is taken.  The same registry serves tables (by their schema) and
JSON records of mixed layout (by each record's own paths).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listforge.llm.common import batches
from listforge.session import ship_package


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """``turns``: path of an array of turns, or "" for one turn a row, or None for fixed fields.

    ``role``, ``text`` and ``order`` are fields of a turn; ``fields`` are (role, path) pairs
    of a fixed layout, empty or missing ones giving no turn; ``joined`` are paths whose
    non-empty values form the text of the first user turn, a line break between them.
    """
    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    order: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    joined: tuple[str, ...] = ()
    aliases: dict = field(default_factory=dict, hash=False)

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


_SPEAKERS = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("turn_rows", ("turn", "role", "text"), turns="", text="text", order="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), turns="messages"),
    Layout("speakers", ("conversations[].from", "conversations[].value"), turns="conversations",
           role="from", text="value", aliases=_SPEAKERS),
    Layout("instruction", ("instruction", "input", "output"), joined=("instruction", "input"),
           fields=(("assistant", "output"),)),
    Layout("instruction_only", ("instruction", "output"), joined=("instruction",), fields=(("assistant", "output"),)),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("system", "prompt", "response"),
           fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_messages", ("prompt[].role", "prompt[].content", "completion[].role", "completion[].content"),
           turns="prompt+completion"),
)


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths: a struct field adds .name, an array []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    return [prefix]


def value_paths(value, prefix: str = "") -> set[str]:
    """The same for a parsed JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, prefix + "[]")}
    return {prefix} if prefix else set()


def select_layout(paths, layouts=LAYOUTS) -> Layout | None:
    have = set(paths)
    fits = [m for m in layouts if fingerprint(have & set(m.paths)) == m.fingerprint]
    return max(fits, key=lambda m: len(m.paths), default=None)


def _turns(df: DataFrame, m: Layout, conv) -> DataFrame:
    def role_of(col):
        role = F.coalesce(col.cast("string"), F.lit(""))
        return F.coalesce(F.create_map(*[F.lit(x) for kv in m.aliases.items() for x in kv])[role], role) if m.aliases else role

    def text_of(col):
        return F.coalesce(col.cast("string"), F.lit(""))

    if m.turns == "":
        return df.select(conv.alias("conv_id"), F.col(m.order).cast("long").alias("turn"),
                         role_of(F.col(m.role)).alias("role"), text_of(F.col(m.text)).alias("text"))
    if m.turns is not None:
        empty = F.expr("cast(array() as array<struct<role: string, text: string>>)")
        lists = [F.coalesce(F.transform(path, lambda t: F.struct(
            t[m.role].cast("string").alias("role"), t[m.text].cast("string").alias("text"))), empty)
            for path in m.turns.split("+")]
        turns = F.concat(*lists)
    else:
        said = [(role, F.col(path).cast("string")) for role, path in m.fields]
        if m.joined:
            parts = [F.when(F.length(c) > 0, c) for c in (F.col(p).cast("string") for p in m.joined)]
            said.insert(0, ("user", F.concat_ws("\n", *parts)))
        turns = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in said]),
                         lambda t: F.length(t["text"]) > 0)
    one = df.select(conv.alias("conv_id"), F.posexplode(turns).alias("turn", "t"))
    return one.select("conv_id", F.col("turn").cast("long"), role_of(F.col("t.role")).alias("role"),
                      text_of(F.col("t.text")).alias("text"))


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of a table of any registered layout.

    Null texts and roles are empty; a null or empty list of turns gives no turn.  A table
    that fits no layout is refused with its fingerprint.
    """
    paths = schema_paths(df.schema)
    m = select_layout(paths, layouts)
    if m is None:
        raise ValueError(f"no layout for fingerprint {fingerprint(paths)}: {sorted(paths)}")
    return _turns(df, m, F.col(id_col).cast("long"))


def canonical_turns_of_json(df: DataFrame, json_col: str, id_col: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """The same for JSON records, each of its own layout.  Layouts of one turn a row don't apply.

    A record that is null, not an object or of no registered layout gives one turn with
    role ``unknown`` and the record as its text, so nothing is lost.
    """
    ship_package(df.sparkSession)
    known = [m for m in layouts if m.turns != ""]

    def name_layout(records: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in records:
            names = []
            for r in part:
                try:
                    m = select_layout(value_paths(json.loads(r)), known) if r is not None else None
                except ValueError:
                    m = None
                names.append(m.name if m else "")
            yield pd.Series(names)

    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(json_col).cast("string").alias("_json"))
    rows = rows.withColumn("_layout", F.pandas_udf(name_layout, "string")("_json"))
    out = rows.where("_layout = ''").select(F.col("_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                                            F.lit("unknown").alias("role"), F.coalesce("_json", F.lit("")).alias("text"))
    for m in known:
        own = rows.where(F.col("_layout") == m.name).withColumn("_v", F.from_json("_json", _record_schema(m)))
        out = out.unionByName(_turns(own.select("_id", "_v.*"), m, F.col("_id")))
    return out


def _record_schema(m: Layout) -> T.StructType:
    top: dict = {}
    for p in m.paths:
        name, _, inner = p.partition("[].")
        top.setdefault(name, []).extend([inner] if inner else [])
    return T.StructType([T.StructField(n, T.ArrayType(T.StructType([T.StructField(i, T.StringType()) for i in inner]))
                                       if inner else T.StringType()) for n, inner in top.items()])


# ---- template: <turn role> LF text LF </turn> LF, control strings of a text behind a backslash

_OPENING = re.compile(r"<turn ((?:\\.|[^\\>])*)>\n", re.S)
_CLOSING = "\n</turn>\n"  # a text never holds it: its own "</turn" follows a backslash
_UNESCAPE = re.compile(r"\\(.)", re.S)


def _escaped(col, role: bool = False):
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for control in ("<turn", "</turn"):
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return F.replace(out, F.lit(">"), F.lit("\\>")) if role else out


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; anything that is not a turn is refused."""
    at = 0
    while at < len(formatted):
        m = _OPENING.match(formatted, at)
        end = formatted.find(_CLOSING, m.end()) if m else -1
        if end < 0:
            raise ValueError(f"not a turn at {at}")
        yield unescaped(m[1]), unescaped(formatted[m.end():end])
        at = end + len(_CLOSING)


def formatted_turns(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """turns with ``formatted`` and the loss mask as ``loss_start``, ``loss_length`` (code points).

    A conversation is its turns' ``formatted`` in order; a turn is a row of its own, so a
    conversation of any length needs no row that holds all of it.  The mask covers exactly
    the text of turns by ``learn_role``.
    """
    opening = F.concat(F.lit("<turn "), _escaped(F.col("role"), role=True), F.lit(">\n"))
    body = _escaped(F.col("text"))
    learn = F.col("role") == learn_role
    return turns.withColumn("formatted", F.concat(opening, body, F.lit("\n</turn>\n"))).withColumn(
        "loss_start", F.when(learn, F.length(opening))).withColumn("loss_length", F.when(learn, F.length(body)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from ``formatted`` and its mask alone: turns, digests and sizes.

    Turns follow ``turn``, then role and text (null first); each row is a turn, repeated
    ones too; rows without a conv_id form one conversation.  A conversation is read as a
    stream: its digests are sequential, its rows never held together.
    """
    ship_package(formatted.sparkSession)

    def read(parts):
        make = batches({"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(),
                        "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()})
        now, state = None, None

        def row():
            n, turns, chars, loss, size = state
            return now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in parts:
            out = []
            for conv, text, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now is not None:
                        out.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    masked = unescaped(text[start:start + length])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            yield make(out)
        if now is not None:
            yield make([row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
