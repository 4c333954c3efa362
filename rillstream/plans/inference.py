"""Schema inference over an ordered stream of JSON rows, in parallel.

What a field is inferred to be hangs on the order its values come in, so partial results cannot be types. They are
functions: for each state a field may be in before a run of rows, the state after it. Such functions compose, and each
task works out those of its own rows in one pass. A field whose values contradict each other freezes; nothing below it
counts from there on, so a pass is repeated for the levels below fields that froze while they had children.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstream.functions.classify import token_of
from rillstream.operators.ranks import chunks

#: What the type on the left becomes when a value of the type above comes (fixed values: they are the semantics of
#: inference). A dash is a contradiction: the field becomes JSON and is frozen.
LATTICE = """
from       BYTES  TIMESTAMP DATE   DATETIME BIGNUMERIC NUMERIC    BOOLEAN    STRING FLOAT      INTEGER    JSON RECORD
BYTES      BYTES  -         -      -        -          -          -          STRING -          -          -    RECORD
TIMESTAMP  -      TIMESTAMP STRING STRING   -          -          -          STRING -          -          -    RECORD
DATE       -      STRING    DATE   STRING   -          -          -          STRING -          -          -    RECORD
DATETIME   -      STRING    STRING DATETIME -          -          -          STRING -          -          -    RECORD
BIGNUMERIC -      -         -      -        BIGNUMERIC -          BIGNUMERIC JSON   BIGNUMERIC BIGNUMERIC -    RECORD
BOOLEAN    -      -         -      -        JSON       -          BOOLEAN    JSON   JSON       JSON       -    RECORD
STRING     STRING STRING    STRING STRING   JSON       JSON       JSON       STRING JSON       JSON       -    RECORD
FLOAT      -      -         -      -        BIGNUMERIC -          JSON       JSON   FLOAT      FLOAT      -    RECORD
NUMERIC    -      -         -      -        BIGNUMERIC NUMERIC    JSON       JSON   FLOAT      FLOAT      -    RECORD
INTEGER    -      -         -      -        BIGNUMERIC -          JSON       STRING FLOAT      INTEGER    -    RECORD
JSON       JSON   JSON      JSON   JSON     JSON       JSON       JSON       JSON   JSON       JSON       JSON RECORD
NONE       BYTES  TIMESTAMP DATE   DATETIME BIGNUMERIC NUMERIC    BOOLEAN    STRING FLOAT      INTEGER    JSON RECORD
RECORD     -      JSON      JSON   JSON     JSON       JSON       JSON       JSON   JSON       JSON       JSON RECORD
"""

_head, *_body = [line.split() for line in LATTICE.strip().splitlines()]
NEW_TYPES = tuple(_head[1:])
TYPES = tuple(row[0] for row in _body)
RULES: dict[tuple[str, str], str | None] = {(row[0], new): None if to == "-" else to for row in _body for new, to in zip(NEW_TYPES, row[1:], strict=True)}

MODES = ("", "NULLABLE", "REPEATED")
#: A state is type x mode x frozen, numbered; START is no type, no mode.
STATES = len(TYPES) * len(MODES) * 2


def state(kind: str, mode: str, frozen: bool) -> int:
    return (TYPES.index(kind) * len(MODES) + MODES.index(mode)) * 2 + frozen


def parts_of(s: int) -> tuple[str, str, bool]:
    return TYPES[s // 2 // len(MODES)], MODES[s // 2 % len(MODES)], bool(s % 2)


START = state("NONE", "", False)


def merged(kind: str, new: str) -> tuple[str, bool]:
    """The type after a value of type new, and whether that is a contradiction."""
    to = kind if kind == new else RULES[kind, new]
    return ("JSON", True) if to is None else (to, False)


def _step(token: str) -> np.ndarray:
    out = np.empty(STATES, np.int16)
    for s in range(STATES):
        kind, mode, frozen = parts_of(s)
        if frozen:
            out[s] = s
        elif token == "LIST":  # the list itself; its elements are tokens of their own
            out[s] = state("JSON", mode, True) if mode == "NULLABLE" else state(kind, "REPEATED", False)
        else:
            to, wrong = ("RECORD", False) if token == "RECORD" else merged(kind, token)
            # the mode is set even by the value that freezes the field
            out[s] = state(to, mode or "NULLABLE", wrong)
    return out


STEPS = {t: _step(t) for t in (*NEW_TYPES, "LIST")}
SEP = "\x00"


class Number(str):
    """The text of a JSON number: it is told apart like a string."""


def parse(text: str):
    return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=Number)


def visit(value, path: str, say: Callable[[str, str | None], None]) -> None:
    """Tokens of a value and of all below it, in order; say(path, None) for a null, which only makes the field known."""
    if value is None:
        say(path, None)
    elif isinstance(value, bool):
        say(path, "BOOLEAN")
    elif isinstance(value, str):
        say(path, token_of(value))
    elif isinstance(value, bytes):
        say(path, "BYTES")
    elif isinstance(value, list):
        say(path, "LIST")
        for v in value:
            if v is not None:
                visit(v, path, say)
    elif isinstance(value, dict):
        say(path, "RECORD")
        for k, v in value.items():
            visit(v, path + SEP + k if path else SEP + k, say)
    else:
        raise TypeError(f"no JSON value: {type(value).__name__}")


@dataclass
class Node:
    """A field: its type and mode, what it contains, and what contradicted it, if anything did."""

    name: str
    type: str = ""
    mode: str = ""
    conflict: bool = False
    fields: list[Node] = field(default_factory=list)

    def as_json(self) -> dict:
        out = {"name": self.name, "type": self.type, "mode": self.mode}
        return out | ({"fields": [f.as_json() for f in self.fields]} if self.fields else {})

    def spark_type(self) -> T.DataType:
        plain = {
            "STRING": T.StringType(), "BYTES": T.BinaryType(), "INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(),
            "TIMESTAMP": T.TimestampType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "NUMERIC": T.DecimalType(38, 9), "BIGNUMERIC": T.DecimalType(38, 18),
        }
        if self.type == "RECORD":
            kind: T.DataType = T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields])
        else:
            kind = plain.get(self.type, T.StringType())  # JSON and unknown types are read as text
        return T.ArrayType(kind) if self.mode == "REPEATED" else kind


def fold(rows: list) -> Node:
    """Inference over rows one after the other: the definition that the parallel version is tested against."""
    held: dict[str, int] = {"": START}
    children: dict[str, list[str]] = {}

    def add(path: str, name: str, value) -> None:
        inner = path + SEP + name
        if inner not in held:
            held[inner] = START
            children.setdefault(path, []).append(name)
        take(inner, value)

    def take(path: str, value) -> None:
        if parts_of(held[path])[2] or value is None:
            return
        if isinstance(value, list):
            held[path] = int(STEPS["LIST"][held[path]])
            if not parts_of(held[path])[2]:
                for v in value:
                    take(path, v)
        elif isinstance(value, dict):
            held[path] = int(STEPS["RECORD"][held[path]])
            for k, v in value.items():
                add(path, k, v)
        else:
            token = "BOOLEAN" if isinstance(value, bool) else "BYTES" if isinstance(value, bytes) else token_of(str(value))
            held[path] = int(STEPS[token][held[path]])

    for r in rows:
        take("", r)
    return tree({p: (s, False) for p, s in held.items()})


def tree(states: dict[str, tuple[int, bool]]) -> Node:
    nodes: dict[str, Node] = {}
    for path in sorted(states, key=lambda p: (p.count(SEP), p.encode())):
        kind, mode, frozen = parts_of(states[path][0])
        node = nodes[path] = Node(path.rpartition(SEP)[2], "" if kind == "NONE" else kind, mode, frozen)
        if path:
            nodes[path.rpartition(SEP)[0]].fields.append(node)
    return nodes.get("", Node(""))


NEVER = (1 << 62, 0)
PID, AT = "__pid", "__at"
PARTIAL = "path string, chunk long, step array<short>, pos array<long>, seq array<int>"


def _partials(ordered: DataFrame, json_col: str, frozen: dict[str, tuple[int, int]]) -> DataFrame:
    """For each path and chunk: the state after it for every state before, and where it froze. Tokens below a path of
    `frozen` count only up to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> pa.RecordBatch:
            cols = [[p for p in held], [now] * len(held), [h[0] for h in held.values()], [h[1] for h in held.values()], [h[2] for h in held.values()]]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "chunk", "step", "pos", "seq"])

        for batch in batches:
            for chunk, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if chunk != now:
                    if held:
                        yield out()
                    now, held = chunk, {}
                seq = 0

                def say(path: str, token: str | None, at: int = at) -> None:
                    nonlocal seq
                    seq += 1
                    if frozen:
                        above = path
                        while above:
                            above = above.rpartition(SEP)[0]
                            if (at, seq) > frozen.get(above, NEVER):
                                return
                    h = held.get(path)
                    if h is None:
                        h = held[path] = [np.arange(STATES, dtype=np.int16), np.full(STATES, -1, np.int64), np.zeros(STATES, np.int32), None]
                    if token is None or token == h[3]:
                        return
                    new = STEPS[token][h[0]]
                    fresh = (new % 2 == 1) & (h[0] % 2 == 0)
                    h[1][fresh], h[2][fresh] = at, seq
                    h[3] = token if (new == h[0]).all() else None  # the same token once more changes nothing
                    h[0] = new

                if text is not None:
                    visit(parse(text), "", say)
        if held:
            yield out()

    return ordered.select(PID, AT, json_col).mapInArrow(run, PARTIAL)


def _resolved(partials: DataFrame) -> DataFrame:
    """One row for each path: its state at the end, and chunk, row and token where it froze."""

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        s, froze = START, (None, None, None)
        for chunk, step, pos, seq in frame.sort_values("chunk")[["chunk", "step", "pos", "seq"]].itertuples(index=False):
            to = int(step[s])
            if to % 2 and not s % 2:
                froze = (int(chunk), int(pos[s]), int(seq[s]))
            s = to
        return pd.DataFrame([(frame["path"].iloc[0], s, *froze)], columns=["path", "state", "chunk", "pos", "seq"])

    return partials.groupBy("path").applyInPandas(compose, "path string, state int, chunk long, pos long, seq int")


def infer_schema(df: DataFrame, json_col: str, position: str) -> Node:
    """The schema of the JSON texts of a column, read in position order. The driver gets one row for each field."""
    ordered = chunks(df.select(F.col(position).alias("__order"), F.col(json_col).cast("string").alias("__json")), [F.col("__order")], PID, AT)
    ordered = ordered.withColumn(AT, F.col(PID).cast("long") * F.lit(1 << 33) + F.col(AT))  # one position over all chunks
    frozen: dict[str, tuple[int, int]] = {}
    while True:
        rows = _resolved(_partials(ordered, "__json", frozen)).collect()
        found = {r["path"]: (r["pos"], r["seq"]) for r in rows if r["pos"] is not None}
        inner = {p.rpartition(SEP)[0] for p in (r["path"] for r in rows) if p}
        # Of newly frozen fields that have children only those with no frozen field above can be trusted yet.
        new = {p: at for p, at in found.items() if p not in frozen and any(q == p or q.startswith(p + SEP) for q in inner)}
        new = {p: at for p, at in new.items() if not any(p != q and (p.startswith(q + SEP) or not q) for q in new)}
        if not new:
            return tree({r["path"]: (r["state"], r["pos"] is not None) for r in rows} | ({} if rows else {"": (START, False)}))
        frozen |= new


def with_schema(df: DataFrame, json_col: str, node: Node) -> DataFrame:
    """df's JSON column read with an inferred schema, as columns."""
    kind = node.spark_type()
    return df.select(*[c for c in df.columns if c != json_col], F.from_json(json_col, kind).alias("__r")).select(*[c for c in df.columns if c != json_col], "__r.*")


def schema_rows(node: Node, path: str = "") -> list[tuple[str, str, str, bool]]:
    """(path, type, mode, conflict) of all fields below a node, in order."""
    out = []
    for f in node.fields:
        own = f"{path}.{f.name}" if path else f.name
        out += [(own, f.type, f.mode, f.conflict), *schema_rows(f, own)]
    return out
