"""Chat formatting: schema fingerprints choose declarative mappings to turns.

A record's layout is the sorted list of its nested field paths; its hash is looked
up for the mapping that says where turns, roles and texts lie. A mapping fits every
layout that has its paths, whatever else is in it. Turns are then written
in one template in which control strings inside texts are escaped reversibly,
and can be read back from the written text alone.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.llm.common import map_batches

#: Strings that chat templates in use give a meaning.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
_MARK = "\\!"
_INNER = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True) if c[0] == "<")
_BREAK = r"(<)(?=" + _INNER + r")|(\|)(?=>)|(\[)(?=/?INST\])"
_NAME = re.compile(r"(?:`((?:[^`]|``)*)`|([^:]*)): ")
_LEAF = re.compile(r"[A-Z_ ]+(?:\([^)]*\))?")
_SEGMENT = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)


def escape(text: Column) -> Column:
    """Double every backslash, then break each control string after its first character."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _BREAK, r"$1$2$3\\!")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else "", text, flags=re.S)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns``: path of an array of turns, with ``role`` and ``text`` inside it.
    With ``turn`` the record is itself a turn of that number, and its role is
    kept as it is. With neither, ``fixed`` lists (role, paths of text parts) of
    one turn each.
    """

    turns: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


def field_paths(kind: T.DataType, at: str = "$") -> list[str]:
    """Nested field paths of a type, arrays as ``[]``."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{_key(f.name)}"))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def _key(name: str) -> str:
    """A field's name in a path, quoted if it could be taken for several steps."""
    return name if re.fullmatch(r"[\w -]+", name) else json.dumps(name)


def shape_paths(shape: str) -> list[str]:
    """Nested field paths of a layout as ``schema_of_variant`` writes it."""
    paths, at = [], 0

    def read(path: str) -> None:
        nonlocal at
        if shape.startswith("ARRAY<", at):
            at += 6
            read(path + "[]")
            at += 1
        elif shape.startswith("OBJECT<", at):
            at += 7
            while shape[at] != ">":
                name = _NAME.match(shape, at)
                at = name.end()
                read(f"{path}.{_key(name[2] if name[1] is None else name[1].replace('``', '`'))}")
                at += 2 if shape.startswith(", ", at) else 0
            at += 1
        else:
            paths.append(path)
            at = _LEAF.match(shape, at).end()

    read("$")
    return sorted(paths)


def choose(paths: Iterable[str], layouts: Iterable[tuple[str, ...]]) -> int | None:
    """Position of the mapping for a layout: the one with its fingerprint, else, of those whose paths it has, the one that covers all others."""
    own, layouts = set(paths), list(layouts)
    if (k := {fingerprint(p): k for k, p in enumerate(layouts)}.get(fingerprint(own))) is not None:
        return k
    fit = [(k, set(p)) for k, p in enumerate(layouts) if own.issuperset(p)]
    if not fit:
        return None
    k, most = max(fit, key=lambda x: len(x[1]))
    return k if all(p <= most for _, p in fit) else None


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Layouts by field paths. Add to it to read more.
LAYOUTS: dict[tuple[str, ...], Mapping] = {
    ("$.messages[].content", "$.messages[].role"): Mapping("messages", "role", "content"),
    ("$.conversations[].from", "$.conversations[].value"): Mapping("conversations", "from", "value"),
    ("$.conv_id", "$.role", "$.text", "$.turn"): Mapping(role="role", text="text", turn="turn"),
    ("$.completion", "$.prompt"): Mapping(fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    ("$.prompt", "$.response"): Mapping(fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    ("$.instruction", "$.output"): Mapping(fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    ("$.input", "$.instruction", "$.output"): Mapping(fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
}


def canonical_turns(records: DataFrame, id_col: str, body_col: str, layouts: dict[tuple[str, ...], Mapping] | None = None) -> DataFrame:
    """(conv_id, turn, role, text, fingerprint) from records of mixed layouts.

    ``body_col`` is a JSON text or a struct. The fingerprint is that of the
    record's layout, extra fields included; null for a null body or none that is
    JSON. A struct whose declared fields choose a mapping is read by it, else each
    record is read by its fields that are not null. A record whose layout has no
    mapping, or several of which none covers the others, gives one row with null
    turn, role and text, so nothing vanishes unseen. Text parts are joined by an
    empty line, empty and null parts left out. Known other names of roles
    become user and assistant, except where the record is a turn. Rows that
    repeat are converted each for itself.
    """
    layouts = LAYOUTS if layouts is None else layouts
    kind, body = records.schema[body_col].dataType, F.col(body_col)
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    if isinstance(kind, T.StructType) and (k := choose(field_paths(kind), layouts)) is not None:
        got = _turns(list(layouts.values())[k], lambda path, to: _field(body, path) if to == "array" else _field(body, path).cast(to), _field)
        base = records.select(F.col(id_col).alias("conv_id"), F.when(body.isNotNull(), F.lit(fingerprint(field_paths(kind)))).alias("fingerprint"), F.when(body.isNotNull(), got).otherwise(none).alias("turns"))
    else:
        body = F.try_parse_json(body if isinstance(kind, T.StringType) else F.to_json(body))
        base = records.select(F.col(id_col).alias("conv_id"), body.alias("body"))
        base = base.withColumn("layout", _layout_of(layouts)(F.schema_of_variant("body").cast("string")))
        read = lambda path, to: F.try_variant_get("body", f"$.{path}", "array<variant>" if to == "array" else to)
        turns = none
        for k, mapping in enumerate(layouts.values()):
            turns = F.when(F.col("layout.mapping") == k, _turns(mapping, read, lambda v, name: F.try_variant_get(v, f"$.{name}", "string"))).otherwise(turns)
        base = base.select("conv_id", F.col("layout.fingerprint").alias("fingerprint"), turns.alias("turns"))
    rows = base.select("conv_id", "fingerprint", F.explode_outer("turns").alias("t"))
    return rows.select("conv_id", "t.turn", "t.role", "t.text", "fingerprint")


@functools.lru_cache(10_000)
def _look(shape: str, layouts: tuple[tuple[str, ...], ...]) -> dict:
    paths = shape_paths(shape)
    return {"fingerprint": fingerprint(paths), "mapping": choose(paths, layouts)}


def _layout_of(layouts: dict[tuple[str, ...], Mapping]):
    """From written layouts to (fingerprint, position of the mapping); each is looked at once per worker."""

    known = tuple(layouts)

    @F.arrow_udf("struct<fingerprint:string,mapping:int>")
    def layout_of(shapes: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _look(x, known) for x in shapes.to_pylist()], pa.struct([("fingerprint", pa.string()), ("mapping", pa.int32())]))

    return layout_of


def _field(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value.getField(name)
    return value


def _turns(mapping: Mapping, read: Callable[[str, str], Column], inner: Callable[[Column, str], Column]) -> Column:
    """The turns of a record; ``read`` gives what lies at a path, ``inner`` what a turn has under a name."""

    def turn(number: Column, role: Column, text: Column) -> Column:
        return F.struct(number.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))

    def known(role: Column) -> Column:
        role = F.lower(role.cast("string"))
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), role), role)

    if mapping.turn:
        return F.array(turn(read(mapping.turn, "long"), read(mapping.role, "string"), read(mapping.text, "string")))
    if mapping.turns:
        return F.transform(read(mapping.turns, "array"), lambda v, k: turn(k, known(inner(v, mapping.role)), inner(v, mapping.text)))
    text = lambda parts: F.array_join(F.filter(F.array(*[read(p, "string") for p in parts]), lambda x: x != ""), "\n\n")
    return F.array(*[turn(F.lit(k), F.lit(role), text(parts)) for k, (role, parts) in enumerate(mapping.fixed)])


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, segment, loss_start, loss_end), one row per turn.

    A conversation's formatted text is its segments in order of turn, then role
    and text for equal turns. The loss span covers an assistant's text, in code
    points of the segment, else it is null. Null roles and texts are empty.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.concat(F.lit(OPEN), escape(role), F.lit(SHUT)).alias("head"), escape(text).alias("inner"))
    learn = F.col("role") == "assistant"
    return row.select(
        "conv_id", "turn", "role", "text", F.concat("head", "inner", F.lit(END)).alias("segment"),
        F.when(learn, F.length("head")).alias("loss_start"), F.when(learn, F.length("head") + F.length("inner")).alias("loss_end"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of what the formatted text holds, one row per conversation.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn),
    loss_chars and loss_sha256 (the text under the loss spans, unescaped), and
    formatted_chars. Rows are sorted within the partition and streamed: however
    long a conversation is, a task holds one turn and two running digests.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, done = None, []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for conv, segment, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _SEGMENT.finditer(segment):
                    state[1] += 1
                    state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if lo is not None:
                    text = unescape(segment[lo:hi])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(ordered.select("conv_id", "segment", "loss_start", "loss_end"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
