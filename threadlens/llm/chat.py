"""Chat records of any layout as canonical turns, and turns as marked, reversible text.

A record's layout is told by a fingerprint: a hash of the paths of its nested fields.
The fingerprint selects a declared mapping, and the mapping says where the turns are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare_workers


@dataclass(frozen=True)
class Mapping:
    """``fields``: (role, field) pairs in order, for records with one field a turn.
    ``items``: the list that holds the turns, with its role and text fields ("" if the
    record itself is one turn)."""
    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict, hash=False, compare=False)
    either: tuple[str, ...] = ()    # further places of the text, of which a turn uses one

    @property
    def paths(self) -> tuple[str, ...]:
        if self.items is None:
            return tuple(f for _, f in self.fields)
        lead = f"{self.items}[]." if self.items else ""
        return (lead + self.role, lead + self.text, *(lead + e for e in self.either))


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_instruction", (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("messages", items="messages"),
    Mapping("messages_parts", items="messages", text="content[].text"),
    Mapping("messages_mixed", items="messages", either=("content[].text",)),
    Mapping("conversations", items="conversations", role="from", text="value", roles=_NAMES),
    Mapping("turn_rows", items="", role="role", text="text"),
)
KNOWN_PATHS = frozenset(p for m in MAPPINGS for p in m.paths)


def fingerprint(paths: Iterable[str]) -> str:
    """Of the paths that any mapping knows; others don't change a layout."""
    known = sorted(set(paths) & KNOWN_PATHS)
    return hashlib.blake2b("\n".join(known).encode(), digest_size=8).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def value_paths(value, lead: str = "") -> Iterator[str]:
    """Paths of the scalar fields of a parsed JSON value; ``[]`` steps into a list."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from value_paths(v, f"{lead}.{k}" if lead else k)
    elif isinstance(value, list):
        for v in value:
            yield from value_paths(v, f"{lead}[]")
    else:
        yield lead


def schema_paths(kind: T.DataType, lead: str = "") -> Iterator[str]:
    """The same paths from a DataFrame's schema."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{lead}.{f.name}" if lead else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{lead}[]")
    else:
        yield lead


def table_turns(df: DataFrame, id_column: str, order_column: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) from a table with typed columns, whose schema's
    fingerprint selects the mapping. Rows by turn are read if ``order_column`` is given, and
    only then. Where further columns have names that other mappings know, the fingerprint is no
    mapping's own: then it is the mapping with most paths that the schema holds, of equal ones
    the first declared. A schema that holds none raises ValueError. Null texts are empty turns,
    except that a null field of a one-field-a-turn layout is no turn."""
    paths = set(schema_paths(df.schema))
    able = [m for m in MAPPINGS if (m.items == "") == (order_column is not None) and set(m.paths) <= paths and "[" not in m.text]
    mapping = BY_FINGERPRINT.get(fingerprint(paths))
    if mapping not in able:
        mapping = max(able, key=lambda m: len(m.paths), default=None)
    if mapping is None:
        raise ValueError(f"no mapping for the layout of {df.schema.simpleString()[:200]}")
    conv = F.col(f"`{id_column}`").cast("long").alias("conv_id")

    def role(c: Column) -> Column:
        for old, new in mapping.roles.items():
            c = F.when(c == old, new).otherwise(c)
        return F.coalesce(c, F.lit(""))

    if mapping.items is None:
        turns = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f).cast("string").alias("text"))
                                   for r, f in mapping.fields]), lambda t: t["text"].isNotNull())
        return df.select(conv, F.posexplode(turns).alias("turn", "t")).select(
            "conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
    if mapping.items:
        return df.select(conv, F.posexplode(mapping.items).alias("turn", "t")).select(
            "conv_id", F.col("turn").cast("long").alias("turn"), role(F.col("t")[mapping.role]).alias("role"),
            F.coalesce(F.col("t")[mapping.text], F.lit("")).alias("text"))
    if order_column is None:
        raise ValueError("rows by turn need order_column")
    return df.select(conv, F.col(f"`{order_column}`").cast("long").alias("turn"), role(F.col(mapping.role)).alias("role"),
                     F.coalesce(mapping.text, F.lit("")).alias("text"))


def json_turns(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(conv_id, layout, turn, role, text) from JSON records of mixed layouts, each told by
    its own fingerprint. A record that is null, no JSON, or of no declared layout gives one
    row with layout, turn, role and text null; so does one with nested values where a text or role
    is declared. Null items are no turns, null texts empty ones; of content in parts the texts
    are joined and other parts left out."""
    prepare_workers(df.sparkSession)

    def plain(value, parts: bool) -> str:
        if parts and isinstance(value, list):
            return "".join(plain(p.get("text"), False) for p in value if isinstance(p, dict))
        if isinstance(value, (dict, list)):
            raise ValueError("nested where a text is declared")
        return "" if value is None else str(value)

    def turns_of(record, mapping: Mapping) -> Iterator[tuple[str, str]]:
        if mapping.items is None:
            for role, name in mapping.fields:
                if record[name] is not None:
                    yield role, plain(record[name], False)
            return
        parts = "[]" in mapping.text or bool(mapping.either)
        for item in record[mapping.items] if mapping.items else [record]:
            if item is None:
                continue
            if not isinstance(item, dict):
                raise ValueError("a turn without fields")
            role = plain(item.get(mapping.role), False)
            yield mapping.roles.get(role, role), plain(item.get(mapping.text.partition("[")[0]), parts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mapping = BY_FINGERPRINT.get(fingerprint(value_paths(record))) if isinstance(record, dict) else None
                try:
                    turns = [] if mapping is None else list(turns_of(record, mapping))
                except ValueError:
                    mapping = None
                if mapping is None:
                    rows.append((conv, None, None, None, None))
                else:
                    rows += [(conv, mapping.name, i, r, t) for i, (r, t) in enumerate(turns)]
            names = ["conv_id", "layout", "turn", "role", "text"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return df.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{json_column}`").cast("string")).mapInArrow(
        read, "conv_id long, layout string, turn long, role string, text string")


# Control strings of the template. A text that holds one, with any number of backslashes
# after its first character, gets one more there; reading back takes one away.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[:]", "[/ROLE]")
_REST = r"(/?INST\]|/?ROLE\]|:\]|/?s>|</?SYS>>)"
ESCAPE = rf"([\[<])(\\*){_REST}"
UNESCAPE = rf"([\[<])\\(\\*){_REST}"
SEGMENT = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>"
                     r"|\[ROLE\](?P<role>.*?)\[:\](?P<other>.*?)\[/ROLE\]", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(UNESCAPE, r"\1\2\3", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_length): each turn as marked text. A
    conversation's text is its segments in the order of turn (then role, then text).
    The loss mask covers the escaped text of assistant turns; places count code points in
    the segment, and are null for other turns. Null roles and texts are empty."""
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    segment = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (begin, end) in MARKS.items():
        segment = F.when(role == name, F.concat(F.lit(begin), text, F.lit(end))).otherwise(segment)
    mine = role == "assistant"
    return turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                        segment.alias("segment"),
                        F.when(mine, F.lit(len(MARKS["assistant"][0]))).alias("loss_start"),
                        F.when(mine, F.char_length(text)).alias("loss_length"))


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError("not a segment of the template")
    if m["other"] is not None:
        return unescape(m["role"]), unescape(m["other"])
    return m.lastgroup, unescape(m[m.lastgroup])


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from segments and loss places alone: n_turns, turns_sha256 (of role,
    newline, text, newline a turn), loss_chars and loss_sha256 (of the unescaped text under
    the mask), formatted_chars. Rows with a null conv_id are one conversation; repeated
    turns are turns. Each partition is read as a sorted stream, so a conversation of any
    length takes no more memory than its longest batch."""
    prepare_workers(segments.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def end() -> None:
            if now is not None:
                rows.append((now["id"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"]))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for conv, segment, at, length in zip(*(b.column(i).to_pylist() for i in range(4))):
                if now is None or now["id"] != conv:
                    end()
                    now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                role, text = parse(segment)
                now["turns"] += 1
                now["size"] += len(segment)
                now["all"].update(f"{role}\n{text}\n".encode())
                if at is not None:
                    masked = unescape(segment[at:at + length])
                    now["chars"] += len(masked)
                    now["loss"].update(masked.encode())
            if len(rows) >= 1000:
                yield flush()
                rows.clear()
        end()
        if rows:
            yield flush()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
