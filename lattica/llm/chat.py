"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is a JSON object.  The hash of its sorted nested field paths, its
fingerprint, selects a declarative mapping that says where the turns are:
an array of messages, a prompt with its response, or an instruction with an
optional input and an output.  Canonical turns are then written with a template
and can be read back without loss.

Template of a turn: ``### `` role ``: `` text ``</turn>`` and a line feed.  In texts
and roles a backslash becomes ``\\b``, ``</turn>`` ``\\e``, ``### `` ``\\h`` and, in roles, ``: ``
``\\c``; each is undone in the reverse order, so any text survives.

Records whose fingerprint has no mapping have null turns.  Null roles and texts are
empty ones.  Turns that tie are ordered by role, then text; repeated rows are
turns of their own.  Texts of any length that fit in a row are kept whole; an empty table gives the control
conversation alone, or no records; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: ``each`` = (path of an array, role's path, text's path) or ``fixed`` = ((role, paths joined by a line feed), ...)."""

    example: str
    each: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: The layouts known by default; the example gives the fingerprint.
MAPPINGS = (
    Mapping('{"messages":[{"role":"r","content":"c"}]}', each=("$.messages", "$.role", "$.content")),
    Mapping('{"conversations":[{"from":"r","value":"c"}]}', each=("$.conversations", "$.from", "$.value")),
    Mapping('{"chat":{"turns":[{"speaker":"r","text":"c"}]}}', each=("$.chat.turns", "$.speaker", "$.text")),
    Mapping('{"prompt":"p","response":"r"}', fixed=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Mapping('{"prompt":"p","completion":"r"}', fixed=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Mapping('{"system":"s","prompt":"p","response":"r"}', fixed=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Mapping('{"instruction":"i","output":"o"}', fixed=(("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Mapping('{"instruction":"i","input":"n","output":"o"}', fixed=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
)
#: Roles of other layouts in canonical form.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant, whatever the values' types."""
    shape = F.schema_of_variant(record)
    return F.xxhash64(F.regexp_replace(shape, r": (?:[A-Z]+(?:\([0-9,]+\))?)(?=[,>])", ""))


def example(kind: DataType) -> str:
    """A small JSON text of the field paths of a type; an array has one element."""
    if isinstance(kind, StructType):
        return "{" + ",".join(f"{json.dumps(f.name)}:{example(f.dataType)}" for f in kind) + "}"
    return f"[{example(kind.elementType)}]" if isinstance(kind, ArrayType) else '""'


def typed_fingerprint(kind: StructType) -> Column:
    """The fingerprint of records of a type, from its schema alone, however large they are."""
    return fingerprint(F.parse_json(F.lit(example(kind))))


def _turns(m: Mapping, items: Callable[[str], Column], string: Callable[[Column | None, str], Column]) -> Column:
    """The turns by a mapping: ``items`` gives the array at a path, ``string`` the text at a path of an element or, for None, of the record; never null."""
    if m.each:
        path, role, text = m.each
        named = lambda r: reduce(lambda c, kv: c.when(r == kv[0], F.lit(kv[1])), ROLES.items(), F.when(F.lit(False), r)).otherwise(r)
        return F.transform(items(path), lambda x: F.struct(named(string(x, role)).alias("role"), string(x, text).alias("text")))
    return F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *(string(None, p) for p in paths)).alias("text")) for role, paths in m.fixed))


def canonical_turns(record: Column, print_: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The turns of a variant by the mapping that its fingerprint selects; null where none does."""
    items = lambda path: F.coalesce(F.try_variant_get(record, path, "array<variant>"), F.array().cast("array<variant>"))
    string = lambda x, path: F.coalesce(F.try_variant_get(record if x is None else x, path, "string"), F.lit(""))
    chosen = F.when(F.lit(False), F.lit(None).cast(TURNS))
    for m in mappings:
        chosen = chosen.when(print_ == fingerprint(F.parse_json(F.lit(m.example))), _turns(m, items, string).cast(TURNS))
    return chosen


def _has(kind: DataType, path: str) -> bool:
    for name in path.split(".")[1:]:
        if not isinstance(kind, StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def typed_turns(record: Column, kind: StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The turns of a struct of type ``kind`` by the mapping that its fingerprint selects; null where none does."""
    at = lambda x, path: reduce(lambda c, name: c[name], path.split(".")[1:], x)
    items = lambda path: at(record, path)
    string = lambda x, path: F.coalesce(at(record if x is None else x, path), F.lit(""))
    chosen = F.when(F.lit(False), F.lit(None).cast(TURNS))
    for m in mappings:
        if all(_has(kind, p) for p in ([m.each[0]] if m.each else [p for _, paths in m.fixed for p in paths])):
            chosen = chosen.when(typed_fingerprint(kind) == fingerprint(F.parse_json(F.lit(m.example))), _turns(m, items, string).cast(TURNS))
    return chosen


def escaped(text: Column) -> Column:
    for raw, safe in (("\\", "\\b"), (CLOSE, "\\e"), (OPEN, "\\h")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for raw, safe in ((OPEN, "\\h"), (CLOSE, "\\e"), ("\\", "\\b")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def formatted(turns: Column) -> Column:
    role = lambda t: F.replace(escaped(t["role"]), F.lit(MIDDLE), F.lit("\\c"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), role(t), F.lit(MIDDLE), escaped(t["text"]), F.lit(CLOSE + "\n"))), "")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(text, "\\Q" + CLOSE + "\\E\n"), lambda p: p != "")
    role = lambda p: F.substring_index(p, MIDDLE, 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.replace(F.substring(role(p), F.lit(len(OPEN) + 1), F.length(role(p))), F.lit("\\c"), F.lit(MIDDLE))).alias("role"),
            unescaped(F.substring(p, F.length(role(p)) + len(MIDDLE) + 1, F.length(p))).alias("text"),
        ),
    )


def loss_spans(text: Column) -> Column:
    """Code-point intervals (start, end) of a formatted text under the loss mask: the assistant's texts, escaped."""
    parts = F.filter(F.split(text, "\\Q" + CLOSE + "\\E\n"), lambda p: p != "")
    head = f"{OPEN}{LOSS_ROLE}{MIDDLE}"
    step = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p) + len(CLOSE) + 1).alias("at"),
            F.when(F.startswith(p, F.lit(head)), F.concat(s["spans"], F.array(F.struct((s["at"] + len(head)).alias("start"), (s["at"] + F.length(p)).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return step["spans"]


def loss_texts(text: Column) -> Column:
    """The texts at the loss spans of a formatted text, read in one pass."""
    head = f"{OPEN}{LOSS_ROLE}{MIDDLE}"
    parts = F.filter(F.split(text, "\\Q" + CLOSE + "\\E\n"), lambda p: F.startswith(p, F.lit(head)))
    return F.transform(parts, lambda p: unescaped(F.substring(p, F.lit(len(head) + 1), F.length(p))))


def format_records(df: DataFrame, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``df`` with columns fingerprint, formatted and loss_spans for the JSON text in ``record_col``.

    Texts that are no JSON, or beyond the parser's limits (20 million characters a string, 128 MiB a record), have null columns.
    """
    own = F.try_parse_json(F.col(record_col))
    out = df.withColumn("_record", own).withColumn("fingerprint", fingerprint(F.col("_record")))
    out = out.withColumn("formatted", formatted(canonical_turns(F.col("_record"), F.col("fingerprint"), mappings)))
    return out.withColumn("loss_spans", loss_spans(F.col("formatted"))).drop("_record")


#: The two layouts of rows by turn.
LISTED = StructType().add("messages", ArrayType(StructType().add("role", "string").add("content", "string")))
ASKED = StructType().add("prompt", "string").add("response", "string")


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): rows by turn as records of one of two layouts, a message list or, for a user's and an assistant's turn, a prompt and its response.

    The records are typed and their fingerprints those of the layouts, so no record passes the limits of a JSON parser or a variant.
    """
    turns = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    said = F.col("turns")
    one, two = F.get(said, F.lit(0)), F.get(said, F.lit(1))
    pair = (F.size(said) == 2) & (one["role"] == "user") & (two["role"] == "assistant")
    asked = F.when(pair, F.struct(one["content"].alias("prompt"), two["content"].alias("response")))
    records = rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", asked.alias("asked"), F.when(~pair, F.struct(said.alias("messages"))).alias("listed"))
    own = F.when(F.col("asked").isNotNull(), typed_turns(F.col("asked"), ASKED)).otherwise(typed_turns(F.col("listed"), LISTED))
    return records.select("conv_id", formatted(own).alias("formatted")).withColumn("loss_spans", loss_spans(F.col("formatted")))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Format every conversation and a control one (-7), read the output back, and digest it."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    control = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(said).alias("text"))
    out = format_turns(rows.unionByName(control))
    turns = F.col("turns")
    loss = F.array_join(loss_texts(F.col("formatted")), "")
    return out.withColumn("turns", read_turns(F.col("formatted"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
