r"""Chat formatting by schema fingerprints.

A record is JSON. Its fingerprint is a hash of its nested field paths (`messages[].role`, ...),
which selects a declarative mapping that says where turns, roles and texts are; a record with
fields beyond a mapping's goes to the mapping with the most paths that it has all of, and what the
mapping doesn't use comes back as JSON in `rest`. Mappings turn prompt, instruction and message
layouts into canonical turns (role, text). Names in paths have `.`, `[`, `]` and `\` escaped, so a
dotted name isn't taken for a nested one.

The template writes each turn as `<turn ROLE>\n` + text + `\n</turn>\n`. In texts, backslashes,
`<turn`, `</turn` and `###` get a backslash before them, so no text can start or end a turn; in
roles also `<`, `>`, line feeds and carriage returns. Reading back is exact. The loss mask is
spans of code points, start and end, over the escaped texts of assistant turns.

Edge cases: null texts and roles are empty; a record that isn't an object, that no mapping fits,
that is nested too deeply or holds half of a surrogate pair gives no output but an error, in its own
row, and null digests; turns that are no objects, or lack their role or text, are errors too; a
conversation without turns is formatted as an empty string; rows without a conv_id are one
conversation; an empty table gives an empty result; other columns pass through, those named like an
added one with `_given` after their name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import set_aside

OTHER_ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


@dataclass(frozen=True)
class Mapping:
    """paths: the field paths it needs. fixed: (role, fields to be joined by a blank line) of each turn;
    each: the list that holds further turns, with role and text fields."""

    name: str
    paths: frozenset[str]
    each: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()  # names that the layout has for the canonical roles


def _list(name: str, each: str, role: str, text: str, roles: tuple[tuple[str, str], ...] = (), before: tuple[str, ...] = ()) -> Mapping:
    """before: fields that are turns of their own name ahead of the list."""
    return Mapping(name, frozenset({f"{each}[].{role}", f"{each}[].{text}", *before}), each, role, text, tuple((f, (f,)) for f in before), roles)


def _fixed(name: str, *turns: tuple[str, tuple[str, ...]]) -> Mapping:
    return Mapping(name, frozenset(f for _, fields in turns for f in fields), fixed=turns)


MAPPINGS = (
    _list("messages", "messages", "role", "content"),
    _list("system_messages", "messages", "role", "content", before=("system",)),
    _list("conversations", "conversations", "from", "value", OTHER_ROLES),
    _list("system_conversations", "conversations", "from", "value", OTHER_ROLES, ("system",)),
    _list("turns", "turns", "speaker", "text", OTHER_ROLES),
    _list("dialog", "dialog", "role", "text"),
    _fixed("instruction_input", ("user", ("instruction", "input")), ("assistant", ("output",))),
    _fixed("instruction", ("user", ("instruction",)), ("assistant", ("output",))),
    _fixed("instruction_response", ("user", ("instruction",)), ("assistant", ("response",))),
    _fixed("system_prompt_response", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    _fixed("prompt_completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _fixed("prompt_response", ("user", ("prompt",)), ("assistant", ("response",))),
    _fixed("question_answer", ("user", ("question",)), ("assistant", ("answer",))),
)


_IN_NAMES = re.compile(r"[\\.\[\]]")


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves; an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        names = {k: _IN_NAMES.sub(lambda m: "\\" + m[0], k) for k in value}
        return set().union(*[field_paths(v, f"{at}.{names[k]}" if at else names[k]) for k, v in value.items()])
    if isinstance(value, list) and value:
        return set().union(*[field_paths(v, f"{at}[]") for v in value])
    return {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


_BY_PRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def _fits(mapping: Mapping, record: dict, paths: set[str]) -> bool:
    lacks = mapping.paths - paths
    if mapping.each and record.get(mapping.each) == []:  # a list without turns has no paths in it
        lacks = {x for x in lacks if not x.startswith(f"{mapping.each}[].")}
    return not lacks


def mapping_for(record: dict) -> Mapping | None:
    paths = field_paths(record)
    if found := _BY_PRINT.get(fingerprint(paths)):
        return found
    return max((m for m in MAPPINGS if _fits(m, record, paths)), key=lambda m: len(m.paths), default=None)


def canonical(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """The turns; raises ValueError where one isn't as the mapping says."""
    say = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    turns = [(role, "\n\n".join(x for f in fields if (x := say(record.get(f))))) for role, fields in mapping.fixed]
    if mapping.each:
        names, listed = dict(mapping.roles), record[mapping.each]
        if not (isinstance(listed, list) and all(isinstance(t, dict) for t in listed)):
            raise ValueError("turns are no objects")
        if not all(mapping.role in t and mapping.text in t for t in listed):
            raise ValueError("a turn lacks its role or text")
        turns += [(names.get(r := say(t[mapping.role]), r), say(t[mapping.text])) for t in listed]
    return turns


def unused(record: dict, mapping: Mapping) -> dict:
    """What a mapping leaves of a record; of its turns, in their order, if any has more than role and text."""
    used = {f for _, fields in mapping.fixed for f in fields}
    out = {k: v for k, v in record.items() if k not in used and k != mapping.each}
    if mapping.each:
        more = [{k: v for k, v in t.items() if k not in (mapping.role, mapping.text)} for t in record[mapping.each]]
        out |= {mapping.each: more} if any(more) else {}
    return out


_ESCAPES = re.compile(r"\\|</?turn|###")
_UNESCAPES = re.compile(r"\\(\\|</?turn|###)")
_ROLE_ESCAPES = {"\\": "\\\\", "<": "\\<", ">": "\\g", "\n": "\\n", "\r": "\\r"}
_ROLE_BACK = {v: k for k, v in _ROLE_ESCAPES.items()}


def escaped(text: str) -> str:
    return _ESCAPES.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _UNESCAPES.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = f"<turn {''.join(_ROLE_ESCAPES.get(c, c) for c in role)}>\n"
        body = escaped(text)
        parts += [head, body, "\n</turn>\n"]
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + 9
    return "".join(parts), mask


_TURN = re.compile(r"<turn ([^>]*)>\n(.*?)\n</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((re.sub(r"\\.", lambda x: _ROLE_BACK[x[0]], m[1]), unescaped(m[2])))
        at = m.end()
    return turns


_ADDED = {"fingerprint": pa.string(), "mapping": pa.string(), "formatted": pa.string(), "loss_spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "rest": pa.string(), "error": pa.string()}
_ADDED_DDL = "fingerprint string, mapping string, formatted string, loss_spans array<struct<start: bigint, end: bigint>>, rest string, error string"


def _format_one(raw: str | None) -> tuple:
    mark = name = None
    try:
        record = json.loads(raw or "null")
        if not isinstance(record, dict):
            return None, None, None, None, None, "not an object"
        mark = fingerprint(field_paths(record))
        mapping = mapping_for(record)
        if not mapping:
            return mark, None, None, None, None, "no mapping"
        name = mapping.name
        text, mask = format_turns(canonical(record, mapping))
        rest = unused(record, mapping)
        text.encode()
        return mark, name, text, [{"start": a, "end": b} for a, b in mask], json.dumps(rest) if rest else None, None
    except RecursionError:
        return mark, name, None, None, None, "nested too deeply"
    except UnicodeEncodeError:
        return mark, name, None, None, None, "half of a surrogate pair"
    except json.JSONDecodeError:
        return None, None, None, None, None, "not JSON"
    except ValueError as e:  # of a turn, or of a number beyond what Python reads
        return mark, name, None, None, None, str(e) if name else "not JSON"


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """records, with JSON in `column`, plus fingerprint, mapping, formatted, loss_spans, rest and error."""
    kept, names = set_aside(records, _ADDED)
    column = names.get(column, column)
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [_ADDED_DDL])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_format_one(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[] for _ in _ADDED]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(cols, _ADDED.values(), strict=True)]], names=[*batch.schema.names, *_ADDED])

    return kept.mapInArrow(run, schema)


def message_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of a conversation, by turn (nulls last, then role and text), as a
    message layout. A conversation is one record, so its rows come together."""
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("messages"))).alias("record"))


_DIGEST = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations finds: turns and text under the loss mask; nulls
    for a record with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if text is None:
                    out.append((conv, None, None, None, None, None))
                    continue
                turns = read_back(text)
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
                out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            cols = zip(*out, strict=True) if out else [[] for _ in _DIGEST]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _DIGEST.values(), strict=True)], names=list(_DIGEST))

    ddl = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select(F.col("conv_id").cast("long"), "formatted", "loss_spans").mapInArrow(run, ddl)
