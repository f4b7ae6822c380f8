"""Chat formatting: records of any known layout become canonical turns, then text with a loss mask.

A layout is the hash of its sorted nested field paths. A registry maps fingerprints to declarative mappings (where the turns,
roles and texts are), so a new layout is a new entry and no code. A layout with extra fields falls back to the mapping with
the most fields that it holds in full. A typed table has one layout, its schema's, found once and applied as column
expressions (`table_turns`); only records of JSON text, whose layouts differ by row, are parsed in Python (`to_turns`).

The template puts `<turn ROLE>`, a line break, the text, a line break and `</turn>`. Control strings inside texts are broken by
a backslash after their first character and backslashes are doubled, so that no text can open or close a turn and reading
back gives the very text. The loss mask covers each assistant text and nothing else.

A conversation's turns are sorted within its task and streamed, so memory does not grow with its length, nor with that of a
text's neighbours. Null texts and roles are empty; null turn numbers come first; ties go by role, then text; rows that repeat
are turns of their own; rows of null conv_id form one conversation. A null record, malformed or too deeply nested JSON, an unknown layout and
an empty list of turns have no turns: the conversation stays, with what turns its other records have, if any. An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StructType

CONTROL = ("<turn", "</turn>", "### Assistant:", "### User:", "### System:", "### Human:", "### Instruction:", "### Response:", "### Input:", "<|")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_SEGMENT = re.compile(r"<turn ((?:\\.|[^\\>])*)>\n(.*?)\n</turn>\n", re.S)
LEARNED_ROLE = "assistant"

#: Declarative mappings. turns: the list of turns; role, text: fields of each; fields: one turn for each non-empty field.
MAPPINGS: list[dict[str, Any]] = [
    {"paths": ["role", "text"], "turns": None, "role": "role", "text": "text"},
    {"paths": ["messages[].content", "messages[].role"], "turns": "messages", "role": "role", "text": "content"},
    {"paths": ["conversations[].from", "conversations[].value"], "turns": "conversations", "role": "from", "text": "value"},
    {"paths": ["completion", "prompt"], "fields": [("user", "prompt"), ("assistant", "completion")]},
    {"paths": ["prompt", "response"], "fields": [("user", "prompt"), ("assistant", "response")]},
    {"paths": ["instruction", "output"], "fields": [("user", "instruction"), ("assistant", "output")]},
    {"paths": ["input", "instruction", "output"], "fields": [("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"paths": ["input", "instruction", "output", "system"], "fields": [("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"paths": ["answer", "question"], "fields": [("user", "question"), ("assistant", "answer")]},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(record: Any, prefix: str = "") -> set[str]:
    """Nested field paths; [] stands for any element of a list."""
    if isinstance(record, dict):
        return set().union(*[field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in record.items()]) if record else {prefix}
    if isinstance(record, list):
        return set().union(*[field_paths(v, f"{prefix}[]") for v in record]) if record else {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(m["paths"]): m for m in MAPPINGS}


def mapping_of(paths: set[str], registry: dict[str, dict] = REGISTRY) -> dict | None:
    found = registry.get(fingerprint(paths))
    if found is None:
        fits = [m for m in registry.values() if set(m["paths"]) <= paths]
        found = max(fits, key=lambda m: (len(m["paths"]), m["paths"])) if fits else None
    return found


def _at(record: Any, path: str | None) -> Any:
    for key in path.split(".") if path else []:
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _string(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def canonical_turns(record: Any, registry: dict[str, dict] = REGISTRY) -> list[tuple[str, str]] | None:
    """(role, text) of each turn; None if no mapping fits."""
    m = mapping_of(field_paths(record), registry)
    if m is None:
        return None
    if "fields" in m:
        return [(role, _string(_at(record, f))) for role, f in m["fields"] if _string(_at(record, f)) or role == LEARNED_ROLE]
    turns = [record] if m["turns"] is None else _at(record, m["turns"]) or []
    turns = [t for t in turns if isinstance(t, dict)]
    name = lambda r: ROLES.get(r, r) if m["turns"] else r
    return [(name(_string(_at(t, m["role"]))), _string(_at(t, m["text"]))) for t in turns]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and end of its loss mask in code points); an empty mask is (0, 0)."""
    head = "<turn " + re.sub(r"([\\<>\n])", r"\\\1", role) + ">\n"
    body = escape(text)
    loss = (len(head), len(head) + len(body)) if role == LEARNED_ROLE else (0, 0)
    return f"{head}{body}\n</turn>\n", *loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from formatted text; raises if anything else stands there."""
    out, at = [], 0
    for m in _SEGMENT.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside turns")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside turns")
    return out


def sound(text: str) -> str:
    """The text with each half of a surrogate pair that stands alone as U+FFFD, so that it can be written as UTF-8."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def record_turns(record: str | None, registry: dict[str, dict] = REGISTRY) -> list[tuple[str, str]]:
    """(role, text) of each turn of a record of JSON text. None if it is null, malformed, nested too deeply to be read or of no
    known layout. Of keys that repeat in an object the last counts."""
    try:
        turns = canonical_turns(json.loads(record), registry) if record is not None else None
    except (ValueError, RecursionError):
        return []
    return [(sound(role), sound(text)) for role, text in turns or []]


def to_turns(records: DataFrame, registry: dict[str, dict] = REGISTRY) -> DataFrame:
    """(conv_id, turn, part, role, text, mapped) from records (conv_id, turn, record as JSON). A record without turns gives one
    row with mapped false."""
    kind, at = (records.schema[c].dataType for c in ("conv_id", "turn"))
    schema = f"conv_id {kind.simpleString()}, turn {at.simpleString()}, part int, role string, text string, mapped boolean"
    kinds = [to_arrow_type(kind), to_arrow_type(at), pa.int32(), pa.string(), pa.string(), pa.bool_()]
    names = ["conv_id", "turn", "part", "role", "text", "mapped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, t, r in zip(*[b.column(i).to_pylist() for i in range(3)]):
                turns = record_turns(r, registry)
                rows += [(c, t, k, role, text, True) for k, (role, text) in enumerate(turns)] if turns else [(c, t, 0, "", "", False)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    return records.select("conv_id", "turn", "record").mapInArrow(run, schema)


def schema_paths(kind: DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a type, as `field_paths` has them of a record."""
    if isinstance(kind, StructType):
        return set().union(*[schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields])
    return schema_paths(kind.elementType, f"{prefix}[]") if isinstance(kind, ArrayType) else {prefix}


def table_turns(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", registry: dict[str, dict] = REGISTRY) -> DataFrame:
    """(conv_id, turn, part, role, text, mapped) of a typed table, whose columns but conv_id and turn are the record. The
    mapping its schema's fingerprint selects becomes column expressions; no row is parsed. Other columns are not read."""
    record = StructType([f for f in table.schema.fields if f.name not in (conv_id, turn)])
    m = mapping_of(schema_paths(record), registry)
    own = [F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn")]
    none = F.struct(F.lit(0).alias("part"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("mapped"))
    if m is None:
        return table.select(*own, none.alias("x")).select("conv_id", "turn", "x.*")
    string = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    made = lambda part, role, text: F.struct(part.alias("part"), role.alias("role"), text.alias("text"), F.lit(True).alias("mapped"))
    if "fields" in m:
        turns = F.array(*[F.struct(F.lit(role).alias("role"), string(F.col(f)).alias("text")) for role, f in m["fields"]])
        turns = F.filter(turns, lambda x: (x["role"] == LEARNED_ROLE) | (x["text"] != ""))
        turns = F.transform(turns, lambda x, i: made(i, x["role"], x["text"]))
    elif m["turns"] is None:
        turns = F.array(made(F.lit(0), string(F.col(m["role"])), string(F.col(m["text"]))))
    else:
        alias = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        turns = F.transform(F.filter(F.col(m["turns"]), lambda x: x.isNotNull()), lambda x, i: made(i, F.coalesce(alias[string(x[m["role"]])], string(x[m["role"]])), string(x[m["text"]])))
        turns = F.when(F.size(F.coalesce(turns, F.filter(F.array(none), lambda x: ~x["mapped"] & x["mapped"]))) == 0, F.array(none)).otherwise(turns)
    return table.select(*own, F.explode(turns).alias("x")).select("conv_id", "turn", "x.*")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, loss_start, loss_end), dealt by conversation and in order; a conversation's text is its segments
    joined. What has no turns is an empty segment, so that its conversation stays."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turn(r, t) if m else ("", 0, 0) for r, t, m in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["conv_id", "segment", "loss_start", "loss_end"])

    return ordered.select("conv_id", "role", "text", "mapped").mapInArrow(run, f"conv_id {kind}, segment string, loss_start bigint, loss_end bigint")


class _Reader:
    """Digests of one conversation, read back segment by segment."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, end: int) -> None:
        for role, text in parse(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        learned = unescape(segment[start:end])
        self.learned.update(learned.encode("utf-8", "surrogatepass"))
        self.loss += len(learned)
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def digests(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted text alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = segments.schema["conv_id"].dataType
    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        reader: _Reader | None = None
        for b in batches:
            done = []
            for c, s, i, j in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if reader is None or reader.conv_id != c:
                    done += [reader.row()] if reader else []
                    reader = _Reader(c)
                reader.add(s, i, j)
            yield batch(done)
        if reader:
            yield batch([reader.row()])

    return segments.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def digest_sql(turns: str) -> str:
    """The digests in SQL, from a subquery of (conv_id, turn, role, text)."""
    controls = "|".join(re.escape(c).replace(r"\ ", " ").replace(r"\#", "#") for c in CONTROL)
    order = "order by turn nulls first, r, x"
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from ({turns}))
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' {order})) as turns_sha256,
  coalesce(sum(length(x)) filter (where r = '{LEARNED_ROLE}'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(x, '' {order}) filter (where r = '{LEARNED_ROLE}'), '')) as loss_sha256,
  sum(17 + length(r) + len(regexp_extract_all(r, '[\\\\<>\\n]')) + length(x) + length(x) - length(replace(x, '\\', '')) + len(regexp_extract_all(x, '{controls}')))::bigint as formatted_chars
from t group by conv_id
"""
