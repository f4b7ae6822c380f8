"""Splittable scans of pair text and FASTA: byte ranges of files, read apart and numbered as a whole.

A scan has two steps. The first reads every range and returns one small row for it (how many tokens or lines begin there, which
records do and how many bases follow). Their running sums, over as many rows as the input has ranges of RANGE_BYTES, give
each range its first number; the second step reads the ranges again and makes numbered rows, without any shuffle.
What begins in a range belongs to it and is read to its end, past the range if need be. Files are opened with
pyarrow's file systems (local paths, file:, hdfs:, s3:, gs: where the library for them is present).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of one read, and of a chunk of a sequence.
RANGE_BYTES, READ_BYTES, CHUNK_BASES = 64 << 20, 1 << 20, 1 << 16
#: A header line is at most this long; a longer stretch without a line end is sequence text.
HEADER_BYTES = 1 << 20

SPACE = b" \t\n\v\f\r"
_SPACE, _LINE, _LINE_END, _HEAD = (re.compile(p) for p in (rb"[ \t\n\v\f\r]", rb"\n", rb"[\r\n]", rb"[\r\n][ \t\n\v\f\r]*>"))
#: Bases in capitals, one N for each character outside ASCII; white space and the other bytes of such characters go.
_BASES = bytes(ord("N") if i >= 0xC0 else bytes([i]).upper()[0] for i in range(256))
_DROPPED = SPACE + bytes(range(0x80, 0xC0))


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files in a folder in order of name; hidden files are left out."""
    from pyarrow import fs

    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name)]


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, inner = _system(path)
    return system.open_input_file(inner)


def pieces(f, start: int, end: int, separator: re.Pattern) -> Iterator[bytes]:
    """The text that begins in [start, end), in pieces that end with a separator or the file."""
    begin = start
    if start:
        begin = _find(f, start - 1, separator)
    stop = _find(f, end - 1, separator)
    rest = b""
    while begin < stop:
        data = rest + f.read_at(min(READ_BYTES, stop - begin), begin)
        begin += len(data) - len(rest)
        if begin >= stop:
            yield data
            return
        last = max(data.rfind(c) for c in ((b"\n",) if separator is _LINE else [bytes([s]) for s in SPACE])) + 1
        if last:
            yield data[:last]
        rest = data[last:]


def _find(f, at: int, separator: re.Pattern) -> int:
    """The place after the first separator at or after `at`; the end of the file if there is none."""
    size = f.size()
    while at < size:
        data = f.read_at(READ_BYTES if at + READ_BYTES <= size else size - at, at)
        if m := separator.search(data):
            return at + m.end()
        at += len(data)
    return size


def tokens(f, start: int, end: int) -> Iterator[list[bytes]]:
    return (p.split() for p in pieces(f, start, end, _SPACE))


def lines(f, start: int, end: int) -> Iterator[list[bytes]]:
    for p in pieces(f, start, end, _LINE):
        found = p.split(b"\n")
        yield found[:-1] if not found[-1] else found


def fasta_events(f, start: int, end: int) -> Iterator[tuple[bool, bytes]]:
    """(True, header) for each header that begins in the range, (False, bases) for the sequence text of the range."""
    at, fresh = start, True
    if start:
        back = f.read_at(min(HEADER_BYTES, start), max(0, start - HEADER_BYTES))
        cut = max(back.rfind(b"\n"), back.rfind(b"\r")) + 1
        line = back[cut:].strip() if cut or start <= HEADER_BYTES else b"long"
        fresh = not line
        if line.startswith(b">"):
            at, fresh = _find(f, start, _LINE_END), True
    data, pos = b"", 0
    while pos < len(data) or at < end:
        if pos == len(data):
            data, pos = f.read_at(min(READ_BYTES, end - at), at), 0
            at += len(data)
            if not data:
                return
        if fresh:
            while pos < len(data) and data[pos] in SPACE:
                pos += 1
            if pos == len(data):
                continue
            fresh = False
            if data[pos : pos + 1] == b">":
                m = _LINE_END.search(data, pos)
                if m:
                    head, pos = data[pos + 1 : m.start()], m.end()
                else:
                    after = _find(f, at, _LINE_END)
                    head, data, pos = data[pos + 1 :] + f.read_at(after - at, at), b"", 0
                    at = after
                yield True, head.strip()
                fresh = True
                continue
        m = _HEAD.search(data, pos)
        bases = data[pos : m.start() if m else len(data)]
        yield False, bases.translate(_BASES, _DROPPED)
        if m:
            pos, fresh = m.end() - 1, True
        else:
            tail = data[len(data.rstrip(SPACE)) :]
            pos, fresh = len(data), b"\n" in tail or b"\r" in tail


@dataclass
class Range(InputPartition):
    """A byte range, the number of its first row, and (FASTA) the record it begins in: its header and place."""

    path: str
    start: int
    end: int
    first: int = 0
    header: str = ""
    place: int = 0


def _pairs(r: Range) -> Iterator[pa.RecordBatch]:
    """`first`: tokens of the file before the range; `place`: the number of the file's first pair."""
    with _open(r.path) as f:
        skip, n, left = r.first % 2, (r.first + 1) // 2 + r.place, None
        for got in tokens(f, r.start, r.end):
            if skip and got:
                got, skip = got[1:], 0
            if left is not None:
                got = [left, *got]
            left = got.pop() if len(got) % 2 else None
            yield _pair_batch(n, got[0::2], got[1::2])
            n += len(got) // 2
        if left is not None:
            for got in tokens(f, r.end, f.size()):
                if got:
                    yield _pair_batch(n, [left], got[:1])
                    break


def _line_pairs(r: Range) -> Iterator[pa.RecordBatch]:
    with _open(r.path) as f:
        n = r.first + r.place
        for got in lines(f, r.start, r.end):
            parts = [line.split(None, 2) for line in got]
            yield _pair_batch(n, [p[0] if p else b"" for p in parts], [p[1] if len(p) > 1 else None for p in parts])
            n += len(got)


def _text(values: list) -> pa.Array:
    return pa.array([None if v is None else v.decode("utf-8", "replace") for v in values], pa.string())


def _pair_batch(n: int, a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(n, n + len(a)), pa.int64()), _text(a), _text(b)], names=["pair_id", "seq_a", "seq_b"])


def _chunks(r: Range) -> Iterator[pa.RecordBatch]:
    record, header, offset, held = r.first, r.header, r.place, []  # all of the record that r begins in

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names, kinds = ["record", "genome", "offset", "sequence"], [pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def cut(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal offset, held
        text = b"".join(held)
        at = 0
        while len(text) - at >= CHUNK_BASES or (whole and at < len(text)):
            piece = text[at : at + CHUNK_BASES]
            yield batch([(record, header, offset, piece.decode())])
            at, offset = at + len(piece), offset + len(piece)
        held = [text[at:]]

    with _open(r.path) as f:
        for is_header, text in fasta_events(f, r.start, r.end):
            if is_header:
                yield from cut(True)
                record, header, offset = record + 1, text.decode("utf-8", "replace"), 0
                yield batch([(record, header, 0, "")])  # a record without bases is a row too
            else:
                held.append(text)
                if sum(map(len, held)) >= 4 * CHUNK_BASES:
                    yield from cut(False)
        yield from cut(True)


def _count_tokens(r: Range) -> dict:
    with _open(r.path) as f:
        return {"n": sum(len(t) for t in tokens(f, r.start, r.end))}


def _count_lines(r: Range) -> dict:
    with _open(r.path) as f:
        return {"n": sum(len(t) for t in lines(f, r.start, r.end))}


def _count_fasta(r: Range) -> dict:
    """`lead`: bases before the first header; `last`: those after the last; `unnamed_bases`: those under empty headers."""
    out = {"n": 0, "lead": 0, "last": 0, "header": "", "named": 0, "unnamed_bases": 0, "first_named": -1}
    with _open(r.path) as f:
        for is_header, text in fasta_events(f, r.start, r.end):
            if is_header:
                out |= {"n": out["n"] + 1, "last": 0, "header": text.decode("utf-8", "replace"), "named": out["named"] + bool(text)}
                if text and out["first_named"] < 0:
                    out["first_named"] = out["n"] - 1
            elif out["n"]:
                out["last"] += len(text)
                out["unnamed_bases"] += 0 if out["header"] else len(text)
            else:
                out["lead"] += len(text)
    return out


_COUNT: dict[str, Callable[[Range], dict]] = {"pairs": _count_tokens, "lines": _count_lines, "fasta": _count_fasta}
_ROWS = {"pairs": _pairs, "lines": _line_pairs, "fasta": _chunks}
_SCHEMA = {"pairs": "pair_id bigint, seq_a string, seq_b string", "lines": "pair_id bigint, seq_a string, seq_b string", "fasta": "record bigint, genome string, offset bigint, sequence string"}


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in json.loads(self.options["ranges"])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind = self.options["kind"]
        if self.options.get("count") == "true":
            got = json.dumps(_COUNT[kind](partition))
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.start], pa.int64()), pa.array([got])], names=["path", "start", "found"])
        else:
            yield from _ROWS[kind](partition)


class ByteRanges(DataSource):
    """`spark.read.format("byte_ranges")`: rows of numbered byte ranges of text files, or one row of counts for each."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start bigint, found string" if self.options.get("count") == "true" else _SCHEMA[self.options["kind"]]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def _load(spark: SparkSession, kind: str, ranges: list[Range], count: bool) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    packed = json.dumps([[r.path, r.start, r.end, r.first, r.header, r.place] for r in ranges])
    return spark.read.format("byte_ranges").option("kind", kind).option("ranges", packed).option("count", str(count).lower()).load()


def _ranges(path: str, size: int) -> list[Range]:
    return [Range(p, i, min(i + size, n)) for p, n in files(path) for i in range(0, n, size)]


def _counted(spark: SparkSession, kind: str, ranges: list[Range]) -> list[dict]:
    if not ranges:
        return []
    got = {(r["path"], r["start"]): json.loads(r["found"]) for r in _load(spark, kind, ranges, True).collect()}  # a row for each range
    return [got[r.path, r.start] for r in ranges]


def scan_pairs(spark: SparkSession, path: str, by_line: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(pair_id, seq_a, seq_b), numbered over all files in order of name; a pair does not reach from one file into the next."""
    kind = "lines" if by_line else "pairs"
    ranges = _ranges(path, range_bytes)
    counts = [c["n"] for c in _counted(spark, kind, ranges)]
    place, i = 0, 0
    while i < len(ranges):
        own = [j for j in range(i, len(ranges)) if ranges[j].path == ranges[i].path]
        for j, first in zip(own, accumulate([0] + [counts[j] for j in own])):
            ranges[j].first, ranges[j].place = first, place
        total = sum(counts[j] for j in own)
        place, i = place + (total if by_line else total // 2), own[-1] + 1
    return _load(spark, kind, ranges, False)


def scan_fasta(spark: SparkSession, path: str, single: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(record, genome, offset, sequence): the records of FASTA files in chunks of at most CHUNK_BASES bases.

    `record` numbers them from 0 over all files. White space goes, letters become capitals, a character outside ASCII is one N.
    A record has one row more, of no bases, where its header begins. With `single` anything but one named record with bases,
    its header first, raises; headers without a name and without bases before it are passed over.
    """
    ranges = _ranges(path, range_bytes)
    found = _counted(spark, "fasta", ranges)
    record, header, place, before = -1, "", 0, None
    named = bases = stray = 0
    for r, c in zip(ranges, found):
        if r.path != before:
            stray += c["lead"]
            header, place, before = "", 0, r.path
        elif not header:
            stray += c["lead"]
        r.first, r.header, r.place = record, header, place
        named, bases = named + c["named"], bases + c["lead"] + c["last"]
        stray += c["unnamed_bases"]
        late = bool(named) and (c["n"] > c["named"] and (named > c["named"] or c["first_named"] != c["n"] - 1))
        stray += late
        record += c["n"]
        header, place = (c["header"], c["last"]) if c["n"] else (header, place + c["lead"])
    if stray and single or single and (named != 1 or not bases):
        raise ValueError("expected one FASTA record with a header first and bases after it")
    return _load(spark, "fasta", ranges, False)
