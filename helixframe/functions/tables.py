"""Table functions for spark.sql, whose columns follow from their arguments.

    SELECT * FROM fragments(TABLE(genomes), sequence_column => 'sequence', window => 128, stride => 32)
    SELECT g.name, m.* FROM genomes g, LATERAL mutants(g.sequence, g.id, 2, 0.05, 42) m
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from helixframe.functions.sequences import BASES

_FRAGMENT = [T.StructField("fragment_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("fragment", T.StringType())]


def _constant(argument: AnalyzeArgument | None, name: str, default=None):
    if argument is None:
        return default
    if argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


class Fragments:
    """All columns of the table but the sequence, and (fragment_id, start, end, fragment) of each window.

    Windows with a character outside ACGT are passed over where skip_ambiguous is true, and raise otherwise. A null or short sequence has none.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, sequence_column: AnalyzeArgument, window: AnalyzeArgument, stride: AnalyzeArgument, skip_ambiguous: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is TABLE(...)")
        name = _constant(sequence_column, "sequence_column")
        if _constant(window, "window") <= 0 or _constant(stride, "stride") <= 0:
            raise ValueError("window and stride must be positive")
        fields = {f.name: f for f in rows.dataType.fields}
        if name not in fields or not isinstance(fields[name].dataType, T.StringType):
            raise ValueError(f"no text column {name}")
        kept = [f for n, f in fields.items() if n != name]
        clash = {f.name for f in kept} & {f.name for f in _FRAGMENT}
        if clash:
            raise ValueError(f"rename {', '.join(sorted(clash))}")
        return AnalyzeResult(T.StructType([*kept, *_FRAGMENT]))

    def eval(self, rows: Row, sequence_column: str, window: int, stride: int, skip_ambiguous: bool = False) -> Iterator[tuple]:
        kept = tuple(v for n, v in rows.asDict(recursive=False).items() if n != sequence_column)
        text, n = (rows[sequence_column] or "").upper(), 0
        plain = not text.strip(BASES)
        if len(text) >= window and not plain and not skip_ambiguous and set(text) - set(BASES):
            raise ValueError("genome holds unsupported bases")
        for s in range(0, len(text) - window + 1, stride):
            piece = text[s : s + window]
            if plain or not piece.strip(BASES):
                yield (*kept, n, s, s + window, piece)
                n += 1


class Mutants:
    """(copy, mutant): copies of a sequence with the bases that `sequences.mutate` gives them."""

    @staticmethod
    def analyze(sequence: AnalyzeArgument, sequence_id: AnalyzeArgument, copies: AnalyzeArgument, rate: AnalyzeArgument, seed: AnalyzeArgument) -> AnalyzeResult:
        if _constant(copies, "copies") <= 0 or not 0 <= float(_constant(rate, "rate")) <= 1:
            raise ValueError("copies must be positive, rate between 0 and 1")
        return AnalyzeResult(T.StructType([T.StructField("copy", T.IntegerType()), T.StructField("mutant", T.StringType())]))

    def eval(self, sequence: str, sequence_id: int, copies: int, rate, seed: int) -> Iterator[tuple]:
        limit = int(float(rate) * 2**32)
        draw = lambda s, c, i: int(hashlib.md5(f"{s}|{sequence_id}|{c}|{i}".encode()).hexdigest()[:8], 16)
        for c in range(copies if sequence is not None else 0):
            out = [BASES[(BASES.find(x) + 1 + draw(seed + 1, c, i) % 3) % 4] if draw(seed, c, i) < limit else x for i, x in enumerate(sequence)]
            yield c, "".join(out)


def register_table_functions(spark: SparkSession) -> None:
    """fragments(TABLE(...), ...) and mutants(...) for spark.sql."""
    spark.udtf.register("fragments", udtf(Fragments, useArrow=False))
    spark.udtf.register("mutants", udtf(Mutants, useArrow=False))
