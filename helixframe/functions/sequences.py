"""Scalar functions on sequences, as built-in column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def is_valid(seq: Column) -> Column:
    """Only ACGT in either case; the empty sequence is valid."""
    return seq.rlike("^[ACGTacgt]*$")


def chars(seq: Column) -> Column:
    """Array of characters; empty for the empty string (split('', '') alone would have one element)."""
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def encode_bases(seq: Column) -> Column:
    """A=0 C=1 G=2 T=3 in either case; any other character raises."""
    code = lambda c: F.instr(F.lit(BASES), c) - 1
    checked = F.when(is_valid(seq), F.upper(seq)).otherwise(F.raise_error(F.concat(F.lit("invalid DNA base in: "), seq)).cast("string"))
    return F.transform(chars(checked), code)


def encode_digits(seq: Column) -> Column:
    """Base-4 digits as text, case folded: the compact form of encode_bases."""
    return F.translate(F.upper(seq), BASES, "0123")


def unsupported_bases(seq: Column) -> Column:
    """Sorted distinct characters outside upper-case ACGT."""
    return F.array_sort(F.array_distinct(chars(F.regexp_replace(seq, "[ACGT]", ""))))


def substitution_score(x: Column, y: Column, match: int = 2, mismatch: int = -1) -> Column:
    return F.when(x == y, F.lit(match)).otherwise(F.lit(mismatch))


def hamming_distance(a: Column, b: Column, mode: str = "char") -> Column:
    """Mismatching positions. 'char' compares raw characters, 'encoded' folds case. Unequal lengths raise.

    Valid DNA is compared in packed words (three bits a base where case counts), other text character by character."""
    if mode not in ("char", "encoded"):
        raise ValueError(f"unknown Hamming mode: {mode}")
    alphabet, bits = (BASES + BASES.lower(), 3) if mode == "char" else (BASES, 2)
    if mode == "encoded":
        a, b = F.upper(a), F.upper(b)
    packed = packed_hamming(_packed(a, alphabet, bits), _packed(b, alphabet, bits), bits)
    both = F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, F.lit(0)).otherwise(F.lit(1)))
    total = F.when(is_valid(a) & is_valid(b), packed).otherwise(F.aggregate(both, F.lit(0), lambda acc, v: acc + v))
    return F.when(F.length(a) == F.length(b), total).otherwise(F.raise_error(F.lit("sequences in a pair must have equal length")).cast("int"))


def _packed(seq: Column, alphabet: str, bits: int) -> Column:
    """Digits of `bits` bits each, in longs of as many as leave the sign bit free; the last may hold fewer."""
    digits = F.translate(seq, alphabet, "01234567"[: len(alphabet)])
    return F.transform(F.regexp_extract_all(digits, F.lit(f".{{1,{63 // bits}}}"), F.lit(0)), lambda x: F.conv(x, 2**bits, 10).cast("bigint"))


def pack_2bit(seq: Column) -> Column:
    """Two bits a base, case folded, in longs of 31 bases."""
    return _packed(F.upper(seq), BASES, 2)


def packed_hamming(a: Column, b: Column, bits: int = 2) -> Column:
    """Mismatching bases of two packed sequences of equal length: a base differs if any of its bits does."""
    low = F.lit(sum(1 << i for i in range(0, 63, bits))).cast("bigint")

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d
        for k in range(1, bits):
            folded = folded.bitwiseOR(F.shiftright(d, k))
        return F.bit_count(folded.bitwiseAND(low))

    return F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, v: acc + v)


def similarity(distance: Column, length: Column) -> Column:
    """Percent of equal positions; null for empty sequences."""
    return F.lit(100.0) * (F.lit(1.0) - F.try_divide(distance, length))


def hash_u32(*parts: Column | str | int) -> Column:
    """Uniform integer in [0, 2^32) from the md5 of the parts joined by '|'; the same in any engine with md5."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint")


def hashed_dna(key: Column) -> Column:
    """32 bases that depend on the key alone."""
    return F.translate(F.md5(key.cast("string")), "0123456789abcdef", BASES * 4)


def text_dna(text: Column) -> Column:
    """Bases from all of a text's letters a-z."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(text, "[^a-z]", ""), letters, (BASES * 7)[:26])


def mutate(seq: Column, seq_id: Column, copy: Column, rate: float, seed: int = 42) -> Column:
    """Each base changes with probability `rate` to one of the other three, by hash of (seed, id, copy, place)."""
    limit = int(rate * 2**32)

    def base(c: Column, i: Column) -> Column:
        u = hash_u32(seed, seq_id, copy, i)
        to = (F.instr(F.lit(BASES), c) + hash_u32(seed + 1, seq_id, copy, i) % 3) % 4 + 1
        return F.when(u < F.lit(limit), F.substring(F.lit(BASES), to.cast("int"), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars(seq), base), "")


def safe_divide(n: Column, d: Column) -> Column:
    """0.0 when the denominator is not positive or either side is missing."""
    return F.coalesce(F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0)), F.lit(0.0))
