"""Dense features of texts, for whole batches at once."""

from __future__ import annotations

import numpy as np

from helixframe.llm.text import SpanHash, is_kind, per_text, runs, segment_sum, slabs, to_codes

NAMES = (
    "log_chars", "log_words", "word_length", "long_words", "one_char_words", "capitals", "caps_words", "digits", "exclamations", "questions",
    "punctuation", "symbols", "bars", "non_ascii", "line_breaks", "inner_symbols", "stretched", "distinct_words", "repeated_lines", "letters",
)
_SYMBOLS = np.array([ord(c) for c in "#$%&*@^~<>{}[]=+_\\/"], np.uint32)


def dense(texts: list[str | None]) -> np.ndarray:
    """One row a text, columns NAMES. Null and empty texts give a row of zeros."""
    parts = [_slab([t or "" for t in texts[i:j]]) for i, j in slabs([t or "" for t in texts])]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def _slab(texts: list[str]) -> np.ndarray:
    codes, bounds = to_codes(texts)
    letter, upper, word = is_kind(codes, "letter"), is_kind(codes, "upper"), is_kind(codes, "word")
    space = is_kind(codes, "space")
    n = np.diff(bounds) - 1
    sums = lambda mask: segment_sum(mask.astype(np.int64), bounds).astype(float)
    start, end = runs(word)
    size = end - start
    at = per_text(bounds, start)
    words = np.diff(at).astype(float)
    of_words = lambda v: segment_sum(v.astype(np.float64), at)
    caps = np.concatenate(([0], np.cumsum(upper)))
    # Words that repeat within a text, and lines that do.
    spans = SpanHash(codes)
    distinct = _distinct(spans(start, end), at)
    ls, le = runs(codes != 10)
    # A text's closing space ends its last line; texts are cut apart there.
    line_at = per_text(bounds, ls)
    lines = np.diff(line_at).astype(float)
    repeated = lines - _distinct(spans(ls, le), line_at)
    sym = np.isin(codes, _SYMBOLS)
    inner = np.zeros(len(codes), bool)
    odd = sym | (codes == 33) | ((codes >= 48) & (codes <= 57))
    inner[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
    same = np.zeros(len(codes), bool)
    same[2:] = letter[2:] & (codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2])
    c, w = np.maximum(n, 1), np.maximum(words, 1)
    out = np.stack([
        np.log1p(n), np.log1p(words), of_words(size) / w, of_words(size > 14) / w, of_words(size == 1) / w, sums(upper) / c,
        of_words((size > 1) & (caps[end] - caps[start] == size)) / w, sums((codes >= 48) & (codes <= 57)) / c, sums(codes == 33) / w, sums(codes == 63) / w,
        (sums(~word & ~space)) / c, sums(sym) / c, sums(codes == 124) / c, sums(codes > 127) / c, sums(codes == 10) / c, sums(inner) / w, sums(same) / w,
        distinct / w, repeated / np.maximum(lines, 1), sums(letter) / c,
    ], axis=1)
    out[n == 0] = 0.0
    return out


def _distinct(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct values in each part."""
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, own))
    v, o = values[order], own[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(at) - 1).astype(float)


def hashed_words(texts: list[str | None], dims: int) -> np.ndarray:
    """Square roots of the shares of hashed words: rows of `dims` columns."""
    out = []
    for i, j in slabs([t or "" for t in texts]):
        codes, bounds = to_codes([(t or "").lower() for t in texts[i:j]])
        start, end = runs(is_kind(codes, "word"))
        h = (SpanHash(codes)(start, end) & np.uint64(dims - 1)).astype(np.int64)
        at = per_text(bounds, start)
        own = np.repeat(np.arange(j - i), np.diff(at))
        c = np.bincount(own * dims + h, minlength=(j - i) * dims).reshape(j - i, dims)
        out.append(np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1)))
    return np.concatenate(out) if out else np.zeros((0, dims))
