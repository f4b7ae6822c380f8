"""Kernels beyond the linear score: affine gaps, bands with a proof, tiles with borders, and traceback.

All of them keep a row of the score matrix at a time and resolve the moves along a row by a running maximum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from helixframe.functions.alignment import KERNEL_CELLS, _codes
from helixframe.schemas import AffineScoring, Scoring

#: Far below any score, and far from the end of 64 bits.
LOW = -(1 << 60)


def affine_batch(a: list[str], b: list[str], local: bool, s: AffineScoring) -> np.ndarray:
    """Scores with affine gaps (Gotoh 1982): the first base of a gap costs `gap_open`, each further one `gap_extend`.

    Rows past a pair's own end are computed and ignored.
    """
    if not a:
        return np.zeros(0, np.int64)
    xs, la = _codes(a, -1)
    ys, lb = _codes(b, -2)
    n, m = len(a), ys.shape[1]
    place = np.arange(m + 1, dtype=np.int64)
    first = np.where(place == 0, 0, s.gap_open + (place - 1) * s.gap_extend)
    best_row = np.broadcast_to(np.zeros(m + 1, np.int64) if local else first, (n, m + 1)).copy()
    up = np.full((n, m + 1), LOW, np.int64)
    top = np.zeros(n, np.int64)
    own = np.arange(n)
    score = best_row[own, lb].copy() if not local else np.zeros(n, np.int64)
    inside = place[None, :] <= lb[:, None]
    for i in range(1, xs.shape[1] + 1):
        up = np.maximum(best_row + s.gap_open, up + s.gap_extend)
        row = np.empty_like(best_row)
        row[:, 0] = 0 if local else s.gap_open + (i - 1) * s.gap_extend
        row[:, 1:] = np.maximum(best_row[:, :-1] + np.where(ys == xs[:, i - 1][:, None], s.match, s.mismatch), up[:, 1:])
        if local:
            np.maximum(row, 0, out=row)
        # A gap that ends at j began at some k < j, best where row[k] - k * gap_extend is greatest.
        reach = np.maximum.accumulate(row - place * s.gap_extend, axis=1)
        row[:, 1:] = np.maximum(row[:, 1:], reach[:, :-1] + (place[1:] - 1) * s.gap_extend + s.gap_open)
        best_row = row
        if local:
            live = la >= i
            top[live] = np.maximum(top[live], np.where(inside[live], row[live], 0).max(axis=1))
        else:
            done = la == i
            score[done] = row[done, lb[done]]
    return top if local else score


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def tile(a: np.ndarray, b: np.ndarray, top: np.ndarray, left: np.ndarray, s: Scoring, local: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(bottom, right, best) of a tile of the score matrix.

    `top` has the row above the tile with its corner (len(b) + 1 values), `left` the column before it (len(a) values);
    `bottom` is the tile's last row with the corner before it, `right` its last column. `best` is the highest cell (local).
    """
    m = len(b)
    step = np.arange(m + 1, dtype=np.int64) * s.gap
    prev = top - step
    right = np.empty(len(a), np.int64)
    best = 0
    same, other = s.match - s.gap, s.mismatch - s.gap
    for i in range(len(a)):
        cur = np.empty(m + 1, np.int64)
        cur[0] = left[i]
        np.maximum(np.where(b == a[i], same, other) + prev[:-1], prev[1:] + s.gap, out=cur[1:])
        if local:
            np.maximum(cur[1:], -step[1:], out=cur[1:])
        np.maximum.accumulate(cur, out=cur)
        prev = cur
        right[i] = cur[-1] + step[-1]
        if local and m:
            best = max(best, int((cur[1:] + step[1:]).max()))
    return prev + step, right, best


def tile_batch(a: list[np.ndarray], b: list[np.ndarray], tops: list[np.ndarray], lefts: list[np.ndarray], s: Scoring, local: bool) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """`tile` of many tiles, none without letters. Cells past a tile's own end are computed and ignored."""
    la, lb = (np.array([len(x) for x in side]) for side in (a, b))
    xs, ys, left, prev = _padded(a, la, -1), _padded(b, lb, -2), _padded(lefts, la, 0), _padded(tops, lb + 1, 0)
    step, own = np.arange(ys.shape[1] + 1, dtype=np.int64) * s.gap, np.arange(len(a))
    prev -= step
    bottom, right, best = np.empty_like(prev), np.empty_like(left), np.zeros(len(a), np.int64)
    same, other = s.match - s.gap, s.mismatch - s.gap
    inside = np.arange(1, ys.shape[1] + 1) <= lb[:, None]
    for i in range(xs.shape[1]):
        cur = np.empty_like(prev)
        cur[:, 0] = left[:, i]
        np.maximum(np.where(ys == xs[:, i, None], same, other) + prev[:, :-1], prev[:, 1:] + s.gap, out=cur[:, 1:])
        if local:
            np.maximum(cur[:, 1:], -step[1:], out=cur[:, 1:])
        np.maximum.accumulate(cur, axis=1, out=cur)
        prev = cur
        right[:, i] = cur[own, lb] + step[lb]
        if local:
            np.maximum(best, np.where(inside & (i < la)[:, None], cur[:, 1:] + step[1:], 0).max(axis=1), out=best)
        done = la == i + 1
        bottom[done] = cur[done] + step
    return [x[: n + 1] for x, n in zip(bottom, lb)], [x[:n] for x, n in zip(right, la)], best


def _padded(rows: list[np.ndarray], lengths: np.ndarray, pad: int) -> np.ndarray:
    out = np.full((len(rows), int(lengths.max(initial=0))), pad, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.concatenate(rows)
    return out


def slabs(width: np.ndarray, height: np.ndarray) -> Iterator[np.ndarray]:
    """Places of matrices of like width, wide ones last, few enough that a row and a column of all of them are small."""
    order = np.lexsort((height, width))
    width, height = width[order], height[order]
    i = 0
    while i < len(order):
        limit = 2 * int(width[i]) + 16
        j = min(i + max(1, KERNEL_CELLS // limit), int(np.searchsorted(width, limit, "right")))
        while j - i > 1 and (j - i) * int(height[i:j].max()) > 4 * KERNEL_CELLS:
            j = i + (j - i) // 2
        yield order[i:j]
        i = j


def _last_row(a: np.ndarray, b: np.ndarray, s: Scoring) -> np.ndarray:
    top = np.arange(len(b) + 1, dtype=np.int64) * s.gap
    return tile(a, b, top, np.arange(1, len(a) + 1, dtype=np.int64) * s.gap, s, False)[0]


def operations(a: np.ndarray, b: np.ndarray, s: Scoring) -> list[tuple[str, int]]:
    """One best global alignment as runs of =, X, D (base of a alone) and I (base of b alone), by Hirschberg's halving.

    Memory is in proportion to the lengths, work to twice the score matrix. Of several splits the leftmost is taken.
    """
    out: list[tuple[str, int]] = []

    def add(op: str, n: int) -> None:
        if not n:
            return
        if out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + n)
        else:
            out.append((op, n))

    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        if i == j or k == m:
            add("D", j - i)
            add("I", m - k)
        elif j - i == 1:
            fits = np.flatnonzero(b[k:m] == a[i])
            at, gain = (int(fits[0]), s.match) if len(fits) else (0, s.mismatch)
            if len(fits) and s.match < s.mismatch and len(fits) < m - k:
                at, gain = int(np.flatnonzero(b[k:m] != a[i])[0]), s.mismatch
            if gain >= 2 * s.gap:
                add("I", at)
                add("=" if b[k + at] == a[i] else "X", 1)
                add("I", m - k - at - 1)
            else:
                add("D", 1)
                add("I", m - k)
        else:
            half = (i + j) // 2
            total = _last_row(a[i:half], b[k:m], s) + _last_row(a[half:j][::-1], b[k:m][::-1], s)[::-1]
            cut = k + int(total.argmax())
            stack += [(half, j, cut, m), (i, half, k, cut)]  # the left part comes off first
    return out


def cigar(a: str, b: str, s: Scoring) -> str:
    return "".join(f"{n}{op}" for op, n in operations(codes(a), codes(b), s))


def _last_rows(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, bt: np.ndarray, m: np.ndarray, turn: int, s: Scoring) -> np.ndarray:
    """Last rows of the score matrices of a[at : at + n] and b[bt : bt + m], or with turn -1 of a[at], a[at - 1], ... and so on."""
    own, wide = np.arange(len(n)), np.arange(int(m.max()))
    ys = b[np.clip(bt[:, None] + turn * wide, 0, len(b) - 1)]  # letters past an end change no cell before it
    prev = np.zeros((len(n), len(wide) + 1), np.int64)
    out = np.empty_like(prev)
    same, other = s.match - s.gap, s.mismatch - s.gap
    for i in range(int(n.max())):
        xs = a[np.clip(at + turn * i, 0, len(a) - 1)]
        cur = np.empty_like(prev)
        cur[:, 0] = (i + 1) * s.gap
        np.maximum(np.where(ys == xs[:, None], same, other) + prev[:, :-1], prev[:, 1:] + s.gap, out=cur[:, 1:])
        np.maximum.accumulate(cur, axis=1, out=cur)
        prev = cur
        done = n == i + 1
        out[done] = cur[done]
    return out + np.arange(len(wide) + 1) * s.gap


def cigars(a: list[str], b: list[str], s: Scoring) -> list[str]:
    """`cigar` of many pairs: the parts of all of them are halved together, a level at a time."""
    out: list[str] = []
    i = 0
    while i < len(a):
        letters, j = len(a[i]) + len(b[i]), i + 1
        while j < len(a) and letters + len(a[j]) + len(b[j]) <= 4 * KERNEL_CELLS:
            letters += len(a[j]) + len(b[j])
            j += 1
        out += _cigars(a[i:j], b[i:j], s)
        i = j
    return out


def _cigars(a: list[str], b: list[str], s: Scoring) -> list[str]:
    la, lb = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    x, y = codes("".join(a)), codes("".join(b))
    j, m = la.cumsum(), lb.cumsum()
    parts = np.stack((np.arange(len(a)), j - la, j, m - lb, m))  # pair, from and to in x, from and to in y
    leaves = []
    while parts.shape[1]:
        _, i, j, k, m = parts
        whole = (j - i <= 1) | (k == m)
        leaves.append(parts[:, whole])
        parts = parts[:, ~whole]
        p, i, j, k, m = parts
        half, cut = (i + j) // 2, np.empty_like(i)
        for take in slabs(m - k + 1, half - i + 1):
            h, lo, hi = half[take], k[take], m[take]
            width = hi - lo
            ahead = _last_rows(x, i[take], h - i[take], y, lo, width, 1, s)
            back = _last_rows(x, j[take] - 1, j[take] - h, y, hi - 1, width, -1, s)
            place = np.arange(ahead.shape[1])
            total = ahead + np.take_along_axis(back, np.maximum(width[:, None] - place, 0), axis=1)
            cut[take] = lo + np.where(place <= width[:, None], total, LOW).argmax(axis=1)
        parts = np.concatenate((np.stack((p, i, half, k, cut)), np.stack((p, half, j, cut, m))), axis=1)
    parts = np.concatenate(leaves, axis=1)
    p, i, j, k, m = parts[:, np.lexsort((parts[1], parts[0]))]
    # Up to three runs a part: base i against the one at `at`, the rest of y's before and after it; or no two against each other.
    wide, one = m - k, (j - i == 1) & (m > k)
    at, fit = np.zeros_like(i), np.zeros(len(i), bool)
    for take in slabs(wide[one], np.ones_like(wide[one])):
        own = np.flatnonzero(one)[take]
        place = np.arange(int(wide[own].max()))
        inside = place < wide[own, None]
        hit = y[np.clip(k[own, None] + place, 0, len(y) - 1)] == x[i[own], None]
        first, none = (hit & inside).argmax(axis=1), ~(hit & inside).any(axis=1)
        if s.match < s.mismatch:
            miss = ~hit & inside
            first = np.where(miss.any(axis=1), miss.argmax(axis=1), first)
        at[own] = np.where(none, 0, first)
        fit[own] = hit[np.arange(len(own)), at[own]]
    met = one & (np.where(fit, s.match, s.mismatch) >= 2 * s.gap)
    counts = np.stack((np.where(met, at, 0), np.where(met, 1, j - i), np.where(met, wide - at - 1, wide)), axis=1).ravel()
    ops = np.stack((np.full(len(i), "I"), np.where(met, np.where(fit, "=", "X"), "D"), np.full(len(i), "I")), axis=1).ravel()
    pair = np.repeat(p, 3)[counts > 0]
    ops, counts = ops[counts > 0], counts[counts > 0]
    if not len(ops):
        return [""] * len(a)
    starts = np.flatnonzero(np.concatenate(([True], (ops[1:] != ops[:-1]) | (pair[1:] != pair[:-1]))))
    texts = [f"{n}{op}" for n, op in zip(np.add.reduceat(counts, starts).tolist(), ops[starts].tolist())]
    ends = np.searchsorted(pair[starts], np.arange(len(a) + 1)).tolist()
    return ["".join(texts[u:v]) for u, v in zip(ends, ends[1:])]


def _band_scores(a: list[np.ndarray], b: list[np.ndarray], width: np.ndarray, s: Scoring) -> tuple[np.ndarray, np.ndarray]:
    """(best scores of alignments that stay within `width` of the diagonal, cells computed); in each pair len(a) <= len(b)."""
    n, m = (np.array([len(x) for x in side]) for side in (a, b))
    reach = m - n + width  # places j - i from -width to reach
    size = width + reach + 1
    place = np.arange(int(size.max()), dtype=np.int64)
    step = place * s.gap
    xs = _padded(a, n, -1)
    letters = np.full((len(a), len(place) + xs.shape[1]), -2, np.int64)  # b[j - 1] at place p of row i stands at p + i
    column = np.arange(letters.shape[1]) - width[:, None] - 1
    letters[(column >= 0) & (column < m[:, None])] = np.concatenate(b)
    d = place - width[:, None]
    own, band, score, cells = np.arange(len(a)), place < size[:, None], np.empty(len(a), np.int64), np.zeros(len(a), np.int64)
    for i in range(xs.shape[1] + 1):
        j = d + i
        inside = band & (j >= 0) & (j <= m[:, None])
        if i == 0:
            row = np.where(inside, j * s.gap, LOW)
        else:
            cur = row + np.where(letters[:, i : i + len(place)] == xs[:, i - 1, None], s.match, s.mismatch)
            np.maximum(cur[:, :-1], row[:, 1:] + s.gap, out=cur[:, :-1])
            cur = np.where(inside & (j >= 1), cur, np.where(inside, i * s.gap, LOW))
            row = np.where(inside, np.maximum.accumulate(cur - step, axis=1) + step, LOW)
        cells += np.where(n >= i, inside.sum(axis=1), 0)
        done = n == i
        score[done] = row[own[done], reach[done]]
    return score, cells


def banded(a: str, b: str, s: Scoring, width: int = 16) -> tuple[int, int, int]:
    """(score, cells computed, width of the band that proved it).

    An alignment that leaves the band has over `width` gap bases on the shorter side's part and as many more as the lengths
    differ by on the other, which bounds its score; a band whose score reaches the bound holds a best alignment. Otherwise
    the width doubles, up to the whole matrix. Needs match >= mismatch and gap <= 0 for the bound; else takes the whole matrix.
    """
    return tuple(int(v[0]) for v in banded_batch([a], [b], s, width))


def banded_batch(a: list[str], b: list[str], s: Scoring, width: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`banded` of many pairs: those of like size together, and again those whose band proved nothing."""
    sides = [sorted((codes(x), codes(y)), key=len) for x, y in zip(a, b)]
    n, m = (np.array([len(side[k]) for side in sides], dtype=np.int64) for k in (0, 1))
    usable = s.match >= s.mismatch and s.gap <= 0
    w = np.minimum(width, m + 1) if usable else m + 1
    score, total, open_ = np.empty(len(a), np.int64), np.zeros(len(a), np.int64), np.arange(len(a))
    while len(open_):
        for take in slabs((2 * w + m - n + 1)[open_], (n + 1)[open_]):
            take = open_[take]
            score[take], cells = _band_scores([sides[k][0] for k in take], [sides[k][1] for k in take], w[take], s)
            total[take] += cells
        # Outside, at least w + 1 bases of x stand alone, and m - n + w + 1 of y; what is left can match at best.
        bound = (n - w - 1) * max(s.match, 2 * s.gap) + (m - n + 2 * (w + 1)) * s.gap
        open_ = open_[((w < n) & (w <= m) & (score < bound))[open_]]
        w[open_] = np.minimum(2 * w, m + 1)[open_]
    return score, total, w
