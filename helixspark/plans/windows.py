"""Windows of templates for oligo design, on arrays: all windows of many templates of one length at a time.

The formulas are those of functions.thermo and of oligo; the Columns there would run once for each of a template's thousand windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..functions import tables
from ..functions.thermo import _PARTS, Params, salt_regime, strand_concentration

_LETTERS = "ACGTN"
_COMPLEMENT = np.array([3, 2, 1, 0, 9, 9])
#: Windows that are looked at in one step.
CELLS = 1 << 18


def _table(values: dict[str, float], scale: float = 0) -> np.ndarray:
    """Values by pairs of codes; unknown pairs are NaN."""
    out = np.full((6, 6), np.nan)
    for k, v in values.items():
        if set(k) <= set(_LETTERS):
            out[_LETTERS.index(k[0]), _LETTERS.index(k[1])] = round(v * scale) if scale else v
    return out


def _ends(values: dict[str, float]) -> np.ndarray:
    return np.array([values.get(c, np.nan) for c in _LETTERS] + [np.nan])


_H, _E, _G = _table(tables.NN_H, _PARTS), _table(tables.NN_S, _PARTS), _table(tables.DELTA_G_END)
_END_H, _END_S, _END_G = _ends(tables.END_H), _ends(tables.END_S), _ends(tables.INIT_G_END)


class Block:
    """Templates of one length: codes (n, length) and running sums over neighbours and bases."""

    def __init__(self, texts: list[str]):
        size = len(texts[0])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), size)
        known = np.full(128, 5, dtype=np.int8)
        known[[ord(c) for c in _LETTERS]] = range(5)
        self.size, self.points, self.code = size, points, np.where(points < 128, known[np.minimum(points, 127)], 5).astype(np.intp)
        a, b = self.code[:, :-1], self.code[:, 1:]
        h, e = _H[a, b], _E[a, b]
        unknown = np.isnan(h) | np.isnan(e)
        total = lambda x: np.concatenate([np.zeros((len(texts), 1)), np.cumsum(x, axis=1)], axis=1)
        self.h, self.e, self.unknown = total(np.where(unknown, 0, h)), total(np.where(unknown, 0, e)), total(unknown)
        self.strong = (self.code == 1) | (self.code == 2)
        self.gc = total(self.strong)

    def palindromes(self) -> np.ndarray:
        """(n, size): of each place the bases before it that the bases from it on mirror as complements."""
        out = np.zeros(self.code.shape, dtype=np.int32)
        alive = np.ones(self.code.shape, dtype=bool)
        for k in range(1, self.size // 2 + 1):
            fits = np.zeros(self.code.shape, dtype=bool)
            fits[:, k : self.size - k + 1] = _COMPLEMENT[self.code[:, : self.size - 2 * k + 1]] == self.code[:, 2 * k - 1 :]
            alive &= fits
            if not alive.any():
                break
            out[alive] = k
        return out

    def melting(self, rows: np.ndarray, start: np.ndarray, n: np.ndarray, p: Params, mirrored: np.ndarray) -> np.ndarray:
        """Degrees of windows of at least two bases; NaN where a neighbour is unknown."""
        stop = start + n - 1
        first, last = self.code[rows, start], self.code[rows, stop]
        h = (_END_H[first] + _END_H[last]) + (self.h[rows, stop] - self.h[rows, start]) / _PARTS
        e = (_END_S[first] + _END_S[last]) + (self.e[rows, stop] - self.e[rows, start]) / _PARTS
        own = (n % 2 == 0) & (2 * mirrored[rows, np.minimum(start + n // 2, self.size - 1)] >= n)
        ct = strand_concentration(p.primer, p.template)
        known = self.unknown[rows, stop] == self.unknown[rows, start]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = 1000 * h / (e + np.where(own, -1.4, 0.0) + tables.GAS * np.where(own, math.log(p.primer), math.log(ct)))
            gc = (self.gc[rows, stop + 1] - self.gc[rows, start]) / n
            return np.where(known, _salted(t, gc, n, p), np.nan)

    def stable(self) -> np.ndarray:
        """(n, size): whether the last five bases up to a place hold loosely enough; NaN counts as not."""
        out = np.zeros(self.code.shape, dtype=bool)
        if self.size >= 5:
            pair = _G[self.code[:, :-1], self.code[:, 1:]]
            energy = sum((pair[:, i : self.size - 4 + i] for i in range(4)), np.zeros(()))
            out[:, 4:] = energy + _END_G[self.code[:, 4:]] > -9.0
        return out

    def runs(self, period: int, length: int) -> np.ndarray:
        """(n, size + 1): runs of that period and length that begin before a place."""
        same = self.points[:, period:] == self.points[:, : self.size - period] if period < self.size else np.zeros((len(self.points), 0), dtype=bool)
        out = np.zeros((len(self.points), self.size + 1), dtype=np.int32)
        if length <= self.size:
            n = length - period
            sums = np.concatenate([np.zeros((len(same), 1), dtype=np.int32), np.cumsum(same, axis=1, dtype=np.int32)], axis=1)
            full = sums[:, n:] - sums[:, : sums.shape[1] - n] == n
            out[:, 1 : full.shape[1] + 1] = np.cumsum(full, axis=1)
            out[:, full.shape[1] + 1 :] = out[:, full.shape[1] : full.shape[1] + 1]
        return out

    def fours(self) -> np.ndarray:
        """(n, size + 1): CCCC that begin before a place."""
        c = self.code == 1
        full = c[:, :-3] & c[:, 1:-2] & c[:, 2:-1] & c[:, 3:] if self.size >= 4 else c[:, :0]
        out = np.zeros((len(c), self.size + 1), dtype=np.int32)
        out[:, 1 : full.shape[1] + 1] = np.cumsum(full, axis=1)
        out[:, full.shape[1] + 1 :] = out[:, full.shape[1] : full.shape[1] + 1]
        return out


def _salted(t: np.ndarray, gc: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """Degrees of windows from Kelvin at 1 mol/l, as thermo.melting()."""
    regime, _ = salt_regime(p)
    reciprocal, s = 1 / t, dict(tables.SALT)
    if regime == 2:
        ln = math.log(p.monovalent)
        fixed = reciprocal + (4.29 * gc - 3.95) * 1e-5 * ln + 9.40e-6 * ln * ln
    else:
        ln = math.log(max(0.0, p.divalent - p.dntp))
        if regime == 3:
            m = math.log(p.monovalent)
            s["a"] *= 0.843 - 0.352 * p.monovalent**0.5 * m
            s["d"] *= 1.279 - 4.03e-3 * m - 8.03e-3 * m * m
            s["g"] *= 0.486 - 0.258 * m + 5.25e-3 * m**3
        tail = s["e"] + s["f"] * ln + s["g"] * ln * ln
        fixed = reciprocal + s["a"] + s["b"] * ln + gc * (s["c"] + s["d"] * ln) + tail / (2.0 * (n - 1))
    return 1 / fixed - p.kelvin


def blocks(texts: list[str | None], windows: Callable[[int], int]) -> Iterator[tuple[np.ndarray, Block]]:
    """Places and templates of one length each, some hundred thousand windows at a time; null and empty ones are left out."""
    sizes = np.array([len(t) if t else 0 for t in texts])
    for size in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == size)
        step = max(1, CELLS // max(1, windows(int(size))))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            yield part, Block([texts[i] for i in part])


@lru_cache(64)
def spans(size: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all windows."""
    pairs = [(l, n) for l in range(max(0, size - p.min_length + 1)) for n in range(p.min_length, min(p.max_length, size - l) + 1)]
    return tuple(np.array(pairs, dtype=np.intp).reshape(-1, 2).T)


def chosen(block: Block, target: np.ndarray, own: list, p: Params) -> tuple[np.ndarray, ...]:
    """row, l, n, tm, penalty of the windows that may do, as oligo.candidates() says; own: a list of numbers of each base, or None."""
    l, n = spans(block.size, p)
    count, four, mirrored = len(block.code), block.fours(), block.palindromes()
    rows = np.repeat(np.arange(count), len(l))
    l, n = np.tile(l, count), np.tile(n, count)
    free = n < 4
    free |= four[rows, np.maximum(l, l + n - 3)] == four[rows, l]
    rows, l, n = rows[free], l[free], n[free]
    tm = block.melting(rows, l, n, p, mirrored)
    with np.errstate(invalid="ignore"):
        go = np.abs(tm - target[rows]) <= p.tm_max_difference
    rows, l, n, tm = rows[go], l[go], n[go], tm[go]
    end = l + n - 1
    score = np.abs(l - block.size // 2) / p.position_penalty + np.where(block.strong[rows, end], 0.0, p.at_penalty)
    score = score + np.abs(tm - target[rows]) / p.tm_penalty + np.abs(n - p.target_length) / p.length_penalty
    score = score + np.where((n >= 6) & block.stable()[rows, end], 0.0, p.unstable_penalty)
    least = p.poly_length + 1
    run = n >= least if least <= 1 else np.zeros(len(n), dtype=bool)
    for period in (1, 2) if least > 1 else ():
        begins, length = block.runs(period, period * least), period * least
        run |= (n >= length) & (begins[rows, np.maximum(l, l + n - length + 1)] > begins[rows, l])
    score = score + np.where(run, p.poly_penalty, 0.0)
    if any(x is not None for x in own):
        sums, holes = np.zeros((count, block.size + 1)), np.zeros((count, block.size + 1), dtype=np.int32)
        for i, x in enumerate(own):
            if x is not None:
                x = x[: block.size]
                sums[i, 1 : len(x) + 1] = np.cumsum([0.0 if v is None else v for v in x])
                sums[i, len(x) + 1 :] = sums[i, len(x)]
                holes[i, 1 : len(x) + 1] = np.cumsum([v is None for v in x])
                holes[i, len(x) + 1 :] = holes[i, len(x)]
        score = score + np.where(holes[rows, l + n] > holes[rows, l], 0.0, (sums[rows, l + n] - sums[rows, l]) / n)
    return rows, l, n, tm, score


def texts_of(block: Block, rows: np.ndarray, l: np.ndarray, n: np.ndarray) -> pa.Array:
    """The windows' bases, which are all known."""
    stop = np.cumsum(n)
    at = np.repeat(rows * block.size + l - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)
    letters = np.frombuffer(_LETTERS.encode() + b"?", dtype=np.uint8)[block.code].ravel()[at]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(np.r_[0, stop].astype(np.int32)), pa.py_buffer(letters))


def first_of(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the smallest by keys of each row."""
    order = np.lexsort((*keys[::-1], rows))
    return order[np.r_[True, rows[order][1:] != rows[order][:-1]]] if len(order) else order


def grown(block: Block, target: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """n and tm of each template's oligo from its start, as oligo.grown() says. Templates have two bases or more."""
    count, most = len(block.code), min(p.max_length, block.size)
    every = np.arange(count)
    n = np.arange(2, most + 1)
    tm = np.full((count, most + 1), np.nan)
    tm[:, 2:] = block.melting(np.repeat(every, len(n)), np.zeros(count * len(n), dtype=np.intp), np.tile(n, count), p, block.palindromes()).reshape(count, len(n))
    ok = np.zeros((count, most + 1), dtype=bool)
    ok[:, 1:] = (block.strong & block.stable())[:, :most]
    ok[:, :6] = False
    sizes = np.arange(most + 1)
    first = lambda x: np.where(x.any(axis=1), x.argmax(axis=1), -1)
    last = lambda x: np.where(x.any(axis=1), most - x[:, ::-1].argmax(axis=1), -1)
    with np.errstate(invalid="ignore"):
        hit = first((sizes >= max(1, p.min_length)) & (tm >= target[:, None]))
        stop = np.where(hit >= 0, hit, block.size if block.size <= p.max_length else -1)
        counted = lambda at: np.where(at >= p.min_length, tm[every, at], 0.0)
        here, before = counted(np.maximum(stop, 1)), counted(np.maximum(stop - 1, 0))
        own = (stop <= p.min_length) | (np.abs(here - target) < np.abs(before - target))
        t, was = np.where(own, stop, stop - 1), np.where(own, here, before)
        ahead = first(ok & (sizes >= t[:, None]))
        behind = last(ok & (sizes <= t[:, None]) & ((sizes >= p.min_length) | (sizes == t[:, None])))
        ahead, behind = np.maximum(np.where(ahead < 0, t, ahead), 0), np.maximum(np.where(behind < 0, t, behind), 0)
        gap = lambda at: np.abs(tm[every, at] - was)
        moved = np.where(gap(ahead) < gap(behind), ahead, behind)
        near = gap(moved) <= p.at_penalty if p.at_penalty >= 1e-4 else np.zeros(count, dtype=bool)
    final = np.where(stop < 0, p.max_length, np.where(near, moved, t))
    return final, tm[every, final]
