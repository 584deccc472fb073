"""Suffix arrays by induced sorting, and their permuted common prefixes, over numpy arrays.

Induction scans the array once from each end. A step takes as many cells as are final already:
all up to the first cell that a suffix induced by this step lands in.
"""

from __future__ import annotations

import numpy as np


def _narrow(values: np.ndarray, size: int) -> np.ndarray:
    """Symbols below size in the narrowest type, which sorts fastest."""
    return values.astype(np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.int32)


def _grouped(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stable order by symbol, each group's symbol, where it starts, and its size."""
    by = symbols.argsort(kind="stable")
    ordered = symbols[by]
    new = np.empty(len(by), bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    start = new.nonzero()[0]
    size = np.empty(len(start), np.int64)
    np.subtract(start[1:], start[:-1], out=size[:-1])
    size[-1] = len(by) - start[-1]
    return by, ordered[start], start, size


def _larger(text: np.ndarray, small: np.ndarray, array: np.ndarray, heads: np.ndarray) -> None:
    """Places the larger suffixes, left to right, after those that are in the array."""
    free, n, at, step = heads.copy(), len(text), 0, 1 << 10
    while at < n:
        end = min(n, at + step)
        before = array[at:end] - 1
        mask = before >= 0
        mask &= ~small[before]
        before = before[mask]
        if len(before):
            symbols = text[before]
            landing = int(free[symbols].min())
            if landing < end:  # the cells up to there are final
                end = landing
                kept = int(np.count_nonzero(mask[: end - at]))
                before, symbols = before[:kept], symbols[:kept]
            if len(before) == 1:
                own = symbols[0]
                array[free[own]] = before[0]
                free[own] += 1
            elif len(before):
                by, group, start, size = _grouped(symbols)
                first = free[group]
                array[np.arange(len(by)) + np.repeat(first - start, size)] = before[by]
                free[group] = first + size
        step = max(48, 2 * (end - at))
        at = end


def _smaller(text: np.ndarray, small: np.ndarray, array: np.ndarray, tails: np.ndarray) -> None:
    """Places the smaller suffixes, right to left, before those that are in the array."""
    free, end, step = tails.copy(), len(text), 1 << 10
    while end > 0:
        at = max(0, end - step)
        before = array[at:end][::-1] - 1
        mask = before >= 0
        mask &= small[before]
        before = before[mask]
        if len(before):
            symbols = text[before]
            landing = int(free[symbols].max()) - 1
            if landing >= at:
                at = landing + 1
                kept = int(np.count_nonzero(mask[: end - at]))
                before, symbols = before[:kept], symbols[:kept]
            if len(before) == 1:
                own = symbols[0]
                free[own] -= 1
                array[free[own]] = before[0]
            elif len(before):
                by, group, start, size = _grouped(symbols)
                last = free[group]
                array[np.repeat(last - 1 + start, size) - np.arange(len(by))] = before[by]
                free[group] = last - size
        step = max(48, 2 * (end - at))
        end = at


def _induce(text: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the seeds' order induces: larger ones, then smaller ones from those."""
    array = np.full(len(text), -1, np.int32)
    by, group, start, size = _grouped(text[seeds])
    cells = np.repeat(tails[group] - size - start, size) + np.arange(len(by))
    array[cells] = seeds[by]
    _larger(text, small, array, heads)
    array[cells[1:]] = -1  # but for the last symbol's, seeds are induced again in their final cells
    _smaller(text, small, array, tails)
    return array


def _same_as_last(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which substrings equal the one before them in the list."""
    same = np.zeros(len(starts), bool)
    alive = np.flatnonzero(lengths[1:] == lengths[:-1]) + 1
    k = 0
    while len(alive):
        alive = alive[text[starts[alive] + k] == text[starts[alive - 1] + k]]
        k += 1
        whole = lengths[alive] == k
        same[alive[whole]] = True
        alive = alive[~whole]
    return same


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of symbols below size; the last symbol is 0 and stands nowhere else."""
    n = len(text)
    if n <= 1:
        return np.arange(n)
    text = _narrow(np.asarray(text), size)
    # classify: a suffix is small if it sorts before the one after it
    change = np.flatnonzero(text[1:] != text[:-1])
    small = np.ones(n, bool)
    small[: n - 1] = np.repeat(text[change] < text[change + 1], np.diff(np.concatenate(([-1], change))))
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost smaller
    counts = np.bincount(text, minlength=size)
    tails = np.cumsum(counts)
    heads = tails - counts
    # sort the leftmost-smaller substrings by inducing from them in text order
    array = _induce(text, small, heads, tails, left)
    if len(left) > 1:
        number = np.full(n, -1, np.int32)
        number[left] = np.arange(len(left))
        found = number[array]
        ordered = found[found >= 0]
        lengths = np.append(np.diff(left) + 1, 1)
        names = np.empty(len(left), np.int64)
        names[ordered] = np.cumsum(~_same_as_last(text, left[ordered], lengths[ordered])) - 1
        if names[ordered[-1]] + 1 < len(left):  # some are equal: their order is that of the reduced text's suffixes
            ordered = suffix_array(names, int(names[ordered[-1]]) + 1)
        array = _induce(text, small, heads, tails, left[ordered])
    return array


def permuted_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each position, the length of the prefix its suffix shares with the suffix before it in the array.

    Where the symbols before both differ, the two are compared; at any other position the length is one
    less than at the position before it.
    """
    n = len(text)
    text = _narrow(np.asarray(text), int(text.max()) + 1 if n else 1)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    first = before <= 0
    first[0] = True
    rest = np.flatnonzero(~first)
    first[rest] = text[rest - 1] != text[before[rest] - 1]
    at = np.flatnonzero(first)
    shared = np.zeros(len(at), np.int64)
    pack = 8 // text.itemsize
    raw = np.concatenate((text, np.zeros(pack, text.dtype))).view(np.uint8)
    words = np.ndarray((n + 1,), "<u8", raw, 0, (text.itemsize,))
    alive = np.flatnonzero(before[at] >= 0)
    while len(alive):
        a, b = at[alive] + shared[alive], before[at[alive]] + shared[alive]
        alive = alive[words[a] == words[b]]
        shared[alive] += pack
    alive = np.flatnonzero(before[at] >= 0)
    while len(alive):
        a, b = at[alive] + shared[alive], before[at[alive]] + shared[alive]
        alive = alive[text[a] == text[b]]
        shared[alive] += 1
    led = np.cumsum(first) - 1
    return shared[led] - (np.arange(n) - at[led]) * (before >= 0)
