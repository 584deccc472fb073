"""Content-defined anchors of byte strings.

The anchor of a string is the leftmost smallest of the hashes of its first `width` 16-grams. Equal
strings of width + 15 bytes or more have it at the same place, wherever they stand: the choice depends
on nothing but those bytes. Each start of a string has one anchor, and the starts of an anchor
are next to each other.
"""

from __future__ import annotations

import numpy as np

from .core import MUL_A, U64, PrefixHash

K = 16
_PLACE = U64((1 << 31) - 1)  # low bits that hold the place, which breaks ties to the left


def anchors(sums: np.ndarray, hasher: PrefixHash, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all strings of a text of under 2**31 bytes, with the first and the last start of each, from the text's prefix sums."""
    n = len(sums) - K
    if n < width:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    key = sums[K:] - sums[:-K]
    key *= hasher.down[:n]
    key *= MUL_A
    key &= ~_PLACE
    key |= np.arange(n, dtype=U64)
    span, m = 1, key
    while span * 2 <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: n - width + 1], m[width - span : n - span + 1])
    first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    return (m[first] & _PLACE).astype(np.int64), first, np.append(first[1:] - 1, len(m) - 1)
