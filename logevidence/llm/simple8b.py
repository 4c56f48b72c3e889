"""Simple-8b coding of unsigned 32-bit integers, with escapes.

A 64-bit word holds a 4-bit selector and 60 bits for a varying count of
values, as many as fit. Values too wide for the block's ``width`` are written
as its escape code (all ones) and kept beside, in order, so a few wide values
don't thin out whole words.
"""

from __future__ import annotations

import numpy as np

# Selector -> values a word, bits a value. Selectors 0 and 1 are runs of zeros.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([n for n, _ in SELECTORS])
WIDTHS = (8, 10, 12, 15, 20, 30, 60)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def best_width(lengths: np.ndarray) -> int:
    """The width with the smallest estimated size; 60 has no escapes."""
    count = np.bincount(lengths, minlength=64)
    slot = np.array([next(60 / n for n, bits in reversed(SELECTORS[2:][::-1]) if bits >= w) for w in range(61)])
    sizes = {w: (count[: w + 1] * slot[: w + 1]).sum() + count[w + 1 :].sum() * (slot[w] + 32) for w in WIDTHS}
    return min(WIDTHS, key=lambda w: (sizes[w], w))


def _widest(lengths: np.ndarray, n: int) -> np.ndarray:
    """Of each place, the largest of ``lengths`` from there over ``n`` places (that fit)."""
    out, width = lengths, 1
    while 2 * width <= n:
        out = np.maximum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.maximum(out[: len(out) - rest], out[rest:]) if rest else out


def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """``values`` -> width, words (little-endian 64 bit), escapes (little-endian 32 bit)."""
    values = np.asarray(values, dtype=np.uint64)
    if not len(values):
        return 60, b"", b""
    lengths = bit_lengths(values)
    width = best_width(lengths)
    escape = (1 << width) - 1
    escaped = values >= escape if width < 60 else np.zeros(len(values), dtype=bool)
    coded = np.where(escaped, np.uint64(escape), values)
    lengths = bit_lengths(coded)
    choice = np.full(len(values), len(SELECTORS) - 1, dtype=np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        n, bits = SELECTORS[s]
        if n <= len(values):
            fits = _widest(lengths, n) <= bits
            choice[: len(fits)][fits] = s
    steps, starts, at = COUNTS[choice].tolist(), [], 0
    while at < len(steps):  # each word starts where the last one ended
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, dtype=np.int64)
    picked = choice[starts]
    words = picked.astype(np.uint64) << np.uint64(60)
    for s in np.unique(picked).tolist():
        n, bits = SELECTORS[s]
        mine = np.flatnonzero(picked == s)
        for k in range(n if bits else 0):
            words[mine] |= coded[starts[mine] + k] << np.uint64(k * bits)
    return width, words.astype("<u8").tobytes(), values[escaped].astype("<u4").tobytes()


def decode(width: int, words: bytes, escapes: bytes) -> np.ndarray:
    """The values of encode(), all words of a selector at once."""
    raw = np.frombuffer(words, dtype="<u8")
    selector = (raw >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selector])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in np.unique(selector).tolist():
        n, bits = SELECTORS[s]
        if bits:
            mine = np.flatnonzero(selector == s)
            places = (ends[mine] - n)[:, None] + np.arange(n)
            out[places] = raw[mine][:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(bits)) & np.uint64((1 << bits) - 1)
    if escapes:
        out[out == (1 << width) - 1] = np.frombuffer(escapes, dtype="<u4")
    return out
