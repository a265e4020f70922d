"""Simple-8b word-aligned coding of unsigned integers, vectorised over blocks.

Each 64-bit word has a 4-bit selector (top) and 60 payload bits that hold ``COUNT`` values of
``BITS`` bits each. Values of 2**60 and more are escapes: their word's payload is an index into
a separate array of raw 64-bit values, so every word can be decoded on its own. Values are cut
into blocks of ``block`` ids; a block starts at a word, and an array of word offsets per block
lets all blocks (or any one) be decoded at once.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: values per word and bits per value, by selector; 0 is the escape.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
BLOCK = 1024
#: The longest run a word can hold; blocks are padded by it, so a word never reads its neighbour.
_PAD = int(COUNT.max())
_TABLE = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _bit_length(v: np.ndarray) -> np.ndarray:
    if not len(v) or v.max() < len(_TABLE):
        return _TABLE[v.astype(np.int64)]
    n = np.zeros(len(v), np.uint8)
    rest = v.copy()
    for _ in range(4):
        low = _TABLE[(rest & np.uint64(0xFFFF)).astype(np.int64)]
        n = np.where(rest >= (1 << 16), n + np.uint8(16), n + low)
        rest = np.where(rest >= (1 << 16), rest >> np.uint64(16), np.uint64(0))
    return n


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offset of each block (one more than blocks), escaped values."""
    v = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(v) // block)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    wide = block + _PAD
    grid = np.zeros((blocks, wide), np.uint64)
    full = len(v) // block
    grid[:full, :block] = v[:full * block].reshape(full, block)
    if full < blocks:
        grid[full, :len(v) - full * block] = v[full * block:]
    flat = grid.reshape(-1)
    # the selector at each place, should a word start there: the most values that all fit
    most = _bit_length(flat)
    selector = np.where(most <= BITS[14], np.uint8(14), np.uint8(0))
    held = 1
    for s in [*range(13, 0, -1), 15]:
        step = int(COUNT[s]) - held
        most[:-step] = np.maximum(most[:-step], most[step:])
        held += step
        np.putmask(selector, most <= BITS[s], np.uint8(s))
    # all blocks advance together, one word a step
    at = np.zeros(blocks, np.int64)
    end = np.full(blocks, block, np.int64)
    end[-1] = len(v) - (blocks - 1) * block
    live = np.arange(blocks)
    begins = np.zeros(len(flat), bool)
    while len(live):
        where = live * wide + at[live]
        begins[where] = True
        at[live] += COUNT[selector[where]]
        live = live[at[live] < end[live]]
    start = np.flatnonzero(begins)
    sel = selector[start].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            pos, got = start[rows], np.zeros(len(rows), np.uint64)
            for j in range(int(COUNT[s])):
                got |= flat[pos + j] << np.uint64(j * int(BITS[s]))
            words[rows] |= got
    out = np.flatnonzero(sel == 0)
    words[out] |= np.arange(len(out), dtype=np.uint64)
    offsets = np.searchsorted(start, np.arange(blocks + 1) * wide)
    return words, offsets.astype(np.int64), flat[start[out]]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values that :func:`encode` packed."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    count = COUNT[sel]
    before = np.cumsum(count) - count
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = before - before[offsets[:-1]][of] + of * block if len(words) else before
    stop = np.minimum((of + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s in range(1, 15):
        rows = np.flatnonzero(sel == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNT[s])) if len(rows) else ():
            pos = at[rows] + j
            ok = pos < stop[rows]
            out[pos[ok]] = (payload[rows[ok]] >> np.uint64(j * int(BITS[s]))) & mask
    raw = np.flatnonzero(sel == 0)
    out[at[raw]] = escapes[payload[raw].astype(np.int64)]
    return out
