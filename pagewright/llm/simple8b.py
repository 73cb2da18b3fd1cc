"""Simple-8b: selectors pack varying counts of ids into 64-bit words.

A stream is cut into blocks of BLOCK ids. Every word holds a 4-bit selector and 60 bits of payload.
An id of more than ESCAPE_BITS bits may be escaped: the word keeps its low bits and the block's
escape list keeps (position, high bits), so that one wide id doesn't widen its neighbours. All
blocks are encoded and decoded side by side; block_words gives each block's offset.
"""

from __future__ import annotations

import numpy as np

#: Fixed values: (ids in a word, bits of each) by selector.
LAYOUT = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([n for n, _ in LAYOUT], np.int64)
BITS = np.array([b for _, b in LAYOUT], np.int64)
BLOCK = 1024
PAD = 240
ESCAPE_BITS = 15
#: Escape where at most this share of a block's ids is wider.
ESCAPE_SHARE = 1 / 16


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits of every id, 0 for 0."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ids below 2**32 -> (words, words of each block as int32, escapes as rows of 3 int32).

    >>> import numpy as np
    >>> decode(*encode(np.array([1, 70000, 0])), 3).tolist()
    [1, 70000, 0]
    """
    n = len(ids)
    if not n:
        return b"", b"", b""
    rows = -(-n // BLOCK)
    cells = np.zeros((rows, BLOCK + PAD), np.uint64)
    flat = np.zeros(rows * BLOCK, np.uint64)
    flat[:n] = ids
    cells[:, :BLOCK] = flat.reshape(rows, BLOCK)
    used = np.full(rows, BLOCK, np.int64)
    used[-1] = n - (rows - 1) * BLOCK
    width = _widths(cells)
    wide = width > ESCAPE_BITS
    wide &= (wide.sum(1) <= ESCAPE_SHARE * used)[:, None]
    at = np.argwhere(wide)
    escapes = np.empty((len(at), 3), "<i4")
    if len(at):
        full = cells[wide]
        escapes[:, :2], escapes[:, 2] = at, (full >> np.uint64(ESCAPE_BITS)).astype(np.int64)
        cells[wide] = full & np.uint64((1 << ESCAPE_BITS) - 1)
        width[wide] = _widths(cells[wide])
    # widest[k]: the widest of the k ids from each position on, by doubling and joining shorter runs
    widest, known = {1: width}, [1]

    def upto(k: int) -> np.ndarray:
        if k not in widest:
            half = next(j for j in reversed(known) if j < k and 2 * j >= k)
            a, out = widest[half], widest[half].copy()
            out[:, : -(k - half)] = np.maximum(a[:, : -(k - half)], a[:, k - half :])
            widest[k] = out
            known.append(k)
        return widest[k]

    selector = np.full(width.shape, len(LAYOUT) - 1, np.uint8)
    for s in range(len(LAYOUT) - 2, -1, -1):
        count, bits = LAYOUT[s]
        selector[upto(count) <= bits] = s
    lanes, pos, taken = np.arange(rows), np.zeros(rows, np.int64), []
    while len(lanes):
        s = selector[lanes, pos]
        taken.append((lanes, pos, s))
        pos = pos + COUNTS[s]
        open_ = pos < used[lanes]
        lanes, pos = lanes[open_], pos[open_]
    lane, start, sel = (np.concatenate([t[i] for t in taken]) for i in range(3))
    order = np.argsort(lane, kind="stable")
    lane, start, sel = lane[order], start[order], sel[order].astype(np.int64)
    words = sel.astype(np.uint64)
    base = lane * (BLOCK + PAD) + start
    line = cells.reshape(-1)
    for s in np.unique(sel):
        count, bits = LAYOUT[s]
        if bits:
            of = np.flatnonzero(sel == s)
            for j in range(count):
                words[of] |= line[base[of] + j] << np.uint64(4 + j * bits)
    return words.astype("<u8").tobytes(), np.bincount(lane, minlength=rows).astype("<i4").tobytes(), escapes.tobytes()


def decode(words: bytes, block_words: bytes, escapes: bytes, n: int) -> np.ndarray:
    """The ids, as unsigned 32-bit integers."""
    if not n:
        return np.empty(0, np.uint32)
    w, per = np.frombuffer(words, "<u8"), np.frombuffer(block_words, "<i4").astype(np.int64)
    rows = len(per)
    sel = (w & np.uint64(15)).astype(np.int64)
    lane = np.repeat(np.arange(rows), per)
    ends = np.cumsum(COUNTS[sel])
    first = np.cumsum(per) - per
    starts = ends - COUNTS[sel]
    base = lane * (BLOCK + PAD) + starts - starts[first][lane]
    out = np.zeros(rows * (BLOCK + PAD), np.uint64)
    for s in np.unique(sel):
        count, bits = LAYOUT[s]
        if bits:
            of = np.flatnonzero(sel == s)
            mask = np.uint64((1 << bits) - 1)
            for j in range(count):
                out[base[of] + j] = (w[of] >> np.uint64(4 + j * bits)) & mask
    e = np.frombuffer(escapes, "<i4").reshape(-1, 3).astype(np.int64)
    out[e[:, 0] * (BLOCK + PAD) + e[:, 1]] |= e[:, 2].astype(np.uint64) << np.uint64(ESCAPE_BITS)
    return out.reshape(rows, BLOCK + PAD)[:, :BLOCK].reshape(-1)[:n].astype(np.uint32)
