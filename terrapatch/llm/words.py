"""Array kernels that cut UTF-8 text into words and name equal words, without a Python object for each word."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[_WHITE] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and value of each code point of valid UTF-8."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[lead].astype(np.int32)
    if len(lead) != len(data):
        wide = np.flatnonzero(cp >= 0xC0)
        at, first = lead[wide], cp[wide]
        more = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
        b1, b2, b3 = more[at + 1] & 63, more[at + 2] & 63, more[at + 3] & 63
        cp[wide] = np.where(first < 0xE0, (first & 31) << 6 | b1, np.where(first < 0xF0, (first & 15) << 12 | b1 << 6 | b2, (first & 7) << 18 | b1 << 12 | b2 << 6 | b3))
    return lead, cp


def _contractions(cp: np.ndarray, run: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes that begin a contraction, and where each contraction ends. run: starts of runs of a class; first: whether each text position begins a text."""
    n = len(cp)
    at = np.flatnonzero((cp == 39) & run)
    if not len(at):
        return at, at
    pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
    begins = np.concatenate([first, np.ones(3, bool)])
    a, b = np.where(begins[at + 1], 0, pad[at + 1]), pad[at + 2]
    b = np.where(begins[at + 1] | begins[at + 2], 0, b)
    one = np.isin(a, [ord(x) for x in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    keep = one | two
    return at[keep], np.minimum(at[keep] + np.where(one[keep], 2, 3), n)


def split_bytelevel(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of byte-level BPE in the segments that bounds delimits in data."""
    bounds = bounds - bounds[0]
    lead, cp = code_points(data)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes()[cp]
    first = np.zeros(n + 1, bool)
    inner = np.searchsorted(lead, bounds)
    first[inner] = True
    first[n] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(cls[1:], cls[:-1], out=run[1:])
    run |= first[:n]
    space = cls == SPACE
    start = run.copy()
    # the last white space before another character stands alone, or leads that character's word if it is U+0020
    nxt = np.empty(n, bool)  # the next character is no white space and of the same segment
    nxt[-1] = False
    nxt[:-1] = ~space[1:] & ~first[1:n]
    last = space & nxt
    start |= last
    plain = np.flatnonzero(last & (cp == 32))
    start[plain + 1] = False
    del last, nxt
    lone = run.copy()
    lone[plain + 1] = False
    at, end = _contractions(cp, lone, first[:n])
    if len(at):
        start[at + 1] = False
        start[end[end < n]] = True
    begin = np.flatnonzero(start)
    offs = lead[begin]
    return offs, np.append(offs[1:], len(data))


def split_lower(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the lower-case word tokenizer: letters, single numbers, runs of others; white space is dropped."""
    bounds = bounds - bounds[0]
    lead, cp = code_points(data)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, bounds)] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= first[:n]
    at, end = _contractions(cp, start, first[:n])
    start |= cls == NUMBER
    if len(at):
        start[at + 1] = False
        start[end[end < n]] = True
    begin = np.flatnonzero(start)
    offs = lead[begin]
    ends = np.append(offs[1:], len(data))
    keep = cls[begin] != SPACE
    return offs[keep], ends[keep]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_blank(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the segments: starts, ends, and the segment of each."""
    bounds = bounds - bounds[0]
    n = len(data)
    word = np.zeros(n + 1, bool)
    np.logical_not(_BLANK[data], out=word[:n])
    start = word[:n].copy()
    start[1:] &= ~word[: n - 1]
    inner = bounds[1:-1]
    inner = inner[inner < n]
    start[inner] |= word[inner]
    begin = np.flatnonzero(start)
    stop = word[:n] & ~word[1:]
    cut = inner[inner > 0] - 1
    stop[cut] |= word[cut]
    end = np.flatnonzero(stop) + 1
    return begin, end, np.searchsorted(bounds, begin, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case."""
    return _LOWER[data]


_MASK = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * k) if k else 0 for k in range(9)], np.uint64)
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice of data."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", pad.data, 0, (1,))
    length = end - start
    h = mixed(length.astype(np.uint64) * _K3 + (eight[start] & _MASK[np.minimum(length, 8)]) * _K1)
    live = np.flatnonzero(length > 8)
    at = 8
    while len(live):
        rest = length[live] - at
        h[live] = mixed(h[live] * _K2 + (eight[start[live] + at] & _MASK[np.minimum(rest, 8)]) * _K1 + _K3)
        at += 8
        live = live[rest > 8]
    return h


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of a representative of each distinct word, and the distinct word of each word. Equal 64-bit hashes are held equal only if lengths and outer bytes agree as well; words that differ within get names of their own by comparison."""
    h = word_hashes(data, start, end)
    order = np.argsort(h)
    g = h[order]
    new = np.empty(len(g), bool)
    if len(g):
        new[0] = True
        np.not_equal(g[1:], g[:-1], out=new[1:])
        # exact check against the previous in order
        a, b = order[:-1], order[1:]
        same = ~new[1:]
        pad = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", pad.data, 0, (1,))
        la, lb = end[a] - start[a], end[b] - start[b]
        m = _MASK[np.minimum(la, 8)]
        differ = same & ((la != lb) | ((eight[start[a]] & m) != (eight[start[b]] & m)))
        new[1:] |= differ
    name = np.empty(len(g), np.int64)
    name[order] = np.cumsum(new) - 1
    return order[new], name


def gathered(offs: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the slices [offs, offs + lens)."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lens > 0
    offs, lens = offs[keep], lens[keep]
    step = np.ones(total, np.int64)
    ends = np.cumsum(lens)
    step[0] = offs[0]
    step[ends[:-1]] = offs[1:] - offs[:-1] - lens[:-1] + 1
    return np.cumsum(step)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_hashes(data: np.ndarray, offs: np.ndarray, n: int):
    """(row, hash) arrays of the runs of n words of each text, repeats included; a text with fewer words has one run, of all. n is 8 at most."""
    from terrapatch.llm import common

    carry, carry_row = np.zeros(0, np.uint64), -1
    for rows, bounds in common.pieces(data, offs):
        goes_on = bounds[-1] < offs[rows[-1] + 1]
        part = lowered(data[bounds[0] : bounds[-1]])
        start, end, seg = split_blank(part, bounds)
        wh = word_hashes(part, start, end)
        if carry_row == rows[0]:
            wh, seg = np.concatenate([carry, wh]), np.concatenate([np.zeros(len(carry), np.int64), seg])
        count = np.bincount(seg, minlength=len(rows))
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        runs = np.maximum(count - n + 1, 0)
        head = gathered(first, runs)
        h = np.zeros(len(head), np.uint64)
        for k in range(n):
            h += wh[head + k] * _ODD[k]
        row = np.repeat(rows, runs)
        few = (count > 0) & (count < n)
        if goes_on:
            few[-1] = False
        if few.any():
            few = np.flatnonzero(few)
            g = count[few].astype(np.uint64) * _K3
            for k in range(n - 1):
                live = count[few] > k
                g[live] += wh[first[few[live]] + k] * _ODD[k]
            h, row = np.concatenate([h, g]), np.concatenate([row, rows[few]])
        carry, carry_row = (wh[max(len(wh) - n + 1, int(first[-1])) :], rows[-1]) if goes_on else (wh[:0], -1)
        yield row, mixed(h)
