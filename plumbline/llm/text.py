"""Words of UTF-8 text as 64-bit hashes, found with numpy over whole batches of bytes.

A hash is a polynomial in a fixed odd base modulo 2^64, mixed; it depends on the word's bytes alone.
Two different words share one with a chance of about 2^-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_table(separators: str) -> np.ndarray:
    """0 for separators, else the byte with A-Z lower-cased, plus one. separators: 'space' for the six ASCII white
    spaces, 'symbol' for every ASCII byte that is no letter or digit."""
    out = np.zeros(256, np.uint8)
    for b in range(255):
        if separators == "space":
            apart = b == 0x20 or 0x09 <= b <= 0x0D
        else:
            apart = b < 0x80 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
        out[b] = 0 if apart else (b + 32 if 0x41 <= b <= 0x5A else b) + 1
    return out


SPACE, SYMBOL = byte_table("space"), byte_table("symbol")


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, by in enumerate((BASE, _INVERSE)):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the sequence that continues `left` by `right`; the order counts."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + (right ^ np.uint64(0xA5A5A5A55A5A5A5B)))


@dataclass
class Words:
    hash: np.ndarray  # one per word
    start: np.ndarray  # byte positions in the data handed in
    end: np.ndarray
    text: np.ndarray  # text k has the words text[k] to text[k + 1]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACE, piece: int = 1 << 18) -> Words:
    low = int(offsets[0])
    seen = table[data[low : int(offsets[-1])]]
    n = len(seen)
    is_word = seen > 0
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edge = offsets - low
    inner = edge[(edge > 0) & (edge < n)]
    first[inner] = is_word[inner]
    last[inner - 1] = is_word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + piece, "right")))
        size = int(end[j - 1]) - base
        up, down = _power(max(size, piece))
        part = seen[base : base + size].astype(np.uint64)
        part *= up[:size]
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return Words(mix(out), start + low, end + low, np.searchsorted(start, edge))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words of each text and their offsets by text. A text of fewer words has its
    whole sequence as one; a text without words has none."""
    n_texts = len(w.text) - 1
    whole = w.hash.copy()
    for step in range(1, k):
        whole = join(whole[: len(w.hash) - step], w.hash[step:]) if len(w.hash) > step else whole[:0]
    out, ptr = [], np.zeros(n_texts + 1, np.int64)
    for t in range(n_texts):
        a, b = int(w.text[t]), int(w.text[t + 1])
        if b - a >= k:
            own = np.unique(whole[a : b - k + 1])
        elif b > a:
            h = w.hash[a : a + 1]
            for i in range(a + 1, b):
                h = join(h, w.hash[i : i + 1])
            own = h ^ np.uint64(0x5851F42D4C957F2D)
        else:
            own = w.hash[:0]
        out.append(own)
        ptr[t + 1] = ptr[t] + len(own)
    return (np.concatenate(out) if out else w.hash[:0]), ptr
