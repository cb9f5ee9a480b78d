"""Words of many texts as 64-bit hashes, by numpy over their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from folimetry.llm.pieces import text_bytes

#: Odd, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n at least; kept for the next call."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_spans(texts: pa.Array, inside: np.ndarray = ~BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and end of each word in them, words before each row and in all). Words are runs of the bytes marked in
    `inside`: by default all but ASCII white space."""
    borders, data = text_bytes(texts)
    part = data[borders[0] : borders[-1]]
    word = inside[part]
    rows = borders - borders[0]
    opens = np.zeros(len(part) + 1, bool)
    opens[rows] = True
    start, end = word.copy(), word
    start[1:] &= ~word[:-1] | opens[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | opens[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return part, starts, ends, np.searchsorted(starts, rows)


#: Bytes whose running sums are held at once.
HASH_BYTES = 1 << 18


def word_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span of bytes, A-Z lower-cased if asked. Spans rise and don't overlap."""
    return span_hashes(part, starts, ends, (), lower)[0]


def span_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, beginnings: tuple[int, ...], lower: bool = True) -> list[np.ndarray]:
    """Hashes of the spans, then those of their first bytes, so many as each of `beginnings` says (spans that are no longer
    give their own hash)."""
    out = [np.empty(len(starts), np.uint64) for _ in range(len(beginnings) + 1)]
    a = 0
    while a < len(starts):
        first = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, first + HASH_BYTES, "right")))
        here = part[first : int(ends[b - 1])]
        up, down = _powers(len(here) + 1)
        total = np.zeros(len(here) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[here] if lower else here] * up[: len(here)], out=total[1:])
        x, y = starts[a:b] - first, ends[a:b] - first
        scale, before = down[x], total[x]
        for k, n in enumerate((None, *beginnings)):
            z = y if n is None else np.minimum(x + n, y)
            out[k][a:b] = mix((total[z] - before) * scale + (z - x).astype(np.uint64))
        a = b
    return out
