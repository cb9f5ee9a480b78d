"""Sets of shingles side by side: parity bitmaps bound the overlap of two sets from above, sorted arrays settle it."""

from __future__ import annotations

import numpy as np

#: Bits of a bitmap: a power of two near the size of its set, between these.
LEAST_BITS, MOST_BITS = 512, 1 << 16


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Bit k is the parity of how many shingles end in k; wider bitmaps fold into narrower ones by exclusive or."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(len(shingles) - 1, 0).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


class Members:
    """Sets of one tile or block, smallest first. Without shingles, what the bitmaps allow counts as linked."""

    def __init__(self, percent: int, sizes: list[int], bitmaps: list[bytes], shingles: list[bytes] | None = None) -> None:
        self.percent = percent
        self.sizes = np.array(sizes, np.int64)
        self.maps = [np.frombuffer(b, np.uint64) for b in bitmaps]
        self.shingles = None if shingles is None else [np.frombuffer(s, np.uint64) for s in shingles]
        widths = np.array([len(m) for m in self.maps], np.int64)  # rise with the sizes
        starts = np.flatnonzero(np.append(True, widths[1:] != widths[:-1])) if len(widths) else widths
        self.groups = [(int(a), int(b), np.stack(self.maps[a:b])) for a, b in zip(starts, [*starts[1:], len(widths)], strict=True)]
        self.narrow: dict[tuple[int, int], np.ndarray] = {}

    def possible(self, size: int, bitmap: np.ndarray, first: int = 0) -> np.ndarray:
        """Members from `first` on whose bound allows a link: each bit that differs is a shingle that differs."""
        low = max(first, int(np.searchsorted(self.sizes, -(-self.percent * size // 100))))
        high = int(np.searchsorted(self.sizes, 100 * size // self.percent, "right"))
        out = [np.empty(0, np.int64)]
        for k, (a, b, maps) in enumerate(self.groups):
            a0, b0 = max(a, low), min(b, high)
            if a0 >= b0:
                continue
            words = min(maps.shape[1], len(bitmap))
            if words < maps.shape[1]:
                if (k, words) not in self.narrow:
                    self.narrow[k, words] = _folded(maps, words)
                maps = self.narrow[k, words]
            own = bitmap if words == len(bitmap) else _folded(bitmap[None], words)[0]
            apart = np.bitwise_count(maps[a0 - a : b0 - a] ^ own).sum(axis=1, dtype=np.int64)
            sizes = self.sizes[a0:b0]
            most = np.minimum((sizes + size - apart) // 2, np.minimum(sizes, size))
            out.append(np.flatnonzero(100 * most >= self.percent * (sizes + size - most)) + a0)
        return np.concatenate(out)

    def linked(self, k: int, shingles: np.ndarray) -> bool:
        both = np.concatenate([self.shingles[k], shingles])
        both.sort(kind="stable")
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * common >= self.percent * (len(both) - common)

    def links(self) -> list[tuple[int, int]]:
        """Pairs of members that link, leaving out those already joined by others."""
        n, out = len(self.sizes), []
        label = np.arange(n)
        for i in range(n):
            if len(out) == n - 1:
                break
            near = self.possible(int(self.sizes[i]), self.maps[i], i + 1)
            near = near[label[near] != label[i]]
            for j in near.tolist():
                if label[j] != label[i] and (self.shingles is None or self.linked(j, self.shingles[i])):
                    label[label == label[j]] = label[i]
                    out.append((i, j))
        return out
