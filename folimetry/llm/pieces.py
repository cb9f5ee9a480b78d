"""Texts as distinct chunks: what tokenisers and word statistics do once per distinct chunk is gathered back to rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


_C = ctypes.CDLL(None)


def give_back() -> None:
    """Return unused memory of this process to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` as a function for mapInArrow whose worker gives memory back at the end of each task: workers live on, and what
    they keep adds up with the next operator's."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def whole_texts(column: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the texts of a large_string array in their data, and the data."""
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return borders, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


class Ragged:
    """Arrays of ids end to end."""

    def __init__(self, rows: list[bytes], kind: type) -> None:
        self.flat = np.frombuffer(b"".join(rows), kind)
        self.size = np.fromiter(map(len, rows), np.int64, len(rows)) // np.dtype(kind).itemsize
        self.start = np.cumsum(self.size) - self.size

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows asked for, end to end."""
        size = self.size[rows]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((self.start[rows] - (ends - size)).astype(np.int32 if max(total, len(self.flat)) < 2**31 else np.int64), size)
        at += np.arange(total, dtype=at.dtype)
        return self.flat[at]


class Memo:
    """Ids of chunks seen before, up to a number of chunks: only speed depends on what is in it."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int) -> None:
        self.encode, self.most, self.known = encode, most, {}

    def __call__(self, chunks: list[str]) -> list[bytes]:
        out = list(map(self.known.get, chunks))
        absent = [i for i, x in enumerate(out) if x is None]
        if absent:
            for i, ids in zip(absent, self.encode([chunks[i] for i in absent]), strict=True):
                out[i] = ids
            if len(self.known) < self.most:
                self.known.update((chunks[i], out[i]) for i in absent[: self.most - len(self.known)])
        return out


def row_slices(borders: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows [a, b) with at most so many occurrences together, or one row with more."""
    a, rows = 0, len(borders) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(borders, borders[a] + most, "right")) - 1)
        yield a, b
        a = b


def by_bytes(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, so that one batch of long documents stays small in memory."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    for a, b in row_slices(np.concatenate([[0], sizes]), most):
        yield batch.slice(a, b - a)
