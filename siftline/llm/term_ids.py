"""Words of a task as whole numbers, and counts of the combinations of several such columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken apart together.
SLICE = 1 << 20


class Ids(dict):
    """A number for each word, in the order in which they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def strings(self, **instead: bytes) -> pa.Array:
        """The words by number; ``mark`` replaces words that stand for something else."""
        mark = instead.get("mark")
        return pa.array([b"" if w == mark else w for w in self], pa.binary()).cast(pa.string())


def slices(data: bytes, ends: bytes, most: int = SLICE) -> Iterator[bytes]:
    """``data`` in parts of about ``most`` bytes, cut after one of the bytes ``ends``; a longer run without any stays whole."""
    start = 0
    while len(data) - start > most:
        cut = max(data.rfind(e, start, start + most) for e in map(bytes, zip(ends)))
        if cut < 0:
            cut = min((at for e in map(bytes, zip(ends)) if (at := data.find(e, start + most)) >= 0), default=-1)
        if cut < 0:
            break
        yield data[start : cut + 1]
        start = cut + 1
    yield data[start:]


def combined(columns: Sequence[np.ndarray], sizes: Sequence[int]) -> np.ndarray:
    """One number for each combination of the columns' values; ``sizes``: how many values each may have."""
    code, room = columns[0], max(1, sizes[0])
    for c, n in zip(columns[1:], sizes[1:]):
        n = max(1, n)
        if room * n >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            room = len(found)
        code, room = code * n + c, room * n
    return code


def counted(columns: Sequence[np.ndarray], sizes: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """(the columns of all distinct combinations, how often each appears)."""
    sizes = [max(1, n) for n in sizes]
    if math.prod(sizes) >= 1 << 62:
        _, first, n = np.unique(combined(columns, sizes), return_index=True, return_counts=True)
        return [c[first] for c in columns], n
    code = np.sort(combined(columns, sizes))  # plain sorting and division cost less than the places of first appearance
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    code, n, out = code[starts], np.diff(np.append(starts, len(code))), []
    for size in reversed(sizes):
        out.append(code % size)
        code //= size
    return out[::-1], n
