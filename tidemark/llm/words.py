"""Texts as runs of words, a slice of a batch at a time: each distinct word of a slice is looked at once, the rest is arrays.

White space is what Python and Arrow agree on (Unicode's Zs, and the bidirectional classes WS, B and S). A null text has no
words. A slice holds about ``SLICE_BYTES`` of text, or one text that is longer, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 23

_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The one object that a Python worker keeps between its tasks; asking for another lets go of it.

    Workers outlive their stage, so what each stage caches would add up over an application.
    """
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


class Slice(NamedTuple):
    """Rows ``first`` on of a batch: the distinct words, which word stands where, and the first place of each row."""

    first: int
    texts: pa.Array
    words: list[str]
    codes: np.ndarray
    starts: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum of its words' values, added up in text order."""
        rows = np.repeat(np.arange(len(self.texts)), np.diff(self.starts))
        return np.bincount(rows, values[self.codes], len(self.texts))


def cuts(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many bytes; a longer text is a range of its own."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + size, "right")) - 1)
        yield a, b
        a = b


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    for a, b in cuts(texts, size):
        part = pc.fill_null(texts.slice(a, b - a), "")
        lists = pc.utf8_split_whitespace(part)
        found = lists.flatten().dictionary_encode()
        starts = lists.offsets.to_numpy()
        yield Slice(a, part, found.dictionary.to_pylist(), found.indices.to_numpy(), starts - starts[0])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which near ones come far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(x: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of all before its last step."""
    return mix64(x * np.uint64(0x9E3779B97F4A7C15) + step)
