"""Words of whole Arrow columns by byte classes, found in numpy without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z alone; bytes of other characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values lie in one of the ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


class Words(NamedTuple):
    words: pa.LargeBinaryArray
    #: The row of each word, and the number of breaks and rows before it: words are in the same piece if that is equal.
    rows: np.ndarray
    pieces: np.ndarray


def runs(texts: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows of about limit bytes, as binary with nulls empty. A longer row is a run of its own."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield start, texts.slice(start, end - start)
        start = end


def scan(texts: pa.Array, separators: np.ndarray, breaks: np.ndarray | None = None) -> Words:
    """The maximal runs of bytes of each text (large binary, no nulls) that are no separators, A-Z lower-cased. breaks are those separators that end a piece."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        none = np.zeros(0, np.int64)
        return Words(pa.array([], pa.large_binary()), none, none)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = ~separators[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    opens = ends[:-1][np.diff(ends) > 0]
    first[opens] = letter[opens]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(ends, starts, "right") - 1
    pieces = rows if breaks is None else rows + np.cumsum(breaks[raw], dtype=np.int32)[starts]
    before = np.cumsum(letter, dtype=np.int32)
    offsets = np.append(before[starts] - 1, before[-1]).astype(np.int64)
    data = LOWER[raw[letter]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return Words(words, rows, pieces)
