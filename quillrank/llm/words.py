"""Words of whole texts as numpy arrays: hashes, byte ranges and windows, for many texts at once.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, which is the pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8. Everything is computed on
the Arrow buffer of a text column, in pieces of bounded size; no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text that are hashed in one go.
PIECE = 1 << 20
#: Bytes of text that one slice of a batch holds, if it has more than one row.
SLICE = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & _MASK))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up[:n], self.down[:n]


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_char_powers = _Powers(_BASE)


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has one row, or at most SLICE bytes of text."""
    for part in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        if not part.num_rows:
            continue
        size = np.nan_to_num(np.asarray(pa.compute.binary_length(part.column(column)).to_numpy(zero_copy_only=False), dtype=float))
        group = (np.cumsum(size) // SLICE).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [part.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield part.slice(a, b - a)


class Words:
    """Words of a text column. Null counts as empty.

    ``data`` the texts, each followed by a space; ``start``/``end`` byte ranges of the words;
    ``hash`` 64-bit hash of each; ``first`` index of the first word of each text, and the total.
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        n = len(column)
        column = column.fill_null("")
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if n and buffers[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        data = np.full(len(raw) + n, 32, np.uint8)
        keep = np.ones(len(data), bool)
        keep[offsets[1:] + np.arange(n)] = False
        data[keep] = _LOWER[raw] if lower else raw
        self.data, self.text_start = data, offsets + np.arange(n + 1)
        space = np.concatenate([[True], _SPACE[data]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)

    @cached_property
    def hash(self) -> np.ndarray:
        """Polynomial hash of each word from prefix sums, a piece of the data at a time."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            begin = self.start[at]
            to = max(int(np.searchsorted(self.end, begin + PIECE, "right")), at + 1)
            stop = self.end[to - 1]
            up, down = _char_powers.upto(stop - begin)
            total = np.zeros(stop - begin + 1, np.uint64)
            np.cumsum(_LETTERS[self.data[begin:stop]] * up, out=total[1:])
            a, b = self.start[at:to] - begin, self.end[at:to] - begin
            out[at:to] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
            at = to
        return mix(out)

    def windows(self, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
        """Hash of the k words from each word on; windows that leave their text are meaningless."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64)
        up, down = _window_powers.setdefault(base, _Powers(base)).upto(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up, out=total[1:])
        return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """Text number of each word, and its position there."""
        counts = np.diff(self.first)
        text = np.repeat(np.arange(len(counts)), counts)
        return text, np.arange(len(self.hash)) - self.first[:-1][text]


    def join(self, kept: np.ndarray) -> pa.Array:
        """Each text's words that are kept, joined by one space."""
        n = len(self.first) - 1
        word = np.flatnonzero(kept)
        text = np.searchsorted(self.first, word, "right") - 1
        last = np.concatenate([text[1:] != text[:-1], [True]]) if len(word) else np.zeros(0, bool)
        data = self.data.copy()
        data[self.end[word]] = 32
        step = np.zeros(len(data) + 2, np.int8)
        step[self.start[word]] += 1
        stop = self.end[word] + np.where(last, 0, 1)
        np.subtract.at(step, stop, 1)
        used = np.cumsum(step, dtype=np.int8)[: len(data)] > 0
        offsets = np.concatenate([[0], np.cumsum(used)])[self.text_start].astype(np.int32)
        return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data[used].tobytes()))


_window_powers: dict[int, _Powers] = {}
