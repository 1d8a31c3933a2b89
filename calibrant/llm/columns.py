"""Vectorised word and shingle arrays over Arrow string columns, used inside tasks.

Words are runs of bytes other than 0x20 and 0x09-0x0D. All arrays are flat: ``Words.first`` holds,
for document ``i``, the number of its first word, so no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one; a loop over bytes would have one turn per byte.
_LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look independent."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


@dataclass
class Words:
    data: np.ndarray       # bytes of all texts
    start: np.ndarray      # first byte of each word
    end: np.ndarray        # byte after each word
    first: np.ndarray      # per document: number of its first word; one more at the end
    offsets: np.ndarray    # per document: its first byte; one more at the end

    @property
    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        length = self.end - self.start
        order = np.argsort(-np.minimum(length, _LONG + 1).astype(np.int8), kind="stable")
        sizes, starts = length[order], self.start[order]
        long = int(np.searchsorted(-sizes.clip(max=_LONG + 1), -_LONG, side="left"))
        h = sizes.astype(np.uint64) * _STEP
        alive = np.searchsorted(-sizes[long:], -np.arange(1, _LONG + 1), side="right")
        for j, n in enumerate(alive):
            if n == 0:
                break
            part = h[long:long + n]
            part ^= self.data[starts[long:long + n] + j]
            part *= _STEP
            part ^= part >> np.uint64(29)
        raw = self.data
        for i in range(long):
            h[i] = xxhash.xxh64_intdigest(raw[starts[i]:starts[i] + sizes[i]].tobytes())
        out = np.empty_like(h)
        out[order] = mix(h)
        return out


def split_words(column: pa.Array, lower: bool = True) -> Words:
    """The words of every text; NULL counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    base, stop = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[base:stop] if body else np.empty(0, np.uint8)
    offsets = offsets - base if len(offsets) else np.zeros(1, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_BLANK[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] |= inside[cut]           # a word never crosses from one text into the next
    ends[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets), offsets)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words and its document; a shorter text is one shingle."""
    h, first = words.hashes(), words.first
    count = np.diff(first)
    windows = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    document = np.repeat(np.arange(len(count)), windows)
    offset = np.arange(len(document)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = first[:-1][document] + offset
    last = first[1:][document]
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for j in range(width):
        term = np.where(at + j < last, padded[at + j], np.uint64(j + 1))
        out = (out ^ term) * _STEP
        out ^= out >> np.uint64(31)
    return mix(out), document


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20):
    """Cut a batch into runs of rows with at most ``most_bytes`` of text, one row at least."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size.astype(np.int64))
    begin, taken = 0, 0
    while begin < len(total):
        end = max(begin + 1, int(np.searchsorted(total, taken + most_bytes, side="right")))
        yield batch.slice(begin, end - begin)
        taken, begin = int(total[end - 1]), end
