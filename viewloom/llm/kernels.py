"""Vectorised text kernels for Arrow batches: word hashes, word positions and mixing functions.

A word is a run of bytes outside \\x20 and \\x09-\\x0D; A-Z count as a-z. Its hash is the sum of a random 64-bit
value per byte times a power of an odd base, then mixed; equal words have equal hashes and different words
differ but for a chance of about 2**-64 a pair. Work memory is about 60 times `WINDOW`; longer documents are cut
between words, so nothing grows with the longest text but for a single word longer than the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
#: The hash that stands for the end of a text; no word has it but by chance.
END = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 2 * len(_powers)) - 1, BASE, np.uint64))))
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; `gap` says of each byte whether it lies between words."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = gap[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in bytes."""
    starts, ends = word_spans(data, gap)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    sizes = ends - starts
    inside = np.repeat(starts, sizes)
    flat = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = _VALUE[data[inside + flat]] * powers(int(sizes.max()))[flat]
    sums = np.add.reduceat(terms, np.cumsum(sizes) - sizes)
    return mix(sums + sizes.astype(np.uint64)), starts, ends


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


#: Rows and bytes of text of a piece of an Arrow batch that is worked on at once.
TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20


def parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, as Spark counts rows only and a batch of whole texts is large; `text` is the number of the column with texts."""
    for batch in batches:
        _, offsets = texts_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + TEXT_BYTES, "right")) - 1
            end = max(at + 1, min(at + TEXT_ROWS, end))
            yield batch.slice(at, end - at)
            at = end


def _cut(data: np.ndarray, start: int, end: int) -> int:
    """Where to end a window: at white space, if there is any beyond its size."""
    at = start + WINDOW
    while at < end:
        gaps = np.flatnonzero(_SPACE[data[at : min(end, at + 65536)]])
        if len(gaps):
            return at + int(gaps[0])
        at += 65536
    return end


def windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, first byte, last byte + 1): some whole short texts, or a part of one long text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > WINDOW:
            at, end = int(offsets[i]), int(offsets[i + 1])
            while at < end:
                stop = _cut(data, at, end)
                yield i, i + 1, at, stop
                at = stop
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + WINDOW, "right")) - 1)
            yield i, j, int(offsets[i]), int(offsets[j])
            i = j


def batch_words(column: pa.Array | pa.ChunkedArray, gap: np.ndarray = _SPACE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, word hashes) of the words of a column, in order, window by window. White space must be a `gap`, as windows end there."""
    data, offsets = texts_of(column)
    for first, last, start, stop in windows(data, offsets):
        part = data[start:stop]
        if last - first > 1 and len(part):
            # texts touch without white space between them: words that cross a border are cut there
            hashes, where = _split_words(part, offsets[first : last + 1] - start, gap)
            yield where + first, hashes
        else:
            hashes, _, _ = word_hashes(part, gap)
            yield np.full(len(hashes), first, np.int64), hashes


def _split_words(part: np.ndarray, borders: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    inner = borders[1:-1]
    padded = np.insert(part, inner, 32)
    hashes, starts, _ = word_hashes(padded, gap)
    return hashes, np.searchsorted(inner + np.arange(len(inner)), starts, "left")


def doc_words(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, word hashes) of every text with a word."""
    number, held = -1, []
    for where, hashes in batch_words(column):
        cuts = np.flatnonzero(where[1:] != where[:-1]) + 1
        for at, own in zip(where[np.concatenate(([0], cuts))] if len(where) else [], np.split(hashes, cuts), strict=False):
            if at != number:
                if held:
                    yield number, np.concatenate(held)
                number, held = int(at), []
            held.append(own)
    if held:
        yield number, np.concatenate(held)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; fewer words make one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * BASE + words[i : i + n]
    return mix(out + np.uint64(size))
