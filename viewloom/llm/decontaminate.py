"""Benchmark decontamination by the q-gram lemma and banded alignment.

A document leaks an item when some stretch of it is at most k edits (insertions, deletions, substitutions of characters)
away from the whole item; k is `edit_rate` times the item's length, less for short items so that the lemma
still bites. ASCII letters count as lower case and white-space characters as spaces.

The lemma: an occurrence with k edits keeps at least m - q + 1 - k q of the item's m - q + 1 q-grams, on diagonals
(place in the document minus place in the item) that differ by k at most. So shared q-grams are counted in
cells of k + 1 diagonals, two neighbouring cells make one of the overlapping bands, and only bands with enough shared q-grams are
aligned. No occurrence is lost. Items shorter than q are looked up as they stand.

Of the stretches with the fewest edits the first to end counts, and of those with that end the shortest. Alignment fills the
diagonals of its band only, so it costs the item's length times a few k.

The benchmark is the stated query set: it is read in blocks of at most BLOCK_CHARS characters (one longer item is a block), each block
is broadcast and all documents are scanned against it, once per block. Documents are scanned in overlapping pieces, so memory does not grow with a text.
Null and empty texts and items leak nothing. Repeated rows give repeated rows. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm import kernels
from viewloom.llm.kernels import mix

Q = 8
BLOCK_CHARS = 1 << 20
PIECE = 1 << 19
#: Shared q-grams are paired with their items this many at a time.
PAIRS = 1 << 21
_BASE = 0x9E3779B97F4A7C15


def folded(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    return np.where((codes >= 9) & (codes <= 13), np.uint32(32), codes)


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of Q = 8 characters."""
    h = codes.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4):
        h = h[:-step] * np.uint64(pow(_BASE, step, 2**64)) + h[step:]
    return mix(h)


def budget(length: int, edit_rate: float) -> int:
    """The most edits for an item of that length such that an occurrence keeps a q-gram at least."""
    return max(0, min(int(edit_rate * length), (length - Q) // Q))


class Block:
    """The q-gram index of some items."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.codes = [folded(t) for _, t in items]
        sizes = np.array([len(c) for c in self.codes])
        self.k = np.array([budget(n, edit_rate) for n in sizes])
        self.cell = self.k + 1
        self.least = np.maximum(1, sizes - Q + 1 - self.k * Q)
        self.longest = int(sizes.max(initial=0))
        self.short = [i for i, n in enumerate(sizes) if n < Q]
        found = [(grams(c), i) for i, c in enumerate(self.codes) if len(c) >= Q]
        every = np.concatenate([g for g, _ in found]) if found else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(g), i) for g, i in found]) if found else np.zeros(0, int)
        place = np.concatenate([np.arange(len(g)) for g, _ in found]) if found else np.zeros(0, int)
        order = np.argsort(every, kind="stable")
        every, self.owner, self.place = every[order], owner[order], place[order]
        heads = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, int)
        self.grams, self.starts = every[heads], np.append(heads, len(every))
        self.bits = max(20, int(len(self.grams) * 16).bit_length())
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.grams >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray, owners: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int]]:
        """(piece, item, cell) of the bands with enough shared q-grams. `firsts`: where pieces start in `codes`; `owners`: their numbers."""
        if len(codes) < Q or not len(self.grams):
            return []
        h = grams(codes)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[where] == h[at]
        at, where = at[real], where[real]
        if not len(at):
            return []
        piece = np.searchsorted(firsts, at, "right") - 1
        sizes = self.starts[where + 1] - self.starts[where]
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a key has the piece, the item and the cell, each in as many bits as this block and these pieces need
        low = int((int(np.diff(firsts, append=len(codes)).max()) + self.longest) // int(self.cell.min()) + 2).bit_length()
        middle = len(self.codes).bit_length()
        if low + middle + int(owners.max()).bit_length() > 62:
            if len(firsts) == 1:
                raise OverflowError(f"a text of {len(codes)} characters is too long for {len(self.codes)} items of up to {self.longest}")
            half = len(firsts) // 2  # fewer pieces need fewer bits
            border, rest = int(firsts[half]), firsts[half:] - firsts[half]
            found = self.candidates(codes[:border], np.arange(half), firsts[:half])
            found += [(p + half, i, c) for p, i, c in self.candidates(codes[border:], np.arange(len(rest)), rest)]
            return [(int(owners[p]), i, c) for p, i, c in found]
        ends = np.cumsum(sizes)
        cut = 0
        while cut < len(at):
            stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS, "right")))
            n = sizes[cut:stop]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[where[cut:stop]], n)
            item = self.owner[inner]
            diagonal = np.repeat(at[cut:stop] - firsts[piece[cut:stop]], n) - self.place[inner] + self.longest
            key = (np.repeat(owners[piece[cut:stop]], n) << low + middle) | (item << low) | (diagonal // self.cell[item])
            key.sort()
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            keys = np.concatenate((keys, key[heads]))
            counts = np.concatenate((counts, np.diff(heads, append=len(key))))
            cut = stop
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[heads], np.add.reduceat(counts, heads)
        after = np.minimum(np.searchsorted(keys, keys + 1), len(keys) - 1)
        before = np.maximum(np.searchsorted(keys, keys - 1), 0)
        with_after = counts + np.where(keys[after] == keys + 1, counts[after], 0)
        lone_before = keys[before] != keys - 1  # the band that starts one cell lower holds this cell alone
        least = self.least[(keys >> low) & ((1 << middle) - 1)]
        # a band may begin one cell before the first: 1 is added, so that no field runs below 0
        found = np.unique(np.concatenate((keys[with_after >= least] + 1, keys[lone_before & (counts >= least)])))
        return [(int(k >> low + middle), int(k >> low & ((1 << middle) - 1)), int(k & ((1 << low) - 1)) - 1) for k in found]


def align(item: np.ndarray, text: np.ndarray, most: int, low: int, high: int, anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the stretch of `text` that is closest to `item`, the first end if several; (most + 1, -1) if all need more than `most`.

    Only the diagonals (place in the text minus place in the item) from `low` to `high` are filled. Anchored: the stretch begins
    where the text does.
    """
    n, width, far = len(text), high - low + 1, most + 1
    steps = np.arange(width)
    places = low + steps
    row = np.where((places >= 0) & (places <= n), np.maximum(places, 0) if anchored else 0, far)
    padded = np.concatenate((np.full(max(0, -low) + 1, 0xFFFFFFFF, np.uint32), text, np.full(max(0, high + len(item) - n) + 1, 0xFFFFFFFF, np.uint32)))
    shift = max(0, -low) + 1
    for i, code in enumerate(item, 1):
        # of the cell (i, i + d) on diagonal d: from (i - 1, i - 1 + d), from (i - 1, i + d) on d + 1, from (i, i + d - 1) on d - 1
        at = shift + i + low - 1
        if at < 0 or at + width > len(padded):
            return far, -1  # the band has left the text
        new = row + (padded[at : at + width] != code)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        edge = -i - low  # the diagonal on which the text has not begun
        if 0 <= edge < width:
            new[edge] = min(new[edge], i)
        if edge > 0:
            new[: min(edge, width)] = far
            new = np.minimum(new, np.minimum.accumulate(new - steps) + steps)
        if (over := n - i - low + 1) < width:
            new[max(0, over) :] = far
        row = np.minimum(new, far)
        if i >= -low and row.min() > most:  # before that, diagonals below 0 may still begin
            return far, -1
    best = int(row.argmin())
    return (int(row[best]), len(item) + low + best) if row[best] <= most else (far, -1)


def _plain(item: np.ndarray, text: np.ndarray) -> int:
    """The end of the first occurrence as it stands, or -1."""
    at = text.tobytes().find(item.tobytes())
    while at >= 0 and at % 4:
        at = text.tobytes().find(item.tobytes(), at + 1)
    return at // 4 + len(item) if at >= 0 else -1


def _scan(block: Block, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits): the closest stretch, the first if several are."""
    overlap = 4 * block.longest + 2 * Q
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    held: list[tuple[int, int, np.ndarray]] = []
    gap = np.full(Q, 0xFFFFFFF0, np.uint32)

    def flush() -> None:
        if not held:
            return
        joined = np.concatenate([x for _, _, c in held for x in (c, gap)])
        firsts = np.concatenate(([0], np.cumsum([len(c) + Q for _, _, c in held])))[:-1]
        found = block.candidates(joined, np.arange(len(held)), firsts)
        for p, i, cell in found:
            number, offset, codes = held[p]
            item, k = block.codes[i], int(block.k[i])
            low = cell * int(block.cell[i]) - block.longest
            start = max(0, low - k)
            part = codes[start : max(start, low + 2 * int(block.cell[i]) + len(item) + k)]
            end, edits = _plain(item, part), 0
            if end < 0:
                edits, end = align(item, part, k, low - k - start, low + 2 * int(block.cell[i]) + k - start) if k else (1, -1)
            if 0 <= end and edits <= k:
                if edits:
                    back = align(item[::-1], part[:end][::-1], k, -k, k, anchored=True)
                    first = end - back[1]
                else:
                    first = end - len(item)
                new = edits, offset + start + first, offset + start + end
                best[number, i] = min(best.get((number, i), new), new)
        held.clear()

    size = 0
    for number, text in enumerate(texts):
        if not text:
            continue
        codes = folded(text)
        for i in block.short:
            if len(block.codes[i]) and (end := _plain(block.codes[i], codes)) >= 0:
                best[number, i] = 0, end - len(block.codes[i]), end
        for offset in range(0, max(1, len(codes) - overlap), PIECE):
            piece = codes[offset : offset + PIECE + overlap]
            held.append((number, offset, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
                size = 0
    flush()
    for (number, i), (edits, start, end) in sorted(best.items()):
        yield number, i, start, end, edits


def _blocks(benchmark: DataFrame, id_col: str) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), "text").where("length(text) > 0").toLocalIterator():
        if held and size + len(row[1]) > BLOCK_CHARS:  # a very long item stands alone
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


LEAKS = "doc_id long, item_id long, start long, end long, edits int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.1, item_id: str = "item_id") -> DataFrame:
    """One row per document and item it leaks: doc_id, item_id, start and end (in characters) of the closest stretch, edits."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(held.value, edit_rate)
            for part in kernels.parts(batches, 1):
                ids, found = part.column(0).to_pylist(), list(_scan(block, part.column(1).to_pylist()))
                if found:
                    n, i, start, end, edits = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[k] for k in n], pa.int64()),
                            pa.array(block.ids[list(i)], pa.int64()),
                            pa.array(start, pa.int64()),
                            pa.array(end, pa.int64()),
                            pa.array(edits, pa.int32()),
                        ],
                        names=["doc_id", "item_id", "start", "end", "edits"],
                    )

        return rows.mapInArrow(run, LEAKS)

    parts = [scan(items) for items in _blocks(benchmark, item_id)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], LEAKS)
