"""Vector bin packing: examples into sequences under simultaneous limits on tokens, segments and loss-bearing tokens.

A sequence is filled by the dot-product heuristic (Panigrahy and others, 2011): of the examples in the pool that fit, the one whose
demands, weighted by the mean demand of each kind, have the largest dot product with what is left goes in next. What is scarce in the
sequence so draws examples that need little of it. Where no example fits and the gap has `least_cut` tokens or more, the longest example is cut
and its beginning fills the gap. A sequence that still ends short (the last of a task, or one that reached another limit) is cut into
sequences whose lengths are powers of two, which need no padding. So a full sequence has less than `least_cut` tokens of padding.

Each task packs the rows of its own partition: pieces of full length go out at once, the rests wait in a pool of at most POOL examples,
which is refilled from the rows as it empties. Nothing is shuffled or gathered, and a task that is run again packs the same.
A sequence's number has the partition in its high bits.

Null and empty texts are the end token alone. An example without tokens has no piece. A null doc_id stays null; `doc_row` tells repeated rows and
ids apart. Empty tables give empty results. Extra columns are ignored. Without `cut`, only examples that exceed a limit by themselves are cut,
and short sequences stay whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm import kernels
from viewloom.llm.tokens import Encoder

#: Examples that wait at most, and from how many on sequences are filled while there are more rows.
POOL, FILL_FROM = 2048, 1536
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, doc_row long, loss_tokens long, padding long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are at least 1")


class Example:
    """Ids, and how many of the first n bear loss (`upto`; None: all do)."""

    __slots__ = ("name", "row", "ids", "upto", "start")

    def __init__(self, name: int | None, row: int, ids: np.ndarray, mask: np.ndarray | None, start: int = 0):
        self.name, self.row, self.ids, self.start = name, row, ids, start
        self.upto = None if mask is None else np.concatenate(([0], np.cumsum(mask)))

    def loss(self, start: int, end: int) -> int:
        return end - start if self.upto is None else int(self.upto[end] - self.upto[start])

    def prefix(self, tokens: int, loss: int) -> int:
        """The length of the longest beginning of what is left with at most so many tokens and loss-bearing tokens."""
        most = min(tokens, len(self.ids) - self.start)
        if self.upto is None:
            return min(most, loss)
        return min(most, int(np.searchsorted(self.upto, self.upto[self.start] + loss, "right")) - 1 - self.start)


Piece = tuple[Example, int, int]  # start and end in the example's ids


class Packer:
    """The examples of one task: add() them, take sequences from filled()."""

    def __init__(self, limits: Limits, least_cut: int, cut: bool):
        self.limits, self.least_cut, self.cut = limits, least_cut, cut
        self.size = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.examples: list[Example | None] = [None] * POOL
        self.free = list(range(POOL - 1, -1, -1))
        self.need = np.full((POOL, 2), np.iinfo(np.int64).max)  # tokens and loss of what is left of each
        self.count, self.sums = 0, np.zeros(3)

    def __len__(self) -> int:
        return POOL - len(self.free)

    def _put(self, slot: int, example: Example) -> None:
        n = len(example.ids)
        self.examples[slot] = example
        self.need[slot] = n - example.start, example.loss(example.start, n)

    def add(self, example: Example) -> Iterator[list[Piece]]:
        """The sequences that the example fills alone; its rest waits."""
        whole = self.limits.tokens
        while len(example.ids) - example.start > whole and example.loss(example.start, example.start + whole) <= self.limits.loss:
            yield [(example, example.start, example.start + whole)]
            example.start += whole
        if example.start < len(example.ids):
            self._put(self.free.pop(), example)
            self.count += 1
            left = len(example.ids) - example.start
            self.sums += (left, 1, example.loss(example.start, len(example.ids)))

    def filled(self, down_to: int) -> Iterator[list[Piece]]:
        """Sequences from the pool until it has at most `down_to` examples."""
        while len(self) > down_to:
            yield from self._closed(self._sequence())

    def _sequence(self) -> list[Piece]:
        left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss])
        weights = self.sums / self.count / self.size / self.size  # mean demand, and the demand's share of the limit
        pieces: list[Piece] = []
        while left[0] and left[1] and len(self):
            fits = (self.need[:, 0] <= left[0]) & (self.need[:, 1] <= left[2])
            price = weights * left / self.size
            slot = int(np.where(fits, self.need[:, 0] * price[0] + self.need[:, 1] * price[2], -1.0).argmax())
            if fits[slot]:
                example = self.examples[slot]
                piece = example, example.start, len(example.ids)
                self.examples[slot], self.need[slot] = None, np.iinfo(np.int64).max
                self.free.append(slot)
            else:
                held = np.where(self.need[:, 0] < np.iinfo(np.int64).max, self.need[:, 0], -1)
                slot = int(held.argmax())
                example = self.examples[slot]
                n = example.prefix(int(left[0]), int(left[2]))
                too_large = held[slot] > self.limits.tokens or self.need[slot, 1] > self.limits.loss
                if n < 1 or not (self.cut and n >= self.least_cut or too_large and not pieces):
                    break
                piece = example, example.start, example.start + n
                example.start += n
                self._put(slot, example)
            pieces.append(piece)
            left -= (piece[2] - piece[1], 1, example.loss(piece[1], piece[2]))
        return pieces

    def _closed(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        size = sum(end - start for _, start, end in pieces)
        if not self.cut or self.limits.tokens - size < self.least_cut or size & (size - 1) == 0:
            yield pieces
            return
        held, room, left = [], 1 << (size.bit_length() - 1), size
        for example, start, end in pieces:
            while start < end:
                n = min(room, end - start)
                held.append((example, start, start + n))
                start, room, left = start + n, room - n, left - n
                if not room:
                    yield held
                    held, room = [], 1 << (left.bit_length() - 1) if left else 0


def _padding(size: int, tokens: int) -> int:
    return 0 if size & (size - 1) == 0 else tokens - size


def _packed(examples: Iterator[tuple[int | None, np.ndarray, np.ndarray | None]], limits: Limits, least_cut: int, cut: bool) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 33
    packer, rows, sequence = Packer(limits, least_cut, cut), [], first

    def written(sequences: Iterator[list[Piece]]) -> None:
        nonlocal sequence
        for pieces in sequences:
            offset, padding = 0, _padding(sum(end - start for _, start, end in pieces), limits.tokens)
            for e, start, end in pieces:
                crc = zlib.crc32(e.ids[start:end].astype("<u4").tobytes())
                rows.append((e.name, start, end - start, crc, len(e.ids), sequence, offset, e.row, e.loss(start, end), padding))
                offset += end - start
            sequence += 1

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)
        rows.clear()
        return done

    for number, (name, ids, mask) in enumerate(examples):
        written(packer.add(Example(name, first + number, ids, mask)))
        if len(packer) >= POOL - 1:
            written(packer.filled(FILL_FROM))
        if len(rows) >= 10_000:
            yield batch()
    written(packer.filled(0))
    if rows:
        yield batch()


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, least_cut: int = 16, cut: bool = True) -> DataFrame:
    """One row per piece of a document's ids (and `end_id`): PIECES. All ids bear loss. `tokenizer` is the path of a vocabulary file."""
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(source.value)

        def examples() -> Iterator[tuple[int | None, np.ndarray, None]]:
            for part in kernels.parts(batches, 1):
                names, texts = part.column(0).to_pylist(), part.column(1)
                for k, name in enumerate(names):
                    yield name, np.append(encoder.ids([texts[k].as_py()])[0], np.uint32(end_id)), None

        yield from _packed(examples(), limits, least_cut, cut)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), name: str = "doc_id", ids: str = "ids", loss: str | None = None, least_cut: int = 16, cut: bool = True) -> DataFrame:
    """One row per piece of each example: PIECES. `ids` is a column of token ids, `loss` one of booleans beside them (None: all bear loss).

    Null lists are empty. A null inside `loss`, and what it has too few of, bears no loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int | None, np.ndarray, np.ndarray | None]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own = np.array(batch.column(1)[k].as_py() or [], np.uint32)
                    mask = None
                    if loss:
                        mask = np.zeros(len(own), np.int64)
                        given = [bool(x) for x in (batch.column(2)[k].as_py() or [])[: len(own)]]
                        mask[: len(given)] = given
                    yield batch.column(0)[k].as_py(), own, mask

        yield from _packed(rows(), limits, least_cut, cut)

    given = [F.col(name).cast("long"), F.col(ids).cast("array<long>")] + ([F.col(loss).cast("array<boolean>")] if loss else [])
    return examples.select(*given).mapInArrow(run, PIECES)
