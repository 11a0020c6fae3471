"""Hashed sparse features of texts and the linear models trained on them, in NumPy inside Spark tasks.

Texts come in Arrow batches. A feature number is a hash below 2**18. `train_*` get a bounded sample as CSR arrays
(row starts, feature numbers, values) and return plain arrays; the number of steps is fixed, so equal input gives
equal models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from viewloom.llm import kernels

BITS = 18
N = 1 << BITS
_CLASS = np.zeros(256, np.uint64)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[128:] = 4
_CLASS[list(b".,;:?'\"()-")] = 5
_CLASS[list(b"!")] = 6
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 7
_EDGE = np.ones(256, bool)
_EDGE[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = False
_EDGE[128:] = False


def number(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _spans(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, bytes, starts, ends) of the words, window by window."""
    data, offsets = kernels.texts_of(column)
    for first, last, start, stop in kernels.windows(data, offsets):
        part = data[start:stop]
        inner = offsets[first + 1 : last] - start
        padded = np.insert(part, inner, 32) if len(inner) else part
        starts, ends = kernels.word_spans(padded)
        yield first + np.searchsorted(inner + np.arange(len(inner)), starts, "left"), padded, starts, ends


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs, as kernels.word_hashes has them; no run is empty."""
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    flat = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    terms = kernels._VALUE[data[np.repeat(starts, sizes) + flat]] * kernels.powers(int(sizes.max()))[flat]
    return kernels.mix(np.add.reduceat(terms, firsts) + sizes.astype(np.uint64))


def stem_features(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per window (text numbers, feature numbers, counts): words without edge punctuation and their starts of 4, 5 and 6 bytes."""
    for where, data, starts, ends in _spans(column):
        if not len(starts):
            continue
        starts, ends = starts.copy(), ends.copy()
        for _ in range(4):
            starts += _EDGE[data[np.minimum(starts, len(data) - 1)]] & (ends - starts > 1)
            ends -= _EDGE[data[ends - 1]] & (ends - starts > 1)
        found = [_hash(data, starts, ends)]
        for size in (4, 5, 6):
            found.append(kernels.mix(_hash(data, starts, np.minimum(ends, starts + size)) ^ np.uint64(size)))
        keys = (np.tile(where, 4) << BITS) | number(np.concatenate(found))
        keys.sort()
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        yield keys[heads] >> BITS, keys[heads] & (N - 1), np.diff(heads, append=len(keys))


def shape_features(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per window (text number, feature numbers (k, words)) of each word: itself, its shape, its shape after the last one's, and whether it repeats the last word."""
    for where, data, starts, ends in _spans(column):
        if not len(starts):
            continue
        words = _hash(data, starts, ends)
        size = np.minimum(np.int64(15), ends - starts).astype(np.uint64)
        code = [_CLASS[data[starts]], _CLASS[data[np.minimum(starts + 1, ends - 1)]], _CLASS[data[np.maximum(ends - 2, starts)]], _CLASS[data[ends - 1]]]
        shape = size
        for c in code:
            shape = shape * np.uint64(8) + c
        same = where[1:] == where[:-1]
        before = np.concatenate(([np.uint64(0)], np.where(same, shape[:-1] + np.uint64(1), np.uint64(0)))) if len(shape) > 1 else np.zeros(1, np.uint64)
        again = np.concatenate(([False], same & (words[1:] == words[:-1])))
        rows = [words, shape + (np.uint64(1) << np.uint64(40)), (before << np.uint64(20)) + shape + (np.uint64(1) << np.uint64(41)), again.astype(np.uint64) + (np.uint64(1) << np.uint64(42))]
        yield where, np.stack([number(words)] + [number(kernels.mix(r)) for r in rows[1:]])


def csr(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows]))).astype(np.int64)
    ids = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int32)
    values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)
    return starts, ids, values


def _adam(parameters: list[np.ndarray], gradient, steps: int, rate: float) -> None:
    """In place, full batches."""
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(parameters, gradient(), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: Entries that a step of training looks at together.
STEP = 1 << 19


class _Entries:
    """The entries of a sample that are not 0, by row and by the number of their feature among those that occur; the others keep the weight 0."""

    def __init__(self, starts, ids, values):
        kept = np.flatnonzero(values)
        self.numbers = np.flatnonzero(np.bincount(ids[kept], minlength=N))
        place = np.zeros(N, np.int32)
        place[self.numbers] = np.arange(len(self.numbers))
        self.count, self.width = len(starts) - 1, len(self.numbers)
        self.rows = np.repeat(np.arange(self.count, dtype=np.int32), np.diff(starts))[kept]
        self.local, self.values = place[ids[kept]], values[kept].astype(np.float32)

    def _slices(self) -> Iterator[slice]:
        return (slice(i, i + STEP) for i in range(0, len(self.values), STEP))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of each row."""
        return sum((np.bincount(self.rows[s], self.values[s] * weights[self.local[s]], self.count) for s in self._slices()), np.zeros(self.count))

    def along(self, errors: np.ndarray) -> np.ndarray:
        """The sum of the rows' errors over each feature."""
        return sum((np.bincount(self.local[s], self.values[s] * errors[self.rows[s]], self.width) for s in self._slices()), np.zeros(self.width))


def _whole(numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(N)
    out[numbers] = weights
    return out


def train_logistic(starts, ids, values, target, steps: int = 80, rate: float = 0.3, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for probabilities in `target` as soft labels."""
    entries = _Entries(starts, ids, values)
    weights, bias = np.zeros(entries.width), np.zeros(1)

    def gradient():
        error = (_sigmoid(entries.scores(weights) + bias[0]) - target) / max(1, len(target))
        return [entries.along(error) + penalty / 100 * weights, np.array([error.sum()])]

    _adam([weights, bias], gradient, steps, rate)
    return _whole(entries.numbers, weights), float(bias[0])


def train_ordinal(starts, ids, values, grade, n_grades: int, steps: int = 200, rate: float = 0.03, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link model: P(grade > k) = sigmoid(w.x - c_k) with one w for all k and c rising. Returns w and c."""
    entries = _Entries(starts, ids, values)
    weights = np.zeros(entries.width)
    gaps = np.concatenate(([2.0], np.zeros(max(0, n_grades - 2))))  # c_0, then logs of the steps up

    def cuts() -> np.ndarray:
        return gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))

    def gradient():
        c = cuts()
        p = np.vstack((np.ones(len(grade)), _sigmoid(entries.scores(weights)[None, :] - c[:, None]), np.zeros(len(grade))))  # P(grade >= k)
        k, i = grade.astype(int), np.arange(len(grade))
        above, below = p[k, i], p[k + 1, i]
        width = 1 - np.exp(-np.concatenate(([np.inf], np.diff(c), [np.inf])))[k]
        # d log(above - below): these forms stay exact where both are near 0 or near 1
        along_x = (above + below - 1) / max(1, len(k))
        upper, lower = (1 - above) / (1 - below) / width / max(1, len(k)), below / above / width / max(1, len(k))
        by_cut = np.array([upper[k == j + 1].sum() - lower[k == j].sum() for j in range(n_grades - 1)])
        by_gap = [by_cut.sum()] + [np.exp(gaps[j]) * by_cut[j:].sum() for j in range(1, len(gaps))]
        return [entries.along(along_x) + penalty * weights * 0.01, np.array(by_gap)]

    _adam([weights, gaps], gradient, steps, rate)
    return _whole(entries.numbers, weights), cuts()
