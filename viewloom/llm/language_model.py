"""Interpolated modified Kneser-Ney model of two or three words: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Tokens are words (runs outside \\x20 and \\x09-\\x0D, A-Z as a-z) and one end per text. With c the count of the pair (h, w),

    p(w | h) = (max(c - D(c), 0) + (D1 n1(h) + D2 n2(h) + D3 n3(h)) p(w)) / c(h)
    p(w)     = (max(k(w) - D'(k), 0) + rest) / K, with rest = (D'1 n'1 + D'2 n'2 + D'3 n'3) / (V + 1)

where k(w) counts the different words before w, K is their sum, n1, n2, n3 count followers seen once, twice or more often, and the
discounts follow from the counts of counts (Chen and Goodman, 1999). With order 3 the same stands once more on top: c is the count of
three words, the context has two, and the pair (h, w) below has as c the number of different words before it (a pair that begins a
text has its own count). Unknown words share the (V + 1)-th part of the rest, so
the probabilities of all words and one unknown word sum to 1. An unknown history leaves p(w).

Every task counts the pairs of a bounded chunk of its texts; chunks meet by shard of the history's hash, histories that
are very frequent by shard of the pair. A shard is merged in one task and written to the shared folder: sorted 64-bit keys
and their counts. No count is pruned. Word statistics are merged by shard of the word in the same way. Scoring maps those files and
looks up the distinct words and pairs of a chunk. Shards hold about as much however large the corpus is, up to MOST_HOT / 4 of them.

Null and empty texts are one end. A null doc_id is learnt from. Repeated rows count and are scored each. Without any text to learn from,
scores are those of the base. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm import kernels, store
from viewloom.llm.common import arrow_rows, cut, pieces, scratch_folder

START = np.uint64(0x243F6A8885A308D3)
CHUNK = 1 << 21
SHARD_BYTES = 8 << 20
#: At most so many histories are split (the list is broadcast): beyond a quarter as many shards a shard may hold a history of
#: up to tokens / MOST_HOT, so that shards grow, slowly, with the corpus.
MOST_HOT = 1 << 20


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, so shards of sorted hashes are sorted."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pair(histories: np.ndarray, words: np.ndarray) -> np.ndarray:
    return kernels.mix(histories * kernels.BASE + words)


def _streams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, words before the histories, histories, tokens) of a column, window by window. Both histories of a first token are START."""
    data, offsets = kernels.texts_of(column)
    before = older = START
    for first, last, start, stop in kernels.windows(data, offsets):
        part = data[start:stop]
        if last - first == 1 and (start != offsets[first] or stop != offsets[last]):
            words, _, _ = kernels.word_hashes(part)
            if start == offsets[first]:
                before = older = START
            tokens = np.append(words, kernels.END) if stop == offsets[last] else words
            if len(tokens):
                histories = np.concatenate(([before], tokens[:-1]))
                yield np.full(len(tokens), first), _older(histories, older), histories, tokens
                before, older = tokens[-1], histories[-1]
            continue
        words, where = kernels._split_words(part, offsets[first : last + 1] - start) if len(part) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        sizes = np.bincount(where, minlength=last - first) + 1
        ends = np.cumsum(sizes) - 1
        tokens = np.empty(int(sizes.sum()), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends] = True
        tokens[is_end], tokens[~is_end] = kernels.END, words
        histories = np.concatenate(([START], tokens[:-1]))
        histories[np.flatnonzero(is_end[:-1]) + 1] = START
        yield np.repeat(np.arange(first, last), sizes), _older(histories, START), histories, tokens


def _older(histories: np.ndarray, first: np.uint64) -> np.ndarray:
    return np.where(histories == START, START, np.concatenate(([first], histories[:-1])))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words before the histories, histories, tokens) of many texts together."""
    held, size = [], 0
    for batch in batches:
        for _, *part in _streams(batch.column(batch.num_columns - 1)):
            held.append(part)
            size += len(part[-1])
            if size >= CHUNK:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], *(np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values)


def _array(blobs: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, dtype) for b in blobs.to_pylist()] or [np.zeros(0, dtype)])


def _blob_rows(shards: np.ndarray, arrays: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row per shard with its stretch of the arrays; `shards` is sorted."""
    heads = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1])))
    ends = np.append(heads[1:], len(shards))
    columns = [pa.array([a[i:j].tobytes() for i, j in zip(heads, ends, strict=True)], pa.binary()) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array(shards[heads].astype(np.int32)), *columns], names=["shard", *names])


def count_words(docs: DataFrame, shards: int) -> DataFrame:
    """shard, words, counts: the tokens of `docs` (text) and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, tokens in _chunks(batches):
            words, counts = _merged(tokens, np.ones(len(tokens), np.int64))
            yield _blob_rows(_shard(words, shards), [words, counts.astype(np.uint32)], ["words", "counts"])

    def merge(rows: pa.Table) -> pa.Table:
        words, counts = _merged(_array(rows["words"], np.uint64), _array(rows["counts"], np.uint32).astype(np.int64))
        return pa.table({"shard": rows["shard"][:1], "words": [words.tobytes()], "counts": [counts.tobytes()]})

    parts = docs.select("text").mapInArrow(count, "shard int, words binary, counts binary")
    return cut(parts.groupBy("shard").applyInArrow(merge, "shard int, words binary, counts binary"))


def _frequent(vocabulary: DataFrame, above: float) -> np.ndarray:
    """The words with more occurrences than `above`, sorted; the caller bounds how many there can be."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(words, np.uint64)[np.frombuffer(counts, np.int64) > above]
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()] if len(found) else [], pa.binary())], names=["words"])

    rows = vocabulary.select("words", "counts").mapInArrow(pick, "words binary").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.words, np.uint64) for r in rows)]))


def _is_hot(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words if len(hot) else np.zeros(len(words), bool)


def _pair_shard(first: np.ndarray, then: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return np.where(_is_hot(first, hot), _shard(_pair(first, then), shards), _shard(first, shards))


def _gram_shard(older: np.ndarray, first: np.ndarray, then: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the context; a context can only be very frequent if both its words are, and then its grams are dealt by themselves."""
    context = _pair(older, first)
    return np.where(_is_hot(older, hot) & _is_hot(first, hot), _shard(_pair(context, then), shards), _shard(context, shards))


def _runs(shard: np.ndarray, first: np.ndarray, then: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """shard, histories, runs, words, counts: grams sorted by shard, their histories once each."""
    heads = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (shard[1:] != shard[:-1]))))
    runs = _blob_rows(shard[heads], [first[heads], np.diff(heads, append=len(first)).astype(np.uint32)], ["histories", "runs"])
    rest = _blob_rows(shard, [then, counts], ["words", "counts"])
    return pa.RecordBatch.from_arrays([*runs.columns, *rest.columns[1:]], names=["shard", "histories", "runs", "words", "counts"])


def _count_file(folder: str, name: str, keys: np.ndarray, counts: np.ndarray) -> None:
    large = np.flatnonzero(counts >= 255)
    store.put(folder, name, [keys, np.minimum(counts, 255).astype(np.uint8), large, counts[large]])


def _ties(counts: np.ndarray, rows: int) -> dict[str, pa.Array]:
    return {f"c{k}": pa.array([int((counts == k).sum())] + [0] * (rows - 1), pa.int64()) for k in (1, 2, 3, 4)}


def _count_grams(docs: DataFrame, shards: int, hot: np.ndarray, folder: str) -> DataFrame:
    """Writes the files of three words; returns, by kind, the statistics of their contexts (0) and what they add to the pairs (1), and the counts c1 to c4.

    A pair has as its count the number of different words before it; a pair that begins a text has its own count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for older, first, then in _chunks(batches):
            _, at, counts = np.unique(_pair(_pair(older, first), then), return_index=True, return_counts=True)
            shard = _gram_shard(older[at], first[at], then[at], hot, shards)
            order = np.argsort(shard, kind="stable")
            at = at[order]
            yield _blob_rows(shard[order], [older[at], first[at], then[at], counts[order].astype(np.uint32)], ["older", "histories", "words", "counts"])

    def merge(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        older, first, then = (_array(rows[c], np.uint64) for c in ("older", "histories", "words"))
        counts, context = _array(rows["counts"], np.uint32).astype(np.int64), _pair(older, first)
        keys, at = np.unique(_pair(context, then), return_index=True)
        counts = _merged(_pair(context, then), counts)[1]
        _count_file(folder, f"grams-{shard}", keys, counts)
        context, first, then = context[at], first[at], then[at]
        stats = _merged(context, counts, *(x.astype(np.int64) for x in (counts == 1, counts == 2, counts >= 3)))
        own = _blob_rows(_shard(stats[0], shards), list(stats), list("abcde"))
        pair = _pair(first, then)
        _, one = np.unique(pair, return_index=True)
        adds = _merged(pair, np.where(first == START, counts, 1))[1]
        to = _pair_shard(first[one], then[one], hot, shards)
        order = np.lexsort((first[one], to))
        one = one[order]
        down = _runs(to[order], first[one], then[one], adds[order])
        n = own.num_rows + down.num_rows
        columns = {"kind": pa.array([0] * own.num_rows + [1] * down.num_rows, pa.int32())}
        columns |= {c: pa.concat_arrays([own.column(i), down.column(i)]) for i, c in enumerate(["shard", *"abcd"])}
        columns |= {"e": pa.concat_arrays([own.column(5), pa.nulls(down.num_rows, pa.binary())]), "wrote": pa.array([shard] + [None] * (n - 1), pa.int32())}
        return pa.table(columns | _ties(counts, n))

    parts = docs.select("text").mapInArrow(count, "shard int, older binary, histories binary, words binary, counts binary")
    schema = "kind int, shard int, a binary, b binary, c binary, d binary, e binary, wrote int, c1 long, c2 long, c3 long, c4 long"
    return cut(parts.groupBy("shard").applyInArrow(merge, schema))


def _merge_contexts(grams: DataFrame, folder: str) -> DataFrame:
    """Writes the files of contexts of two words; returns the shards written."""

    def merge(rows: pa.Table) -> pa.Table:
        stats = _merged(_array(rows["a"], np.uint64), *(_array(rows[c], np.int64) for c in "bcde"))
        store.put(folder, f"contexts-{rows['shard'][0].as_py()}", [stats[0], *(x.astype(np.uint32) if x.max(initial=0) < 2**32 else x for x in stats[1:])])
        return pa.table({"wrote": rows["shard"][:1]})

    return cut(grams.where("kind = 0").select("shard", *"abcde").groupBy("shard").applyInArrow(merge, "wrote int"))


STATS = ["seen", "total", "n1", "n2", "n3", "before"]


def _packed(longs: bytes) -> bytes:
    """64-bit counts, compressed; in 32 bits where all of them fit."""
    counts = np.frombuffer(longs, np.int64)
    return zlib.compress(b"\4" + counts.astype(np.uint32).tobytes() if counts.max(initial=0) < 2**32 else b"\10" + longs, 1)


def _unpacked(blob: bytes) -> np.ndarray:
    plain = zlib.decompress(blob)
    return np.frombuffer(plain, np.uint32 if plain[0] == 4 else np.int64, offset=1).astype(np.int64)


def _pair_parts(docs: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """shard, histories, runs, words, counts of the pairs of chunks of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, histories, tokens in _chunks(batches):
            # the first history of a chunk may be a token of the chunk before
            words, ids = np.unique(np.append(tokens, histories[:1]), return_inverse=True)
            last = np.roll(ids, 1) + 1
            last, ids = last[:-1], ids[:-1]
            last[histories == START] = 0
            pairs, counts = _merged((last.astype(np.int64) << 32) | ids, np.ones(len(ids), np.int64))
            first = np.concatenate(([START], words))[pairs >> 32]
            then = words[pairs & 0xFFFFFFFF]
            shard = _pair_shard(first, then, hot, shards)
            order = np.argsort(shard, kind="stable")
            yield _runs(shard[order], first[order], then[order], counts[order].astype(np.uint32))

    return docs.select("text").mapInArrow(count, "shard int, histories binary, runs binary, words binary, counts binary")


def _count_pairs(parts: DataFrame, shards: int, folder: str, kind=np.uint32) -> DataFrame:
    """Writes the pair files; returns shard, words, stats (word statistics by shard of the word), the shards written and the counts of pair counts c1 to c4."""

    def merge(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        first = np.repeat(_array(rows["histories"], np.uint64), _array(rows["runs"], np.uint32))
        then, counts = _array(rows["words"], np.uint64), _array(rows["counts"], kind).astype(np.int64)
        keys = _pair(first, then)
        order = np.argsort(keys, kind="stable")
        keys, first, then, counts = keys[order], first[order], then[order], counts[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, first, then, counts = keys[heads], first[heads], then[heads], np.add.reduceat(counts, heads)
        _count_file(folder, f"pairs-{shard}", keys, counts)
        one = np.ones(len(first), np.int64)
        word, *stats = _merged(
            np.concatenate((first, then)),
            np.concatenate((counts, 0 * one)),
            *(np.concatenate((x.astype(np.int64), 0 * one)) for x in (counts == 1, counts == 2, counts >= 3)),
            np.concatenate((0 * one, one)),
        )
        out = _blob_rows(_shard(word, shards), [word, *stats], ["words", *STATS[1:]])
        # mostly small numbers: packed, since the checkpoint does not compress
        packed = [pa.array([_packed(b) for b in out.column(n).to_pylist()], pa.binary()) for n in STATS[1:]]
        out = pa.RecordBatch.from_arrays([*out.columns[:2], *packed], names=out.schema.names)
        ties = {"wrote": pa.array([shard] + [None] * (out.num_rows - 1), pa.int32())}
        ties |= _ties(counts, out.num_rows)
        return pa.table({n: out.column(i) for i, n in enumerate(out.schema.names)} | ties)

    stats = ", ".join(f"{n} binary" for n in STATS[1:])
    return cut(parts.groupBy("shard").applyInArrow(merge, f"shard int, words binary, {stats}, wrote int, c1 long, c2 long, c3 long, c4 long"))


def _merge_words(partial: DataFrame, vocabulary: DataFrame, folder: str) -> DataFrame:
    """Writes the word files; returns, with the shards written, the counts k1 to k4 of words with so many words before them, and their sum."""

    def merge(rows: pa.Table) -> pa.Table:
        words = _array(rows["words"], np.uint64)
        sizes = [len(b) // 8 for b in rows["words"].to_pylist()]

        def column(name: str) -> np.ndarray:
            """A row that does not have it counts as zeros."""
            blobs = zip(rows[name].to_pylist(), sizes, strict=True)
            return np.concatenate([np.zeros(n, np.int64) if b is None else np.frombuffer(b, np.int64) if name == "seen" else _unpacked(b) for b, n in blobs])

        words, *stats = _merged(words, column("seen"), *map(column, STATS[1:]))
        store.put(folder, f"words-{rows['shard'][0].as_py()}", [words, *(x.astype(np.uint32) if x.max(initial=0) < 2**32 else x for x in stats)])
        before = stats[-1]
        return pa.table({"wrote": rows["shard"][:1], "k1": [int((before == 1).sum())], **{f"k{k}": [int((before == k).sum())] for k in (2, 3, 4)}, "more": [int((before >= 3).sum())], "total": [int(before.sum())]})

    nothing = F.lit(None).cast("binary")
    names = ["shard", "words", *STATS]
    known = vocabulary.select("shard", "words", F.col("counts").alias("seen"), *(nothing.alias(n) for n in STATS[1:]))
    parts = partial.select("shard", "words", nothing.alias("seen"), *STATS[1:])
    return cut(parts.select(names).union(known.select(names)).groupBy("shard").applyInArrow(merge, "wrote int, k1 long, k2 long, k3 long, k4 long, more long, total long"))


def discounts(n: list[int]) -> np.ndarray:
    """D(0) to D(3 or more) from the counts of the counts 1 to 4; the usual formula, kept above 0 and up to the count."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0, *(min(max(x, 0.01), k) for k, x in enumerate(d, 1))])


class Model:
    """What scoring needs besides the files: a few numbers."""

    def __init__(self, folder: str, shards: int, hot: np.ndarray, tokens: int, types: int, pair_ties: list[int], words: list[int], gram_ties: list[int] | None):
        """`words`: how many have 1, 2, 3, 4 and 3 or more different words before them, and the sum of those; `gram_ties`: None for order 2."""
        self.folder, self.shards, self.hot, self.tokens, self.types, self.total = folder, shards, hot, tokens, types, words[5]
        self.pair_cut, self.word_cut = discounts(pair_ties), discounts(words[:4])
        self.gram_cut = None if gram_ties is None else discounts(gram_ties)
        lost = self.word_cut[1] * words[0] + self.word_cut[2] * words[1] + self.word_cut[3] * words[4]
        self.rest = lost / (types + 1)

    def _found(self, kind: str, keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(where in keys, where in the file, the file's arrays) of the keys that are there, shard by shard."""
        order = np.lexsort((keys, shard))
        heads = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0))) if len(keys) else []
        for i, j in zip(heads, np.append(heads[1:], len(keys)) if len(keys) else [], strict=True):
            own = order[i:j]
            arrays = store.view(self.folder, f"{kind}-{shard[own[0]]}")  # every shard has a file: a missing one is an error
            if not len(arrays[0]):
                continue
            at = np.minimum(np.searchsorted(arrays[0], keys[own]), len(arrays[0]) - 1)
            real = arrays[0][at] == keys[own]
            yield own[real], at[real], arrays

    def _stats(self, kind: str, keys: np.ndarray, size: int) -> np.ndarray:
        """(size, keys): the statistics of distinct keys that are kept by shard of the key."""
        out = np.zeros((size, len(keys)))
        for own, at, arrays in self._found(kind, keys, _shard(keys, self.shards)):
            for k, a in enumerate(arrays[1:]):
                out[k, own] = a[at]
        return out

    def _counts(self, kind: str, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        for own, at, (_, counts, large, exact) in self._found(kind, keys, shard):
            found = counts[at].astype(np.float64)
            over = found == 255
            if over.any():
                found[over] = exact[np.searchsorted(large, at[over])]
            out[own] = found
        return out

    def log10(self, older: np.ndarray, histories: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of each token after its history, and how often the token was seen."""
        words, ids = np.unique(np.concatenate((histories, tokens)), return_inverse=True)
        seen, total, n1, n2, n3, before = self._stats("words", words, len(STATS))
        h, w = ids[: len(tokens)], ids[len(tokens) :]
        pairs, back = np.unique(h * len(words) + w, return_inverse=True)
        ph, pw = pairs // len(words), pairs % len(words)
        counts = self._counts("pairs", _pair(words[ph], words[pw]), _pair_shard(words[ph], words[pw], self.hot, self.shards))
        cut_of = lambda table, n: table[np.minimum(n, 3).astype(int)]
        alone = (before - cut_of(self.word_cut, before) + self.rest) / self.total if self.total else np.full(len(words), 1 / (self.types + 1))
        spared = self.pair_cut[1] * n1 + self.pair_cut[2] * n2 + self.pair_cut[3] * n3
        known = total[ph] > 0
        p = np.where(known, (counts - cut_of(self.pair_cut, counts) + spared[ph] * alone[pw]) / np.where(known, total[ph], 1), alone[pw])[back]
        if self.gram_cut is not None:
            contexts, of = np.unique(_pair(older, histories), return_inverse=True)
            total, n1, n2, n3 = self._stats("contexts", contexts, 4)
            spared = self.gram_cut[1] * n1 + self.gram_cut[2] * n2 + self.gram_cut[3] * n3
            grams, at, back = np.unique(_pair(contexts[of], tokens), return_index=True, return_inverse=True)
            counts = self._counts("grams", grams, _gram_shard(older[at], histories[at], tokens[at], self.hot, self.shards))[back]
            known = total[of] > 0
            p = np.where(known, (counts - cut_of(self.gram_cut, counts) + spared[of] * p) / np.where(known, total[of], 1), p)
        return np.log10(p), seen[w]


def _fill(written: DataFrame, shards: int, folder: str, kind: str, arrays: list[np.ndarray]) -> None:
    """Empty files for the shards that nothing fell in."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                store.put(folder, f"{kind}-{shard}", arrays)
            yield batch

    missing = written.sparkSession.range(shards).join(written.where("wrote is not null").select(F.col("wrote").cast("long").alias("id")), "id", "left_anti")
    missing.mapInArrow(put, "id long").write.format("noop").mode("overwrite").save()


def train(docs: DataFrame, order: int = 3) -> Model:
    """A model of the texts in `docs`, of two or three words."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    shards = pieces(docs, SHARD_BYTES)
    folder = scratch_folder(docs.sparkSession, "language-model")
    vocabulary = count_words(docs, shards)
    types = vocabulary.agg(F.sum((F.octet_length("words") / 8).cast("long"))).first()[0] or 0
    tokens = _total(vocabulary)
    hot = _frequent(vocabulary, tokens / min(4 * shards, MOST_HOT))
    sums = lambda rows, names: [x or 0 for x in rows.agg(*map(F.sum, names)).first()]
    fours = ["c1", "c2", "c3", "c4"]
    none, small, long = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    no_counts = [none, np.zeros(0, np.uint8), long, long]
    gram_ties = None
    if order == 3:
        grams = _count_grams(docs, shards, hot, folder)
        gram_ties = sums(grams, fours)
        _fill(grams, shards, folder, "grams", no_counts)
        _fill(_merge_contexts(grams, folder), shards, folder, "contexts", [none, *[small] * 4])
        below = grams.where("kind = 1").select("shard", *(F.col(c).alias(n) for c, n in zip("abcd", ("histories", "runs", "words", "counts"), strict=True)))
        partial = _count_pairs(below, shards, folder, np.int64)
    else:
        partial = _count_pairs(_pair_parts(docs, shards, hot), shards, folder)
    merged = _merge_words(partial, vocabulary, folder)
    _fill(partial, shards, folder, "pairs", no_counts)
    _fill(merged, shards, folder, "words", [none, *[small] * len(STATS)])
    return Model(folder, shards, hot, tokens, types, sums(partial, fours), sums(merged, ["k1", "k2", "k3", "k4", "more", "total"]), gram_ties)


def _total(vocabulary: DataFrame) -> int:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(b, np.int64).sum()) for b in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    return vocabulary.select("counts").mapInArrow(add, "n long").agg(F.sum("n")).first()[0] or 0


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs` (doc_id, held_out, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((4, n))  # tokens, known, base, score

            def add(parts: list) -> None:
                where, older, histories, tokens = map(np.concatenate, zip(*parts, strict=True))
                logs, seen = m.log10(older, histories, tokens)
                base = np.log10((seen + 1) / (m.tokens + m.types + 1))
                for k, values in enumerate((None, (seen > 0).astype(float), base, logs)):
                    out[k] += np.bincount(where, values, minlength=n)

            held_parts, size = [], 0
            for part in _streams(batch.column(2)):
                held_parts.append(part)
                size += len(part[-1])
                if size >= CHUNK // 2:
                    add(held_parts)
                    held_parts, size = [], 0
            if held_parts:
                add(held_parts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(out[0].astype(np.int64)),
                    pa.array(out[1].astype(np.int64)),
                    pa.array(np.full(n, m.tokens), pa.int64()),
                    pa.array(out[2]),
                    pa.array(out[3]),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCORES)


def score_documents(docs: DataFrame, parts: int = 7, part: int = 2, order: int = 3) -> DataFrame:
    """Train on the documents that are not held out, score all."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), parts, part).alias("held_out"), "text")
    with arrow_rows(docs.sparkSession, kernels.TEXT_ROWS):
        model = train(rows.where("not held_out").select("text"), order)
    return score(rows, model)
