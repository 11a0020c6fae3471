"""Ranked lexical search: a blocked sparse product of item-term multiplicities and term-document impacts, in 64-bit integers.

Terms are runs of letters, digits and characters beyond ASCII, A-Z as a-z. One pass over the documents keeps, for blocks of BLOCK_DOCS documents,
the number of terms of each document and the rows (term: documents and counts) of the terms that the items have, in a table in the
shared folder. Document counts, document frequencies and the total length follow from that table; they and the weights are a few numbers for each
term of the items. Scoring reads the blocks again: impacts replace the counts, the rows of an item's terms are merged into one
accumulator over the block (Gustavson's order: a row of the product from rows of the right factor), and a block only passes on what
beats the k-th best score that its task has seen. The best k of each task are ranked in two steps, so no task gets rows from all the others.

Items go in blocks of up to a million characters; each block is one pass over the documents, so what is broadcast has a bound.
Terms are told apart by 64-bit hashes. Scores equal, lower ids come first, null ids last.

Null texts and texts without a term are no documents for the statistics and are never found. Items without a term, and items whose terms
no document has, get no row. Repeated items get rows each, repeated documents are ranked each. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewloom.llm import kernels
from viewloom.llm.common import arrow_rows, scratch_folder

#: Characters of items in a block.
BLOCK_CHARS = 1 << 20
#: Documents in a block (their numbers have 16 bits), and postings from which on a block is closed.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 22
#: All bytes but digits, letters and those of characters beyond ASCII.
GAP = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_BLOCK = pa.schema([("with_terms", pa.int64()), ("n_terms", pa.int64())] + [(n, pa.binary()) for n in ("ids", "named", "sizes", "terms", "starts", "rows", "counts")])
_BLOCK_DDL = "with_terms long, n_terms long, ids binary, named binary, sizes binary, terms binary, starts binary, rows binary, counts binary"


class Items:
    """A block of items: the sorted hashes of their terms, and of each item the numbers and multiplicities of its terms."""

    def __init__(self, first: int, items: list[tuple[int | None, str]]):
        self.first, self.ids = first, [i for i, _ in items]
        where, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for w, h in kernels.batch_words(pa.array([t for _, t in items], pa.large_string()), GAP):
            where.append(w)
            hashes.append(h)
        where, hashes = np.concatenate(where), np.concatenate(hashes)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        keys, counts = np.unique(where << 32 | number, return_counts=True)
        borders = np.searchsorted(keys, np.arange(len(items) + 1) << 32)
        self.terms = [(keys[a:b] & 0xFFFFFFFF, counts[a:b]) for a, b in zip(borders, borders[1:])]


def _item_blocks(items: DataFrame, id_col: str) -> Iterator[Items]:
    held, size, first = [], 0, 0
    for row in items.select(F.col(id_col).cast("long").alias("item"), "text").where("length(text) > 0").toLocalIterator():
        if held and size + len(row[1]) > BLOCK_CHARS:  # a very long item stands alone
            yield Items(first, held)
            first, held, size = first + len(held), [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield Items(first, held)


class _Gather:
    """Documents and their postings until a block is full."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes = [], []
        self.keys, self.counts, self.docs, self.held = [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        n = len(ids)
        sizes = np.zeros(n, np.int64)
        for where, hashes in kernels.batch_words(texts, GAP):
            sizes += np.bincount(where, minlength=n)
            if len(self.vocabulary):
                at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
                real = self.vocabulary[at] == hashes
                self._keep(*np.unique(at[real] << 16 | (self.docs + where[real]), return_counts=True))
        self.ids += ids.to_pylist()
        self.sizes.append(sizes)
        self.docs += n

    def _keep(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * BLOCK_POSTINGS:  # the windows of a very long text repeat its terms
            keys, counts = self._merged()
            self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts

    def block(self) -> pa.RecordBatch:
        """One row; the documents are numbered by id, nulls last, so that a lower number wins a tie."""
        named = np.array([i is not None for i in self.ids], bool)
        ids, sizes = np.array([i or 0 for i in self.ids], np.int64), np.concatenate(self.sizes)
        order = np.lexsort((ids, ~named))
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        keys, counts = self._merged()
        keys = keys >> 16 << 16 | number[keys & 0xFFFF]
        again = np.argsort(keys)
        keys, counts = keys[again], counts[again]
        terms = keys >> 16
        heads = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(keys) else np.zeros(0, np.int64)
        counts = counts.astype(np.uint16) if counts.max(initial=0) < 1 << 16 else counts.astype(np.int64)
        parts = [ids[order], named[order], sizes[order], terms[heads].astype(np.uint32), np.append(heads, len(keys)).astype(np.uint32), (keys & 0xFFFF).astype(np.uint16), counts]
        done = [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
        self.clear()
        return pa.RecordBatch.from_arrays(done, schema=_BLOCK)


def _blocks(docs: DataFrame, items: Items) -> DataFrame:
    """The blocks of all documents, as a table in the shared folder."""
    held = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(held.value)
        for part in kernels.parts(batches, 1):
            if gather.docs and (gather.docs + part.num_rows > BLOCK_DOCS or gather.held > BLOCK_POSTINGS):
                yield gather.block()
            gather.add(part.column(0), part.column(1))
        if gather.docs:
            yield gather.block()

    folder = scratch_folder(docs.sparkSession, "postings")
    with arrow_rows(docs.sparkSession, kernels.TEXT_ROWS):
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCK_DDL).write.parquet(f"{folder}/blocks")
    return docs.sparkSession.read.schema(_BLOCK_DDL).parquet(f"{folder}/blocks")


def _frequencies(blocks: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of the items' terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(terms, np.int64)
        for batch in batches:
            for own, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[np.frombuffer(own, np.uint32)] += np.diff(np.frombuffer(starts, np.uint32).astype(np.int64))
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(found[seen])], names=["term", "docs"])

    out = np.zeros(terms, np.int64)
    for r in blocks.select("terms", "starts").mapInArrow(run, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[r.term] = r.docs
    return out


def _share(sizes: np.ndarray, docs: int, total: int) -> np.ndarray:
    """90 * n * N div L, in wide integers where 64 bits could overflow."""
    if not len(sizes) or 90 * int(sizes.max()) * docs < 1 << 63:
        return 90 * sizes * docs // total
    return np.array([90 * n * docs // total for n in sizes.tolist()], np.int64)


def _best(score: np.ndarray, named: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~named, -score))[:k]


def _scores(blocks: DataFrame, items: Items, weights: np.ndarray, docs: int, total: int, k: int, repeats: bool) -> DataFrame:
    """part, item, item_id, doc_id, score: the best k of each task."""
    held = blocks.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = held.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items.ids)
        slot = np.empty(len(weights), np.int64)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, named, sizes = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], bool), np.frombuffer(row[2], np.int64)
                terms, starts, docs_of = np.frombuffer(row[3], np.uint32), np.frombuffer(row[4], np.uint32).astype(np.int64), np.frombuffer(row[5], np.uint16).astype(np.int64)
                counts = np.frombuffer(row[6], np.uint16 if len(row[6]) == len(row[5]) else np.int64).astype(np.int64)
                length = 10 + _share(sizes, docs, total) if total else sizes
                impact = np.repeat(weights[terms], np.diff(starts)) * (1_000_000_000 * counts // (1000 * counts + 8 * length[docs_of]))
                slot[:] = -1
                slot[terms] = np.arange(len(terms))
                sums = np.zeros(len(ids), np.int64)
                for item, (own, times) in enumerate(items.terms):
                    sums[:] = 0
                    at = slot[own]
                    for s, n in zip(at[at >= 0].tolist(), times[at >= 0].tolist(), strict=True):
                        a, b = starts[s], starts[s + 1]
                        sums[docs_of[a:b]] += impact[a:b] * n if repeats else impact[a:b]
                    score, there, name = best[item]
                    least = max(1, int(score[-1])) if len(score) == k else 1
                    found = np.flatnonzero(sums >= least)
                    if len(found) > k:
                        own_least = np.partition(sums[found], len(found) - k)[len(found) - k]
                        found = found[sums[found] >= own_least]
                        found = found[_best(sums[found], named[found], ids[found], k)]
                    if len(found):
                        both = tuple(map(np.concatenate, zip(best[item], (sums[found], named[found], ids[found]), strict=True)))
                        first = _best(*both, k)
                        best[item] = tuple(x[first] for x in both)
        part = TaskContext.get().partitionId()
        sizes = [len(s) for s, _, _ in best]
        score, named, ids = (np.concatenate([b[i] for b in best]) for i in range(3))
        number = np.repeat(np.arange(len(best)), sizes)
        columns = [pa.array(np.full(len(number), part), pa.int32()), pa.array(items.first + number, pa.int64())]
        columns += [pa.array([items.ids[i] for i in number.tolist()], pa.int64()), pa.array(ids, pa.int64(), mask=~named), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "item", "item_id", "doc_id", "score"])

    lean = blocks.select("ids", "named", "sizes", "terms", "starts", "rows", "counts")
    return lean.mapInArrow(run, "part int, item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, repeats: bool = False, item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of each item. `repeats`: a term that an item has twice counts twice."""
    spark = docs.sparkSession
    parts: list[DataFrame] = []
    for block in _item_blocks(items, item_id):
        postings = _blocks(docs, block)
        found = postings.agg(F.sum("with_terms").alias("docs"), F.sum("n_terms").alias("total")).first()
        n, total = found.docs or 0, found.total or 0
        of = _frequencies(postings, len(block.vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in of.tolist()], np.int64)
        parts.append(_scores(postings, block, weights, n, total, k, repeats))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = reduce(DataFrame.union, parts)
    deals = max(1, math.isqrt(parts[0].rdd.getNumPartitions()))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("deal", F.col("part") % deals)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "deal").orderBy(*order))).where(F.col("rank") <= k)
    whole = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return whole.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def oracle(documents: str = "documents", items: str = "benchmark", k: int = 10) -> str:
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM {documents} WHERE text IS NOT NULL),
size AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
wanted AS MATERIALIZED (SELECT DISTINCT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {terms} AS t FROM {items} WHERE text IS NOT NULL)),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weight AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), whole),
scored AS (SELECT i, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (r), whole GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
