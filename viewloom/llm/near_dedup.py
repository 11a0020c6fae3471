"""Near-duplicate classes by DartMinHash signatures of weighted word shingles.

Elements are five-word shingles (texts of fewer words are one shingle), weights their counts in the text, similarity
the weighted Jaccard sum(min) / sum(max). Darts are thrown by hashing: for every element and weight interval
[0, 1), [1, 2), [2, 4), ... a Poisson process of ranks with a weight position each; darts that land below the element's weight
count. A coordinate of the signature keeps its earliest dart, so two texts agree in a coordinate with
a probability equal to their similarity.

Texts with the same shingles and counts share a node. Nodes meet in bands of ROWS coordinates. In a band's bucket the nodes
are first compared with a leader only; what is linked becomes one tree. This is done twice, the second
time with one node per tree and bucket. In the last round all nodes of a bucket whose components differ are compared
(components only save what is linked already), crowded buckets in salted blocks. Candidates with nearly agreeing signatures are verified exactly on their shingles. Two texts
of similarity 0.8 share no band with a probability of 2e-6.

A family of n texts that all lie just below the similarity costs n * n comparisons of signatures in every band they share, in blocks of CROWDED.

Null texts and texts without words are copies of one another. Repeated rows are copies. A null doc_id gets the class of its
text; a class id is the smallest doc_id of the class (null where none has one). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from viewloom.llm import kernels
from viewloom.llm.common import arrow_rows, compact, cut, forget, hot_keys, lookup, semi_join
from viewloom.llm.components import climbed, connected

BANDS, ROWS = 25, 4
COORDINATES = BANDS * ROWS
#: A bucket of more nodes is compared in blocks of about this size in the last round.
CROWDED = 4096
#: Nodes of either side in a piece of exact work, whose shingle sets a task holds at once.
PIECE = 256
#: Four standard errors below a similarity of 0.8: candidates whose signatures agree less are not verified.
SLACK = 0.16
#: Stands for a null doc_id inside the operator.
NO_ID = -(2**63)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, highest: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ranks and owners of the darts with rank up to `highest` (of the element) that hit below the weights."""
    found, low, width, level = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64))], 0.0, 1.0, 1
    while len(elements):
        state = kernels.mix(elements + np.uint64(level * 0xD1342543DE82EF95 % 2**64))
        top, limit, owner, rank, k = weights, highest, owners, np.zeros(len(state)), 0
        while len(state):
            k += 1
            rank = rank - np.log(_uniform(kernels.mix(state + np.uint64(3 * k)))) / width
            kept = np.flatnonzero(rank <= limit)
            state, top, limit, owner, rank = state[kept], top[kept], limit[kept], owner[kept], rank[kept]
            hit = np.flatnonzero(low + width * _uniform(kernels.mix(state + np.uint64(3 * k + 1))) < top)
            found.append((kernels.mix(state[hit] + np.uint64(3 * k + 2)), rank[hit], owner[hit]))
        low, width, level = (1.0, 1.0, 2) if level == 1 else (low * 2, low * 2, level + 1)
        above = np.flatnonzero(weights > low)
        elements, weights, highest, owners = elements[above], weights[above], highest[above], owners[above]
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def signatures(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, count: int, size: int = COORDINATES) -> np.ndarray:
    """(count, size) 32-bit integers: the earliest dart of every coordinate. Owners run from 0 to count - 1; each has an element."""
    out = np.zeros((count, size), np.uint32)
    reach = size * (np.log(size) + 2) / np.bincount(owners, weights, count)
    left = np.arange(count)
    while len(left):
        ids, ranks, own = darts(elements, weights, reach[owners], owners)
        slot = own * size + ((ids >> np.uint64(33)) % np.uint64(size)).astype(np.int64)
        late = np.argsort(-ranks, kind="stable")
        out.reshape(-1)[slot[late]] = (ids[late] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        filled = np.zeros(count * size, bool)
        filled[slot] = True
        short = ~filled.reshape(count, size).all(axis=1)
        left = left[short[left]]
        again = np.isin(owners, left)  # the few with an empty coordinate throw further
        elements, weights, owners, reach = elements[again], weights[again], owners[again], reach * 2
    return out


def elements_of(where: np.ndarray, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, distinct shingles and counts of the texts whose words are given in order."""
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(words):
        rolled = rolled * kernels.BASE + hashes[i : i + n]
    inside = np.flatnonzero(where[:n] == where[words - 1 :]) if n else np.zeros(0, np.int64)
    own, shingle = [where[inside]], [kernels.mix(rolled[inside] + np.uint64(words))]
    sizes = np.bincount(where)
    ends = np.cumsum(sizes)
    for k in np.flatnonzero((sizes > 0) & (sizes < words)):
        own.append(np.array([k]))
        shingle.append(kernels.shingles(hashes[ends[k] - sizes[k] : ends[k]], words))
    owner, shingle = np.concatenate(own), np.concatenate(shingle)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    heads = np.flatnonzero(np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[heads], shingle[heads], np.diff(heads, append=len(owner)).astype(np.float64)


def node_names(owners: np.ndarray, elements: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """(count, 2) 64-bit integers that name the sets of weighted elements; owners are sorted."""
    each = kernels.mix(elements ^ (weights.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    heads = np.searchsorted(owners, np.arange(count))
    return np.stack([np.add.reduceat(each, heads), np.add.reduceat(kernels.mix(each + np.uint64(0x9FB21C651E98DF25)), heads)], axis=1)


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, word hashes) of whole texts: many short ones or one long one."""
    data, offsets = kernels.texts_of(column)
    held: list[np.ndarray] = []
    for first, last, start, stop in kernels.windows(data, offsets):
        part = data[start:stop]
        if last - first == 1:
            if len(part):
                held.append(kernels.word_hashes(part)[0])
            if stop == offsets[last]:
                hashes = np.concatenate(held) if held else np.zeros(0, np.uint64)
                held = []
                if len(hashes):
                    yield np.full(len(hashes), first), hashes
        elif len(part):
            hashes, where = kernels._split_words(part, offsets[first : last + 1] - start)
            if len(hashes):
                yield where + first, hashes


def _numbered(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sorted hashes of (shingle, occurrence): their plain Jaccard is the weighted Jaccard of the shingles."""
    counts = weights.astype(np.int64)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(np.where(nth == 0, np.repeat(elements, counts), kernels.mix(np.repeat(elements, counts) + nth.astype(np.uint64))))


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """key, rank, at, node, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.parts(batches, 3):
            nodes, signed = [b"\0" * 16] * batch.num_rows, [None] * batch.num_rows
            for where, hashes in _blocks(batch.column(3)):
                owners, elements, weights = elements_of(where - where[0], hashes, words)
                texts, own = np.unique(owners, return_inverse=True)
                names = node_names(own, elements, weights, len(texts))
                found = signatures(elements, weights, own, len(texts))
                for k, name, sketch in zip(texts + where[0], names, found, strict=True):
                    nodes[k], signed[k] = name.tobytes(), sketch.tobytes()
            columns = [*batch.columns[:3], pa.array(nodes, pa.binary()), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "rank", "at", "node", "signature"])

    return docs.select("key", "rank", "at", "text").mapInArrow(run, "key long, rank long, at long, node binary, signature binary")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, elements: of every row of `docs` (text) with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.parts(batches, 0):
            found = []
            for where, hashes in _blocks(batch.column(0)):
                owners, elements, weights = elements_of(where - where[0], hashes, words)
                _, own = np.unique(owners, return_inverse=True)
                names = node_names(own, elements, weights, int(own[-1]) + 1)
                cuts = np.flatnonzero(np.diff(own)) + 1
                for name, e, w in zip(names, np.split(elements, cuts), np.split(weights, cuts), strict=True):
                    found.append((name.tobytes(), _numbered(e, w).tobytes()))
                if len(found) >= 500:
                    yield _sets(found)
                    found = []
            if found:
                yield _sets(found)

    return docs.select("text").mapInArrow(run, "node binary, elements binary")


def _sets(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], names=["node", "elements"])


@F.pandas_udf(DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1) if len(a) else np.zeros(0))


@F.pandas_udf(DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: bytes, y: bytes) -> float:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        where = np.searchsorted(q, p)
        shared = int((q[np.minimum(where, len(q) - 1)] == p).sum())
        return shared / (len(p) + len(q) - shared)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _band_keys() -> list[Column]:
    return [F.xxhash64(F.lit(k), F.substring("signature", 1 + 4 * ROWS * k, 4 * ROWS)) for k in range(BANDS)]


def _bands(nodes: DataFrame) -> DataFrame:
    """bucket, node: the band keys of each signature."""
    return nodes.select("node", F.explode(F.array(*_band_keys())).alias("bucket"))


def _buckets(bands: DataFrame) -> DataFrame:
    """bucket, node, degree of the buckets with two nodes or more; the degree of a node is the number of nodes in all its buckets."""
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(bands.join(sizes, "bucket"))
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    found = compact(shared.select("bucket", "node").join(degrees, "node").select("bucket", "node", "degree"))
    forget(shared)
    return found


def _led(grouped: DataFrame) -> DataFrame:
    """For every node, one pair (a, b): of the leaders of its buckets (the nodes of the highest degree) the one that leads most of them.

    What many texts are copies of has the highest degree, so a group mostly falls together at once. A leader is above its nodes by
    degree and name, so the pairs are trees.
    """
    leaders = grouped.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1")
    led = grouped.join(leaders.select("bucket", F.col("b.node").alias("b")), "bucket").where("node <> b")
    shared = led.groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("a").agg(F.max(F.struct("n", "b")).alias("x")).select("a", F.col("x.b").alias("b"))


def _collapsed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, degree: one node per component and bucket, the one of the highest degree."""
    labelled = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    one = labelled.groupBy("bucket", "component").agg(F.min(F.struct((-F.col("degree")).alias("p"), "node", "degree")).alias("x"))
    return one.select("bucket", "x.node", "x.degree")


def _sets_of(used: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, elements: the shingle sets of the nodes in `used`, from the row of `docs` that each node knows by a hash of id and text."""
    used = cut(nodes.join(used, "node", "left_semi").select("node", "at"))
    sets = _shingle_sets(semi_join(docs, used.select("at"), "at"), words).join(used, "node", "left_semi")
    found = cut(sets.dropDuplicates(["node"]))
    forget(used)
    return found


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The links (a, b) among candidate pairs: those whose shingles are similar enough, looked at where the signatures nearly are.

    Many nodes have the same leader b; both joins by it go straight to a table, so that Spark can deal the rows of a hot b over tasks.
    """
    signed = nodes.select("node", "signature")
    near = pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
    near = near.join(signed.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    near = compact(near.where(_agreement("sa", "sb") >= least - SLACK).select("a", "b"))
    sets = _sets_of(near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct(), nodes, docs, words)
    full = near.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    with arrow_rows(docs.sparkSession, 256):  # shingle sets of long texts are large
        found = compact(full.where(_jaccard("ea", "eb") >= least).select("a", "b"))
    forget(near, sets)
    return found


def _lifted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between different components, as (a, b) of their roots."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("component").alias("root"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    return links.where("a <> b").select("a", "b")


def _hooked(links: DataFrame, labels: DataFrame) -> DataFrame:
    """`labels` after linked roots are hooked to one another: each to the greatest linked root above it. Links beyond those stay open."""
    up = climbed(_lifted(links, labels).groupBy(F.least("a", "b").alias("node")).agg(F.max(F.greatest("a", "b")).alias("component")))
    above = up.select(F.col("node").alias("component"), F.col("component").alias("higher"))
    found = compact(labels.join(above, "component", "left").select("node", F.coalesce("higher", "component").alias("component")).union(up))
    forget(up, labels)
    return found


def _dealt(rows: DataFrame) -> DataFrame:
    """task, side and the rows (bucket, node, component), dealt so that any two nodes of a bucket with different components meet in a task.

    A bucket of up to CROWDED nodes is one task. Larger ones are cut into salted blocks: each block of the bucket's largest component
    meets each block of the others, and the blocks of the others meet one another. Side 2 meets all, sides 0 and 1 each other.
    """
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("components"))
    sizes = sizes.where("components > 1").select("bucket", "total", F.when(F.col("total") > CROWDED, F.col("top.component")).alias("largest"), "top.n")
    placed = rows.join(sizes, "bucket").withColumn("large", F.coalesce(F.col("component") == F.col("largest"), F.lit(False)))
    placed = placed.withColumn("m", F.when(F.col("largest").isNull(), 0).otherwise(F.ceil(F.col("n") / CROWDED)))
    placed = placed.withColumn("k", F.when(F.col("largest").isNull(), 1).otherwise(F.ceil((F.col("total") - F.col("n")) / CROWDED)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("large"), F.col("m")).otherwise(F.col("k"))))
    one = "named_struct('kind', {}, 'i', {}, 'j', {}, 'side', {})"
    large = "transform(sequence(0, k - 1), x -> " + one.format(0, "own", "x", 0) + ")"
    cross = "transform(sequence(0, m - 1), x -> " + one.format(0, "x", "own", 1) + ")"
    inner = "transform(sequence(0, k - 1), x -> " + one.format(1, "least(own, x)", "greatest(own, x)", "if(own = x, 2, if(own < x, 0, 1))") + ")"
    meets = F.expr(f"CASE WHEN large THEN {large} WHEN m > 0 THEN concat({cross}, {inner}) ELSE {inner} END")
    dealt = placed.select("bucket", "node", "component", F.explode(meets).alias("t"))
    return dealt.select(F.xxhash64("bucket", "t.kind", "t.i", "t.j").alias("task"), F.col("t.side").alias("side"), "bucket", "node", "component")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        start = int(np.searchsorted(keys, keys[-1]))
        if start or (held and held[-1].column(0)[-1].as_py() != keys[0]):
            if start:
                held.append(batch.slice(0, start))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _near_in_task(task: np.ndarray, side: np.ndarray, band: np.ndarray, component: np.ndarray, signed: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a task with different components whose signatures agree enough; a pair counts in the first band it shares."""
    first, second, step, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, np.arange(len(task))
    while True:
        step += 1
        rows = rows[rows + step < len(task)]
        rows = rows[task[rows] == task[rows + step]]
        if not len(rows):
            return np.concatenate(first), np.concatenate(second)
        a = rows[(component[rows] != component[rows + step]) & ((side[rows] == 2) | (side[rows] != side[rows + step]))]
        same = signed[a] == signed[a + step]
        enough = np.flatnonzero(same.sum(axis=1) >= least * COORDINATES)
        bands = same[enough].reshape(-1, BANDS, ROWS).all(axis=2)
        a = a[enough[bands.argmax(axis=1) == band[a[enough]]]]
        first.append(a)
        second.append(a + step)


def _candidates(rows: DataFrame, least: float) -> DataFrame:
    """work, node, component, number, partners: the nodes of each piece of work, numbered, and the numbers of those to verify a node against.

    `rows` has task, side, band, node, component, signature. A piece of work has at most 2 * PIECE nodes, and no row is made for a pair.
    """
    schema = pa.schema([("work", pa.int64()), ("node", pa.binary()), ("component", pa.binary()), ("number", pa.int32()), ("partners", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches):
            task, side, band = (part.column(i).to_numpy() for i in range(3))
            signed = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            component = np.unique(np.array(part.column(4).to_pylist(), object), return_inverse=True)[1]
            a, b = _near_in_task(task, side, band, component, signed, least)
            if not len(a):
                continue
            start = np.searchsorted(task, task)
            piece = ((a - start[a]) // PIECE << 16 | (b - start[b]) // PIECE).astype(np.uint64)
            work = kernels.mix(task[a].view(np.uint64) ^ kernels.mix(piece + np.uint64(1))).view(np.int64)
            order = np.lexsort((b, a, work))
            work, a, b = work[order], a[order], b[order]
            heads = np.flatnonzero(np.concatenate(([True], (work[1:] != work[:-1]) | (a[1:] != a[:-1]))))
            partners = [x.astype(np.int32).tobytes() for x in np.split(b, heads[1:])]
            led = {(w, n): p for w, n, p in zip(work[heads].tolist(), a[heads].tolist(), partners, strict=True)}
            for w, n in zip(work.tolist(), b.tolist(), strict=True):
                led.setdefault((w, n), b"")
            at = pa.array([n for _, n in led])
            nodes, components = (pa.array(part.column(i).to_pylist(), pa.binary()).take(at) for i in (3, 4))
            columns = [pa.array([w for w, _ in led], pa.int64()), nodes, components, at.cast(pa.int32()), pa.array(list(led.values()), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    placed = rows.select("task", "side", "band", "node", "component", "signature").repartition("task").sortWithinPartitions("task")
    return placed.mapInArrow(run, "work long, node binary, component binary, number int, partners binary")


def _exact_links(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join different components, of pieces of work (work, node, component, number, partners, elements)."""

    def links(part: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        nodes, components, numbers, partners, elements = (part.column(i).to_pylist() for i in range(1, 6))
        sets = [np.frombuffer(e, np.uint64) for e in elements]
        ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([len(x) for x in sets])[:-1])
        marks, place, up = np.zeros(sum(map(len, sets)), bool), {n: k for k, n in enumerate(numbers)}, {}

        def top(c: bytes) -> bytes:
            while (d := up.get(c, c)) != c:
                up[c] = up.get(d, d)
                c = d
            return c

        for k, near in enumerate(partners):
            if not near:
                continue
            marks[ids[k]] = True
            for other in np.frombuffer(near, np.int32).tolist():
                o = place[other]
                x, y = top(components[k]), top(components[o])
                if x == y:
                    continue
                shared = int(np.count_nonzero(marks[ids[o]]))
                if shared / (len(ids[k]) + len(ids[o]) - shared) >= least:
                    up[x] = y
                    yield nodes[k], nodes[o]
            marks[ids[k]] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches):
            works = part.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], works[1:] != works[:-1])))
            found = [x for s, e in zip(starts, [*starts[1:], len(works)], strict=True) for x in links(part.slice(s, e - s))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], names=["a", "b"])

    placed = rows.select("work", "node", "component", "number", "partners", "elements").repartition("work").sortWithinPartitions("work")
    return placed.mapInArrow(run, "a binary, b binary")


def _met(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The links (a, b) between different components among all nodes that share a bucket."""
    labelled = compact(buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")))
    rows = _dealt(labelled).join(nodes.select("node", "signature"), "node")
    band = F.array_position(F.array(*_band_keys()), F.col("bucket")).cast("int") - 1
    work = compact(_candidates(rows.withColumn("band", band), least - SLACK))
    sets = _sets_of(work.select("node").distinct(), nodes, docs, words)
    with arrow_rows(docs.sparkSession, 256):  # shingle sets of long texts are large
        found = compact(_exact_links(work.join(sets, "node"), least))
    forget(labelled, work, sets)
    return found


def near_duplicate_classes(docs: DataFrame, words: int = 5, least: float = 0.8, rank: str | None = None) -> DataFrame:
    """One row per document: doc_id, class_id. `rank` names a column whose least value (nulls last, then by id) says whose id a class has."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), (F.col(rank) if rank else F.lit(0)).cast("long").alias("rank"), "text")
    keyed = keyed.withColumn("at", F.xxhash64("key", "text"))
    with arrow_rows(docs.sparkSession, kernels.TEXT_ROWS):
        sketches = cut(_sketches(keyed, words))
        nodes = compact(sketches.where("signature is not null").groupBy("node").agg(F.first("signature").alias("signature"), F.min("at").alias("at")))
        buckets = _buckets(_bands(nodes))
        first = _verified(_led(buckets), nodes, keyed, words, least)
        labels = climbed(first.select(F.col("a").alias("node"), F.col("b").alias("component")))
        second = _verified(_led(_collapsed(buckets, labels)), nodes, keyed, words, least)
        labels = _hooked(second, labels)
        third = _met(buckets, labels, nodes, keyed, words, least)
        top = connected(_lifted(second.union(third), labels))
        forget(buckets, nodes, first, second, third)

        name = F.struct(F.col("rank").isNull(), "rank", (F.col("key") == NO_ID).alias("nameless"), "key")
        each = sketches.groupBy("node").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("copies"))
        each = each.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        each = each.join(top.select(F.col("node").alias("component"), F.col("component").alias("higher")), "component", "left")
        each = compact(each.select("node", "first", "copies", F.coalesce("higher", "component").alias("component")))
        forget(labels, top)
        best = each.groupBy("component").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("size"))
        best = best.select("component", F.col("best.key").alias("class_id"), "size")
        classes = lookup(each.select("node", "component", "copies"), best.drop("size"), "component", hot_keys(best.drop("class_id")))
    copied = hot_keys(each.select("node", F.col("copies").alias("size")))
    found = lookup(sketches.select("key", "node"), classes.select("node", "class_id"), "node", copied)
    return found.select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), F.nullif("class_id", F.lit(NO_ID)).alias("class_id"))
