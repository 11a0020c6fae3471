"""Quality from weak labels: heuristic labellers vote, expectation-maximisation weighs them, a hashed linear scorer learns.

Every labeller votes good (1), bad (0) or abstains (-1) on a text. EM over the counts of vote patterns of ALL documents
estimates the share of good texts and each labeller's accuracy on either class; a pattern's posterior is the
label of its texts. A logistic model on hashed words, word shapes, shape pairs and word repetitions is fitted to the posteriors of a
hash sample of about `sample_rows` different documents (id and text) and scores every document.

There are at most 3 ** len(LABELLERS) patterns, so EM runs on a bounded table. Null and empty texts have no word:
they get the score 0 and are rejected. Repeated rows give repeated rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from viewloom.llm import hashed, kernels
from viewloom.llm.common import arrow_rows, bounded_sample

SAMPLE_ROWS = 6000
KEEP_FROM = 0.4
_UPPER, _LOWER, _SPACE, _MARK, _SHOUT, _PIPE = range(6)
_KIND = np.zeros((6, 256), bool)
_KIND[_UPPER, 65:91] = _KIND[_LOWER, 97:123] = True
_KIND[_SPACE, [32, *range(9, 14)]] = True
_KIND[_MARK, list(b"#$%&*+/<=>@[\\]^_`{}~")] = True
_KIND[_SHOUT, list(b"!")] = True
_KIND[_PIPE, list(b"|")] = True

#: Name, measure, good up to (or from), bad from (or up to). Between the two the labeller abstains.
LABELLERS = (
    ("marks", "marks_per_word", 0.05, 0.30),
    ("shouting", "shouts_per_word", 0.05, 0.30),
    ("tables", "pipes_per_word", 0.05, 0.30),
    ("capitals", "capital_share", 0.30, 0.60),
    ("echo", "echo_share", 0.10, 0.30),
    ("variety", "distinct_share", 0.40, 0.25),
    ("plain_words", "plain_share", 0.80, 0.50),
    ("marked_ends", "marked_share", 0.05, 0.30),
    ("word_size", "bytes_per_word", 9.0, 14.0),
    ("sentences", "stops_per_word", 0.03, 0.005),
)


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """The labellers' measures of each text; n_words 0 marks texts without words."""
    n = len(column)
    words, echo, distinct, letters, stops, plain, marked = (np.zeros(n) for _ in range(7))
    kinds = np.zeros((6, n))
    for where, data, starts, ends in hashed._spans(column):
        if not len(starts):
            continue
        hashes = hashed._hash(data, starts, ends)
        words += np.bincount(where, minlength=n)
        letters += np.bincount(where, ends - starts, minlength=n)
        same = where[1:] == where[:-1]
        echo += np.bincount(where[1:][same & (hashes[1:] == hashes[:-1])], minlength=n)
        order = np.lexsort((hashes, where))
        w, h = where[order], hashes[order]
        distinct += np.bincount(w[np.concatenate(([True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])))], minlength=n)
        last = data[ends - 1]
        stops += np.bincount(where[(last == 46) | (last == 63)], minlength=n)
        odd = np.concatenate(([0], np.cumsum(hashed._EDGE[data] & ~_KIND[_SPACE][data])))
        plain += np.bincount(where[(odd[np.maximum(ends - 1, starts + 1)] == odd[starts]) | (odd[ends] == odd[starts])], minlength=n)
        marked += np.bincount(where[(_KIND[_MARK] | _KIND[_PIPE] | _KIND[_SHOUT])[last]], minlength=n)
        for k in (_UPPER, _LOWER, _MARK, _SHOUT, _PIPE):
            total = np.concatenate(([0], np.cumsum(_KIND[k][data])))
            kinds[k] += np.bincount(where, total[ends] - total[starts], minlength=n)
    each = np.maximum(words, 1)
    return {
        "n_words": words,
        "marks_per_word": kinds[_MARK] / each,
        "shouts_per_word": kinds[_SHOUT] / each,
        "pipes_per_word": kinds[_PIPE] / each,
        "capital_share": kinds[_UPPER] / np.maximum(kinds[_UPPER] + kinds[_LOWER], 1),
        "echo_share": echo / each,
        # the share of distinct words falls with length; the square root makes long and short texts comparable
        "distinct_share": distinct / np.minimum(each, 10 * np.sqrt(each)),
        "plain_share": plain / each,
        "marked_share": marked / each,
        "bytes_per_word": letters / each,
        "stops_per_word": stops / each,
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, labellers) of 1, 0 and -1; texts without words get bad votes."""
    columns = []
    for _, name, good, bad in LABELLERS:
        x = found[name]
        is_good, is_bad = (x <= good, x >= bad) if good < bad else (x >= good, x <= bad)
        short = found["n_words"] < 8  # too short to tell
        columns.append(np.where(found["n_words"] == 0, 0, np.where(short & (name in ("echo_share", "distinct_share", "stops_per_word")), -1, np.where(is_good, 1, np.where(is_bad, 0, -1)))))
    return np.stack(columns, axis=1)


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern, P(vote | class) as (labeller, class, vote + 1), share of good. A pattern is a string of g, b and -."""
    v = np.array([["-bg".index(c) for c in p] for p in patterns])
    good, bad = (v == 2).sum(axis=1), (v == 1).sum(axis=1)
    # a start from which good means good: a single bad vote speaks against a text
    posterior = np.where(bad > 0, 0.5 / (1 + bad), np.where(good > 0, 0.95, 0.5))
    rates, share = np.full((v.shape[1], 2, 3), 1 / 3), 0.5
    total = max(counts.sum(), 1)
    for _ in range(rounds):
        share = float(np.clip((posterior * counts).sum() / total, 1e-4, 1 - 1e-4))
        for j in range(len(rates)):
            for c, weight in ((1, posterior * counts), (0, (1 - posterior) * counts)):
                seen = np.bincount(v[:, j], weight, minlength=3) + 0.5
                rates[j, c] = seen / seen.sum()
        logs = np.log(share) - np.log(1 - share) + sum(np.log(rates[j, 1, v[:, j]]) - np.log(rates[j, 0, v[:, j]]) for j in range(len(rates)))
        posterior = hashed._sigmoid(logs)
    return posterior, rates, share


def _text_parts(text: pa.Array) -> Iterator[pa.Array]:
    """The texts of a batch in pieces."""
    return (p.column(0) for p in kernels.parts([pa.record_batch([text], ["text"])], 0))


@F.arrow_udf(StringType())
def _pattern(text: pa.Array) -> pa.Array:
    letters = np.array(["-", "b", "g"])
    return pa.array(["".join(r) for part in _text_parts(text) for r in letters[votes(measures(part)) + 1]], pa.string())


def label_model(docs: DataFrame) -> dict[str, float]:
    """The posterior of each vote pattern among all documents."""
    rows = docs.select(_pattern("text").alias("pattern")).groupBy("pattern").count().orderBy("pattern").collect()
    if not rows:
        return {}
    posterior, _, _ = expectation_maximisation([r.pattern for r in rows], np.array([r["count"] for r in rows], float))
    return {r.pattern: float(p) for r, p in zip(rows, posterior, strict=True)}


def _features(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and their frequencies per word, by text."""
    own: dict[int, list[np.ndarray]] = {}
    for where, ids in hashed.shape_features(column):
        cuts = np.flatnonzero(np.diff(where)) + 1
        for k, part in zip(where[np.concatenate(([0], cuts))], np.split(ids, cuts, axis=1), strict=True):
            own.setdefault(int(k), []).append(part)
    found = {}
    for k, parts in own.items():
        ids = np.concatenate(parts, axis=1)
        numbers, counts = np.unique(ids, return_counts=True)
        found[k] = numbers, counts / ids.shape[1]
    return found


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float] | None:
    """Weights and bias of the scorer; None for an empty table."""
    posterior = label_model(docs)
    if not posterior:
        return None
    drawn = bounded_sample(docs.select("doc_id", "text"), ["doc_id", "text"], sample_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.parts(batches, 1):
            letters = np.array(["-", "b", "g"])[votes(measures(batch.column(1))) + 1]
            target = [posterior["".join(r)] for r in letters]
            rows = sorted(_features(batch.column(1)).items())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0)[k].as_py() for k, _ in rows], pa.int64()),
                    pa.array([target[k] for k, _ in rows], pa.float64()),
                    pa.array([i.astype(np.int32).tobytes() for _, (i, _) in rows], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, (_, v) in rows], pa.binary()),
                ],
                names=["doc_id", "target", "ids", "vals"],
            )

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(frames)
        if not frames or not sum(map(len, frames)):
            return
        frame = pd.concat(frames).sort_values(["doc_id", "target", "ids"], kind="stable")
        rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(frame["ids"], frame["vals"], strict=True)]
        starts, ids, values = hashed.csr(rows)
        target = frame["target"].to_numpy()
        del frame, frames, rows  # their bytes are copied: a task has little memory beside the executor's heap
        rare = np.bincount(ids, minlength=hashed.N) < 3
        values[rare[ids]] = 0.0
        weights, bias = hashed.train_logistic(starts, ids, values, target)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    rows = drawn.select(F.col("doc_id").cast("long"), "text").mapInArrow(features, "doc_id long, target double, ids binary, vals binary")
    model = rows.repartition(1).mapInPandas(train, "weights binary, bias double").collect()
    return (np.frombuffer(model[0].weights, np.float32), model[0].bias) if model else None


def quality_of(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Column:
    """A column for the probability that `text` is good, by a scorer fitted on `docs`."""
    with arrow_rows(docs.sparkSession, kernels.TEXT_ROWS):
        held = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_rows))

    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        if held.value is None:
            return pa.array(np.zeros(len(text)))
        (weights, bias), found = held.value, [np.zeros(0)]
        for part in _text_parts(text):
            n = len(part)
            total, words = np.zeros(n), np.zeros(n)
            for where, ids in hashed.shape_features(part):
                total += np.bincount(where, weights[ids].sum(axis=0), minlength=n)
                words += np.bincount(where, minlength=n)
            found.append(np.where(words > 0, hashed._sigmoid(total / np.maximum(words, 1) + bias), 0.0))
        return pa.array(np.concatenate(found))

    return score("text")


def classify_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: doc_id, quality (0 to 1), keep."""
    scored = docs.select("doc_id", F.round(quality_of(docs, sample_rows), 6).alias("quality"))
    return scored.withColumn("keep", F.col("quality") >= keep_from)
