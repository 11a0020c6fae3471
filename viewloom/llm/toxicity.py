"""Toxicity severity by cumulative-link ordinal regression on hashed word and stem features.

Labels say toxic or not. Grades for training: 0 for rows that are not toxic, and for toxic rows 1, 2 or 3 by the
share of marker words among their words (the thirds of the sample's toxic rows), where markers are features that toxic rows of the sample
have at least MARKER_ODDS times as often as others. The model shares its weights across the ordered
thresholds: P(severity > k) = sigmoid(w.x - c_k), and the expected severity is the sum over k.

The model is trained in one task on a hash sample of about `sample_rows` different labelled documents (id and text), which bounds its
input however large the tables are and however often a row repeats; all documents are scored. Labels with a null are left out; of several labels
of a document the highest counts. Without both classes in the sample all severities are 0. Null and empty texts
have no feature and get the severity of the thresholds alone. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm import hashed, kernels
from viewloom.llm.common import arrow_rows, bounded_sample, cut

MARKER_ODDS = 30.0
GRADES = 4
SAMPLE_ROWS = 8000


def grades(toxic: np.ndarray, starts: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(toxic)), np.diff(starts))
    seen = [np.bincount(ids[(toxic == t)[rows]], minlength=hashed.N) for t in (0, 1)]
    rate = [(seen[t] + 0.1) / ((toxic == t).sum() + 0.2) for t in (0, 1)]
    marker = (rate[1] / rate[0] >= MARKER_ODDS) & (seen[1] >= 3)
    found = np.bincount(rows, np.where(marker[ids], counts, 0), minlength=len(toxic))
    # each word, marker or not, shows as itself and as up to three stems
    dense = found / np.maximum(np.bincount(rows, counts, minlength=len(toxic)), 1)
    steps = np.quantile(dense[toxic > 0], [(g + 1) / (GRADES - 1) for g in range(GRADES - 2)])
    return np.where(toxic == 0, 0, 1 + (dense[:, None] > steps).sum(axis=1))


def telling(toxic: np.ndarray, starts: np.ndarray, ids: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Features whose share of texts differs between the classes by `least` standard errors; the others stay out of the model."""
    rows, n = np.repeat(toxic, np.diff(starts)), np.array([(~toxic).sum(), toxic.sum()])
    seen = np.stack([np.bincount(ids[rows == t], minlength=hashed.N) for t in (False, True)])
    share = seen.sum(axis=0) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
    return (np.abs(seen[1] / n[1] - seen[0] / n[0]) >= least * error) & (seen.sum(axis=0) >= 3)


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, text, toxic of about `sample_rows` different labelled documents at most."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = cut(bounded_sample(known, ["doc_id"], sample_rows))
    return bounded_sample(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), ["doc_id", "text"], sample_rows)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and thresholds, or None without both classes."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.parts(batches, 1):
            doc, toxic, own = batch.column(0).to_pylist(), batch.column(2).to_pylist(), {}
            for where, ids, counts in hashed.stem_features(batch.column(1)):
                cuts = np.flatnonzero(np.diff(where)) + 1
                for k, i, c in zip(where[np.concatenate(([0], cuts))], np.split(ids, cuts), np.split(counts, cuts), strict=True):
                    own.setdefault(int(k), []).append((i, c))
            rows = [(doc[k], toxic[k], *(np.concatenate(x) for x in zip(*own[k], strict=True))) for k in sorted(own)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2].astype(np.int32).tobytes() for r in rows], pa.binary()),
                    pa.array([r[3].astype(np.int32).tobytes() for r in rows], pa.binary()),
                ],
                names=["doc_id", "toxic", "ids", "counts"],
            )

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("doc_id", kind="stable") if (frames := list(frames)) else pd.DataFrame({"toxic": []})
        toxic = frame["toxic"].to_numpy() > 0
        if not toxic.any() or toxic.all():
            return
        rows = [(np.frombuffer(i, np.int32), np.frombuffer(c, np.int32)) for i, c in zip(frame["ids"], frame["counts"], strict=True)]
        starts, ids, counts = hashed.csr(rows)
        grade = grades(toxic.astype(int), starts, ids, counts)
        values = np.where(telling(toxic, starts, ids)[ids], 1 + np.log(counts), 0.0)
        weights, cuts = hashed.train_ordinal(starts, ids, values, grade, GRADES)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "cuts": [cuts.tobytes()]})

    rows = _sample(docs, labels, sample_rows).mapInArrow(features, "doc_id long, toxic int, ids binary, counts binary")
    model = rows.repartition(1).mapInPandas(train, "weights binary, cuts binary").collect()
    return (np.frombuffer(model[0].weights, np.float32), np.frombuffer(model[0].cuts)) if model else None


def severity(column: pa.Array, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Expected severity of each text, 0 to GRADES - 1."""
    x = np.zeros(len(column))
    for where, ids, counts in hashed.stem_features(column):
        x += np.bincount(where, weights[ids] * (1 + np.log(counts)), minlength=len(column))
    return hashed._sigmoid(x[:, None] - cuts[None, :]).sum(axis=1)


def score_severity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, toxic_from: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_severity, severity (the nearest grade), toxic."""
    with arrow_rows(docs.sparkSession, kernels.TEXT_ROWS):
        model = fit(docs, labels, sample_rows)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.parts(batches, 1):
            found = severity(batch.column(1), *held.value) if held.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "expected_severity"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_severity double")
    return scored.select(
        "doc_id",
        F.round("expected_severity", 6).alias("expected_severity"),
        F.round("expected_severity").cast("int").alias("severity"),
        (F.col("expected_severity") >= toxic_from).alias("toxic"),
    )
