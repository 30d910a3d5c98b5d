"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, its pairs of neighbours and its pairs one word apart, lower-cased
(A-Z) and hashed to 64 bits; a longer word also counts by its first 4 and 6 bytes, so that inflected forms share a weight. Training takes one bounded sample of labelled rows (`most_rows`, the rows with the
smallest hashed doc_id), in one task, since the updates are sequential: every coordinate has its own learning rate, and
the L1 penalty leaves most weights at exactly zero. What remains is a short list of (feature, weight), broadcast
once its size has been checked. Scoring covers every row and whole texts; it first tests features against a bitmap of
those with a weight, so its cost hardly depends on the model.

Defined results: a null or empty text has no features and gets the score of the intercept; without usable labels all
scores are the prior 0; labels other than 0 and 1 or null are left out; rows equal in
doc_id, label and text are learned once and scored each; very long texts are scored alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgraph.llm import hashing, workers

_SKIP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_STEMS = (4, 6)
_BITMAP_BITS = 22
_COUNT_BITS = 25
#: Largest model that is broadcast.
_MOST_WEIGHTS = 4 << 20
_INTERCEPT = 0


@dataclass(frozen=True)
class Settings:
    """Parameters of the fit. most_rows bounds the labelled sample."""

    most_rows: int = 6_000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    least_documents: int = 3


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit features of all texts, repeats included."""
    encoded = [t.encode("utf-8", "replace").lower() for t in texts]
    ends = np.cumsum([len(e) + 1 for e in encoded])
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    starts, stops = hashing.runs(hashing.WORD[data])
    sums = hashing.prefix_sums(data)
    words = hashing.span_hashes(sums, starts, stops)
    rows = np.searchsorted(ends, starts, side="right")
    out, at = [words], [rows]
    for gap, salt in enumerate(_SKIP, 1):
        same = rows[:-gap] == rows[gap:]
        out.append(hashing.mix(words[:-gap] * salt + words[gap:])[same])
        at.append(rows[gap:][same])
    for size in _STEMS:
        longer = stops - starts > size
        out.append(~hashing.span_hashes(sums, starts[longer], starts[longer] + size))
        at.append(rows[longer])
    return np.concatenate(at), np.concatenate(out)


def fit(texts: list[str], labels: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted features with a weight, their weights, and the intercept."""
    # Twice over the texts: first documents are counted by feature bucket, then only features that can be common are held.
    bucket = np.uint64(64 - _COUNT_BITS)
    seen = np.zeros(1 << _COUNT_BITS, np.uint16)
    rows, found = [], []
    for counting in (True, False):
        for text in enumerate(texts):
            feature = np.unique(features([text[1]])[1])
            at = (feature >> bucket).astype(np.int64)
            if counting:
                seen[at] += seen[at] < 0xFFFF
            else:
                found.append(feature[seen[at] >= settings.least_documents])
                rows.append(np.full(len(found[-1]), text[0], np.int32))
    rows = np.concatenate(rows)
    names, index = np.unique(np.concatenate(found), return_inverse=True)
    common = np.bincount(index, minlength=len(names)) >= settings.least_documents
    names, rows, index = names[common], rows[common[index]], (np.cumsum(common) - 1)[index[common[index]]].astype(np.int32)
    del found
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    n, z = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    last = len(names)

    def weights(x: np.ndarray) -> np.ndarray:
        zx = z[x]
        w = -(zx - np.sign(zx) * settings.l1) / ((settings.beta + np.sqrt(n[x])) / settings.alpha + settings.l2)
        w[np.abs(zx) <= settings.l1] = 0
        return w

    for _ in range(settings.epochs):
        for r in range(len(texts)):
            x = np.append(index[bounds[r] : bounds[r + 1]], last)
            w = weights(x)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[r]
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / settings.alpha * w
            n[x] += g * g
    w = weights(np.arange(last + 1))
    kept = np.flatnonzero(w[:-1])
    return names[kept], w[kept], float(w[-1])


def _train(settings: Settings) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], r[2]))
        names, w, intercept = np.zeros(0, np.uint64), np.zeros(0), -35.0
        if rows:
            names, w, intercept = fit([r[2] for r in rows], np.array([r[1] for r in rows], float), settings)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(names, np.uint64(_INTERCEPT)).view(np.int64)), pa.array(np.append(w, intercept))], ["feature", "weight"]
        )

    return train


def train(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on labels (doc_id, toxic) whose rows satisfy `usable`, an expression over doc_id."""
    settings = settings or Settings()
    sample = (
        labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("order"))
        .orderBy("order", "doc_id", "toxic")
        .limit(settings.most_rows)
    )
    # As many rows as `most_rows`, however often a labelled doc_id stands in the documents.
    rows = (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .select("order", "doc_id", "toxic", "text")
        .distinct()
        .orderBy("order", "doc_id", "toxic", "text")
        .limit(settings.most_rows)
        .select("order", "toxic", "text")
        .repartition(1)
        .mapInArrow(_train(settings), "feature bigint, weight double")
        .collect()
    )
    got = sorted((r.feature & 0xFFFFFFFFFFFFFFFF, r.weight) for r in rows)
    intercept = sum(w for f, w in got if f == _INTERCEPT) if rows else -35.0
    kept = [(f, w) for f, w in got if f != _INTERCEPT]
    if len(kept) > _MOST_WEIGHTS:
        raise ValueError(f"{len(kept)} weights are too many to broadcast; raise l1")
    return np.array([f for f, _ in kept], np.uint64), np.array([w for _, w in kept], float), intercept


def _score(model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, intercept = model.value
        seen = np.zeros(1 << _BITMAP_BITS, bool)
        seen[(names >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)] = True
        for batch in batches:
            texts = batch.column(1)
            scores = np.full(batch.num_rows, intercept)
            for part in hashing.chunks(enumerate(x.as_py() or "" for x in texts), 1):
                at, found = features([t for _, t in part])
                maybe = np.flatnonzero(seen[(found >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)])
                if len(names) and len(maybe):
                    place = np.minimum(np.searchsorted(names, found[maybe]), len(names) - 1)
                    real = names[place] == found[maybe]
                    pairs = np.unique(at[maybe[real]] * np.int64(len(names)) + place[real])
                    np.add.at(scores, part[0][0] + pairs // len(names), weights[pairs % len(names)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(scores, -700, 700))))], ["doc_id", "score"]
            )

    return score


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_score(shared), f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float) -> DataFrame:
    """All columns of the rows whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.append(batch)
                column = batch.column(at).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), column], ["doc_id", "text"])

        for scores in _score(shared)(texts()):
            yield held.pop().filter(pa.array(scores.column(1).to_numpy() < threshold))

    return docs.mapInArrow(workers.tidy(keep), docs.schema)
