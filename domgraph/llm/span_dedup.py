"""Substring dedup by sliding spans of sentences.

A text is cut into sentences: at line breaks, and at white space after [.!?] (quotes and brackets that close may stand
between). Every run of `sentences` consecutive sentences is hashed, and so is a sentence that alone has `least_words` words. As
a passage is often pasted into the middle of a sentence, a run also begins at each capital letter that follows white
space: there it takes the rest of that sentence in place of the whole. This adds starts of runs, not ends of sentences, so a
German noun cuts nothing. Words compare with A-Z in lower case and white space between them ignored.

Every run's hash is joined across the corpus, once a document: the smallest doc_id that holds it is the first, and in all others
the run is repeated, as is any run that stands earlier in its own text. Repeated runs that touch or overlap make a passage; passages of
`least_words` words or more are removed. Hashes are found once, written, and combined before they are shuffled; the rows of
repeated hashes are found by a plain join of two written tables, which Spark may split where a passage is in a third of all
documents.

Defined results: null and empty texts have no sentences and keep their (empty) text; texts under `least_words` are left alone; a
line without white space (as in Chinese) is one sentence; a null doc_id counts as larger than all others; rows that share a
doc_id are one document to the join, so neither removes the other's sentences; very long texts are cut like others, one at
a time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domgraph.llm import hashing, scratch

_LAST = 2**63 - 1
_SPANS = "doc bigint, version bigint, start int, n int, h1 bigint, h2 bigint"
#: First bytes of two-byte characters with the range of second bytes that are capitals: Latin, Greek, Cyrillic.
_CAPITALS = ((0xC3, 0x80, 0x9E), (0xCE, 0x91, 0xA9), (0xD0, 0x80, 0xAF))
#: Closing quotes and brackets that may follow a sentence's end, as the bytes they end with.
_CLOSERS = tuple(x.encode() for x in ("\"", "'", ")", "]", "»", "”", "’"))


def _ends_sentence(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words (by the place after their last byte) end in [.!?], closing quotes and brackets aside."""
    at = ends.copy()
    for _ in range(2):
        for closer in _CLOSERS:
            match = at > len(closer)
            for k, byte in enumerate(reversed(closer), 1):
                match &= data[np.maximum(at - k, 0)] == byte
            at = np.where(match, at - len(closer), at)
    last = data[np.maximum(at - 1, 0)]
    return (last == 46) | (last == 33) | (last == 63)


def _starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, which of them begin a sentence, and which begin with a capital."""
    starts, ends = hashing.runs(~hashing.SPACE[data])
    begins = np.zeros(len(starts), bool)
    if not len(starts):
        return starts, ends, begins, begins
    head, following = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    capital = (head >= 65) & (head <= 90)
    for lead, low, high in _CAPITALS:
        capital |= (head == lead) & (following >= low) & (following <= high)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    begins[0] = True
    begins[1:] = _ends_sentence(data, ends[:-1]) | (lines[starts[1:]] > lines[starts[:-1]])
    return starts, ends, begins, capital


def _fold(data: np.ndarray) -> np.ndarray:
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    return data


def spans(texts: list[str], sentences: int, least_words: int) -> tuple[np.ndarray, ...]:
    """(text number, first word, number of words, h1, h2) of all runs of all texts."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(x + b"\n" for x in encoded), np.uint8)
    bounds = np.cumsum([len(x) + 1 for x in encoded])
    starts, ends, begins, capital = _starts(data)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    row = np.searchsorted(bounds, starts, side="right")
    begins[1:] |= row[1:] != row[:-1]
    words = hashing.span_hashes(hashing.prefix_sums(_fold(data)), starts, ends)
    sums = [hashing.prefix_sums(words), hashing.prefix_sums(words ^ (words >> np.uint64(29)))]
    first = np.flatnonzero(begins)
    stop = np.append(first[1:], len(starts))  # one past the last word of each sentence
    one = np.flatnonzero(begins | capital)  # where runs begin
    own = np.searchsorted(first, one, "right") - 1
    last = np.minimum(own + sentences - 1, len(first) - 1)
    inside = (own + sentences <= len(first)) & (row[first[last]] == row[one])
    alone = stop[own] - one >= least_words
    a = np.concatenate([one[inside & ~alone], one[alone]])
    b = np.concatenate([stop[last][inside & ~alone], stop[own][alone]])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    hashed = [hashing.span_hashes(s, a, b).view(np.int64) for s in sums]
    text_start = np.searchsorted(row, np.arange(len(texts)), "left")
    return row[a], a - text_start[row[a]], b - a, hashed[0], hashed[1]


def _later_in_text(row: np.ndarray, start: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which runs have an equal one earlier in their own text."""
    order = np.lexsort((start, h2, h1, row))
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (row, h1, h2)]) if len(order) else False
    later = np.zeros(len(order), bool)
    later[order] = same
    return later


def _spans(sentences: int, least_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(k).to_numpy() for k in (0, 1)]
            for part in hashing.chunks(enumerate(x.as_py() for x in batch.column(2)), 1):
                row, start, n, h1, h2 = spans([t for _, t in part], sentences, least_words)
                first = ~_later_in_text(row, start, h1, h2)
                row, start, n, h1, h2 = (x[first] for x in (row, start, n, h1, h2))
                row = row + part[0][0]
                columns = [pa.array(x[row]) for x in ids] + [pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "version", "start", "n", "h1", "h2"])

    return run


def passages(repeated: list[tuple[int, int]], least_words: int) -> list[tuple[int, int]]:
    """First word and end of the passages that repeated runs (first word, number of words) make together."""
    out: list[list[int]] = []
    for a, n in sorted(repeated):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out if b - a >= least_words]


def _remove(sentences: int, least_words: int, changed_only: bool) -> Callable:
    def one(text: str, gone: list[tuple[int, int]]) -> tuple[int, int, str, str]:
        encoded = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(encoded + b"\n", np.uint8)
        starts, _, begins, _ = _starts(data)
        sentence = np.cumsum(begins)
        # Characters before each byte: all bytes but those that continue one.
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if gone else None
        keep, taken, at, touched = [], [], 0, 0
        for a, b in gone:
            touched += int(sentence[b - 1] - sentence[a]) + 1
            a, b = int(starts[a]), int(starts[b]) if b < len(starts) else len(encoded)
            keep.append(encoded[at:a])
            taken.append(f"{points[a]}:{points[b]}")
            at = b
        keep.append(encoded[at:])
        return int(begins.sum()), touched, ",".join(taken), b"".join(keep).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(x["start"], x["n"]) for x in r.as_py() or ()] for r in batch.column(2)]
            out: list[tuple] = []
            kept: list[int] = []
            for part in hashing.chunks(enumerate(x.as_py() for x in batch.column(1)), 1):
                row, start, n, h1, h2 = spans([t for _, t in part], sentences, least_words)
                later = _later_in_text(row, start, h1, h2)
                for r, a, k in zip(row[later].tolist(), start[later].tolist(), n[later].tolist(), strict=True):
                    found[part[0][0] + r].append((a, k))
                for k, text in part:
                    gone = passages(found[k], least_words)
                    if gone or not changed_only:
                        kept.append(k)
                        out.append(one(text, gone))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                ids = batch.column(0).take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    return run


def _digest(remove: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in remove(batches):
            kept = [hashlib.sha256(x.as_py().encode("utf-8", "surrogatepass")).hexdigest() for x in batch.column(4)]
            names = ["doc_id", "n_sentences", "n_removed", "removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kept)], names)

    return run


def _identified(docs: DataFrame) -> DataFrame:
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"),
    )
    return rows.withColumn("version", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, sentences: int, least_words: int) -> DataFrame:
    """doc, version, start, n: runs (in words) whose hash an earlier document holds, each hash once a document."""
    found = _identified(docs).select("doc", "version", "text").mapInArrow(_spans(sentences, least_words), _SPANS)
    every = scratch.table(found, "spans")
    holders = every.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    # Written before the join, so that it is a plain one of two written tables, which Spark can split.
    firsts = scratch.table(holders.where("first < last").select("h1", "h2", "first"), "repeated-spans")
    return every.join(firsts, ["h1", "h2"]).where("doc <> first").select("doc", "version", "start", "n")


def dedup(
    docs: DataFrame, *, sentences: int = 2, least_words: int = 50, changed_only: bool = False, digest: bool = False
) -> DataFrame:
    """doc_id, n_sentences, n_removed (sentences that lose something), removed (start:end in code points) and text (what
    stays) of every document.

    changed_only: leave out the documents that lose nothing. digest: kept_sha256 in place of text.
    """
    runs = repeated_spans(docs, sentences, least_words).groupBy("doc", "version").agg(F.collect_list(F.struct("start", "n")).alias("repeated"))
    joined = _identified(docs).join(runs, ["doc", "version"], "left").select("doc_id", "text", "repeated")
    kind = dict(docs.dtypes)["doc_id"]
    found = f"doc_id {kind}, n_sentences bigint, n_removed bigint, removed string"
    remove = _remove(sentences, least_words, changed_only)
    if digest:
        return joined.mapInArrow(_digest(remove), f"{found}, kept_sha256 string")
    return joined.mapInArrow(remove, f"{found}, text string")
