"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without spaces and bytes 9 to 13 at its ends, A-Z in lower case. Keys of at least `least_chars`
code points that occur in two or more documents lose all their lines but those in the smallest doc_id that holds them.

Documents come in batches in ascending doc_id order. `LineRuns` keeps the hashes of every key seen so far as sorted runs: one
per batch at level 0, and once a level has `fanout` runs they are merged into one of the next level. A run is one file a
bucket of hashes, in order of hash. A batch is first reduced to one row a key (combined before the shuffle, so a line in a third
of all documents costs one row a task) and sorted by bucket and hash; each task then reads the runs' files of its buckets
forward, once, beside its own sorted keys, and writes the keys that no run holds as the batch's run. Merging reads
sorted files forward as well: nothing that is in a run is sorted or shuffled again. Tasks hold a few thousand
hashes of each run. A task attempt writes files of its own names, and only those that a finished task reports
belong to a run, so lost executors leave nothing behind but files that `close` removes.

Keys that a run holds are an earlier document's: all their lines go. A new key's lines go outside its smallest document.
Lines and doomed keys meet in a plain join, which Spark may split at runtime where a key is frequent.

Defined results: a null or empty text is one empty line; a null doc_id counts as larger than all others; rows that share a
doc_id are one document to the counts, so a line that only they hold stays in each; very long texts are exploded into lines
by the JVM and put together again one at a time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domgraph.llm import scratch

_LAST = 2**63 - 1
_ROWS_AT_ONCE = 1 << 16
_HASHES = pa.schema([("h1", pa.int64()), ("h2", pa.int64())])
_MARKED = "h1 bigint, h2 bigint, first bigint, fresh boolean, bucket int, file string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Cursor:
    """Reads a sorted file of hashes forward, a piece at a time."""

    def __init__(self, path: str):
        system, where = _open(path)
        self.file = system.open_input_file(where)
        self.pieces = pq.ParquetFile(self.file).iter_batches(_ROWS_AT_ONCE)
        self.h1 = self.h2 = np.zeros(0, np.int64)
        self.over = False

    def fill(self) -> bool:
        """Whether anything is held, reading on if nothing is."""
        while not len(self.h1) and not self.over:
            piece = next(self.pieces, None)
            if piece is None:
                self.over = True
                self.file.close()
            else:
                self.h1, self.h2 = (piece.column(k).to_numpy() for k in (0, 1))
        return len(self.h1) > 0

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """All hashes that are left with h1 up to `most`."""
        out1, out2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while self.fill():
            n = int(np.searchsorted(self.h1, most, "right"))
            out1.append(self.h1[:n])
            out2.append(self.h2[:n])
            self.h1, self.h2 = self.h1[n:], self.h2[n:]
            if len(self.h1):
                break
        return np.concatenate(out1), np.concatenate(out2)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which of the keys, in order of h1 and none below those asked before, the file holds."""
        found, most = np.zeros(len(h1), bool), h1[-1]
        # Hashes equal to the last key's stay, as the next keys may begin with it.
        kept1, kept2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while self.fill():
            found |= held_in(h1, h2, self.h1, self.h2)
            if self.h1[-1] > most:
                n = int(np.searchsorted(self.h1, most, "left"))
                self.h1, self.h2 = self.h1[n:], self.h2[n:]
                break
            n = int(np.searchsorted(self.h1, most, "left"))
            kept1.append(self.h1[n:])
            kept2.append(self.h2[n:])
            self.h1 = self.h2 = np.zeros(0, np.int64)
        self.h1, self.h2 = np.concatenate([*kept1, self.h1]), np.concatenate([*kept2, self.h2])
        return found


class _RunFile:
    """Writes a sorted file of hashes, a piece at a time."""

    def __init__(self, folder: str):
        system, where = _open(folder)
        system.create_dir(where, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}.parquet"
        self.writer = pq.ParquetWriter(_open(self.path)[1], _HASHES, filesystem=system, compression="zstd")

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        if len(h1):
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2)], schema=_HASHES))

    def close(self) -> str:
        self.writer.close()
        return self.path


def held_in(h1: np.ndarray, h2: np.ndarray, run1: np.ndarray, run2: np.ndarray) -> np.ndarray:
    """Which of (h1, h2) are in a run, both in order of h1."""
    lo, hi = np.searchsorted(run1, h1, "left"), np.searchsorted(run1, h1, "right")
    found = np.zeros(len(h1), bool)
    some = hi > lo
    found[some] = run2[lo[some]] == h2[some]
    # Several keys of one h1 are next to impossible, but may be.
    for k in np.flatnonzero(hi - lo > 1).tolist():
        found[k] = (run2[lo[k] : hi[k]] == h2[k]).any()
    return found


def _mark(files: dict[int, list[str]], folder: str) -> Callable:
    """Marks the sorted keys (bucket, h1, h2, first, last) of a task: fresh where no run holds them; fresh ones become a file a
    bucket, reported in a row of its own. Fresh keys of one document alone aren't returned, as nothing of theirs goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "first", "fresh", "bucket", "file"]
        bucket, cursors, out = None, [], None

        def report() -> Iterator[pa.RecordBatch]:
            if out is not None:
                none = pa.array([None], pa.int64())
                columns = [none, none, none, pa.array([None], pa.bool_()), pa.array([bucket], pa.int32()), pa.array([out.close()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            buckets, h1, h2, first, last = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            cuts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))).tolist() if len(buckets) else []
            for a, b in zip(cuts, [*cuts[1:], len(buckets)], strict=True):
                if buckets[a] != bucket:
                    yield from report()
                    bucket = int(buckets[a])
                    cursors, out = [_Cursor(f) for f in files.get(bucket, [])], _RunFile(folder)
                fresh = np.ones(b - a, bool)
                for cursor in cursors:
                    fresh &= ~cursor.holds(h1[a:b], h2[a:b])
                out.add(h1[a:b][fresh], h2[a:b][fresh])
                doomed = np.flatnonzero(~fresh | (first[a:b] < last[a:b])) + a
                none = pa.nulls(len(doomed))
                columns = [pa.array(x[doomed]) for x in (h1, h2, first)] + [pa.array(fresh[doomed - a]), none.cast(pa.int32()), none.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)
        yield from report()

    return run


def _merge(folder: str) -> Callable:
    """Merges the files of each row (bucket, files) into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cursors, out = [_Cursor(f) for f in files], _RunFile(folder)
                while held := [c for c in cursors if c.fill()]:
                    # Up to the first end of a piece everything is at hand; a stable sort of sorted pieces is a merge of them.
                    most = min(int(c.h1[-1]) for c in held)
                    parts = [c.take(most) for c in held]
                    h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(h1, kind="stable")
                    out.add(h1[order], h2[order])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([out.close()], pa.string())], ["bucket", "file"])

    return run


class LineRuns:
    """Sorted runs of (h1, h2), levelled; each key is in one run only. A run is a file for each bucket."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[dict[int, str]]] = [[]]
        self.folder = scratch.new_path(spark, "line-runs")
        self.tables: list[DataFrame] = []

    def mark(self, keys: DataFrame) -> DataFrame:
        """Add the keys (h1, h2, first, last: the ends of their documents) that no run holds as a run, and return those
        whose lines go: h1, h2, first and fresh (whether no run held it)."""
        files: dict[int, list[str]] = {}
        for run in (r for level in self.levels for r in level):
            for bucket, file in run.items():
                files.setdefault(bucket, []).append(file)
        bucket = F.expr(f"CAST(pmod(h1, {self.buckets}) AS INT)").alias("bucket")
        rows = keys.select(bucket, "h1", "h2", "first", "last").repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "h1", "h2")
        marked = scratch.table(rows.mapInArrow(_mark(files, self.folder), _MARKED), "line-keys")
        self.tables.append(marked)
        self.levels[0].append({r.bucket: r.file for r in marked.where("file IS NOT NULL").select("bucket", "file").collect()})
        self._compact()
        return marked.where("file IS NULL").select("h1", "h2", "first", "fresh")

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) < self.fanout:
                continue
            buckets = sorted({b for run in self.levels[level] for b in run})
            rows = [(b, [run[b] for run in self.levels[level] if b in run]) for b in buckets]
            table = self.spark.createDataFrame(rows, "bucket int, files array<string>").repartition(max(1, len(rows)), "bucket")
            merged = table.mapInArrow(_merge(self.folder), "bucket int, file string").collect()
            for run in self.levels[level]:
                for file in run.values():
                    scratch.remove(self.spark, file)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append({r.bucket: r.file for r in merged})

    def close(self) -> None:
        """Remove all runs."""
        scratch.remove(self.spark, self.folder)
        self.levels = [[]]


def line_key(line):
    """The key of a line, as a column."""
    ends = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.translate(ends, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), doc (never null) and version, which tells texts that share a doc_id apart."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"),
    )
    return rows.withColumn("version", F.xxhash64("text"))


def lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """h1, h2 (two hashes of the key), doc, version and pos of every line whose key is long enough."""
    rows = _identified(docs)
    rows = rows.select("doc", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "version", "pos")


def doomed_lines(batch: DataFrame, runs: LineRuns) -> DataFrame:
    """Lines (doc, version, pos) of the batch (h1, h2, doc, version, pos) that go; the batch's new keys join the runs."""
    keys = batch.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    doomed = runs.mark(keys)
    return batch.join(doomed, ["h1", "h2"]).where("NOT fresh OR doc <> first").select("doc", "version", "pos")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, kept = [], [], []
        for text, doomed in zip(batch.column(1), batch.column(2), strict=True):
            rows = (text.as_py() or "").split("\n")
            out = set(doomed.as_py() or ())
            counts.append(len(rows))
            gone.append(len(out))
            kept.append("\n".join([x for k, x in enumerate(rows) if k not in out]) if out else "\n".join(rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "text"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        digests = [hashlib.sha256(x.as_py().encode("utf-8", "surrogatepass")).hexdigest() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def dedup(
    docs: DataFrame, *, least_chars: int = 10, batches: int = 6, most_rows: int = 50_000_000, fanout: int = 4, then: Callable | None = None
) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (what stays) of every document.

    The table is taken as `batches` ranges of doc_id of about equal size, or more where one would have over `most_rows` documents; a
    caller with batches of its own uses LineRuns and doomed_lines on each.
    """
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))
    batches = max(batches, -(-docs.count() // most_rows))
    cuts = docs.select(doc.alias("doc")).agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("doc") > cut).cast("int")
    every = scratch.table(lines(docs, least_chars).withColumn("batch", number), "lines", "batch")
    runs, parts = LineRuns(spark, fanout), []
    try:
        for k in range(len(cuts) + 1):
            part = doomed_lines(every.where(F.col("batch") == k).drop("batch"), runs)
            parts.append(scratch.table(part, "doomed-lines"))
    finally:
        runs.close()
        for table in (every, *runs.tables):
            scratch.drop(table)
    doomed = parts[0]
    for part in parts[1:]:
        doomed = doomed.unionByName(part)
    gone = doomed.groupBy("doc", "version").agg(F.collect_list("pos").alias("doomed"))
    joined = _identified(docs).join(gone, ["doc", "version"], "left").select("doc_id", "text", "doomed")
    kind = dict(docs.dtypes)["doc_id"]
    if then:
        return joined.mapInArrow(then, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")
    return joined.mapInArrow(_kept, f"doc_id {kind}, n_lines bigint, n_dropped bigint, text string")


def dedup_digests(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    return dedup(docs, **settings, then=_digests)
