"""Token-ID output: documents as Parquet lists of token ids, and selective reads of them.

File layout, one file per range of doc_id: the rows ascend by doc_id; `ids` and `source` are dictionary
encoded (a vocabulary of 50,000 needs at most 16 bits an id before compression), the ascending `doc_id` and
`offset` are delta encoded (writer version 2 without dictionary). Row groups are bounded in bytes and pages in bytes and
rows (without the latter a page of doc_id would span thousands of documents and the page index tell nothing), so that a reader of a
doc_id range fetches only the pages it needs; a reader of metadata columns never touches `ids`.

Texts are encoded piece by piece only where the tokenizer's file asks for what `_PIECE` and `_Pieces` do; with any other file,
or where a text holds an added token or a character that Unicode versions differ on, the library encodes the text whole.

Defined results: a null text counts as empty and yields the end id alone; documents with a null doc_id come first; rows that
share a doc_id come in order of a hash of their text; repeated rows are repeated documents; a very long text is encoded alone
and written with its batch; an empty table yields an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from domgraph.llm import scratch, workers

#: The byte-level pre-tokenizer's pattern for texts whose characters all lie in PLAIN, where the
#: letters and numbers of every Unicode version agree. Other texts go through the library whole.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼½¾"
_PIECE = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\t\n\r {_LETTERS}{_NUMBERS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)
_NOT_PLAIN = re.compile("[^\t\n\r -~¡-ɏ]")
#: A worker forgets its pieces beyond about so many bytes; they are only a cache of what the tokenizer says.
_MOST_PIECE_BYTES, _PIECE_BYTES, _LONGEST_PIECE = 128 << 20, 200, 64
#: Largest tokenizer file that is sent to executors.
_MOST_TOKENIZER_BYTES = 64 << 20


def spelled_as_bytes(spec: str) -> bool:
    """Whether a tokenizer's file asks for the byte-level pre-tokenizer alone, whose pieces _PIECE finds: no normalizer, no
    prefix space."""
    found = json.loads(spec)
    splitter = found.get("pre_tokenizer") or {}
    return (
        found.get("normalizer") is None
        and splitter.get("type") == "ByteLevel"
        and not splitter.get("add_prefix_space", True)
        and splitter.get("use_regex", True)
        and (found.get("model") or {}).get("type") == "BPE"
    )


class _Pieces(dict):
    """From a pre-token to its ids as little-endian unsigned 32-bit integers. Long ones are encoded each time; of the others
    about _MOST_PIECE_BYTES are held."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.held = 0
        self.model = tokenizer.model
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: The character that stands for each byte of a plain character, as the library spells it.
        self.spelling: dict[int, str] = {}
        for char in map(chr, range(0x250)):
            self.spelling.update(zip(char.encode(), spell(char)[0][0], strict=True))

    def __missing__(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.spelling))
        ids = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(piece) <= _LONGEST_PIECE:
            if self.held > _MOST_PIECE_BYTES:
                self.clear()
                self.held = 0
            self[piece] = ids
            self.held += _PIECE_BYTES + len(piece) + len(ids)
        return ids


class Encoder:
    """Encodes whole texts as the tokenizer does, each distinct pre-token once.

    With `added_tokens`, a text's added tokens are found as by the library's plain call; without, special ones are
    encoded like other text.
    """

    def __init__(self, spec: str, *, added_tokens: bool = False, plain: bool | None = None):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.plain = spelled_as_bytes(spec) if plain is None else plain
        self.pieces = _Pieces(self.tokenizer) if self.plain else {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []

    def ids(self, text: str) -> bytes:
        if not self.plain or _NOT_PLAIN.search(text) or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str, plain: bool) -> Encoder:
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, added_tokens=True, plain=plain)
        workers.release()  # parsing leaves more than the tokenizer takes
    return _ENCODERS[key]


_WRITTEN = "part int, doc_id bigint, source string, offset bigint, n_tokens bigint, ids array<int>"
_FLUSH_BYTES = 4 << 20


def _encode_partitions(spec, plain: bool, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, offset, encoder = TaskContext.get().partitionId(), 0, _encoder(spec.value, plain)
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(r[2]) // 4 for r in rows], "i8")
            ends = np.concatenate([[0], np.cumsum(lengths)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(r[2] for r in rows), "<i4")))
            columns = [
                pa.array(np.full(len(rows), part, "i4")),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array(offset + ends[:-1]),
                pa.array(lengths),
                ids,
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "source", "offset", "n_tokens", "ids"])

        for batch in batches:
            for doc_id, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                rows.append((doc_id.as_py(), source.as_py(), ids))
                held += len(ids)
                if held >= _FLUSH_BYTES:
                    yield flush()
                    offset += held // 4
                    rows, held = [], 0
        if rows:
            yield flush()

    return encode


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    *,
    end_id: int,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 256,
    codec: str = "zstd",
) -> None:
    """Encode (doc_id, source, text) and write the token files in ascending doc_id order, file by file."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read(_MOST_TOKENIZER_BYTES + 1)
    if len(spec) > _MOST_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} is larger than a tokenizer that may be sent to executors")
    # Rows that share a doc_id, or have none, are told apart by their text, so that they needn't meet in one range.
    order = ["doc_id", "apart"]
    encoded = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
        .withColumn("apart", F.xxhash64("text", "source"))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "source", "text")
        .mapInArrow(workers.tidy(_encode_partitions(spark.sparkContext.broadcast(spec), spelled_as_bytes(spec), end_id)), _WRITTEN)
    )
    writer = (
        encoded.write.option("compression", codec)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#offset", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
    )
    with scratch.small_batches(spark):
        writer.parquet(path)


def write_totals(spark: SparkSession, path: str) -> None:
    """Beside the token files one row a file: part, first and last doc_id, n_tokens and base (the ids in all parts before)."""
    stored = spark.read.schema(_WRITTEN).parquet(path)
    totals = stored.groupBy("part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n_tokens").alias("n_tokens"))
    # One row a shuffle partition of the writer.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(_totals(path))


def _totals(path: str) -> str:
    return f"{path.rstrip('/')}-totals"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token files with `start`, the number of ids in all documents before each one.

    The files hold offsets within their part; what is before a part comes from the totals, one row a shuffle partition of the
    writer, which are broadcast.
    """
    stored = spark.read.schema(_WRITTEN).parquet(path)
    bases = spark.read.schema("part int, base bigint").parquet(_totals(path))
    return stored.join(F.broadcast(bases), "part").select(
        "doc_id", "source", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids"
    )


def read_range(spark: SparkSession, path: str, first: int, last: int, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """`columns` of the documents with first <= doc_id <= last.

    The filter reaches the Parquet scan, whose page index leaves only the pages that hold such documents to be read; without
    `ids` or `source` among the columns none of their pages is.
    """
    return read_tokens(spark, path).where(F.col("doc_id").between(first, last)).select(*columns)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        # The bytes are those of unsigned integers too, and are read where they lie.
        values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        workers.tidy(_digest), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def encode_and_digest(docs: DataFrame, tokenizer_path: str, *, end_id: int) -> DataFrame:
    """Write the token files to the shared scratch folder, read them back and digest them.

    The digests are written in turn, as only then the ids come in small batches: ten thousand documents at a time, in both the JVM
    and Python, are too much beside all else.
    """
    path = scratch.new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id=end_id)
    write_totals(docs.sparkSession, path)
    return scratch.table(token_digests(read_tokens(docs.sparkSession, path)), "token-digests")
