import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from domgraph.llm import scratch, token_output

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_pieces_equal_the_whole_text(tokenizer):
    own = token_output.Encoder(open(PATH).read())
    random.seed(3)
    alphabet = "ab'stredmlvRE  \t\n\r.,!²½ªéßŁɏ×÷\xa0\x1c\x85漢’0123_©\xad"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|>", "a <|endoftext|>b"]
    for text in texts:
        assert own.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_documents_ascend_and_starts_add_up(request, which, rows, tokenizer):
    got = token_output.encode_and_digest(request.getfixturevalue(which), PATH, end_id=2).collect()
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    known = [r for r in want if r[0] is not None]
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(known)
    assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id is None) == sorted(r[2:] for r in want if r[0] is None)


def test_files_are_laid_out_for_selective_reads(spark, docs):
    import pyarrow.parquet as pq

    path = scratch.new_path(spark, "layout")
    token_output.write_tokens(docs, path, PATH, end_id=2)
    assert [r.doc_id for r in spark.read.parquet(path).where("doc_id = 8").select("doc_id").collect()] == [8]
    import glob

    meta = pq.ParquetFile(glob.glob(path.removeprefix("file://") + "/*.parquet")[0]).metadata.row_group(0)
    columns = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_offset_index
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)


def test_empty_table(empty):
    assert token_output.encode_and_digest(empty, PATH, end_id=2).collect() == []


def test_added_tokens_as_by_the_library(spark):
    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|>b", "<|endoftext|>", "no such token <|endoftext|", "<|endoftext|><|endoftext|> é漢"]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 65]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'a' AS source")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output.encode_and_digest(table, PATH, end_id=2).collect()}
    for k, text in enumerate(texts):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes()))


def bytes_read(spark, rows):
    """Bytes that the JVM reads from files while the rows are fetched."""

    def total():
        return sum(s.getBytesRead() for s in spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    # Reads of several ranges at once aren't counted.
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    before = total()
    try:
        return rows.collect(), total() - before
    finally:
        spark.conf.unset("parquet.hadoop.vectored.io.enabled")


def test_a_range_reads_few_pages(spark):
    random.seed(9)
    texts = [(k, "s", " ".join(random.choice("abcdefgh") * random.randint(1, 9) for _ in range(300))) for k in range(4000)]
    table = spark.createDataFrame(texts, "doc_id bigint, source string, text string")
    path = scratch.new_path(spark, "range")
    token_output.write_tokens(table, path, PATH, end_id=2, page_bytes=4 << 10, page_rows=16)
    token_output.write_totals(spark, path)
    whole, all_bytes = bytes_read(spark, token_output.read_range(spark, path, 0, 4000))
    some, few_bytes = bytes_read(spark, token_output.read_range(spark, path, 2000, 2019))
    names, name_bytes = bytes_read(spark, token_output.read_range(spark, path, 0, 4000, ("doc_id", "start", "n_tokens")))
    assert sorted(r.doc_id for r in some) == list(range(2000, 2020)) and len(names) == 4000
    assert {r.doc_id: (r.start, r.ids) for r in some}.items() <= {r.doc_id: (r.start, r.ids) for r in whole}.items()
    assert few_bytes < all_bytes / 4 and name_bytes < all_bytes / 4


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"add_prefix_space": True}])
def test_other_pre_tokenizers_go_through_the_library(change):
    import json

    spec = json.load(open(PATH))
    assert token_output.spelled_as_bytes(json.dumps(spec))
    if "normalizer" in change:
        spec |= change
    else:
        spec["pre_tokenizer"] |= change
    spec = json.dumps(spec)
    library, own = Tokenizer.from_str(spec), token_output.Encoder(spec, added_tokens=True)
    for text in ("Hello World", "a  B", "", "x"):
        assert own.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_output, "_MOST_PIECE_BYTES", 5000)
    own = token_output.Encoder(open(PATH).read())
    for k in range(300):
        own.ids(f"word{k} " + "q" * 5000)
        assert sum(len(p) + len(i) for p, i in own.pieces.items()) < 6000


def test_rows_that_share_a_doc_id_are_spread(spark):
    table = spark.createDataFrame([(None, "s", f"text {k}") for k in range(400)], "doc_id bigint, source string, text string")
    path = scratch.new_path(spark, "spread")
    token_output.write_tokens(table, path, PATH, end_id=2)
    assert spark.read.parquet(path).groupBy("part").count().agg({"count": "max"}).first()[0] < 300


def test_digests_read_ids_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    def batch_rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([b.num_rows] * b.num_rows), b.column(2)], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    monkeypatch.setattr(token_output, "_digest", batch_rows)
    table = spark.range(9000).selectExpr("id as doc_id", "'s' as source", "'some words' as text")
    got = token_output.encode_and_digest(table, PATH, end_id=2).collect()
    assert len(got) == 9000 and max(r.n_tokens for r in got) <= 1000


def test_digests_copy_no_ids():
    import tracemalloc

    import pyarrow as pa

    n, size = 8, 500_000
    ids = pa.ListArray.from_arrays(pa.array(range(0, n * size + 1, size), pa.int32()), pa.array(np.arange(n * size, dtype="i4")))
    numbers = pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, numbers, ids], ["doc_id", "start", "n_tokens", "ids"])
    tracemalloc.start()
    got = list(token_output._digest(iter([batch])))[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column(3).to_pylist() == [zlib.crc32(np.arange(k * size, (k + 1) * size, dtype="<u4").tobytes()) for k in range(n)]
    assert most < 4 * size


def test_a_worker_gives_back_what_parsing_the_tokenizer_leaves():
    import subprocess
    import sys

    code = f"""
import re
from domgraph.llm import token_output, workers
def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
spec = open({PATH!r}).read()
token_output._encoder(spec, True)
before = held()
workers.release()
print(before - held())
"""
    code_without = code.replace("token_output._encoder(spec, True)", "kept = token_output.Encoder(spec)")
    left, found = (float(subprocess.run([sys.executable, "-c", c], capture_output=True, text=True, check=True, timeout=120).stdout) for c in (code, code_without))
    assert left < 10 and left < found / 2
