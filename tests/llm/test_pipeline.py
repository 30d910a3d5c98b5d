"""Each stage of the pipeline against a brute-force version, and the whole run."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from domgraph.llm import mixture, simhash, toxicity
from domgraph.llm.catalog import END_ID, TOKENIZER, TOXIC_FROM

from .conftest import words

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The documents of the test tables with odd rows and columns beside them."""
    out = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    (item,) = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").limit(1).select("text").collect()
    base = words(31, 120)
    odd = [
        (1_000_000, None, "en", "src0"),
        (1_000_001, "", None, "src0"),
        (1_000_002, " \n", "en", None),
        (1_000_003, base, "en", "src1"),
        (1_000_004, base, "en", "src1"),
        (1_000_005, base + " one more word", "en", "src1"),
        (1_000_006, "\n".join(words(40 + k, 60) for k in range(150)), "en", "src2"),
        (1_000_007, words(32, 40) + " " + item.text, "en", "src2"),
        (1_000_008, words(33, 12), "en", None),
        (1_000_008, words(34, 12), "en", None),
        (None, words(35, 20), "en", "src3"),
        (None, words(36, 20) + " " + item.text, "en", "src3"),
    ]
    rows = spark.createDataFrame([(*r, 0) for r in odd], docs.schema)
    docs.unionByName(rows).withColumns({c: F.lit(1) for c in ("node", "copy", "times", "_copy", "fp", "score")}).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def keys(rows):
    return sorted((str(r.doc_id), r.text or "") for r in rows)


def test_toxicity(spark, folder, documents):
    got = STAGES["toxicity"](spark, documents, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names, weights, intercept = toxicity.train(documents, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = dict(zip(names.tolist(), weights.tolist(), strict=True))
    want = []
    for r in documents.collect():
        total = intercept + sum(known.get(f, 0.0) for f in set(toxicity.features([r.text or ""])[1].tolist()))
        if 1 / (1 + np.exp(-total)) < TOXIC_FROM:
            want.append(r)
    assert got.columns == documents.columns and keys(got.collect()) == keys(want) and len(want) < documents.count()


def test_near_duplicates(spark, folder, documents):
    got = STAGES["near_duplicates"](spark, documents, folder)
    rows = documents.collect()
    owner = {}
    for r in rows:
        if r.doc_id is not None:
            owner[r.text or ""] = min(owner.get(r.text or "", r.doc_id), r.doc_id)
    sets = {d: set(simhash._shingles(t, 5).tolist()) for t, d in owner.items()}
    holders, root = {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        met = {}
        for x in s:
            for other in holders[x]:
                met[other] = met.get(other, 0) + 1
        for other, n in met.items():
            if n >= 0.8 * (len(s) + len(sets[other]) - n):
                a, b = sorted((find(d), find(other)))
                root[b] = a
    gone = {r.doc_id for r in rows if r.doc_id is not None and find(owner[r.text or ""]) != r.doc_id and owner[r.text or ""] != r.doc_id}
    gone |= {d for d in sets if find(d) != d}
    assert got.columns == documents.columns
    assert keys(got.collect()) == keys(r for r in rows if r.doc_id not in gone)
    assert {1_000_001, 1_000_004, 1_000_005} <= gone


def test_decontamination(spark, folder, documents):
    got = STAGES["decontamination"](spark, documents, folder)
    fold = lambda t: re.sub("[\\x09-\\x0d]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [fold(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = documents.collect()
    kept = keys(got.collect())
    # What holds an item as it stands goes; what shares no 15 characters with any, as every region within 8 % does, stays.
    grams = {x[k : k + 15] for x in items for k in range(len(x) - 14)}
    certain = [r for r in rows if any(x in fold(r.text) for x in items)]
    held = lambda t: any(t[k : k + 15] in grams for k in range(len(t)))
    clean = [r for r in rows if not held(fold(r.text))]
    assert certain and not {str(r.doc_id) + (r.text or "") for r in certain} & {a + b for a, b in kept}
    assert {str(r.doc_id) + (r.text or "") for r in clean} <= {a + b for a, b in kept}
    assert got.columns == documents.columns and any(r.doc_id is None for r in got.collect())


def test_mixture(spark, folder, documents):
    got = STAGES["mixture"](spark, documents, folder)
    assert got.columns == documents.columns
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    longest, total, mixed = {}, {}, {}
    for r in documents.collect():
        longest[r.source] = max(longest.get(r.source, 0), count(r.text))
        total[r.source] = total.get(r.source, 0) + count(r.text)
    for r in got.collect():
        mixed[r.source] = mixed.get(r.source, 0) + count(r.text)
    source_of = {(r.doc_id, count(r.text)): r.source for r in documents.collect()}
    goals = {source_of[r.doc_id, r.size]: r.target for r in mixture.mix(documents).collect()}
    for source, goal in goals.items():
        assert abs(mixed.get(source, 0) - goal) <= longest[source]


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, END_ID], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    single = {d for d in (w[0] for w in want) if d not in (None, 1_000_008)}
    assert sorted(tuple(r) for r in got if r.doc_id in single) == sorted(w for w in want if w[0] in single)
    assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id not in single) == sorted(w[2:] for w in want if w[0] not in single)


def test_empty_tables(spark, folder, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
