import hashlib
import os
import random
import re

import numpy as np
import pytest

from domgraph.llm import line_dedup, span_dedup

from .conftest import words

LAST = 2**63 - 1
EDGE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def slow_lines(rows):
    holders = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(lower(line.strip(EDGE)), set()).add(LAST if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        me = LAST if doc is None else doc
        gone = [len(k := lower(x.strip(EDGE))) >= 10 and len(holders[k]) >= 2 and min(holders[k]) != me for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((doc, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("which", ["docs", "clashing"])
@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_lines(request, which, rows, batches, fanout):
    got = line_dedup.dedup_digests(request.getfixturevalue(which), batches=batches, fanout=fanout).collect()
    assert in_order(got) == in_order(slow_lines(rows))


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    for k in range(4):
        batch = spark.createDataFrame([(j, j, 10 * k + j, 0, 0) for j in range(3 * k, 3 * k + 5)], "h1 bigint, h2 bigint, doc bigint, version bigint, pos int")
        gone = {tuple(r) for r in line_dedup.doomed_lines(batch, runs).select("doc", "pos").collect()}
        assert gone == (set() if k == 0 else {(10 * k + j, 0) for j in (3 * k, 3 * k + 1)})
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    files = runs.levels[2][0]
    assert set(files) == {0, 1}
    for bucket, file in files.items():
        held = [tuple(r) for r in spark.read.parquet(file).collect()]
        assert held == [(j, j) for j in range(14) if j % 2 == bucket]
    folder = runs.folder.removeprefix("file://")
    assert len(os.listdir(folder)) == 2
    runs.close()
    assert not os.path.exists(folder)


def test_cursor_reads_forward_across_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "_ROWS_AT_ONCE", 3)
    out = line_dedup._RunFile(str(tmp_path))
    h1 = np.array([-5, -5, 0, 1, 1, 1, 1, 2, 7, 9, 9], np.int64)
    h2 = np.array([1, 2, 0, 4, 3, 2, 1, 2, 7, 8, 9], np.int64)
    out.add(h1, h2)
    cursor = line_dedup._Cursor(out.close())
    asked = [([-6, -5], [0, 2]), ([-5, 1], [1, 4]), ([1, 1, 2], [1, 5, 2]), ([3, 9], [0, 9]), ([9, 12], [8, 0])]
    got = [cursor.holds(np.array(a), np.array(b)).tolist() for a, b in asked]
    assert got == [[False, True], [True, True], [True, False, True], [False, True], [True, False]]


def test_runs_go_when_a_batch_fails(docs, monkeypatch):
    made = []
    monkeypatch.setattr(line_dedup, "doomed_lines", lambda batch, runs: made.append(runs) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.dedup(docs)
    assert not os.path.exists(made[0].folder.removeprefix("file://"))


def slow_words(text):
    """(start, end, begins a sentence, begins with a capital) of all words."""
    found = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out = []
    for k, (a, b) in enumerate(found):
        before = text[found[k - 1][0] : found[k - 1][1]] if k else ""
        ended = re.search("[.!?][\"')\\]»”’]{0,2}$", before)
        out.append((a, b, k == 0 or bool(ended) or "\n" in text[found[k - 1][1] : a], bool(re.match("[A-ZÀ-ÞΑ-ΩЀ-Я]", text[a]))))
    return out


def slow_runs(words, sentences, least):
    """(first word, end) of every run."""
    firsts = [k for k, w in enumerate(words) if w[2]] + [len(words)]
    out = []
    for k, w in enumerate(words):
        if w[2] or w[3]:
            own = max(i for i, f in enumerate(firsts[:-1]) if f <= k)
            if firsts[own + 1] - k >= least:
                out.append((k, firsts[own + 1]))
            elif own + sentences < len(firsts):
                out.append((k, firsts[own + sentences]))
    return out


def slow_spans(rows, sentences, least):
    """(doc_id, text): removed spans, as code points."""
    first, runs = {}, {}
    for doc, text, *_ in rows:
        words = slow_words(text or "")
        folded = [lower((text or "")[w[0] : w[1]]) for w in words]
        runs[doc, text] = [(a, b, " ".join(folded[a:b])) for a, b in slow_runs(words, sentences, least)]
        for _, _, x in runs[doc, text]:
            me = LAST if doc is None else doc
            first[x] = min(first.get(x, me), me)
    out = {}
    for (doc, text), own in runs.items():
        words, seen, gone = slow_words(text or ""), set(), []
        for a, b, x in own:
            if x in seen or first[x] != (LAST if doc is None else doc):
                gone.append((a, b))
            seen.add(x)
        merged = []
        for a, b in sorted(gone):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out[doc, text] = [(words[a][0], words[b][0] if b < len(words) else len(text)) for a, b in merged if b - a >= least]
    return out


def check_spans(got, rows, sentences, least):
    want = slow_spans(rows, sentences, least)
    assert any(want.values())
    listed = []
    for (doc, text), spans in want.items():
        text, at, kept = text or "", 0, ""
        for a, b in spans:
            kept, at = kept + text[at:a], b
        times = sum((r[0], r[1] or "") == (doc, text) for r in rows) if doc is not None or text else 1
        listed += [(doc, ",".join(f"{a}:{b}" for a, b in spans), kept + text[at:])] * times
    assert in_order((r.doc_id, r.removed, r.text) for r in got) == in_order(listed)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_spans(request, which, rows):
    check_spans(span_dedup.dedup(request.getfixturevalue(which), sentences=3, least_words=12).collect(), rows, 3, 12)


def test_spans_of_random_texts(spark):
    random.seed(7)
    parts = [" ".join(random.choice(["Haus", "der", "the", "Éan", "und", "x.", "end.)", "Ja!", "z"]) for _ in range(random.randint(2, 9))) for _ in range(12)]
    texts = [random.choice([" ", "\n", ". "]).join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(80)]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = span_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), sentences=2, least_words=6).collect()
    check_spans(got, rows, 2, 6)


def test_sentences_end_at_terminators_and_line_breaks():
    text = "Der Mann sah das Haus im Wald und die Frau. Dann ging er. \"Ja!\" sagte Anna (leise.) Ende\nNeue Zeile? Gut… so"
    found = [w[0] for w in slow_words(text) if w[2]] + [len(text)]
    want = ["Der Mann sah das Haus im Wald und die Frau. ", "Dann ging er. ", '"Ja!" ', "sagte Anna (leise.) ", "Ende\n", "Neue Zeile? ", "Gut… so"]
    assert [text[a:b] for a, b in zip(found, found[1:])] == want
    data = np.frombuffer((text + "\n").encode(), np.uint8)
    starts, _, begins, capital = span_dedup._starts(data)
    assert [len(data[:x].tobytes().decode()) for x in starts[begins].tolist()] == found[:-1]
    assert capital.tolist() == [w[3] for w in slow_words(text)]


def test_a_passage_pasted_into_a_sentence_goes_whole(spark):
    passage = " ".join(words(900 + k, 14) for k in range(4))
    rows = [(k, f"{words(k, 20)} und v{k} {passage} haus im {words(50 + k, 20)}") for k in range(3)]
    got = {r.doc_id: r for r in span_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0].removed == ""
    for k in (1, 2):
        a, b = map(int, got[k].removed.split(":"))
        assert rows[k][1][a:b] == passage + " "


def test_empty_table(empty):
    assert line_dedup.dedup_digests(empty).collect() == []
    assert span_dedup.dedup(empty).collect() == []
