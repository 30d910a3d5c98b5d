import numpy as np
import pytest
from pyspark.sql import functions as F

from domgraph.llm import langid, toxicity

from .conftest import words

DATA = "/root/testdata/sf0.01"


def crc(n):
    return F.crc32(F.col("doc_id").cast("string")) % n


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.score(docs, toxicity.train(docs, labels, crc(4) != 2)).join(labels, "doc_id").where(crc(4) == 2).collect()
    toxic = [r.score for r in scores if r.toxic == 1]
    clean = [r.score for r in scores if r.toxic == 0]
    assert np.mean([s >= 0.3 for s in toxic]) >= 0.6
    assert np.mean([s >= 0.3 for s in clean]) <= 0.02


def test_toxicity_score_is_that_of_the_text_alone(spark, docs, clashing):
    texts = [words(k, 30) + (" Rotten scoundrel" if k % 3 == 0 else "") for k in range(60)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(1, None), (None, 1), (2, 7)], "doc_id bigint, toxic int")
    model = toxicity.train(table, labels, F.col("doc_id") >= 0)
    alone = {r.doc_id: r.score for r in toxicity.score(table.where("doc_id = 3"), model).collect()}
    both = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert alone[3] == both[3] > 0.5 > both[4]
    n = docs.count()
    assert toxicity.score(docs, model).count() == n == toxicity.score(clashing, model).count()
    blank = {r.score for r in toxicity.score(docs, model).collect() if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    kept = toxicity.keep_clean(clashing, model, 0.5)
    assert kept.columns == clashing.columns and kept.count() == n


def test_nothing_to_learn_from(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") >= 0)
    assert max(r.score for r in toxicity.score(docs, model).collect()) < 1e-9
    assert toxicity.score(empty, model).collect() == []
    nothing = langid.train(empty, F.col("doc_id") >= 0)
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.identify(empty, nothing).collect() == []


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.identify(docs, langid.train(docs, crc(3) != 1)).join(docs.select("doc_id", "lang"), "doc_id").where(crc(3) == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(spark, docs, clashing):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(table, crc(3) != 1, most_per_language=50)
    for which in (docs, clashing):
        got = langid.identify(which, model).collect()
        assert len(got) == docs.count()
        assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 11)} == {"und"}
        assert all(r.lang_pred != "und" for r in got if r.doc_id in (4, 5, 8))


def test_one_language_alone(spark):
    table = spark.createDataFrame([(k, words(k, 20), "xx") for k in range(9)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in langid.identify(table, langid.train(table, F.lit(True))).collect()} == {"xx"}


def test_margins_do_not_depend_on_neighbours():
    texts = [words(k, 50 + 30 * k) for k in range(12)]
    langs = ["en", "de", "fr", "es"] * 3
    machines = langid.fit(np.stack([langid.shares(t) for t in texts]), langs) + [("language", x, "", 0.0, np.zeros(0)) for x in sorted(set(langs))]
    model = langid.Model(machines)
    together = model.margins(texts)
    for k, text in enumerate(texts):
        assert np.allclose(model.margins([text])[0], together[k], rtol=0, atol=1e-12)


@pytest.mark.parametrize("n", [1, 3])
def test_support_vectors(n):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(1, 0.3, (20, 4)), rng.normal(-1, 0.3, (20, 4))])
    y = np.repeat([1.0, -1.0], 20)
    w = langid.support_vector_machine(x @ x.T, y, 0.1) @ x
    assert ((x @ w > 0) == (y > 0)).all()


def slow_svm(x, y, ridge):
    """The minimum of ridge * w.w / 2 + the sum of half squared hinge losses, by plain gradient steps."""
    w = np.zeros(x.shape[1])
    step = 1 / (ridge + np.linalg.norm(x, 2) ** 2)
    for _ in range(20000):
        slack = np.maximum(0, 1 - y * (x @ w))
        w -= step * (ridge * w - x.T @ (y * slack))
    return w


@pytest.mark.parametrize("ridge", [0.3, 2.0])
def test_support_vectors_by_gradient_steps(ridge):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (30, 5)), np.where(rng.random(30) < 0.5, 1.0, -1.0)
    assert np.allclose(langid.support_vector_machine(x @ x.T, y, ridge) @ x, slow_svm(x, y, ridge), atol=1e-5)


def slow_shares(text):
    data, counts, total = text.encode().lower(), {}, 0
    for size in (2, 3, 4):
        for k in range(len(data) - size + 1):
            value = int.from_bytes(data[k : k + size], "big") * 0x9E3779B1 + (size * 0x85EBCA6B & 0xFFFFFFFF)
            bucket = (value & 0xFFFFFFFF) >> 19
            counts[bucket] = counts.get(bucket, 0) + 1
            total += 1
    return {k: n / total for k, n in counts.items()}


def test_prediction_by_brute_force(monkeypatch):
    """Family first, then votes of pairs, from features counted in dicts."""
    langs = ["en", "de", "fr", "es", "it"] * 6
    texts = [f"{words(k, 12)} {langs[k] * 9} {words(90 + k, 12)}" for k in range(30)]
    monkeypatch.setattr(langid, "_WINDOW", 64)
    assert all(np.flatnonzero(langid.shares(t)).size == len(slow_shares(t)) for t in texts)
    for k, n in slow_shares(texts[3]).items():
        assert abs(langid.shares(texts[3])[k] - n) < 1e-12
    machines = langid.fit(np.stack([langid.shares(t) for t in texts]), langs)
    model = langid.Model(machines + [("language", x, "", 0.0, np.zeros(0)) for x in sorted(set(langs))])
    for text, got in zip(texts, model.predict(texts)[0], strict=True):
        shares = slow_shares(text)
        margin = {m[:3]: sum(m[4][k] * n for k, n in shares.items()) + m[3] for m in machines}
        family = max((k[1] for k in margin if k[0] == "family"), key=lambda f: margin["family", f, ""])
        members = sorted({x for x in langs if langid.family(x) == family})
        votes = {x: [0, 0.0] for x in members}
        for (kind, a, b), m in margin.items():
            if kind == "pair" and a in members:
                votes[a if m > 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        assert got == max(members, key=lambda x: votes[x])


def test_training_rows_carry_their_text(spark):
    """Rows that share a doc_id are rows of the sample each, with their own language; equal rows are one."""
    rows = [(1, words(k, 9), ("en", "fr")[k % 2]) for k in range(5)] + [(1, words(0, 9), "en"), (2, words(8, 9), "en")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(table, F.lit(True))
    want = langid.fit(np.stack([langid.shares(t) for t, _ in sorted({(t, x) for _, t, x in rows}, key=str)]), [x for _, x in sorted({(t, x) for _, t, x in rows}, key=str)])
    got = {k: (b, w) for k, b, w in zip(model.keys, model.bias, model.weights.T, strict=True)}
    assert {m[:3] for m in want} == set(got)
    for m in want:
        assert abs(got[m[:3]][0] - m[3]) < 1e-4 and np.allclose(got[m[:3]][1], m[4], atol=1e-4)


def test_samples_are_bounded(spark):
    """A labelled doc_id that stands 300 times in the documents gives most_rows rows, as if only they were there."""
    same = spark.range(300).selectExpr("1L AS doc_id", "concat('word', id, ' of a text') AS text", "'en' AS lang")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    settings = toxicity.Settings(most_rows=20, l1=0.1)
    names, weights, intercept = toxicity.train(same, labels, F.lit(True), settings)
    first = sorted(r.text for r in same.collect())[:20]
    want = toxicity.fit(first, np.ones(20), settings)
    assert names.tolist() == want[0].tolist() and np.allclose(weights, want[1]) and abs(intercept - want[2]) < 1e-9
    assert langid.train(same, F.lit(True), most_per_language=10).langs == ["en"]


def slow_ftrl(texts, labels, settings):
    """FTRL-proximal with a dict for each sum, one feature after another."""
    found = [set(toxicity.features([t])[1].tolist()) for t in texts]
    common = {f for f in set().union(*found) if sum(f in x for x in found) >= settings.least_documents}
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= settings.l1:
            return 0.0
        sign = 1 if z[f] > 0 else -1
        return -(z[f] - sign * settings.l1) / ((settings.beta + n[f] ** 0.5) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for x, label in zip(found, labels, strict=True):
            active = [*(x & common), "intercept"]
            w = {f: weight(f) for f in active}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for f in active:
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / settings.alpha * w[f]
                n[f] = old + g * g
    return {f: weight(f) for f in [*common, "intercept"]}


def test_ftrl_by_brute_force():
    texts = [words(k % 40, 12) + (" rotten old scoundrel" if k % 3 == 0 else " dear old friend") for k in range(90)]
    labels = np.array([float(k % 3 == 0) for k in range(90)])
    settings = toxicity.Settings(l1=0.7, epochs=2)
    names, weights, intercept = toxicity.fit(texts, labels, settings)
    want = slow_ftrl(texts, labels, settings)
    assert abs(want.pop("intercept") - intercept) < 1e-9
    got = dict(zip(names.tolist(), weights.tolist(), strict=True))
    assert set(got) == {f for f, w in want.items() if w} and 0 < len(got) < len(want)
    assert all(abs(got[f] - want[f]) < 1e-9 for f in got)


def test_toxicity_features_by_brute_force():
    """Words, pairs of neighbours, pairs one word apart, and the first 4 and 6 bytes of longer words, each its own feature."""
    text = "Rotten scoundrel, go away rotten"
    words_ = ["rotten", "scoundrel", "go", "away", "rotten"]
    want = {("w", w) for w in words_} | {("n", a, b) for a, b in zip(words_, words_[1:])} | {("s", a, b) for a, b in zip(words_, words_[2:])}
    want |= {("p", w[:n]) for w in words_ for n in (4, 6) if len(w) > n}
    assert len(set(toxicity.features([text])[1].tolist())) == len(want)
    assert set(toxicity.features([text.upper()])[1].tolist()) == set(toxicity.features([text])[1].tolist())
