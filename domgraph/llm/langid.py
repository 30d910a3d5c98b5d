"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

Features are the shares of hashed byte n-grams (2, 3 and 4 bytes, A-Z in lower case) in the whole text. One linear SVM a family
against the rest picks the family; in it, one SVM for each pair of languages votes, and the sum of margins breaks
ties. All SVMs minimise squared hinge loss, exactly, by Newton steps over the rows inside the margin. They learn in one task
from a bounded sample of rows that the caller allows: about `most_per_language` for each language, those with the smallest
hash of doc_id and text. The weights are one number a feature and machine, broadcast to score every row.

Defined results: a text that is null or has no letter gets `und` and score 0, and so does everything if no language could be
learned; a family of one language needs no second step; a language outside FAMILIES belongs to the family `other`;
rows with a null lang or doc_id are scored but not learned from; rows equal in doc_id, lang and text are learned once
and scored each; very long texts are taken window by window; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgraph.llm import hashing

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la rm",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu se",
    "turkic": "tr az kk ky uz tk tt",
    "semitic": "ar he mt am ti",
    "indic": "hi ur bn pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
    "malayic": "id ms jv su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_SIZES = (2, 3, 4)
_BITS = 13
_WINDOW = 256 << 10
#: Largest model that is broadcast: machines times features.
_MOST_WEIGHTS = 64 << 20
UNDETERMINED = "und"


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


def _indices(data: np.ndarray, size: int) -> np.ndarray:
    """The feature of the n-gram that starts at each byte."""
    n = max(0, len(data) - size + 1)
    value = np.zeros(n, np.uint32)
    for k in range(size):
        value = (value << np.uint32(8)) | data[k : k + n]
    return ((value * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - _BITS)).astype(np.int64)


def _fold(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)


def shares(text: str) -> np.ndarray:
    """The feature vector of a whole text, taken window by window."""
    counts, data = np.zeros(1 << _BITS), _fold(text)
    for at in range(0, max(1, len(data)), _WINDOW):
        for size in _SIZES:
            counts += np.bincount(_indices(data[at : at + _WINDOW + size - 1], size), minlength=1 << _BITS)
    return counts / max(1.0, counts.sum())


def support_vector_machine(gram: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients of the rows of the linear SVM with squared hinge loss; gram holds the rows' inner products."""
    inside = np.ones(len(y), bool)
    for _ in range(50):
        coefficients = np.zeros(len(y))
        coefficients[inside] = np.linalg.solve(gram[np.ix_(inside, inside)] + ridge * np.eye(inside.sum()), y[inside])
        now = y * (gram @ coefficients) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return coefficients


def fit(x: np.ndarray, langs: list[str], ridge: float = 1.0) -> list[tuple[str, str, str, float, np.ndarray]]:
    """(kind, a, b, bias, weights) of each machine; kind is family (a against the rest) or pair (a against b). x: a row's
    features each."""
    x = x.astype(np.float32)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    x = np.hstack([x * scale, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    gram = (x @ x.T).astype(float)
    langs_ = np.array(langs)
    families = np.array([family(v) for v in langs])
    out = []

    def add(kind: str, a: str, b: str, rows: np.ndarray, positive: np.ndarray) -> None:
        y = np.where(positive, 1.0, -1.0)
        w = support_vector_machine(gram[np.ix_(rows, rows)], y, ridge) @ x[rows]
        out.append((kind, a, b, float(w[-1]), w[:-1] * scale))

    every = np.arange(len(langs))
    names = sorted(set(families.tolist()))
    for name in names:
        if len(names) > 1:
            add("family", name, "", every, families == name)
        members = sorted(set(langs_[families == name].tolist()))
        for a, b in combinations(members, 2):
            rows = np.flatnonzero((langs_ == a) | (langs_ == b))
            add("pair", a, b, rows, langs_[rows] == a)
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) as lang and the text's features, for texts with a letter."""
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            if any(map(str.isalpha, text)):
                columns = [pa.array([lang.as_py()]), pa.array([shares(text).astype(np.float32).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "features"])


def _train(ridge: float) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True)]
        rows.sort()
        if rows:
            machines = fit(np.stack([np.frombuffer(r[1], np.float32) for r in rows]), [r[0] for r in rows], ridge)
            machines += [("language", lang, "", 0.0, np.zeros(0)) for lang in sorted({r[0] for r in rows})]
            for m in machines:
                columns = [pa.array([v]) for v in m[:4]] + [pa.array([m[4].tolist()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "bias", "weights"])

    return train


class Model:
    """Machines as one table of weights."""

    def __init__(self, machines: list[tuple]):
        self.langs = sorted(m[1] for m in machines if m[0] == "language")
        found = sorted((m for m in machines if m[0] != "language"), key=lambda m: m[:3])
        self.keys = [m[:3] for m in found]
        self.bias = np.array([m[3] for m in found])
        self.weights = np.array([m[4] for m in found], np.float32).reshape(len(found), 1 << _BITS).T.copy()
        if self.weights.size > _MOST_WEIGHTS:
            raise ValueError("too many machines to broadcast")
        self.names = sorted({family(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.names}
        at = {k: i for i, k in enumerate(self.keys)}
        self.family_at = [at[("family", f, "")] for f in self.names] if len(self.names) > 1 else []
        self.pair_at = {(a, b): at[("pair", a, b)] for f in self.names for a, b in combinations(self.members[f], 2)}

    def margins(self, texts: list[str]) -> np.ndarray:
        """Each text's margin at each machine. A text's sums never depend on its neighbours."""
        parts = [_fold(t) for t in texts]
        sums, counts = np.zeros((len(parts), len(self.keys))), np.zeros(len(parts))
        if not self.keys:
            return sums
        if len(parts) == 1:
            windows = [(parts[0][a : a + _WINDOW + max(_SIZES) - 1], a) for a in range(0, len(parts[0]), _WINDOW)]
        else:
            windows = [(np.concatenate(parts), 0)]
        sizes = np.array([len(p) for p in parts])
        begins = np.cumsum(sizes) - sizes
        for data, _ in windows:
            for size in _SIZES:
                index = _indices(data, size)
                if len(parts) == 1:
                    index = index[:_WINDOW]
                    starts, lengths = np.zeros(1, np.int64), np.array([len(index)])
                else:
                    starts, lengths = begins, np.maximum(sizes - size + 1, 0)
                full = np.flatnonzero(lengths)
                if not len(full):
                    continue
                # The grams that run into the next text make odd segments of their own, which are thrown away.
                edges = np.stack([starts[full], starts[full] + lengths[full]], axis=1).ravel()
                counts[full] += lengths[full]
                for k in range(len(self.keys)):
                    got = np.append(self.weights[index, k], np.float32(0)).astype(np.float64)
                    edges_ = np.minimum(edges, len(got) - 1)
                    sums[full, k] += np.add.reduceat(got, edges_)[::2]
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score (the least confidence on the way) of each text."""
        margins = self.margins(texts)
        langs, scores = [], []
        for text, margin in zip(texts, margins, strict=True):
            if not self.langs or not any(map(str.isalpha, text)):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            name, least = self.names[0], np.inf
            if self.family_at:
                by = margin[self.family_at]
                name, least = self.names[int(by.argmax())], float(by.max())
            members = self.members[name]
            votes = dict.fromkeys(members, (0, 0.0))
            for a, b in combinations(members, 2):
                m = float(margin[self.pair_at[a, b]])
                for lang, own in ((a, m), (b, -m)):
                    votes[lang] = (votes[lang][0] + (own > 0), votes[lang][1] + own)
            best = max(members, key=lambda x: votes[x])
            own = [margin[k] if a == best else -margin[k] for (a, b), k in self.pair_at.items() if best in (a, b)]
            langs.append(best)
            scores.append(float(1 / (1 + np.exp(-2 * min([least, 8.0, *own])))))
        return langs, scores


def train(docs: DataFrame, usable: Column, *, most_per_language: int = 400, ridge: float = 1.0) -> Model:
    """Fit on (text, lang) of the rows of docs that satisfy `usable`, an expression over doc_id."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    if not counts:
        return Model([])
    part = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, most_per_language / n))])
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    place = (F.xxhash64("doc_id", text).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).alias("place")
    # The text goes with its row: many rows of one doc_id are as many rows of the sample, and the limit holds for them.
    rows = (
        known.select(place, "doc_id", F.col("lang").cast("string").alias("lang"), text)
        .where(F.col("place") < part[F.col("lang")])
        .distinct()
        .orderBy("place", "doc_id", "lang", "text")
        .limit(2 * most_per_language * len(counts))
        .select("lang", "text")
        .mapInArrow(_vectors, "lang string, features binary")
        .repartition(1)
        .mapInArrow(_train(ridge), "kind string, a string, b string, bias double, weights array<double>")
        .collect()
    )
    return Model([(r.kind, r.a, r.b, r.bias, np.array(r.weights)) for r in rows])


def _predict(model) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for part in hashing.chunks(((x.as_py() or "",) for x in batch.column(1)), 0, _WINDOW):
                found = model.value.predict([t for (t,) in part])
                langs += found[0]
                scores += found[1]
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _predict(shared), f"doc_id {kind}, lang_pred string, score double"
    )
