import re

import numpy as np
import pytest
import xxhash

from domgraph.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[k : k + 3]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    """doc_id to the smallest doc_id reachable; fps: (doc_id, fingerprint)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(fps):
        least[find(k)] = min(least.get(find(k), doc), doc)
    return [least[find(k)] for k in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "A", "a b", "a b c", "É a B  c\x0b d\x85e\xa0f g", "x y z w " * 30])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("most", [4096, 4])
def test_links_and_components(spark, most):
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    values = list(centres)
    for c in centres[:12]:
        for _ in range(12):
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                c ^= 1 << int(bit)
            values.append(c)
    values += [0, 0, 2**64 - 1]
    fps = [(k, v) for k, v in enumerate(values)]
    signed = [(k, v - 2**64 if v >= 2**63 else v) for k, v in fps]
    frame = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    nodes = frame.select("fp").distinct()
    edges = simhash.links(nodes, 2, most_in_root=most).collect()
    unsigned = lambda x: x % 2**64
    assert edges
    if most == 4096:
        got = {r.doc_id: r.component_id for r in simhash.components(frame).collect()}
    else:
        first = {}
        for k, v in fps:
            first.setdefault(v, k)
        parent = {v: v for v in first}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in edges:
            parent[find(unsigned(r.a))] = find(unsigned(r.b))
        least = {}
        for v, k in first.items():
            least[find(v)] = min(least.get(find(v), k), k)
        got = {k: least[find(v)] for k, v in fps}
    assert [got[k] for k, _ in fps] == slow_components(fps)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_documents(request, which, rows):
    got = simhash.near_duplicates(request.getfixturevalue(which)).collect()
    last = 2**63 - 1
    fps = [(last if r[0] is None else r[0], slow_fingerprint(r[1])) for r in rows]
    want = [(None if d == last else d, f"{f:016x}", None if c == last else c) for (d, f), c in zip(fps, slow_components(fps), strict=True)]
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_first(empty).collect() == []


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_keep_first_by_brute_force(request, which, rows):
    table = request.getfixturevalue(which)
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns
    named = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    sets = [set(simhash._shingles(t, 5).tolist()) for _, t in named]
    parent = list(range(len(named)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(named)):
        for b in range(a):
            if named[a][1] == named[b][1] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {named[k][0] for k in range(len(named)) if find(k) == k}
    got = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {d for d in got if d is not None} == want
    assert got.count(None) == sum(r[0] is None for r in rows)


def _brute_components(texts, similarity):
    sets = [set(simhash._shingles(t, 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def _variants(rng, words, n, replaced):
    out = []
    for _ in range(n):
        copy = list(words)
        for at in rng.choice(len(copy), replaced, replace=False):
            copy[at] = f"x{rng.integers(1 << 40)}"
        out.append(copy)
    return out


def _stars_and_chains():
    """Originals amid variants that are like them and unlike each other; texts each like the next one only."""
    rng = np.random.default_rng(8)
    texts = []
    for star in range(3):
        original = [f"s{star}w{k}" for k in range(200)]
        around = _variants(rng, original, 40, 4)
        texts += [" ".join(t) for t in [*around[:20], original, *around[20:]]]
    chain = [f"c{k}" for k in range(200)]
    for _ in range(40):
        texts.append(" ".join(chain))
        (chain,) = _variants(rng, chain, 1, 4)
    order = rng.permutation(len(texts))
    return texts[: 3 * 41] + [texts[k] for k in order if k >= 3 * 41]


def test_keep_first_of_stars_and_chains(spark):
    texts = _stars_and_chains()
    want = _brute_components(texts, 0.8)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.keep_first(table).collect()} == set(want)


def test_large_groups_block_against_block(spark):
    texts = _stars_and_chains()
    want = _brute_components(texts, 0.8)
    table = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    # Blocks of about three texts; slices of one shingle make large groups.
    found = simhash.similar_links(table, words_in_shingle=5, similarity=0.8, slices=24, shingles=1, block_bytes=5000).collect()
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        x, y = find(r.a), find(r.b)
        parent[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(texts))] == want


def test_links_between_equal_all_pairs():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.choice(16, 12).astype(np.uint64)) for _ in range(80)]
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))
    for side in (np.zeros(80, int), np.arange(80) % 2):
        pairs = [(a, b) for a in range(80) for b in range(a) if like(a, b) and (side[a] != side[b] or not side.any())]
        found = simhash.links_between(sets, np.arange(80), side, 0.6)
        assert found and all(like(a, b) for a, b in found)
        one, all_ = (dict(zip(*(x.tolist() for x in simhash.forest(np.array([p[0] for p in l]), np.array([p[1] for p in l]))), strict=True)) for l in (found, pairs))
        assert one.keys() == all_.keys()
        assert len({(one[k], all_[k]) for k in one}) == len(set(one.values())) == len(set(all_.values()))


def _components_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(int(a)), find(int(b))))
        root[y] = x
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("most", [4096, 4])
def test_links_of_kinds(spark, most):
    rng = np.random.default_rng(11)
    values = []
    for kind in range(3):
        for c in rng.integers(0, 1 << 40, 12).tolist():
            values += [kind << 40 | c, (kind + 1) << 40 | c ^ 1 << int(rng.integers(40))]
            values += [kind << 40 | c ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 40, (4, 2))]
    values = sorted(set(values))
    near = lambda a, b: a >> 40 == b >> 40 and (a ^ b).bit_count() <= 2
    want = [(a, b) for a in range(len(values)) for b in range(a) if near(values[a], values[b])]
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"), 2, most_in_root=most, kind_bits=24).collect()
    place = {v: k for k, v in enumerate(values)}
    assert _components_of(len(values), [(place[r.a], place[r.b]) for r in found]) == _components_of(len(values), want)


def test_similar_links_come_from_the_trie_join_under_the_budget(spark, monkeypatch):
    # One slice: what it finds is what the whole-text fingerprint or that of the slice holds within two bits, equal or not.
    rng = np.random.default_rng(12)
    texts = []
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(200)]
        texts += [" ".join(words), *(" ".join(t) for t in _variants(rng, words, 1, 4))]
    fps = [simhash.slice_fingerprints(simhash._shingles(t, 5), 1, 8).tolist() for t in texts]
    sets = [set(simhash._shingles(t, 5).tolist()) for t in texts]
    apart = {(a, b): min((x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True)) for a in range(120) for b in range(a)}
    alike = {p for p in apart if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    want = {p for p in alike if apart[p] <= 2}
    assert {apart[p] for p in want} >= {0, 1, 2} and alike - want
    calls = []
    join = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: calls.append(a[1:]) or join(*a, **k))
    table = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    found = simhash.similar_links(table, words_in_shingle=5, similarity=0.8, slices=1, shingles=8).collect()
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in found} == want and calls == [(2,)]


def test_links_between_within_the_budget():
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.choice(16, 12).astype(np.uint64)) for _ in range(80)]
    fps = rng.integers(0, 1 << 5, 80).astype(np.uint64)
    near = lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count() <= 1
    like = lambda a, b: near(a, b) and len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))
    pairs = [(a, b) for a in range(80) for b in range(a) if like(a, b)]
    found = simhash.links_between(sets, np.arange(80), np.zeros(80, int), 0.6, fps, 1)
    assert all(like(a, b) for a, b in found)
    assert _components_of(80, found) == _components_of(80, pairs)


def _rows_joined(spark, already):
    """Rows that the joins of all executions but the first `already` made, and the number of executions."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    executions = store.executionsList()
    made = 0
    for k in range(already, executions.size()):
        number = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.get(metric.accumulatorId()).isDefined():
                    made += int(values.get(metric.accumulatorId()).get().replace(",", ""))
    return made, executions.size()


def test_components_join_a_small_multiple_of_the_edges(spark):
    # A path, a star and pairs, their numbers in no order: what takes many rounds must not join all edges in each.
    rng = np.random.default_rng(14)
    name = (rng.permutation(1400) - 700).tolist()
    pairs = [(k, k + 1) for k in range(799)] + [(800, 801 + k) for k in range(399)] + [(1200 + 2 * k, 1201 + 2 * k) for k in range(100)]
    least = rng.permutation(1400).tolist()
    edges = spark.createDataFrame([(name[a], name[b]) for a, b in [*pairs, (5, 4), (900, 900)]], "a bigint, b bigint")
    component = _components_of(1400, pairs)
    members = {c: [k for k in range(1400) if component[k] == c] for c in set(component)}
    want = {name[k]: min(least[m] for m in members[c]) for k, c in enumerate(component)}
    nodes = spark.createDataFrame([(name[k], least[k]) for k in range(1400)], "fp bigint, least bigint")
    before = _rows_joined(spark, 10**9)[1]
    got = simhash.smallest_reachable(nodes, edges).collect()
    assert len(got) == 1400 and {r.fp: r.component for r in got} == want
    assert 0 < _rows_joined(spark, before)[0] < 10 * len(pairs)
    own = simhash.smallest_reachable(None, edges).collect()
    assert len(own) == 1400 and {r.fp: r.component for r in own} == {name[k]: min(name[m] for m in members[c]) for k, c in enumerate(component)}
    assert simhash.smallest_reachable(None, edges.limit(0)).collect() == simhash.smallest_reachable(nodes, edges.limit(0)).collect() == []
