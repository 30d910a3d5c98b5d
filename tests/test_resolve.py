import random
import time

import pytest

from domgraph import schemas
from domgraph.operators import resolve

MAIN = "globalActor(MainActor)"


def declaration(usr, name="x", explicit=None, actor=False, container=None, static=False, superclass=None, eligible=True, extension=None, nested=False):
    return (usr, name, explicit, actor, container, static, superclass, eligible, extension, nested, None, None, None, False, False, 0)


def run(spark, declarations, conformances=(), default="nonisolated"):
    d = spark.createDataFrame(declarations, schemas.DECLARATION)
    c = spark.createDataFrame(list(conformances), schemas.CONFORMANCE)
    return {r.usr: r.iso for r in resolve.resolve(d, c, default).collect()}


def test_rules_in_one_project(spark):
    rows = [
        declaration("session", "UserSession", actor=True),
        declaration("m1", container="session", explicit="nonisolated"),
        declaration("m2", container="session"),
        declaration("m3", container="session", static=True),
        declaration("main", explicit=MAIN),
        declaration("m4", container="main"),
        declaration("m5", container="main", static=True),
        declaration("derived", superclass="main"),
        declaration("m6", container="derived"),
        declaration("same"),
        declaration("neither"),
        declaration("witness"),
        declaration("plain"),
        declaration("m7", container="plain", extension=MAIN),
        declaration("m8", container="plain", extension=MAIN, explicit="nonisolated"),
        declaration("m9", container="main", extension="nonisolated"),
        declaration("n1", container="session", nested=True),
        declaration("n2", container="main", nested=True),
        declaration("n3", container="main", nested=True, superclass="main"),
        declaration("beats", "A", explicit="nonisolated", actor=True),
        declaration("orphan", container="gone", superclass="gone"),
    ]
    conformances = [
        ("same", 0, "P", "MainActor", True, False),
        ("neither", 0, "P", "MainActor", False, False),
        ("witness", 0, "P", "MainActor", False, True),
    ]
    got = run(spark, rows, conformances)
    assert got == {
        "session": "actor(UserSession)", "m1": "nonisolated", "m2": "actor(UserSession)", "m3": "nonisolated", "main": MAIN, "m4": MAIN, "m5": MAIN,
        "derived": MAIN, "m6": MAIN, "same": MAIN, "neither": "nonisolated", "witness": MAIN, "plain": "nonisolated", "m7": MAIN, "m8": "nonisolated",
        "m9": "nonisolated", "n1": "nonisolated", "n2": "nonisolated", "n3": MAIN, "beats": "actor(A)", "orphan": "nonisolated",
    }


def test_module_default(spark):
    rows = [
        declaration("type"),
        declaration("case", eligible=False),
        declaration("session", "UserSession", actor=True),
        declaration("member", container="session"),
        declaration("custom", explicit="globalActor(CustomActor)"),
        declaration("nested", container="custom", nested=True),
        declaration("off", explicit="nonisolated"),
        declaration("inside", container="off", nested=True),
        declaration("conforming"),
    ]
    got = run(spark, rows, [("conforming", 0, "P", "IndexerActor", True, False)], resolve.default_isolation("6.2", MAIN))
    assert got["type"] == MAIN and got["case"] == "nonisolated" and got["member"] == "actor(UserSession)"
    assert got["nested"] == MAIN and got["inside"] == "nonisolated" and got["conforming"] == "globalActor(IndexerActor)"


def slow(declarations, conformances, default):
    rows = {d[0]: d for d in declarations}
    named = sorted((c for c in conformances if c[3]), key=lambda c: (0 if c[4] else 1, c[2], c[1]))

    def iso(usr, path):
        if usr in path or usr not in rows:
            return "unspecified"
        _, name, explicit, actor, container, static, superclass, eligible, extension, nested = rows[usr][:10]
        path = path | {usr}
        if actor or explicit or extension:
            return f"actor({name})" if actor else explicit or extension
        if not nested and container in rows:
            c = iso(container, path)
            if c.startswith("actor(") and not static or c.startswith("globalActor("):
                return c
        if superclass in rows and (s := iso(superclass, path)).startswith("globalActor("):
            return s
        for c in named:
            if c[0] == usr and (c[4] or c[5]):
                return f"globalActor({c[3]})"
        if not eligible:
            return "nonisolated"
        if nested and (container not in rows or iso(container, path) == "nonisolated"):
            return "nonisolated"
        return default

    return {u: iso(u, frozenset()) for u in rows}


@pytest.mark.parametrize("default", ["nonisolated", MAIN])
def test_rings_with_all_kinds_of_members(spark, default):
    """Rings of one to six members that lack one parent, with declarations below them."""
    rng = random.Random(5)
    rows, conformances = [], []
    for ring in range(120):
        size = rng.randint(1, 6)
        names = [f"r{ring}.{k}" for k in range(size)]
        for k, n in enumerate(names):
            up, nested = names[(k + 1) % size], rng.random() < 0.5
            c, s = (up, rng.choice([None, "g", "n"])) if rng.random() < 0.6 else (rng.choice([None, "g", "n", "a"]), up)
            rows.append(declaration(n, n, None, False, c, rng.random() < 0.5, s, rng.random() < 0.8, None, nested))
            if rng.random() < 0.3:
                conformances.append((n, 0, "P", "X", True, False))
            rows.append(declaration(f"{n}.below", n, None, False, n, False, None, True, None, rng.random() < 0.5))
            rows.append(declaration(f"{n}.lower", n, None, False, f"{n}.below", False, n, True, None, rng.random() < 0.5))
    rows += [declaration("g", explicit="globalActor(G)"), declaration("n", explicit="nonisolated"), declaration("a", "A", actor=True)]
    assert run(spark, rows, conformances, default) == slow(rows, conformances, default)


def test_a_long_chain_below_a_ring(spark):
    n = 20_000
    rows = [declaration("u0", container="u1"), declaration("u1", container="u0")]
    rows += [declaration(f"u{k}", container=f"u{k - 1}" if k % 3 else None, superclass=None if k % 3 else f"u{k - 1}", nested=k % 5 == 0) for k in range(2, n)]
    rows += [declaration(f"m{k}", explicit=MAIN if k == 0 else None, superclass=f"m{k - 1}") for k in range(n)]
    began = time.time()
    got = run(spark, rows, default="nonisolated")
    assert time.time() - began < 90
    assert {got[f"m{k}"] for k in range(n)} == {MAIN} and {got[f"u{k}"] for k in range(n)} == {"nonisolated"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_with_cycles(spark, seed):
    rng = random.Random(seed)
    names = [f"u{k}" for k in range(60)]
    pick = lambda p: rng.choice([*names, "gone"]) if rng.random() < p else None
    rows = [
        declaration(n, n, rng.choice([None] * 6 + ["nonisolated", MAIN, "globalActor(B)"]), rng.random() < 0.05, pick(0.6), rng.random() < 0.3, pick(0.5), rng.random() < 0.8, None, rng.random() < 0.4)
        for n in names
    ]
    conformances = [(rng.choice(names), k, f"P{rng.randrange(4)}", rng.choice([None, "X", "Y"]), rng.random() < 0.5, rng.random() < 0.5) for k in range(20)]
    assert run(spark, rows, conformances, MAIN) == slow(rows, conformances, MAIN)


def test_rule_sets():
    assert [resolve.default_isolation(v, MAIN) for v in ("5.0", "5.10", "6.0", "6.1", "6.2", "6.3")] == ["nonisolated"] * 4 + [MAIN] * 2
    with pytest.raises(ValueError):
        resolve.default_isolation("4.2")
    assert resolve.effective_version("5", "6.2") == "5" and resolve.effective_version("6", "6.2") == "6.2"


def test_transitive_closure_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "protocol string, parent string")
    got = {tuple(r) for r in resolve.transitive(edges, "protocol", "parent").collect()}
    assert got == {(x, y) for x in "abc" for y in "abc" if x != y} | {("d", x) for x in "abc"}
