from collections import defaultdict

from domgraph.plans import catalog
from domgraph.plans.facts import fact

FOLDER = "/root/testdata/sf0.001"


def test_every_event_is_a_closure_and_an_awaited_range(spark):
    n = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert fact(spark, FOLDER, "closure_literal").count() == n
    assert fact(spark, FOLDER, "awaited_range").count() == n


def test_closures_and_awaits_by_brute_force(spark):
    sites = {(r.file, r.line, r.col) for r in fact(spark, FOLDER, "call_edge").collect()}
    # From the events themselves, so that a filter in the derived facts shows.
    ids = [r.event_id for r in spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id").collect()]
    closures, awaits = defaultdict(list), defaultdict(list)
    for e in ids:
        file = f"F{e % 97}"
        main = e % 5 == 0 or e % 3 == 0 and e % 2 == 0
        closures[file].append(((10 + e % 60, 1 + e % 40), (10 + e % 60 + e % 7, 30 + e % 50), e, "globalActor(MainActor)" if main else None))
        awaits[file].append(((10 + e % 70, 1 + e % 30), (10 + e % 70 + e % 2, 20 + e % 60)))
    want = {}
    for file, *at in sites:
        inside = [(start, e, override) for start, end, e, override in closures[file] if start <= tuple(at) <= end]
        if inside:
            want[file, *at] = max(inside, key=lambda x: x[:2])[2]
    assert want
    assert {(r.file, r.line, r.col): r.override for r in catalog.QUERIES["closure_override"](spark, FOLDER).collect()} == want
    held = {(file, *at) for file, *at in sites if any(start <= tuple(at) <= end for start, end in awaits[file])}
    assert {(r.file, r.line, r.col) for r in catalog.QUERIES["awaited_edges"](spark, FOLDER).collect()} == held


def test_protocol_closure_of_all_parts_by_brute_force(spark):
    # sf0.01 has 2,000 parts.
    folder = FOLDER.replace("sf0.001", "sf0.01")
    parents = defaultdict(set)
    for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey").collect():
        if r.p_partkey >= 1:
            parents[r.p_partkey].add(r.p_partkey // 2)
    parents[1].add(7)
    assert max(parents) > 400
    want = set()
    for key in parents:
        seen, left = set(), [key]
        while left:
            left = [p for k in left for p in parents.get(k, ()) if p not in seen and not seen.add(p)]
        want |= {(f"Q{key}", f"Q{p}") for p in seen if p != key}
    got = [(r.protocol, r.ancestor) for r in catalog.QUERIES["protocol_closure"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want
