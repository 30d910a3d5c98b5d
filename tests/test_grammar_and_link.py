import pytest
from pyspark.sql import functions as F

from domgraph import schemas
from domgraph.functions import grammar
from domgraph.operators import backfill, link, staleness
from domgraph.sources import readers

SHORTCUT = "s:So24UISceneConnectionOptionsC12shortcutItemSo021UIApplicationShortcutE0CSgvg"
SAMPLES = [
    (grammar.imported_struct_container, "s:So6CGSizeV5width14CoreFoundation7CGFloatVvg", "s:So6CGSizeV"),
    (grammar.imported_struct_container, "s:So12UIEdgeInsetsV4zeroABvgZ", "s:So12UIEdgeInsetsV"),
    (grammar.imported_struct_container, "s:So99UIEdgeInsetsV4zeroABvgZ", None),
    (grammar.is_imported_constant, "s:So18NSCocoaErrorDomainSSvg", True),
    (grammar.is_imported_constant, SHORTCUT, False),
    (grammar.swift_enum, "s:15MiniAnchorRepro10PaymentWayO8rawValueSSvg", "s:15MiniAnchorRepro10PaymentWayO"),
    (grammar.objc_enum, "s:12MiniObjCEnum8LogLevelO8rawValueSivg", "c:@M@MiniObjCEnum@E@LogLevel"),
    (grammar.hashable_owner, "s:4Moya8EndpointC9hashValueSivg", "s:4Moya8EndpointC"),
    (grammar.subscript_declaration, "s:So12NSDictionaryC10FoundationEyypSgypcig", "s:So12NSDictionaryC10FoundationEyypSgypcip"),
    (grammar.static_declaration, "s:12YandexPaySDK0aB6SDKApiC8instanceACvgZ", "s:12YandexPaySDK0aB6SDKApiC8instanceACvpZ"),
    (grammar.objc_property, SHORTCUT, "c:objc(cs)UISceneConnectionOptions(py)shortcutItem"),
    (grammar.module_suffix, "s:4Moya8EndpointC", "8EndpointC"),
    (grammar.module_suffix, "s:4Moya", None),
    (grammar.without_module_qualifier, "c:@CM@Mod@@objc(cs)T", "c:objc(cs)T"),
    (grammar.demangled_signature, "Mod.(helper in _0AB1).run() -> ()", "helper.run() -> ()"),
]


@pytest.mark.parametrize("function,usr,want", SAMPLES)
def test_grammar(spark, function, usr, want):
    assert spark.createDataFrame([(usr,)], "u string").select(function(F.col("u")).alias("x")).first().x == want


def test_bridged_selection(spark):
    rows = [
        ("s:So11NSFoobarKeya3oneABvgZ", 0, "c:@E@x", "two", "source.lang.objc", "$sSo11NSFoobarKeyamD", None, None),
        ("s:So11NSFoobarKeya3oneABvgZ", 1, "c:@y", "one", "source.lang.objc", "$sSo11NSFoobarKeyamD", None, None),
        ("s:4Mod1aC", 0, "s:4Mod1aC::SYNTHESIZED::s:x", "a", "source.lang.swift", None, None, None),
    ]
    got = {r.target_usr: r.usr for r in backfill.select_symbol(spark.createDataFrame(rows, schemas.CURSOR_ANSWER)).collect()}
    assert got == {"s:So11NSFoobarKeya3oneABvgZ": "c:@y", "s:4Mod1aC": "s:4Mod1aC::SYNTHESIZED::s:x"}


def declared(spark, *names):
    rows = [(f"syntactic:{n}", n, None, False, None, False, None, True, None, False, "F", k + 1, 1, False, False, k) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, schemas.DECLARATION)


def test_locations(spark):
    symbols = [
        ("s:1", "any", "F", 1, 1),
        ("s:g", "getter:currentUser", "F", 2, 1), ("s:s", "setter:currentUser", "F", 2, 1), ("s:2", "currentUser", "F", 2, 1),
        ("s:a", "loginAttempt", "F", 3, 1), ("s:3", "login(as:)", "F", 3, 1),
        ("s:x", "somethingElse", "F", 4, 1), ("s:y", "somethingDifferent", "F", 4, 1),
    ]
    rows = declared(spark, "One", "currentUser", "login", "Ambiguous")
    matched = link.match_locations(rows, spark.createDataFrame(symbols, schemas.INDEXED_SYMBOL))
    assert {r.usr: r.real_usr for r in matched.collect()} == {"syntactic:One": "s:1", "syntactic:currentUser": "s:2", "syntactic:login": "s:3"}
    mapping = link.placeholder_map(rows, matched)
    edges = spark.createDataFrame([("syntactic:A.login", "syntactic:One", "F", 1, 1), ("syntactic:None", "s:9", "G", 1, 1)], schemas.CALL_EDGE)
    got = link.rewrite(link.rewrite(edges, "caller_usr", mapping), "callee_usr", mapping)
    assert sorted((r.caller_usr, r.callee_usr) for r in got.collect()) == [("syntactic:A.login", "s:1"), ("syntactic:None", "s:9")]


def test_references_are_rewritten(spark):
    """By key, else by the only nested type of that name; an override comes first, and unread files keep theirs."""
    mapping = spark.createDataFrame([("syntactic:Top", "s:t"), ("syntactic:Outer.In", "s:i"), ("syntactic:A.Two", "s:1"), ("syntactic:B.Two", "s:2"), ("syntactic:T.m#4", "s:m")], "usr string, real_usr string")
    rows = [(u, "F") for u in ("syntactic:Top", "syntactic:In", "syntactic:Two", "syntactic:m", "syntactic:X.In", "s:q", None)] + [("syntactic:Top", "unread")]
    table = spark.createDataFrame(rows, "u string, file string")
    unread = spark.createDataFrame([("unread",)], "file string")
    over = spark.createDataFrame([("syntactic:Top", "s:over")], "usr string, real_usr string")
    got = {tuple(r) for r in link.rewrite(table, "u", mapping, over, unread).collect()}
    assert got == {("s:over", "F"), ("s:i", "F"), ("syntactic:Two", "F"), ("syntactic:m", "F"), ("syntactic:X.In", "F"), ("s:q", "F"), (None, "F"), ("syntactic:Top", "unread")}


def test_ancestors_bring_no_actor(spark):
    pairs = spark.createDataFrame([("u", 0, "P", "MainActor", True, False)], schemas.CONFORMANCE)
    closure = spark.createDataFrame([("P", "Q")], "protocol string, ancestor string")
    assert sorted(map(tuple, link.with_ancestors(pairs, closure).collect())) == [("u", 0, "P", "MainActor", True, False), ("u", 0, "Q", None, True, False)]


def test_accessors_need_one_owner(spark):
    rows = [("g1", 1 << 15, "p1", "p", 4, 0), ("g2", 1 << 15, "p1", "p", 4, 0), ("g2", 1 << 15, "p2", "p", 4, 1), ("g3", 1 << 15, "p1", "p", 4, 0), ("g3", 1 << 15, "p2", "p", 2, 1)]
    rows += [("c:objc(cs)K(im)x", 1 << 15, "c:objc(cs)K(py)x", "x", 2, 0)]
    owners = link.accessor_owner(spark.createDataFrame([(*r, "rec", "F", 1, 1, "n") for r in rows], schemas.RELATION))
    assert {r.accessor: r.owner for r in owners.collect()} == {"g1": "p1", "g3": "p2", "c:objc(cs)K(im)x": "c:objc(cs)K(py)x"}
    edges = spark.createDataFrame([("g1", "c:@CM@Mod@@objc(cs)K(im)x", "F", 1, 1), ("c:objc(cs)K(im)x", "g2", "F", 2, 1)], schemas.CALL_EDGE)
    assert [(r.caller_usr, r.callee_usr) for r in link.canonical(edges, owners).orderBy("line").collect()] == [("p1", "c:objc(cs)K(py)x"), ("c:objc(cs)K(py)x", "g2")]


def occurrence(usr, name, roles, line, module="M", system=False, record="r"):
    return (usr, name, roles, "F", line, 1, module, system, record)


def test_each_call_keeps_its_own_caller(spark):
    """One callee called from two functions; a setter counts unless a getter is called at the same place."""
    seen = [occurrence("callee", "callee()", 32, 1), occurrence("callee", "callee()", 32, 2), occurrence("callee", "callee()", 2, 9)]
    seen += [occurrence("s", "setter:x", 32, 3), occurrence("g", "getter:x", 32, 3), occurrence("s", "setter:x", 32, 4), occurrence("lost", "lost()", 32, 5)]
    relations = [("callee", 8192, "one", "one", 32, 0, "r", "F", 1, 1), ("callee", 8192, "late", "late", 32, 1, "r", "F", 1, 1), ("callee", 8192, "two", "two", 32, 0, "r", "F", 2, 1)]
    relations += [(u, 8192, "one", "one", 32, 0, "r", "F", n, 1) for u, n in (("s", 3), ("g", 3), ("s", 4))] + [("lost", 512, "one", "one", 32, 0, "r", "F", 5, 1)]
    got = link.calls(spark.createDataFrame(seen, schemas.OCCURRENCE), spark.createDataFrame([(*r, "n") for r in relations], schemas.RELATION)).collect()
    assert sorted((r.caller_usr, r.callee_usr, r.line) for r in got) == [("one", "callee", 1), ("one", "g", 3), ("one", "s", 4), ("two", "callee", 2)]


def test_a_record_counts_in_the_first_unit_in_scope(spark):
    rows = [occurrence("a", "a", 2, 1, "App"), occurrence("a", "a", 2, 1, "Tests"), occurrence("b", "b", 2, 2, "Lib", record="q"), occurrence("c", "c", 2, 3, "Kit", True, "k")]
    seen = spark.createDataFrame(rows, schemas.OCCURRENCE)
    kept = link.once_per_record(link.in_scope(seen, ["Tests"])).collect()
    assert sorted((r.usr, r.module) for r in kept) == [("a", "Tests"), ("c", "Kit")]
    assert link.skipped_units(seen, ["Tests"]).first().skipped == 2


def test_extended_types_of_definitions_alone(spark):
    rows = [("m", 512, "other", "o", 4, 0), ("m", 512, "ext", "e", 2, 1), ("T", 16384, "ext", "e", 4, 0), ("U", 16384, "other", "o", 4, 0), ("n", 512, "ext", "e", 4, 0)]
    relations = spark.createDataFrame([(*r, "r", "F", 1, 1, "n") for r in rows], schemas.RELATION)
    assert [tuple(r) for r in link.extended_type(relations).collect()] == [("m", "T")]
    held = [("m", "syntactic:T"), ("n", "syntactic:T"), ("syntactic:T.m#1", "syntactic:T"), ("k", "T")]
    table = spark.createDataFrame(held + [("m", "real")], "usr string, containing_type_usr string")
    assert sorted(tuple(r) for r in link.with_extended_type(table, relations).collect()) == sorted([("m", "T"), ("m", "real"), *held[1:]])


def test_pairs_that_need_an_answer(spark):
    declared = [(u, u, None, False, "nominal", False, None, True, None, False, f, 1, 1, False, False, 0) for u, f in (("w", "F"), ("local", "F"), ("placeless", None))]
    pairs = [("w", 0, "open", None, True, False), ("w", 1, "witness", None, False, True), ("w", 2, "apart", None, False, False), ("w", 3, "local", None, True, True), ("w", 4, "placeless", None, True, True)]
    pairs += [("w", 5, "named", "MainActor", True, True), ("w", 6, "s:s8SendableP", None, True, True), ("w", 7, "s:s16SendableMetatypeP", None, True, True)]
    d, c = spark.createDataFrame(declared, schemas.DECLARATION), spark.createDataFrame(pairs, schemas.CONFORMANCE)
    got = backfill.needs(d, c, spark.createDataFrame([("nominal",)], "usr string")).collect()
    assert sorted((r.kind, r.target, r.pair_of) for r in got) == [("pair", "open", "nominal"), ("pair", "placeless", "nominal"), ("pair", "witness", "nominal")]


def test_fragments(spark):
    kinds = "f array<struct<kind: string, spelling: string, preciseIdentifier: string>>"
    rows = [([("attribute", "@MainActor", "s:ScM"), ("text", " ", None)],), ([("keyword", "nonisolated", None)],), ([("text", "x", None)],), ([("attribute", "@Mine", None)],)]
    got = spark.createDataFrame(rows, kinds).select(backfill.fragment_isolation("f").alias("a"), backfill.fragment_isolation("f", ["Mine"]).alias("b")).collect()
    assert [r.a for r in got] == ["globalActor(MainActor)", "nonisolated", "nonisolated", "nonisolated"]
    assert got[3].b == "globalActor(Mine)"


def test_chunks(spark):
    items = [(f, k) for f, n in (("a", 4), ("b", 1), ("c", 1), ("d", 1), ("e", 1), ("f", 1)) for k in range(n)]
    got = staleness.balanced_chunks(spark.createDataFrame(items, "file string, k int"), 2).collect()
    assert {r.file for r in got if r.chunk == 0} == {"a", "b", "c"} and {r.file for r in got if r.chunk == 1} == {"d", "e", "f"}


def test_staleness(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], schemas.MANIFEST)
    new = spark.createDataFrame([("a", "2"), ("c", "1")], schemas.MANIFEST)
    assert staleness.freshness(old, new) == ("stale", ["a", "b", "c"]) and staleness.freshness(old, old) == ("fresh", []) and staleness.freshness(None, new)[0] == "noManifest"
    assert staleness.action(True, "fresh", False, False) == "proceed" and staleness.action(True, "stale", False, False) == "stop"


def test_arguments_are_sanitized(spark):
    row = spark.createDataFrame([(["-frontend", "-c", "-working-directory", "/x", "-O"],)], "a array<string>").select(staleness.sanitized("a").alias("s")).first()
    assert row.s == ["-c", "-O"]
    assert readers.tokens("a 'b c' \"d\\\"e\" f\\ g\th") == ["a", "b c", 'd"e', "f g", "h"]


def test_logs_and_settings(spark, tmp_path):
    log = tmp_path / "build.log"
    log.write_text(
        "noise\n/bin/swift-frontend -frontend -c -primary-file A.swift B.swift -O\nswift-frontend -frontend -c -wmo C.swift D.swift\n"
        "swift-frontend -frontend -c -primary-file A.swift -last\nswift-frontend -frontend -emit-module A.swift C.swift\n"
        "swift-frontend -c -primary-file A.swift\necho swift-frontend -frontend -primary-file A.swift\n"
    )
    got = {r.file: r.args for r in readers.package_build_log(spark, str(log)).collect()}
    assert set(got) == {"A.swift", "C.swift", "D.swift"} and got["A.swift"][-1] == "-last"
    settings = tmp_path / "settings"
    settings.write_text("    SDK = one\n    SDK = two\n    lower = x\n    NAME = a b\n")
    assert {(r.key, r.value) for r in readers.build_settings(spark, str(settings)).collect()} == {("SDK", "one"), ("NAME", "a b")}
    names = tmp_path / "module.modulemap"
    names.write_text("framework module Kit {\n}\nmodule Other {}\n")
    assert {r.module for r in readers.module_names(spark, str(names)).collect()} == {"Kit", "Other"}


def test_sources_and_graphs(spark, tmp_path):
    (tmp_path / "src" / ".build").mkdir(parents=True)
    (tmp_path / "src" / "a.swift").write_text("let x = 1\n")
    (tmp_path / "src" / "b.swift").write_bytes(b"\xff\xfe")
    (tmp_path / "src" / ".build" / "c.swift").write_text("no")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in readers.source_files(spark, str(tmp_path / "src")).collect()}
    assert got == {"a.swift": "let x = 1\n", "b.swift": None}
    (tmp_path / "m.symbols.json").write_text('{"symbols": [{"identifier": {"precise": "s:a"}, "kind": {"identifier": "class"}, "declarationFragments": []}], "relationships": [{"kind": "memberOf", "source": "s:b", "target": "s:a"}]}')
    symbols, relations = readers.symbol_graphs(spark, str(tmp_path))
    assert [r.usr for r in symbols.collect()] == ["s:a"] and [tuple(r) for r in relations.collect()] == [("memberOf", "s:b", "s:a")]
