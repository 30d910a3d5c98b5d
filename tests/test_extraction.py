import json

import pytest

from domgraph import cli, schemas
from domgraph.operators import project
from domgraph.sources import extraction, readers, syntax


def file(source, platform=None, name="Sources/A.swift"):
    return syntax.File(source, name, platform)


def named(found, relation="declaration"):
    columns = [c.split()[0] for c in extraction.RELATIONS[relation].split(", ")]
    return [dict(zip(columns, row, strict=True)) for row in found.rows[relation]]


def members(source, **settings):
    return {d["name"]: d for d in named(file(source, **settings))}


def test_isolation_that_is_written_down():
    got = members("""
        @globalActor actor Own { static let shared = Own() }
        @globalActor class Open {}
        @Own class A { nonisolated func free() {}; @MainActor func main() {}; func plain() {}; @Open func other() {} }
        @MainActor extension A { func inside() {}; nonisolated func out() {} }
        nonisolated extension A { func off() {} }
    """)
    said = {k: d["explicit_isolation"] for k, d in got.items()}
    assert said["A"] == "globalActor(Own)" and said["free"] == "nonisolated" and said["main"] == "globalActor(MainActor)"
    assert said["plain"] is said["other"] is said["inside"] is None and said["out"] == "nonisolated"
    assert got["inside"]["enclosing_extension_isolation"] == "globalActor(MainActor)" and got["off"]["enclosing_extension_isolation"] == "nonisolated"
    assert got["plain"]["enclosing_extension_isolation"] is None and got["Own"]["is_actor_type"]


def test_types_and_their_parents():
    source = """
        class C: Base, P, Space.Kit<Int>, @unchecked Sendable, ~Copyable { struct In {} }
        class D: P {}
        protocol P: Q {}
        extension C: Late {}
        struct S: Base {}
        extension Far { func f() {} }
    """
    found = file(source)
    rows = {d["usr"]: d for d in named(found)}
    assert rows["syntactic:C"]["superclass_usr"] == "syntactic:Base" and rows["syntactic:D"]["superclass_usr"] is None
    assert rows["syntactic:C.In"]["is_nested_type"] and rows["syntactic:C.In"]["containing_type_usr"] == "syntactic:C"
    assert not rows["syntactic:C"]["eligible_default"] and rows["syntactic:D"]["eligible_default"]
    assert "syntactic:Far" in rows and rows["syntactic:Far"]["file"] is None
    pairs = {(c["usr"], c["protocol_usr"]): c for c in named(found, "conformance")}
    assert {p for u, p in pairs if u == "syntactic:C"} == {"syntactic:P", "syntactic:Kit", "syntactic:Sendable", "syntactic:Late"}
    assert pairs["syntactic:C", "syntactic:P"]["same_file_as_primary"] and not pairs["syntactic:C", "syntactic:Late"]["same_file_as_primary"]
    assert found.rows["protocol_parent"] == [("P", "Q")]
    assert sum(d["usr"] == "syntactic:C" for d in named(found)) == 1


def test_members_of_every_kind():
    source = (
        "actor A {\n  let a = f(1, 2), b: [String: Int] = [:]\n  var c: Int { get { 1 } set { } }\n  var d: Int = 0 { didSet { let local = 1 } }\n"
        "  init() {}\n  deinit {}\n  subscript(i: Int) -> Int { i }\n  static func == (l: A, r: A) -> Bool { true }\n  typealias T = Int\n}\n"
        "enum E { case one, two(Int, x: String = \"}\"); indirect case three }\n"
        "func top() { if let x = y, let z = w { }; guard let v = u else { return }; for let q in p { }; switch s { case .k(let m): break } }\n"
    )
    found = named(file(source))
    names = [d["name"] for d in found]
    assert names == ["A", "a", "b", "c", "get", "set", "d", "didSet", "local", "init", "deinit", "subscript", "==", "T", "E", "one", "two", "three", "top"]
    by = {d["name"]: d for d in found}
    assert by["a"]["is_immutable_stored_property"] and by["b"]["is_immutable_stored_property"] and not by["c"]["is_immutable_stored_property"]
    assert by["init"]["is_actor_initializer"] and not by["deinit"]["is_actor_initializer"] and by["=="]["is_static_member"]
    assert not any(by[n]["eligible_default"] for n in ("a", "T", "get", "one")) and by["top"]["eligible_default"]
    assert (by["b"]["line"], by["b"]["col"]) == (2, 20) and by["a"]["usr"] == f"syntactic:A.a#{source.index('a = f')}"
    assert by["top"]["usr"] == f"syntactic:.top#Sources_A_swift_{source.index('func top')}"


def test_witnesses_and_requirements():
    found = file("""
        @MainActor protocol Whole { func go() }
        protocol Parts { @MainActor var one: Int { get }; func two() }
        struct W: Parts { var one: Int { 1 }; func two() {} }
        extension W: Whole { func go() {} }
    """)
    assert found.rows["protocol_actor"] == [("Whole", "MainActor", "Sources/A.swift")]
    assert found.rows["protocol_requirement_actor"] == [("Parts", "one", "MainActor", "Sources/A.swift")]
    actors = {(c["usr"].split("#")[0], c["protocol_usr"]): c["protocol_global_actor_name"] for c in named(found, "conformance")}
    assert actors["syntactic:W.one", "syntactic:Parts"] == "MainActor" and actors["syntactic:W.two", "syntactic:Parts"] is None
    assert actors["syntactic:W.go", "syntactic:Whole"] == "MainActor" and actors["syntactic:W", "syntactic:Parts"] is None


def closures(source):
    lines = source.split("\n")
    return [(lines[r[1] - 1][r[2] - 1 : r[4] - 1] if r[1] == r[3] else None, *r[5:8]) for r in file(source).rows["closure_literal"]]


def test_closures_are_told_from_blocks():
    source = (
        "func f() { DispatchQueue.main.async { 1 }; DispatchQueue.main.asyncAfter(deadline: .now(), execute: { 2 })\n"
        " Task { @MainActor [weak self] in 3 }; a.b?.map({ 4 }); let c = { 5 }; x = { 6 }() ; queue().async(group: g) { 7 }\n"
        " if a { } else if b.c { } else { }; while x { }; do { } catch let e { }; for i in 0..<3 { }; switch x { default: { 8 }() }\n"
        " var v: Int { 9 }; var w = 1 { willSet { } }; defer { }; guard g else { return }; foo { 10 }; .shape { 11 }\n}\n"
        "init() { }\n"
    )
    assert closures(source) == [
        ("{ 1 }", None, "DispatchQueue.main", "async"),
        ("{ 2 }", None, "DispatchQueue.main", "asyncAfter"),
        ("{ @MainActor [weak self] in 3 }", "MainActor", None, None),
        ("{ 4 }", None, None, None),
        ("{ 5 }", None, None, None),
        ("{ 6 }", None, None, None),
        ("{ 7 }", None, "queue()", "async"),
        ("{ 8 }", None, None, None),
        ("{ 10 }", None, None, None),
        ("{ 11 }", None, None, None),
    ]


def test_awaits():
    source = "func f() async { let a = await g(1).h[2]?.i + 3; for await x in s { }; try await k { 1 }; if await m() { }\n print(\"\\(await n())\") }"
    lines = source.split("\n")
    got = [lines[r[1] - 1][r[2] - 1 : r[4] - 1] for r in file(source).rows["awaited_range"]]
    assert got == ["await g(1).h[2]?.i", "await k { 1 }", "await m()", "await n()"]


def test_comments_and_literals_hide_what_they_hold():
    source = (
        "// class A {}\n/* class B { /* class C {} */ } */ let s = \"class D { \\(x) \\\" {\"\n"
        'let m = """\nclass E { " \n"""\nlet r = #"class F \\("# ; struct Real { let é = "ü"; let `class` = 1 }\n'
    )
    assert [d["name"] for d in named(file(source))] == ["s", "m", "r", "Real", "é", "class"]
    last = named(file(source))[-1]
    assert last["col"] == len(source.split("\n")[last["line"] - 1].split("`class`")[0].encode()) + 1


@pytest.mark.parametrize("platform,want", [(None, "abcdefg"), ("iOS", "adfg"), ("macOS", "befg"), ("watchOS", "cefg")])
def test_conditional_compilation(platform, want):
    source = """
        #if os(iOS) || os(tvOS)
        func a() {}
        #elseif os(OSX)
        func b() {}
        #else
        func c() {}
        #endif
        #if canImport(UIKit) && !os(watchOS)
        func d() {}
        #else
        func e() {}
        #endif
        #if DEBUG && (swift(>=5.9) || arch(arm64))
        func f() {}
        #endif
        func g() {}
    """
    assert "".join(d["name"] for d in named(file(source, platform))) == want


@pytest.mark.parametrize("source", ["", "}", "{", "class", "func", "let", "@", "#if", "#endif", "case", '"\\(', "/*", "a.b {", "await", "enum E { case", "class A: ", "actor", "init", "subscript", "extension {", "let (a"])
def test_broken_sources_give_what_they_can(source):
    file(source), file(source, "iOS"), file("class X { " + source)


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "Sources").mkdir()
    (tmp_path / "Sources" / "A.swift").write_text("@MainActor final class Screen {\n  func show() {}\n}\n")
    (tmp_path / "Sources" / "B.swift").write_text("func run() {\n  Screen().show()\n  DispatchQueue.main.async { Screen().show() }\n}\nstruct Odd: Refreshable { func refresh() {} }\n")
    (tmp_path / "Sources" / "C.swift").write_text("@MainActor protocol Refreshable { func refresh() }\n")
    (tmp_path / "Sources" / "D.swift").write_bytes(b"\xff\xfe class No {}")
    return str(tmp_path / "Sources")


def index(spark, root):
    a, b, c = (f"file:{root}/{n}.swift" for n in "ABC")
    seen = [("s:Screen", "Screen", 2, a, 1, 24), ("s:show", "show()", 2, a, 2, 8), ("s:run", "run()", 2, b, 1, 6), ("s:show", "show()", 32, b, 2, 12), ("s:show", "show()", 32, b, 3, 38)]
    seen += [("s:Odd", "Odd", 2, b, 5, 8), ("s:refresh", "refresh()", 2, b, 5, 32), ("s:Refreshable", "Refreshable", 2, c, 1, 21)]
    occurrences = [(u, n, r, f, line, col, "App", False, f) for u, n, r, f, line, col in seen]
    relations = [("s:show", 8192, "s:run", "run()", 32, 0, b, b, line, col, "show()") for line, col in ((2, 12), (3, 38))]
    return spark.createDataFrame(occurrences, schemas.OCCURRENCE), spark.createDataFrame(relations, schemas.RELATION)


def test_a_project_from_its_sources(spark, sources):
    facts = extraction.facts(readers.source_files(spark, sources))
    found = project.linked(facts, *index(spark, sources), ["App"])
    got = project.analyzed(found)
    isolations = {r.usr: r.isolation for r in got.nodes.collect()}
    assert isolations["s:show"] == isolations["s:Screen"] == "globalActor(MainActor)" and isolations["s:run"] == "nonisolated"
    # The witness takes the actor that another file gives its protocol, and so does its type.
    assert isolations["s:refresh"] == isolations["s:Odd"] == "globalActor(MainActor)"
    edges = {r.line: (r.caller_isolation, r.risk) for r in got.edges.collect()}
    assert edges == {2: ("nonisolated", "high"), 3: ("globalActor(MainActor)", "low")}
    assert got.summary.first().high_risk_boundaries == 1
    rows = project.work_items(found, 2).collect()
    assert [r.usr for r in rows] == [u for u in (r.usr for r in rows) if u.startswith("syntactic:")]


def test_command_line_from_a_folder_of_sources(spark, sources, tmp_path, capsys):
    occurrences, relations = index(spark, sources)
    occurrences.write.parquet(str(tmp_path / "index" / "occurrence.parquet"))
    relations.write.parquet(str(tmp_path / "index" / "relation.parquet"))
    out = str(tmp_path / "report.json")
    assert cli.main([sources, "--sources", "--index", str(tmp_path / "index"), "--out", out]) == 1
    whole = json.load(open(out))
    assert whole["summary"]["highRiskBoundaries"] == 1 and len(whole["edges"]) == 2
    assert cli.main([sources, "--sources", "--format", "mermaid"]) == 0
    assert "flowchart LR" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "nothing")]) == 2
