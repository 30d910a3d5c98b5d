from pyspark.sql import functions as F

from domgraph import schemas
from domgraph.operators import project, staleness
from domgraph.plans import sinks
from domgraph.sources import readers


def test_a_project_build_log_and_its_lists(spark, tmp_path):
    lists = [tmp_path / n for n in ("one.list", "two.list")]
    lists[0].write_text("  /src/A\\ b.swift \n\n/src/B.swift\n")
    lists[1].write_text("/src/B.swift\n")
    log = tmp_path / "log"
    log.write_text(f"noise\n  builtin-Swift-Compilation -- swiftc -O @{lists[0]}\nbuiltin-Swift-Compilation -- swiftc -last @{lists[1]}\n")
    calls = readers.project_build_log(spark, str(log))
    listed = readers.response_files(spark, [str(x) for x in lists]).withColumn("file_list", F.regexp_replace("file_list", "^file:/+", "/"))
    got = {r.file: r.args for r in readers.arguments(calls, listed).collect()}
    assert set(got) == {"/src/A b.swift", "/src/B.swift"} and got["/src/B.swift"][1] == "-last" and got["/src/A b.swift"][1] == "-O"
    assert not readers.enough_files(readers.arguments(calls, listed)) and readers.enough_files(readers.arguments(calls, listed), 2)


def test_schemes_and_packages(spark, tmp_path):
    scheme = tmp_path / "A.xcscheme"
    scheme.write_text('<Scheme><BuildAction><BuildableReference BlueprintName="App" BuildableName="App.app"/><BuildableReference BlueprintName="Kit" BuildableName="Kit.framework"/></BuildAction></Scheme>')
    assert {(r.name, r["product"]) for r in readers.scheme_targets(spark, str(scheme)).collect()} == {("App", "App.app"), ("Kit", "Kit.framework")}
    package = tmp_path / "p.json"
    package.write_text('{"products": [{"name": "P", "targets": ["T", "gone"]}],\n "targets": [{"name": "T", "path": "S/T", "sources": ["a.swift"]}, {"name": "U", "path": "S/U", "sources": []}]}')
    products, targets = readers.package(spark, str(package))
    assert {tuple(r) for r in staleness.schemes(products, targets).collect()} == {("P", "T", "S/T"), ("T", "T", "S/T"), ("U", "U", "S/U")}


def test_manifests(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert readers.read_manifest(spark, path) is None
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], schemas.MANIFEST)
    sinks.write_manifest(rows, path)
    assert sorted(readers.read_manifest(spark, path).collect()) == sorted(rows.collect())
    sinks.write_manifest(rows.limit(1), path)
    assert readers.read_manifest(spark, path).count() == 1
    (tmp_path / "broken").write_text("{not json")
    assert readers.read_manifest(spark, str(tmp_path / "broken")) is None


def test_small_texts(spark, tmp_path):
    said = tmp_path / "destinations"
    said.write_text("Available:\n { platform:macOS, arch:arm64 }\n { platform:iOS Simulator, id:1 }\n { platform:tvOS Simulator, id:2 }\n")
    assert readers.simulator(spark, str(said)) == "iOS Simulator"
    answers = spark.createDataFrame([("s:4Mod1aC ---> Mod.a",), ("noise",)], "line string")
    assert [tuple(r) for r in readers.demangled(answers).collect()] == [("s:4Mod1aC", "Mod.a")]
    xml = '<d xmlns:x="u"><syntaxtype.attribute.name>@MainActor</syntaxtype.attribute.name> func</d>'
    got = spark.createDataFrame([(xml,), ("<broken",), (None,)], "x string").select(readers.attribute_names("x").alias("n")).collect()
    assert [r.n for r in got] == [["MainActor"], None, None]


def test_lines_come_in_file_order(spark, tmp_path):
    path = tmp_path / "long"
    path.write_text("".join(f"line {k}\r\n" for k in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = readers.lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4
        assert [r.line for r in rows.orderBy("line_no").collect()] == [f"line {k}" for k in range(50_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_plan_dump_and_items(spark):
    items = spark.createDataFrame([("u", "F", 3, 4), ("t", "F", 1, 9), ("v", "G", 1, 1)], "usr string, file string, line int, col int")
    assert sinks.plan_dump(items).first().line == "u\tF:3:4"
    assert [(r.usr, r.chunk, r.nth) for r in project.ordered_items(items, 2).orderBy("chunk", "nth").collect()] == [("t", 0, 0), ("u", 0, 1), ("v", 1, 0)]
    assert project.live_files(items).first().files == 2
