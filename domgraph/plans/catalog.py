"""Registered queries: every operator over fact tables that are derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domgraph.functions import grammar
from domgraph.operators import backfill, intervals, link, project, report, resolve, staleness
from domgraph.plans import sinks
from domgraph.plans.facts import fact
from domgraph.plans.oracle import ORACLES as ORACLES
from domgraph.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _facts(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [fact(spark, sf_dir, n) for n in names]


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(*_facts(spark, sf_dir, "declaration", "conformance"))


def _edges(spark: SparkSession, sf_dir: str, resolved: DataFrame) -> DataFrame:
    declarations, calls, closures, names, awaited, unknown = _facts(
        spark, sf_dir, "declaration", "call_edge", "closure_literal", "global_actor_name", "awaited_range", "unknown_usr"
    )
    return report.report_edges(declarations, calls, resolved, intervals.classify_closures(closures, names), awaited, unknown)


@query
def resolve_hierarchy(spark, sf_dir):
    """The isolation of every declaration."""
    return _resolved(spark, sf_dir)


@query
def cross_edges(spark, sf_dir):
    """Calls between different isolations."""
    return report.cross_edges(fact(spark, sf_dir, "call_edge"), _resolved(spark, sf_dir))


@query
def closure_override(spark, sf_dir):
    """The innermost closure's override at each call site."""
    calls, closures, names = _facts(spark, sf_dir, "call_edge", "closure_literal", "global_actor_name")
    return intervals.closure_override(calls, intervals.classify_closures(closures, names))


@query
def awaited_edges(spark, sf_dir):
    """Call sites in an awaited range."""
    return intervals.awaited_sites(*_facts(spark, sf_dir, "call_edge", "awaited_range"))


@query
def risk_edges(spark, sf_dir):
    """Reported edges with risk and explanation."""
    return _edges(spark, sf_dir, _resolved(spark, sf_dir))


@query
def severity_filter(spark, sf_dir):
    """Reported edges of high risk and uncertain ones."""
    return report.severity_filter(_edges(spark, sf_dir, _resolved(spark, sf_dir)), "high")


@query
def synthetic_nodes(spark, sf_dir):
    """Nodes of reported endpoints without a declaration."""
    return report.synthetic_nodes(_edges(spark, sf_dir, _resolved(spark, sf_dir)), fact(spark, sf_dir, "declaration"))


@query
def report_nodes(spark, sf_dir):
    """All nodes of the report."""
    resolved = _resolved(spark, sf_dir)
    return report.nodes(fact(spark, sf_dir, "declaration"), resolved, _edges(spark, sf_dir, resolved))


@query
def risk_summary(spark, sf_dir):
    """The summary counters."""
    resolved = _resolved(spark, sf_dir)
    declarations, conformances, calls = _facts(spark, sf_dir, "declaration", "conformance", "call_edge")
    return report.summary(declarations, conformances, calls, resolved, _edges(spark, sf_dir, resolved))


@query
def uncertainty_rate(spark, sf_dir):
    """How many reported edges are uncertain."""
    return report.uncertainty(_edges(spark, sf_dir, _resolved(spark, sf_dir)))


@query
def severity_summary(spark, sf_dir):
    """How many edges each level of the filter keeps."""
    edges = _edges(spark, sf_dir, _resolved(spark, sf_dir))
    kept = None
    for level in report.RISKS:
        rows = report.severity_filter(edges, level).groupBy("risk").agg(F.count("*").alias("n")).withColumn("level", F.lit(level))
        kept = rows if kept is None else kept.unionByName(rows)
    return kept


@query
def protocol_closure(spark, sf_dir):
    """G1: all ancestors of each protocol, through a cycle."""
    return link.protocol_closure(fact(spark, sf_dir, "protocol_parent"))


@query
def conformance_expansion(spark, sf_dir):
    """Conformances with every ancestor protocol."""
    conformances, parents = _facts(spark, sf_dir, "conformance", "protocol_parent")
    return link.with_ancestors(conformances, link.protocol_closure(parents))


@query
def location_link(spark, sf_dir):
    """Declarations and the symbols at their place."""
    declarations, symbols = _facts(spark, sf_dir, "declaration", "indexed_symbol")
    return link.match_locations(declarations, symbols)


@query
def own_identity(spark, sf_dir):
    """Declarations under the symbol of their place, else of their placeholder."""
    declarations, symbols = _facts(spark, sf_dir, "declaration", "indexed_symbol")
    matched = link.match_locations(declarations, symbols)
    return link.own_identity(declarations, matched, link.placeholder_map(declarations, matched)).select("usr", "name", "file", "line")


@query
def merge_collisions(spark, sf_dir):
    """A1: declarations that fall together on one symbol."""
    rows = fact(spark, sf_dir, "declaration").withColumn("usr", F.concat(F.left("usr", F.lit(1)), (F.col("ord") % 500).cast("string")))
    return link.merge(rows)


@query
def accessor_canon(spark, sf_dir):
    """Calls with accessors replaced by their property."""
    calls, relations = _facts(spark, sf_dir, "call_edge", "relation")
    return link.canonical(calls, link.accessor_owner(relations))


@query
def setter_suppress(spark, sf_dir):
    """Calls of odd symbols where no call of an even one is made."""
    calls = fact(spark, sf_dir, "call_edge")
    odd = F.substring("callee_usr", 2, 20).cast("bigint") % 2 == 1
    return link.without_setters(calls.where(odd), calls.where(~odd & (F.col("line") % 20 == 0)))


@query
def call_graph_union(spark, sf_dir):
    """Calls of known symbols, and of unknown ones in some files."""
    calls, declarations = _facts(spark, sf_dir, "call_edge", "declaration")
    return link.call_graph(calls, declarations, calls.where("line % 3 = 0 AND col > 78").select("file"))


@query
def base_of(spark, sf_dir):
    """Base names that stand for one symbol."""
    return link.unique_base(fact(spark, sf_dir, "relation"))


@query
def earliest_callsite(spark, sf_dir):
    """A5: the first call of each symbol."""
    return link.earliest_call(fact(spark, sf_dir, "call_edge"))


@query
def mangled_forms(spark, sf_dir):
    """What the symbol grammar reads from mangled names."""
    u = F.col("usr")
    return fact(spark, sf_dir, "mangled").select(
        "p_partkey",
        "usr",
        grammar.imported_struct_container(u).alias("struct"),
        grammar.is_imported_constant(u).alias("constant"),
        grammar.swift_enum(u).alias("swift_enum"),
        grammar.objc_enum(u).alias("objc_enum"),
        grammar.hashable_owner(u).alias("hashable"),
        grammar.subscript_declaration(u).alias("subscript"),
        grammar.static_declaration(u).alias("static"),
        grammar.objc_property(u).alias("property"),
        grammar.module_suffix(u).alias("suffix"),
        grammar.without_module_qualifier(u).alias("unqualified"),
    )


def _known_types(spark, sf_dir):
    mangled = fact(spark, sf_dir, "mangled").where("p_partkey % 2 = 0")
    return mangled.select(F.coalesce(grammar.swift_enum(F.col("usr")), grammar.hashable_owner(F.col("usr"))).alias("usr")).where("usr IS NOT NULL")


@query
def matcher_chain(spark, sf_dir):
    """The first matcher that settles each unknown callee."""
    mangled = fact(spark, sf_dir, "mangled")
    bulk = mangled.where("p_partkey % 4 <> 1").select(
        F.coalesce(grammar.subscript_declaration(F.col("usr")), grammar.static_declaration(F.col("usr")), grammar.objc_property(F.col("usr"))).alias("usr"),
        F.lit("globalActor(MainActor)").alias("isolation"),
    )
    return backfill.matcher_chain(mangled, _known_types(spark, sf_dir), bulk.where("usr IS NOT NULL").distinct())


@query
def sibling_alias(spark, sf_dir):
    """Callees and the same symbol of another module."""
    parts = fact(spark, sf_dir, "mangled").where("p_partkey % 9 = 3")
    moved = parts.select(F.regexp_replace("usr", "^s:4Moya", "s:5MoyaX").alias("usr")).union(
        parts.select(F.regexp_replace("usr", "^s:4Moya", "s:6AMoyaX").alias("usr"))
    )
    return backfill.sibling_facts(parts, moved)


@query
def inherit_chain(spark, sf_dir):
    """The nearest signal up the superclass chain."""
    types = fact(spark, sf_dir, "declaration").where("usr LIKE 'P%'").select("usr", "superclass_usr", F.col("explicit_isolation").alias("signal"))
    return backfill.nearest_signal(types)


@query
def bulk_lookup(spark, sf_dir):
    """Verdicts of members through their type's chain, looked up for callees."""
    declarations, calls = _facts(spark, sf_dir, "declaration", "call_edge")
    types = declarations.where("usr LIKE 'P%'").select("usr", "superclass_usr", F.col("explicit_isolation").alias("signal"))
    chains = backfill.nearest_signal(types)
    members = declarations.where("usr LIKE 'S%'").select("usr", F.col("explicit_isolation").alias("signal"), F.col("superclass_usr").alias("member_of"))
    verdicts = backfill.external_verdict(members, chains)
    return calls.select(F.col("callee_usr").alias("usr")).distinct().join(verdicts, "usr")


@query
def claim_once(spark, sf_dir):
    """Each superclass and container claimed by one declaration."""
    declarations = fact(spark, sf_dir, "declaration").where("explicit_isolation IS NULL AND enclosing_extension_isolation IS NULL")
    wanted = declarations.select(
        F.lit("superclass").alias("kind"), F.col("superclass_usr").alias("target"), F.lit("").alias("pair_of"), F.col("is_nested_type").cast("int").alias("tier"), "file", "line", "col", "usr"
    ).unionByName(
        declarations.select(
            F.lit("container").alias("kind"), F.col("containing_type_usr").alias("target"), F.lit("").alias("pair_of"), F.col("is_static_member").cast("int").alias("tier"), "file", "line", "col", "usr"
        )
    )
    return backfill.claim_once(wanted.where("target IS NOT NULL")).select("kind", "target", "usr", "tier")


@query
def pair_fanout(spark, sf_dir):
    """An actor found for (nominal, protocol) on every conformance of the pair."""
    conformances, declarations = _facts(spark, sf_dir, "conformance", "declaration")
    found = declarations.where("usr LIKE 'N%'").select(F.col("usr").alias("nominal"), F.concat(F.lit("Q"), (F.col("ord") % 7).cast("string")).alias("protocol_usr"), F.lit("MainActor").alias("actor"))
    return backfill.pair_fanout(conformances, declarations.select("usr", "containing_type_usr"), found)


@query
def unknown_propagation(spark, sf_dir):
    """Failed symbols and their members."""
    failed = fact(spark, sf_dir, "declaration").where("usr LIKE 'C%' AND ord % 19 = 0 OR usr LIKE 'N%' AND ord % 6 = 0").select("usr")
    return backfill.propagate_unknown(failed, fact(spark, sf_dir, "declaration"))


@query
def overlay_merge(spark, sf_dir):
    """Updated and backfilled facts over declarations."""
    declarations = fact(spark, sf_dir, "declaration").withColumn("file", F.when(F.col("ord") % 5 != 0, F.col("file")))
    updated = declarations.where("ord % 7 = 0").withColumn("explicit_isolation", F.lit("globalActor(Updated)"))
    extra = declarations.where("ord % 3 = 0").withColumn("explicit_isolation", F.lit("globalActor(Backfilled)")).withColumn("file", F.lit(None).cast("string"))
    extra = extra.unionByName(extra.where("ord % 6 = 0").withColumn("usr", F.concat(F.lit("new"), "usr")))
    return backfill.overlay(declarations, updated, extra).select("usr", "explicit_isolation", "file")


@query
def manifest_diff(spark, sf_dir):
    """Documents that are new, changed or gone since the last manifest."""
    return staleness.manifest_diff(*_facts(spark, sf_dir, "manifest_old", "manifest_new"))


@query
def balanced_chunks(spark, sf_dir):
    """Call sites dealt to eight workers by whole files."""
    chunks = staleness.balanced_chunks(fact(spark, sf_dir, "call_edge"), 8)
    return chunks.groupBy("chunk").agg(F.countDistinct("file").alias("files"), F.count("*").alias("items"))


@query
def closest_name(spark, sf_dir):
    """the nearest nation for misspelt ones."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"))
    return staleness.closest_name(names.select(F.concat(F.expr("substring(name, 2, 100)"), F.lit("x")).alias("requested")), names)


@query
def mermaid_lines(spark, sf_dir):
    """The Mermaid diagram's lines."""
    resolved = _resolved(spark, sf_dir)
    edges = _edges(spark, sf_dir, resolved)
    return sinks.mermaid_lines(report.nodes(fact(spark, sf_dir, "declaration"), resolved, edges), edges)


@query
def dot_lines(spark, sf_dir):
    """The DOT graph's lines."""
    resolved = _resolved(spark, sf_dir)
    edges = _edges(spark, sf_dir, resolved)
    return sinks.dot_lines(report.nodes(fact(spark, sf_dir, "declaration"), resolved, edges), edges)


@query
def scope_filter(spark, sf_dir):
    """Definitions in scope, each record counted in the first unit of those in scope that hold it."""
    occurrences = fact(spark, sf_dir, "occurrence")
    return link.definitions(link.once_per_record(link.in_scope(occurrences, ["M1", "M3"])))


@query
def skipped_units(spark, sf_dir):
    """How many units are out of scope."""
    return link.skipped_units(fact(spark, sf_dir, "occurrence"), ["M1", "M3"])


@query
def call_projection(spark, sf_dir):
    """Call occurrences with their own caller; setters where no getter is called."""
    return link.calls(*_facts(spark, sf_dir, "occurrence", "relation"))


@query
def extended_type(spark, sf_dir):
    """Members of extensions and the types these extend."""
    return link.extended_type(fact(spark, sf_dir, "relation"))


@query
def extension_containers(spark, sf_dir):
    """Members of extensions whose container is a placeholder, under the extended type."""
    declarations, relations = _facts(spark, sf_dir, "declaration", "relation")
    placed = declarations.where("usr LIKE 'O%'").withColumns(
        {
            "containing_type_usr": F.when(F.col("ord") % 2 == 0, F.concat(F.lit(link.PLACEHOLDER), "containing_type_usr")).otherwise(F.col("containing_type_usr")),
        }
    )
    return link.with_extended_type(placed, relations).select("usr", "containing_type_usr")


@query
def conformance_actor(spark, sf_dir):
    """Actors of placeholder protocols filled in."""
    conformances = fact(spark, sf_dir, "conformance").withColumn("protocol_usr", F.concat(F.lit(link.PLACEHOLDER), "protocol_usr"))
    wholes = spark.sql("SELECT 'Q1' AS protocol, 'DataActor' AS actor UNION ALL SELECT 'Q4', 'IndexActor'")
    ones = spark.sql("SELECT 'Q2' AS protocol, 'run' AS requirement, 'MainActor' AS actor UNION ALL SELECT 'Q5', 'stop', 'DataActor'")
    names = conformances.select("usr").distinct().withColumn("name", F.when(F.col("usr").endswith("1"), "run").otherwise("stop"))
    return link.backfill_conformance_actor(conformances, wholes, ones, names)


@query
def demangled_sibling(spark, sf_dir):
    """Callees and the only declaration of the same demangled signature."""
    parts = fact(spark, sf_dir, "mangled").select("p_partkey", "usr")
    number = (F.col("p_partkey") % 300).cast("string")
    wanted = parts.where("p_partkey % 4 = 0").select("usr", F.concat(F.lit("ModA.Type"), number, F.lit(".run() -> ()")).alias("demangled"))
    known = parts.where("p_partkey % 3 = 0").select(F.concat(F.lit("d"), "usr").alias("usr"), F.concat(F.lit("ModB.Type"), (F.col("p_partkey") % 500).cast("string"), F.lit(".run() -> ()")).alias("demangled"))
    return backfill.demangled_sibling(wanted, known)


@query
def external_needs(spark, sf_dir):
    """Parents that neither a located declaration nor a fact answers."""
    declarations, conformances = _facts(spark, sf_dir, "declaration", "conformance")
    placed = declarations.withColumn("file", F.when(F.col("ord") % 4 != 0, F.col("file")))
    found = declarations.where("ord % 8 = 0").select("usr")
    return backfill.needs(placed, conformances, found)


@query
def query_outcomes(spark, sf_dir):
    """Queried symbols settled by the cache, by an answer, or unknown."""
    parts = fact(spark, sf_dir, "declaration").where("usr LIKE 'P%'")
    cache = parts.where("ord % 3 = 0").select("usr", F.lit("nonisolated").alias("isolation"))
    answers = parts.where("ord % 2 = 0").select(F.col("usr").alias("target_usr"), F.lit("globalActor(MainActor)").alias("isolation"))
    return backfill.outcomes(parts.select("usr"), cache, answers)


@query
def merged_modules(spark, sf_dir):
    """Verdicts of the last module, protocols of any."""
    bulk = fact(spark, sf_dir, "declaration").where("usr LIKE 'O%'").select(
        F.concat(F.lit("u"), (F.col("ord") % 700).cast("string")).alias("usr"),
        F.concat(F.lit("globalActor(A"), (F.col("ord") % 9).cast("string"), F.lit(")")).alias("isolation"),
        (F.col("ord") % 50 == 0).alias("is_protocol"),
        F.col("ord").alias("module_ord"),
    )
    return backfill.merge_modules(bulk)


@query
def statistics_delta(spark, sf_dir):
    """A10: change of counts by kind."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("kind"), "event_id")
    before = events.where("event_id % 3 = 0 AND kind <> 'click'").groupBy("kind").agg(F.count("*").alias("n"))
    after = events.where("event_id % 5 = 0 AND kind <> 'view'").groupBy("kind").agg(F.count("*").alias("n"))
    return staleness.statistics_delta(before, after)


@query
def preferred_arguments(spark, sf_dir):
    """Arguments of the target that the path names, else the first."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("src/T"), (F.col("p_partkey") % 6).cast("string"), F.lit("/f"), (F.col("p_partkey") % 101).cast("string")).alias("file"),
        F.concat(F.lit("T"), (F.col("p_partkey") % 8).cast("string")).alias("target"),
        F.col("p_partkey").alias("ordinal"),
        F.concat(F.lit("-a"), F.col("p_partkey").cast("string")).alias("args"),
    )
    return staleness.preferred_arguments(rows)


@query
def sanitized_arguments(spark, sf_dir):
    """Arguments without front-end flags and their values."""
    flags = F.array(F.when(F.col("p_partkey") % 2 == 0, "-frontend").otherwise("-c"), F.when(F.col("p_partkey") % 3 == 0, "-working-directory").otherwise("-O"), F.col("p_brand"), F.lit("-g"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", flags.alias("args"))
    return rows.select("p_partkey", F.array_join(staleness.sanitized("args"), " ").alias("args"))


@query
def module_eligibility(spark, sf_dir):
    """Whether a declaration takes the module's default."""
    kinds = F.when(F.col("p_size") % 4 == 0, "typealias").when(F.col("p_size") % 4 == 1, "accessor").otherwise("function")
    bound = F.array(F.when(F.col("p_size") % 5 == 0, "Sendable").otherwise("Equatable"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", staleness.default_eligible(kinds, F.col("p_size") % 7 == 0, bound).alias("eligible"))


@query
def reference_rewrite(spark, sf_dir):
    """Placeholders by override, by key, by the only nested type of that name; files without symbols keep theirs."""
    rows = fact(spark, sf_dir, "reference")
    names = fact(spark, sf_dir, "placeholder_name")
    return link.rewrite(rows, "ref", names.where("kind = 'map'").drop("kind"), names.where("kind = 'override'").drop("kind"), spark.sql("SELECT 'F3' AS file"))


@query
def live_answers(spark, sf_dir):
    """The symbol that each live query's answers come to."""
    return backfill.select_symbol(fact(spark, sf_dir, "cursor_answer")).select("target_usr", "usr", "name")


@query
def fragment_isolation(spark, sf_dir):
    """isolation by declaration fragments."""
    piece = lambda kind, spelling, precise=None: F.struct(F.lit(kind).alias("kind"), spelling.alias("spelling"), F.lit(precise).cast("string").alias("preciseIdentifier"))
    p = F.col("p_partkey")
    own = F.concat(F.lit("@A"), (p % 4).cast("string"))
    fragments = (
        F.when(p % 5 == 0, F.array(piece("text", F.lit("var ")), piece("attribute", F.lit("@MainActor"), "s:ScM"), piece("keyword", F.lit("nonisolated"))))
        .when(p % 5 == 1, F.array(piece("keyword", F.lit("nonisolated")), piece("attribute", own)))
        .when(p % 5 == 2, F.array(piece("attribute", F.lit("@objc")), piece("attribute", own)))
        .when(p % 5 == 3, F.array(piece("text", own)))
        .otherwise(F.array().cast("array<struct<kind: string, spelling: string, preciseIdentifier: string>>"))
    )
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fragments.alias("fragments"))
    return rows.select("p_partkey", backfill.fragment_isolation("fragments", ["A1", "A2"]).alias("isolation"))


@query
def scheme_list(spark, sf_dir):
    """Products with their targets, and targets that are no product."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    targets = nations.select(F.col("n_name").alias("name"), F.concat(F.lit("Sources/"), "n_name").alias("path"))
    products = nations.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("name"), F.array("n_name", F.lit("NOWHERE"), F.lit("FRANCE")).alias("targets"))
    return staleness.schemes(products, targets)


@query
def first_arguments(spark, sf_dir):
    """The value of a flag in the first file that has arguments."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey > 17").select(
        F.col("p_partkey").alias("ord"), F.array(F.lit("-O"), F.lit("-sdk"), F.concat(F.lit("/sdk/"), F.col("p_partkey").cast("string"))).alias("args")
    )
    found = [staleness.first_arguments(rows, flag).withColumn("flag", F.lit(flag)) for flag in ("-sdk", "-target")]
    return found[0].unionByName(found[1])


@query
def first_file_wins(spark, sf_dir):
    """Of the actors that files give a protocol that of the first file."""
    rows = fact(spark, sf_dir, "conformance").where("protocol_global_actor_name IS NOT NULL").select(
        F.col("protocol_usr").alias("protocol"), F.concat(F.lit("A"), "usr").alias("actor"), F.concat(F.lit("file"), "usr").alias("file")
    )
    return link.first_wins(rows, ["protocol"], "actor", "file")


@query
def text_decisions(spark, sf_dir):
    """Versions, platforms, identities, names, offsets and escapes."""
    number = F.col("p_partkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Apple Swift version "), (F.col("p_partkey") % 7).cast("string"), F.lit(".2 (x)"))).otherwise("none").alias("banner"),
        F.concat(F.lit("arm64-apple-"), F.when(F.col("p_partkey") % 2 == 0, "ios").otherwise("macosx"), number).alias("triple"),
        F.concat(F.lit("a b-"), number, F.lit(".c")).alias("name"),
        F.concat(F.lit("ü"), number, F.lit("\nzwei é\n3")).alias("text"),
        F.concat(F.lit("a\\ b\\\\"), number).alias("escaped"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("__C.S.x.getter : "), number)).otherwise(F.concat(F.lit("M.S.x.getter : "), number)).alias("demangled"),
        (F.col("p_partkey") % 5).cast("int").alias("line"),
    )
    return rows.select(
        "p_partkey",
        staleness.compiler_version("banner").alias("version"),
        readers.platform_of(F.col("triple")).alias("platform"),
        staleness.sanitized_name("name").alias("sanitized"),
        staleness.path_identity("name").alias("identity"),
        readers.byte_offset(F.col("text"), F.col("line"), F.lit(2)).alias("offset"),
        staleness.unescaped("escaped").alias("plain"),
        grammar.is_demangled_struct_member(F.col("demangled")).alias("struct_member"),
    )


@query
def work_items(spark, sf_dir):
    """O2: declarations in order of file and place, file by file."""
    rows = fact(spark, sf_dir, "call_edge").select(F.col("callee_usr").alias("usr"), "file", "line", "col").distinct()
    return project.ordered_items(rows, 8)


@query
def live_files(spark, sf_dir):
    """How many files hold calls of symbols that have no declaration."""
    calls, declarations = _facts(spark, sf_dir, "call_edge", "declaration")
    return project.live_files(calls.join(declarations.select(F.col("usr").alias("callee_usr")), "callee_usr", "left_anti"))


@query
def output_tails(spark, sf_dir):
    """The end of each text, and the triple of a platform."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    platform = F.when(F.col("doc_id") % 3 == 0, "iOS").when(F.col("doc_id") % 3 == 1, "macOS").otherwise("other")
    return rows.select("doc_id", F.md5(readers.last_output(F.col("text"))).alias("tail"), readers.triple_of(platform, "arm64", "17.0").alias("triple"))


@query
def unresolved_placeholders(spark, sf_dir):
    """Declarations that have a place and no symbol."""
    declarations, symbols = _facts(spark, sf_dir, "declaration", "indexed_symbol")
    declarations = declarations.where("usr LIKE 'C%'").withColumn("usr", F.concat(F.lit(link.PLACEHOLDER), "usr"))
    declarations = declarations.withColumn("file", F.when(F.col("ord") % 5 != 0, F.col("file")))
    matched = link.match_locations(declarations.where("file IS NOT NULL"), symbols)
    mapping = link.placeholder_map(declarations, matched)
    return link.unresolved(declarations.join(mapping, "usr", "left_anti")).select("usr", "file", "line")


@query
def merged_conformances(spark, sf_dir):
    """A1: conformances of declarations that fall together, one after another."""
    rows = fact(spark, sf_dir, "conformance").withColumn("ord", F.substring("usr", 2, 20).cast("bigint")).withColumn("usr", F.concat(F.lit("C"), (F.col("ord") % 100).cast("string")))
    return link.merge_conformances(rows, rows.select("usr").distinct()).select("usr", "idx", "protocol_usr")
