"""Command line: python -m domgraph.cli INPUT [--sources] [--index FOLDER] [--platform iOS] [--module NAME] [--format json|mermaid|dot]
[--severity low|medium|high] [--out FILE].

INPUT is a folder with declaration, conformance and call_edge tables (Parquet), and optionally closure_literal,
global_actor_name, awaited_range and unknown_usr; or, with --sources, a folder of source files, whose facts are linked with the
occurrence and relation tables of --index. Exit code: 1 if there are high-risk boundaries before the severity filter, 0 if not,
2 if the input can't be read.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domgraph import lineage
from domgraph.operators import intervals, project, report, resolve
from domgraph.plans import sinks
from domgraph.sources import extraction, readers, syntax


def _optional(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException:
        return None


def _from_facts(spark: SparkSession, folder: str, default: str) -> report.Report:
    declarations, conformances, calls = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("declaration", "conformance", "call_edge"))
    closures, names = _optional(spark, folder, "closure_literal"), _optional(spark, folder, "global_actor_name")
    if names is None:
        names = spark.createDataFrame([("MainActor",)], "name string")
    classified = None if closures is None else intervals.classify_closures(closures, names)
    awaited, unknown = _optional(spark, folder, "awaited_range"), _optional(spark, folder, "unknown_usr")
    return report.build(declarations, conformances, calls, classified, awaited, unknown, default)


def _from_sources(spark: SparkSession, given: argparse.Namespace, default: str) -> report.Report:
    facts = extraction.facts(readers.source_files(spark, given.input), given.platform)
    if given.index is None:
        return project.analyzed(project.unlinked(facts), default=default)
    occurrences, relations = (spark.read.parquet(f"{given.index}/{t}.parquet") for t in ("occurrence", "relation"))
    return project.analyzed(project.linked(facts, occurrences, relations, given.module), default=default)


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="domgraph", description=__doc__)
    args.add_argument("input")
    args.add_argument("--sources", action="store_true")
    args.add_argument("--index")
    args.add_argument("--platform", choices=tuple(syntax.PLATFORM_NAMES))
    args.add_argument("--module", action="append")
    args.add_argument("--format", choices=("json", "mermaid", "dot"), default="json")
    args.add_argument("--severity", choices=report.RISKS)
    args.add_argument("--language-mode", default="6")
    args.add_argument("--compiler-version", default="6.2")
    args.add_argument("--default-isolation", default=resolve.NONISOLATED)
    args.add_argument("--out")
    given = args.parse_args(argv)
    spark = SparkSession.builder.appName("domgraph").getOrCreate()
    version = resolve.effective_version(given.language_mode, given.compiler_version)
    try:
        default = resolve.default_isolation(version, given.default_isolation)
        whole = _from_sources(spark, given, default) if given.sources else _from_facts(spark, given.input, default)
    except (AnalysisException, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    # Each part is made once; what follows reads what was written.
    whole = report.Report(lineage.cut(whole.nodes), lineage.cut(whole.edges), lineage.cut(whole.summary))
    rate = report.uncertainty(whole.edges).first()
    if rate.alarm:
        print(f"Warning: {rate.n_uncertain} of {rate.total} crossing edges are uncertain on at least one side.", file=sys.stderr)
    edges = report.severity_filter(whole.edges, given.severity)
    n = rate.total if given.severity is None else edges.count()
    shown = report.Report(whole.nodes, edges, whole.summary.withColumn("cross_actor_boundaries", F.lit(n)))
    if given.format == "json":
        pieces = sinks.json_report(shown, "1", version, version)
    else:
        pieces = sinks.text({"mermaid": sinks.mermaid_lines, "dot": sinks.dot_lines}[given.format](shown.nodes, shown.edges))
    if given.out:
        with open(f"{given.out}.tmp", "w", encoding="utf-8") as f:
            f.writelines(pieces)
        os.replace(f"{given.out}.tmp", given.out)
    else:
        sys.stdout.writelines(pieces)
        print()
    return sinks.exit_code(whole)


if __name__ == "__main__":
    sys.exit(main())
