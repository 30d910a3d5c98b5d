"""Linking a project: extracted facts and the index's occurrences and relations to linked declarations and a call graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domgraph import lineage, schemas
from domgraph.operators import intervals, link, report, staleness
from domgraph.operators.resolve import NONISOLATED, transitive
from domgraph.sources.extraction import Facts


@dataclass
class Linked:
    """What the report is built from."""

    declarations: DataFrame
    conformances: DataFrame
    calls: DataFrame
    closures: DataFrame
    awaited: DataFrame
    unresolved: DataFrame


def _conformances(facts: Facts) -> DataFrame:
    """Conformances of every declaration with the ancestors of their protocols and the actors that any file gives."""
    # A declaration is its ord here: one placeholder may stand for several.
    own = facts.conformance.withColumn("usr", F.col("ord").cast("string")).drop("ord")
    parents = facts.protocol_parent.select(*[F.concat(F.lit(link.PLACEHOLDER), c).alias(c) for c in ("protocol", "parent")])
    every = link.with_ancestors(own, transitive(parents, "protocol", "parent"))
    wholes = link.first_wins(facts.protocol_actor, ["protocol"], "actor", "file")
    singles = link.first_wins(facts.protocol_requirement_actor, ["protocol", "requirement"], "actor", "file")
    witnesses = facts.declaration.select(F.col("ord").cast("string").alias("usr"), "name")
    return link.backfill_conformance_actor(every, wholes, singles, witnesses)


def linked(facts: Facts, occurrences: DataFrame, relations: DataFrame, modules: list[str] | None = None, overrides: DataFrame | None = None) -> Linked:
    """J1-J13 in order. modules: units of others count only if they are the system's. overrides: usr, real_usr."""
    occurrences = link.once_per_record(link.in_scope(occurrences, modules) if modules else occurrences)
    if modules:
        relations = relations.join(occurrences.select(*link.OCCURRENCE_KEY).distinct(), link.OCCURRENCE_KEY, "left_semi")
    symbols = lineage.cut(link.definitions(occurrences))
    declared = facts.declaration
    matched = lineage.cut(link.match_locations(declared.where("file IS NOT NULL"), symbols))
    mapping = link.placeholder_map(declared, matched)
    if overrides is not None:
        mapping = mapping.join(overrides, "usr", "left_anti").unionByName(overrides.select(*mapping.columns))
    mapping = lineage.cut(mapping)
    unreadable = declared.where("file IS NOT NULL").select("file").distinct().join(symbols.select("file").distinct(), "file", "left_anti")

    rows = declared
    for column in ("containing_type_usr", "superclass_usr"):
        rows = link.rewrite(rows, column, mapping, unreadable=unreadable)
    # W6 keeps a type's row in each file; by its own place it may have a symbol that its placeholder has not.
    rows = link.rewrite(link.own_identity(rows, matched, mapping), "usr", mapping)
    rows = lineage.cut(rows)
    pairs = _conformances(facts).withColumn("ord", F.col("usr").cast("bigint")).drop("usr").join(rows.select("ord", "usr", "file"), "ord")
    pairs = link.rewrite(pairs, "protocol_usr", mapping, unreadable=unreadable).drop("file")
    merged = lineage.cut(link.merge(rows))
    pairs = link.merge_conformances(pairs, merged)

    extensions = relations.where(link.has_role(F.col("role"), schemas.EXTENDED_BY) & link.has_role(F.col("occurrence_roles"), schemas.EXTENDED_BY))
    bases = lineage.cut(link.unique_base(relations, extensions.select(F.col("usr").alias("nominal"), F.col("target_usr").alias("extension")).distinct()))
    nominals = merged.select("usr", F.coalesce("containing_type_usr", "usr").alias("nominal"))
    merged = link.by_base(merged.join(nominals, "usr"), "superclass_usr", bases).drop("nominal")
    pairs = link.by_base(pairs.join(nominals, "usr"), "protocol_usr", bases).drop("nominal")
    merged = lineage.cut(link.with_extended_type(merged, relations))

    calls = link.call_graph(link.calls(occurrences, relations), mapping.select(F.col("real_usr").alias("usr")).distinct(), declared.where("file IS NOT NULL"))
    calls = link.canonical(calls, link.accessor_owner(relations))
    closures = intervals.classify_closures(facts.closure_literal, facts.global_actor_name)
    return Linked(merged, lineage.cut(pairs), lineage.cut(calls), closures, facts.awaited_range, link.unresolved(declared.join(mapping, "usr", "left_anti")))


def unlinked(facts: Facts) -> Linked:
    """The facts of the sources alone: no index, so no calls."""
    spark = facts.declaration.sparkSession
    return linked(facts, spark.createDataFrame([], schemas.OCCURRENCE), spark.createDataFrame([], schemas.RELATION))


def analyzed(found: Linked, unknown: DataFrame | None = None, default: str = NONISOLATED) -> report.Report:
    """The boundary report of a linked project."""
    return report.build(found.declarations, found.conformances, found.calls, found.closures, found.awaited, unknown, default)


def ordered_items(items: DataFrame, n: int) -> DataFrame:
    """Items (usr, file, line, col) with the chunk of whole files that each falls into, and their order in it."""
    order = Window.partitionBy("chunk").orderBy("file", "line", "col", "usr")
    return staleness.balanced_chunks(items, n).withColumn("nth", F.row_number().over(order) - 1).select("usr", "file", "line", "col", "chunk", "nth")


def work_items(found: Linked, n: int) -> DataFrame:
    """O2: what a live service would be asked: unresolved declarations in order."""
    return ordered_items(found.unresolved.select("usr", "file", "line", "col"), n)


def live_files(items: DataFrame) -> DataFrame:
    """One row with `files`, the number of files that items of a live service lie in."""
    return items.agg(F.countDistinct("file").alias("files"))
