"""Linking syntactic declarations with the index: identity, rewrites, merges, bases, extensions, accessors, calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domgraph import schemas
from domgraph.functions import grammar
from domgraph.operators.resolve import first_by, transitive

PLACEHOLDER = "syntactic:"


def has_role(roles: Column, bit: int) -> Column:
    return roles.bitwiseAND(F.lit(bit)) != 0


def definitions(occurrences: DataFrame) -> DataFrame:
    """Symbols where they are defined."""
    return occurrences.where(has_role(F.col("roles"), schemas.DEFINITION)).select("usr", "name", "file", "line", "col")


def in_scope(occurrences: DataFrame, modules: list[str]) -> DataFrame:
    """Occurrences of system units and of the given modules."""
    return occurrences.where(F.col("is_system") | F.col("module").isin(modules))


def skipped_units(occurrences: DataFrame, modules: list[str]) -> DataFrame:
    """One row with `skipped`, the number of units that are out of scope."""
    out = occurrences.where(~(F.col("is_system") | F.col("module").isin(modules)))
    return out.select("module").distinct().agg(F.count("*").alias("skipped"))


def once_per_record(occurrences: DataFrame) -> DataFrame:
    """Each record counts in the first unit that holds it. Give it the occurrences in scope: a unit that is out of
    scope holds no record for others."""
    unit = F.struct("module", "is_system")
    firsts = occurrences.groupBy("record").agg(F.min(unit).alias("unit")).select("record", "unit.module", "unit.is_system")
    return occurrences.join(firsts, ["record", "module", "is_system"], "left_semi")


def match_locations(declarations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Usr (of the declaration) and real_usr, by location.

    A location's only symbol is taken whatever its name; among several the one of the same name, else the first that
    is the name with an argument list; else none.
    """
    several = symbols.groupBy("file", "line", "col").agg(F.count("*").alias("n"))
    candidates = symbols.select(F.col("usr").alias("real_usr"), F.col("name").alias("symbol_name"), "file", "line", "col")
    rows = declarations.select("usr", "name", "file", "line", "col").join(candidates, ["file", "line", "col"]).join(several, ["file", "line", "col"])
    grade = F.when(F.col("n") == 1, 0).when(F.col("symbol_name") == F.col("name"), 1).when(F.col("symbol_name").startswith(F.concat("name", F.lit("("))), 2)
    best = rows.withColumn("grade", grade).where("grade IS NOT NULL")
    return best.groupBy("usr", "file", "line", "col").agg(F.min_by("real_usr", F.struct("grade", "real_usr")).alias("real_usr"))


def placeholder_map(declarations: DataFrame, matched: DataFrame) -> DataFrame:
    """Placeholder and real_usr; of several declarations of one placeholder the last by file and place counts."""
    rows = declarations.join(matched, ["usr", "file", "line", "col"])
    return rows.groupBy("usr").agg(F.max_by("real_usr", F.struct("ord", "file", "line", "col")).alias("real_usr"))


def bare_name(usr: Column) -> Column:
    """A placeholder without its mark."""
    return F.substring(usr, len(PLACEHOLDER) + 1, 1 << 30)


def rewrite(rows: DataFrame, column: str, mapping: DataFrame, overrides: DataFrame | None = None, unreadable: DataFrame | None = None) -> DataFrame:
    """Column with placeholders replaced: by override, by the map, by the only nested type that ends in its name.

    Rows of files in `unreadable` (file) are left as they are.
    """
    by_key = mapping.select(F.col("usr").alias(column), F.col("real_usr").alias("_by_key"))
    nested = mapping.where(F.contains(bare_name(F.col("usr")), F.lit(".")))
    unique = nested.select(F.substring_index("usr", ".", -1).alias("_bare"), "real_usr").groupBy("_bare").agg(F.count("*").alias("n"), F.min("real_usr").alias("_by_name"))
    out = rows.withColumn("_bare", F.when(F.col(column).startswith(PLACEHOLDER), bare_name(F.col(column))))
    out = out.join(by_key, column, "left").join(unique.where("n = 1").select("_bare", "_by_name"), "_bare", "left")
    new = F.coalesce("_by_key", "_by_name", column)
    if overrides is not None:
        out = out.join(overrides.select(F.col("usr").alias(column), F.col("real_usr").alias("_override")), column, "left")
        new = F.coalesce("_override", new)
    if unreadable is not None:
        out = out.join(unreadable.select("file", F.lit(True).alias("_skip")).distinct(), "file", "left")
        new = F.when(F.col("_skip"), F.col(column)).otherwise(new)
    return out.withColumn(column, new).select(*rows.columns)


def own_identity(declarations: DataFrame, matched: DataFrame, mapping: DataFrame) -> DataFrame:
    """Declarations under their real symbol: by their own location, else by the placeholder."""
    here = matched.withColumnRenamed("real_usr", "_here")
    shared = mapping.select("usr", F.col("real_usr").alias("_shared"))
    out = declarations.join(here, ["usr", "file", "line", "col"], "left").join(shared, "usr", "left")
    return out.withColumn("usr", F.coalesce("_here", "_shared", "usr")).select(*declarations.columns)


def unresolved(declarations: DataFrame) -> DataFrame:
    """Placeholders that have a location and no real symbol."""
    return declarations.where(F.col("usr").startswith(PLACEHOLDER) & F.col("file").isNotNull())


#: Columns of which the first value counts, and flags that are or-ed.
_FIRST = ("explicit_isolation", "containing_type_usr", "superclass_usr", "enclosing_extension_isolation")
_ANY = ("is_actor_type", "is_static_member", "is_nested_type", "is_immutable_stored_property", "is_actor_initializer")


def merge(declarations: DataFrame) -> DataFrame:
    """A1: one row a usr: first values by ord, flags or-ed, eligibility and-ed."""
    order = F.struct("ord", "name", "file", "line", "col")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    place = F.min_by(F.struct("file", "line", "col"), F.when(F.col("file").isNotNull(), order)).alias("place")
    merged = declarations.groupBy("usr").agg(
        F.min_by("name", order).alias("name"),
        *[first(c) for c in _FIRST],
        *[F.bool_or(c).alias(c) for c in _ANY],
        F.bool_and("eligible_default").alias("eligible_default"),
        place,
        F.min("ord").alias("ord"),
    )
    return merged.select("*", "place.file", "place.line", "place.col").drop("place")


def merge_conformances(conformances: DataFrame, declarations: DataFrame) -> DataFrame:
    """A1: the conformances of all rows of a usr, one after another by the rows' ord (conformances: usr, ord, idx, ...), numbered
    anew within the usr."""
    place = F.row_number().over(Window.partitionBy("usr").orderBy("ord", "idx")) - 1
    kept = conformances.join(declarations.select("usr").distinct(), "usr", "left_semi")
    return kept.withColumn("idx", place.cast("int")).drop("ord")


def unique_base(relations: DataFrame, via: DataFrame | None = None) -> DataFrame:
    """Nominal, name and base usr, where a nominal's base name stands for one symbol. A base relates to its nominal.

    via (nominal, extension): extensions whose base relations count for the nominal.
    """
    bases = relations.where(has_role(F.col("role"), schemas.BASE_OF)).select(F.col("target_usr").alias("nominal"), "name", F.col("usr").alias("base"))
    if via is not None:
        through = bases.withColumnRenamed("nominal", "extension").join(via, "extension").select("nominal", "name", "base")
        bases = bases.unionByName(through)
    found = bases.groupBy("nominal", "name").agg(F.min("base").alias("base_usr"), F.max("base").alias("other"))
    return found.where("base_usr = other").drop("other")


def by_base(rows: DataFrame, column: str, bases: DataFrame) -> DataFrame:
    """column's placeholders replaced by the base of that name of the row's `nominal`, if there is one."""
    named = bases.select("nominal", F.concat(F.lit(PLACEHOLDER), "name").alias(column), F.col("base_usr").alias("_base"))
    return rows.join(named, ["nominal", column], "left").withColumn(column, F.coalesce("_base", column)).select(*rows.columns)


def extended_type(relations: DataFrame) -> DataFrame:
    """Member and type: child, where it is defined, of an extension that extends the type."""
    defined = (F.col("role") == schemas.CHILD_OF) & has_role(F.col("occurrence_roles"), schemas.DEFINITION)
    extension = relations.where(defined).groupBy("usr").agg(F.min_by("target_usr", "ordinal").alias("extension"))
    extended = relations.where(F.col("role") == schemas.EXTENDED_BY).groupBy(F.col("target_usr").alias("extension")).agg(F.min("usr").alias("type_usr"))
    return extension.join(extended, "extension").select(F.col("usr").alias("member"), "type_usr")


def with_extended_type(declarations: DataFrame, relations: DataFrame) -> DataFrame:
    """Declarations whose container is a placeholder, while they themselves are known, under the type that their extension
    extends."""
    found = extended_type(relations).select(F.col("member").alias("usr"), "type_usr")
    open_ = F.col("containing_type_usr").startswith(PLACEHOLDER) & ~F.col("usr").startswith(PLACEHOLDER)
    container = F.when(open_, F.coalesce("type_usr", "containing_type_usr")).otherwise(F.col("containing_type_usr"))
    return declarations.join(found, "usr", "left").withColumn("containing_type_usr", container).select(*declarations.columns)


def accessor_owner(relations: DataFrame) -> DataFrame:
    """Accessor and owner, where exactly one property owns it; definitions' relations are preferred."""
    owners = relations.where(F.col("role") == schemas.ACCESSOR_OF)
    defining = has_role(F.col("occurrence_roles"), schemas.DEFINITION)
    found = owners.groupBy("usr").agg(
        F.min(F.when(defining, F.col("target_usr"))).alias("d0"),
        F.max(F.when(defining, F.col("target_usr"))).alias("d1"),
        F.min("target_usr").alias("a0"),
        F.max("target_usr").alias("a1"),
    )
    low, high = F.coalesce("d0", "a0"), F.coalesce("d1", "a1")
    return found.where(low == high).select(F.col("usr").alias("accessor"), low.alias("owner"))


def canonical(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges with accessors replaced by their property at both ends; one that isn't found is looked for again without
    its module's qualifier."""
    columns = edges.columns
    for side in ("caller_usr", "callee_usr"):
        named = owners.select(F.col("accessor").alias(side), F.col("owner").alias("_owner"))
        bare = owners.select(F.col("accessor").alias("_bare"), F.col("owner").alias("_other"))
        edges = edges.withColumn("_bare", grammar.without_module_qualifier(F.col(side)))
        edges = edges.join(named, side, "left").join(bare, "_bare", "left")
        edges = edges.withColumn(side, F.coalesce("_owner", "_other", side)).select(*columns)
    return edges


def without_setters(setters: DataFrame, getters: DataFrame) -> DataFrame:
    """Setter calls without a getter call at the same place."""
    return setters.join(getters.select("file", "line", "col").distinct(), ["file", "line", "col"], "left_anti")


#: What tells one occurrence from another.
OCCURRENCE_KEY = ["record", "file", "line", "col", "usr"]


def call_sites(occurrences: DataFrame, relations: DataFrame) -> DataFrame:
    """Call occurrences, each with the first of its own relations that tells a caller: calls and the callee's name."""
    sites = occurrences.where(has_role(F.col("roles"), schemas.CALL))
    callers = relations.where(has_role(F.col("role"), schemas.CALLED_BY)).groupBy(*OCCURRENCE_KEY).agg(F.min_by("target_usr", F.struct("ordinal", "target_usr")).alias("caller_usr"))
    return sites.join(callers, OCCURRENCE_KEY).select("caller_usr", F.col("usr").alias("callee_usr"), "file", "line", "col", "name")


def calls(occurrences: DataFrame, relations: DataFrame) -> DataFrame:
    """The calls of all occurrences; a setter's counts only where no getter is called."""
    sites = call_sites(occurrences, relations)
    setters, getters = sites.where(F.col("name").startswith("setter:")), sites.where(F.col("name").startswith("getter:"))
    others = sites.where(~F.col("name").startswith("setter:"))
    return others.unionByName(without_setters(setters, getters)).drop("name")


def call_graph(edges: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """Calls of known callees, and in analyzed files also those of unknown ones."""
    names = known.select(F.col("usr").alias("callee_usr")).distinct()
    inside = edges.join(names, "callee_usr", "left_semi")
    outside = edges.join(names, "callee_usr", "left_anti").join(files.select("file").distinct(), "file", "left_semi")
    return inside.unionByName(outside)


def earliest_call(edges: DataFrame) -> DataFrame:
    """A5: the first place (file, line, col) where each callee is called."""
    found = edges.groupBy("callee_usr").agg(F.min(F.struct("file", "line", "col")).alias("place"))
    return found.select("callee_usr", "place.file", "place.line", "place.col")


def first_wins(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The value of the first file that has the key."""
    return rows.groupBy(*key).agg(F.min_by(value, F.struct(order, value)).alias(value))


def protocol_closure(parents: DataFrame) -> DataFrame:
    """G1: protocol and every ancestor."""
    return transitive(parents, "protocol", "parent")


def with_ancestors(conformances: DataFrame, closure: DataFrame) -> DataFrame:
    """Conformances with one for each ancestor not declared, with the flags of the first that reaches it (D3) and without its
    actor, which is that protocol's own."""
    own = conformances.select("usr", "protocol_usr")
    reached = conformances.join(closure.select(F.col("protocol").alias("protocol_usr"), "ancestor"), "protocol_usr")
    reached = reached.join(own.withColumnRenamed("protocol_usr", "ancestor"), ["usr", "ancestor"], "left_anti")
    added = first_by(reached, ["usr", "ancestor"], [F.col("idx")]).withColumn("protocol_usr", F.col("ancestor")).drop("ancestor")
    added = added.withColumn("protocol_global_actor_name", F.lit(None).cast("string"))
    return conformances.unionByName(added.select(*conformances.columns))


def backfill_conformance_actor(conformances: DataFrame, protocol_actors: DataFrame, requirement_actors: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Null actors of placeholder protocols: the protocol's, else that of the requirement the witness is named after.

    witnesses: usr, name. Actors: protocol, actor and protocol, requirement, actor.
    """
    named = conformances.join(witnesses.select("usr", F.col("name").alias("_witness")), "usr", "left")
    key = F.substring(F.col("protocol_usr"), len(PLACEHOLDER) + 1, 1 << 30)
    named = named.withColumn("protocol", F.when(F.col("protocol_usr").startswith(PLACEHOLDER), key))
    named = named.join(protocol_actors.select("protocol", F.col("actor").alias("_whole")), "protocol", "left")
    needs = requirement_actors.select("protocol", F.col("requirement").alias("_witness"), F.col("actor").alias("_one"))
    named = named.join(needs, ["protocol", "_witness"], "left")
    actor = F.coalesce("protocol_global_actor_name", F.when(F.col("protocol").isNotNull(), F.coalesce("_whole", "_one")))
    return named.withColumn("protocol_global_actor_name", actor).select(*conformances.columns)
