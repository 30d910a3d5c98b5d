"""Facts about symbols outside the analyzed code: caches, matcher chain, claims, outcomes and what stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domgraph import lineage
from domgraph.functions import grammar
from domgraph.operators.resolve import NONISOLATED, first_by


def fragment_isolation(fragments: str, actors: list[str] | None = None) -> Column:
    """isolation by the first attribute fragment that tells one, else nonisolated.

    fragments: array of (kind, spelling, preciseIdentifier). MainActor is known by its symbol, others by name.
    """
    known = F.array(*[F.lit(a) for a in ["MainActor", *(actors or [])]])
    name = lambda f: F.regexp_replace(f["spelling"], "^@", "")
    main = lambda f: F.coalesce(f["preciseIdentifier"] == "s:ScM", F.lit(False))
    said = F.filter(
        fragments,
        lambda f: (F.trim(f["spelling"]) == NONISOLATED)
        | (((f["kind"] == "attribute") | main(f)) & (main(f) | F.array_contains(known, name(f)))),
    )
    first = F.get(said, 0)
    return (
        F.when(F.size(said) == 0, NONISOLATED)
        .when(F.trim(first["spelling"]) == NONISOLATED, NONISOLATED)
        .otherwise(F.concat(F.lit("globalActor("), F.when(main(first), "MainActor").otherwise(name(first)), F.lit(")")))
    )


def nearest_signal(types: DataFrame) -> DataFrame:
    """Usr and chain_isolation: the own signal of a type or of its nearest superclass that has one, else nonisolated.

    types: usr, superclass_usr, signal (null without one). Walks up all chains together by doubling; a chain that
    bites its own tail has no signal to reach.
    """
    state = lineage.cut(
        types.select("usr", "signal", F.when(F.col("signal").isNull(), F.col("superclass_usr")).alias("up"))
    )
    n, steps = state.count(), 1
    while steps <= n:
        above = state.select(F.col("usr").alias("up"), F.col("signal").alias("_signal"), F.col("up").alias("_up"))
        state = lineage.cut(state.join(above, "up", "left").select("usr", F.coalesce("signal", "_signal").alias("signal"), F.when(F.col("signal").isNull() & F.col("_signal").isNull(), F.col("_up")).alias("up")))
        steps *= 2
        if state.where("signal IS NULL AND up IS NOT NULL").limit(1).count() == 0:
            break
    return state.select("usr", F.coalesce("signal", F.lit(NONISOLATED)).alias("chain_isolation"))


def external_verdict(symbols: DataFrame, chains: DataFrame) -> DataFrame:
    """Usr and isolation: the own signal, else for a member the chain of its type if that is a global actor, else nonisolated.

    symbols: usr, signal, member_of (null for a type).
    """
    chain = chains.select(F.col("usr").alias("member_of"), "chain_isolation")
    rows = symbols.join(chain, "member_of", "left")
    inherited = F.when(F.col("chain_isolation").startswith("globalActor("), F.col("chain_isolation"))
    return rows.select("usr", F.coalesce("signal", inherited, F.lit(NONISOLATED)).alias("isolation"))


def merge_modules(bulk: DataFrame) -> DataFrame:
    """One verdict a symbol, the last module's; a protocol in any module is one."""
    return bulk.groupBy("usr").agg(F.max_by("isolation", "module_ord").alias("isolation"), F.bool_or("is_protocol").alias("is_protocol"))


def sibling_facts(callees: DataFrame, declarations: DataFrame) -> DataFrame:
    """Callee and the declaration that is the same but for its module, the smallest if there are several."""
    siblings = declarations.select("usr", grammar.module_suffix(F.col("usr")).alias("suffix")).where("suffix IS NOT NULL")
    siblings = siblings.groupBy("suffix").agg(F.min("usr").alias("sibling"))
    wanted = callees.select("usr", grammar.module_suffix(F.col("usr")).alias("suffix"))
    return wanted.join(siblings, "suffix").select("usr", "sibling")


def demangled_sibling(callees: DataFrame, declarations: DataFrame) -> DataFrame:
    """Callee and sibling by demangled signature, where exactly one declaration has it. Inputs: usr, demangled.

    Only declarations whose bare member name is needed are looked at.
    """
    signed = lambda df: df.select("usr", grammar.demangled_signature(F.col("demangled")).alias("signature"))
    wanted, known = signed(callees), signed(declarations)
    bare = lambda df: df.withColumn("bare", F.substring_index(F.substring_index("signature", "(", 1), ".", -1))
    known = bare(known).join(bare(wanted).select("bare").distinct(), "bare", "left_semi")
    unique = known.groupBy("signature").agg(F.count("*").alias("n"), F.min("usr").alias("sibling")).where("n = 1")
    return wanted.join(unique, "signature").select("usr", "sibling")


def matcher_chain(callees: DataFrame, declarations: DataFrame, bulk: DataFrame) -> DataFrame:
    """How each unknown callee is settled: matcher, and the symbol or verdict it leads to.

    callees: usr. bulk: usr, isolation. Steps in order: sibling, enum accessors of known enums, hash accessors of known
    types, imported struct members, imported constants, then cached declarations of subscripts, statics and
    properties; else a live query.
    """
    u = F.col("usr")
    rows = callees.select("usr").distinct()
    known = declarations.select(F.col("usr").alias("known")).distinct()
    rows = rows.join(sibling_facts(rows, declarations), "usr", "left")
    forms = {
        "enum": grammar.swift_enum(u),
        "objc_enum": grammar.objc_enum(u),
        "hash": grammar.hashable_owner(u),
        "struct": grammar.imported_struct_container(u),
        "subscript": grammar.subscript_declaration(u),
        "static": grammar.static_declaration(u),
        "property": grammar.objc_property(u),
    }
    rows = rows.withColumns(forms).withColumn("constant", grammar.is_imported_constant(u))
    for form in ("enum", "objc_enum", "hash"):
        rows = rows.join(known.select(F.col("known").alias(form), F.lit(True).alias(f"has_{form}")), form, "left")
    for form in ("subscript", "static", "property"):
        cached = bulk.select(F.col("usr").alias(form), F.col("isolation").alias(f"iso_{form}"))
        rows = rows.join(cached, form, "left")
    found = F.lit(None).cast("struct<matcher: string, through: string, isolation: string>")
    steps = [
        ("sibling", F.col("sibling").isNotNull(), F.col("sibling"), None),
        ("enum_accessor", F.col("has_enum"), F.col("enum"), NONISOLATED),
        ("objc_enum_accessor", F.col("has_objc_enum"), F.col("objc_enum"), NONISOLATED),
        ("hash_accessor", F.col("has_hash"), F.col("hash"), None),
        ("struct_member", F.col("struct").isNotNull(), F.col("struct"), NONISOLATED),
        ("constant", F.col("constant"), F.lit(None).cast("string"), NONISOLATED),
        ("subscript", F.col("iso_subscript").isNotNull(), F.col("subscript"), F.col("iso_subscript")),
        ("static", F.col("iso_static").isNotNull(), F.col("static"), F.col("iso_static")),
        ("property", F.col("iso_property").isNotNull(), F.col("property"), F.col("iso_property")),
    ]
    found = F.struct(F.lit("live_query").alias("matcher"), F.lit(None).cast("string").alias("through"), F.lit(None).cast("string").alias("isolation"))
    for name, when, through, isolation in reversed(steps):
        value = isolation if isinstance(isolation, Column) else F.lit(isolation).cast("string")
        hit = F.struct(F.lit(name).alias("matcher"), through.alias("through"), value.alias("isolation"))
        found = F.when(F.coalesce(when, F.lit(False)), hit).otherwise(found)
    return rows.withColumn("found", found).select("usr", "found.matcher", "found.through", "found.isolation")


def needs(declarations: DataFrame, conformances: DataFrame, backfilled: DataFrame) -> DataFrame:
    """Parents that no located declaration and no fact answers, and protocol pairs that could give an actor (stated with
    the type or with the witness) and whose protocol is no located declaration: kind, usr, target, pair_of."""
    open_ = declarations.where("explicit_isolation IS NULL AND enclosing_extension_isolation IS NULL")
    located = declarations.where("file IS NOT NULL").select(F.col("usr").alias("target"))
    have = located.union(backfilled.select("usr")).distinct()
    parents = open_.select("usr", F.explode(F.map_from_arrays(F.array(F.lit("superclass"), F.lit("container")), F.array("superclass_usr", "containing_type_usr"))).alias("kind", "target"))
    parents = parents.where("target IS NOT NULL").join(have, "target", "left_anti").withColumn("pair_of", F.lit(None).cast("string"))
    counts = F.col("same_file_as_primary") | F.col("same_context_as_witness")
    pairs = conformances.where(F.col("protocol_global_actor_name").isNull() & counts & ~F.col("protocol_usr").isin(*NEVER_ACTOR))
    pairs = pairs.join(located.select(F.col("target").alias("protocol_usr")), "protocol_usr", "left_anti")
    pairs = pairs.join(open_.select("usr", F.col("containing_type_usr").alias("c")), "usr")
    pairs = pairs.select("usr", F.lit("pair").alias("kind"), F.col("protocol_usr").alias("target"), F.coalesce("c", "usr").alias("pair_of"))
    return parents.select("usr", "kind", "target", "pair_of").unionByName(pairs)


#: Protocols that never carry an actor (Sendable and its metatype form).
NEVER_ACTOR = ("s:s8SendableP", "s:s16SendableMetatypeP")


def claim_once(wanted: DataFrame) -> DataFrame:
    """Each (kind, target, pair_of) once, by the first declaration: eligible witnesses before deferred, then by place."""
    order = [F.col(c).asc_nulls_last() for c in ("tier", "file", "line", "col", "usr")]
    nth = F.row_number().over(Window.partitionBy("kind", "target", "pair_of").orderBy(*order))
    return wanted.withColumn("nth", nth).where("nth = 1").drop("nth")


def pair_fanout(conformances: DataFrame, containers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Conformances with the actor found for (nominal, protocol), on every declaration that refers to the pair.

    containers: usr, containing_type_usr. outcomes: nominal, protocol_usr, actor.
    """
    nominal = containers.select("usr", F.coalesce("containing_type_usr", "usr").alias("nominal"))
    rows = conformances.join(nominal, "usr", "left").join(outcomes, ["nominal", "protocol_usr"], "left")
    actor = F.coalesce("protocol_global_actor_name", "actor")
    return rows.withColumn("protocol_global_actor_name", actor).select(*conformances.columns)


def propagate_unknown(failed: DataFrame, declarations: DataFrame) -> DataFrame:
    """Symbols whose query failed, and their direct members."""
    members = declarations.join(failed.select(F.col("usr").alias("containing_type_usr")), "containing_type_usr", "left_semi")
    return failed.select("usr").union(members.select("usr")).distinct()


def overlay(declarations: DataFrame, updated: DataFrame, backfilled: DataFrame) -> DataFrame:
    """Updated facts replace; backfilled ones only where there is no declaration with a location."""
    base = declarations.join(updated.select("usr"), "usr", "left_anti").unionByName(updated)
    located = base.where("file IS NOT NULL").select("usr")
    extra = backfilled.join(located, "usr", "left_anti")
    return base.join(extra.select("usr"), "usr", "left_anti").unionByName(extra)


def select_symbol(answers: DataFrame) -> DataFrame:
    """Of the symbols answered for each target the one the first shape that matches any selects.

    answers: target_usr, ordinal, usr, name, decl_lang, container_type_usr.
    """
    t, u = F.col("target_usr"), F.col("usr")
    rank = F.when(grammar.same_symbol(u, t), 0)
    for k, shape in enumerate(grammar.BRIDGED, 1):
        rank = rank.when(grammar.bridged_match(t, u, F.col("name"), F.col("decl_lang"), F.col("container_type_usr"), shape), k)
    ranked = answers.withColumn("rank", rank).where("rank IS NOT NULL")
    return first_by(ranked, ["target_usr"], [F.col("rank"), F.col("ordinal")])


def outcomes(items: DataFrame, bulk: DataFrame, selected: DataFrame) -> DataFrame:
    """Usr, isolation and is_unknown of queried items: cache first, then the answer, else unknown. selected: target_usr, isolation."""
    rows = items.join(bulk.select("usr", F.col("isolation").alias("_cached")), "usr", "left")
    rows = rows.join(selected.select(F.col("target_usr").alias("usr"), F.col("isolation").alias("_answered")), "usr", "left")
    found = F.coalesce("_cached", "_answered")
    return rows.select("usr", found.alias("isolation"), found.isNull().alias("is_unknown"))
