"""Isolation of every declaration: a rule-priority fixpoint over containers and superclasses.

Isolations are the strings actor(X), globalActor(X), nonisolated and unspecified, which compare like what they stand for.
Only declarations that are someone's container or superclass take part in the passes; all others are decided in one
last step. A pass decides every declaration whose consulted parents are decided. One that lacks a single parent is a function
of that parent's isolation, which tells only its class apart (actor, global actor, nonisolated, unspecified) and gives either the
parent's isolation itself or a constant. Such functions compose, so chains are followed by doubling: a chain of n takes log n
steps. Chains that end nowhere lead into a ring, whose members are decided as the walk from each decides them: its guard finds
the ring's start again, unspecified, so the value is that of the functions around the ring, taken of unspecified. What is below
a ring is decided in the next pass. Rings that are tangled (members lack two parents) are walked exactly, with all that they reach.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domgraph import lineage

NONISOLATED, UNSPECIFIED = "nonisolated", "unspecified"


def is_actor(iso: Column) -> Column:
    return iso.startswith("actor(")


def is_global_actor(iso: Column) -> Column:
    return iso.startswith("globalActor(")


def conformance_actor(conformances: DataFrame) -> DataFrame:
    """usr, conf_actor: the first conformance by protocol that carries an actor in the same file, else in the same context."""
    named = conformances.where(F.col("protocol_global_actor_name").isNotNull())
    tier = F.when(F.col("same_file_as_primary"), 0).when(F.col("same_context_as_witness"), 1)
    named = named.withColumn("tier", tier).where("tier IS NOT NULL")
    order = F.struct("tier", "protocol_usr", "idx")
    return named.groupBy("usr").agg(F.min_by("protocol_global_actor_name", order).alias("conf_actor"))


def prepared(declarations: DataFrame, conformances: DataFrame) -> DataFrame:
    """What the rules look at: terminal (decided by the declaration alone), parents that are declared, flags."""
    known = declarations.select("usr").distinct()
    terminal = (
        F.when(F.col("is_actor_type"), F.concat(F.lit("actor("), "name", F.lit(")")))
        .when(F.col("explicit_isolation").isNotNull(), F.col("explicit_isolation"))
        .otherwise(F.col("enclosing_extension_isolation"))
    )
    rows = declarations.select(
        "usr",
        terminal.alias("terminal"),
        F.col("containing_type_usr").alias("container"),
        F.col("superclass_usr").alias("superclass"),
        "is_static_member",
        "is_nested_type",
        "eligible_default",
    )
    rows = rows.join(known.select(F.col("usr").alias("container"), F.lit(True).alias("c_known")), "container", "left")
    rows = rows.join(known.select(F.col("usr").alias("superclass"), F.lit(True).alias("s_known")), "superclass", "left")
    return rows.join(conformance_actor(conformances), "usr", "left").select(
        "usr",
        "terminal",
        F.when(F.col("c_known"), F.col("container")).alias("container"),
        F.when(F.col("s_known"), F.col("superclass")).alias("superclass"),
        "is_static_member",
        "is_nested_type",
        "eligible_default",
        "conf_actor",
    )


def decision(default: str, c: Column | None = None, s: Column | None = None) -> Column:
    """The isolation by priority from c and s (c_iso and s_iso), or null while a parent that comes first is undecided."""
    c, s, nested = F.col("c_iso") if c is None else c, F.col("s_iso") if s is None else s, F.col("is_nested_type")
    has_c, has_s = F.col("container").isNotNull(), F.col("superclass").isNotNull()
    wait = F.lit(None).cast("string")
    return (
        F.when(F.col("terminal").isNotNull(), F.col("terminal"))
        .when(~nested & has_c & c.isNull(), wait)
        .when(~nested & has_c & is_actor(c) & ~F.col("is_static_member"), c)
        .when(~nested & has_c & is_global_actor(c), c)
        .when(has_s & s.isNull(), wait)
        .when(has_s & is_global_actor(s), s)
        .when(F.col("conf_actor").isNotNull(), F.concat(F.lit("globalActor("), "conf_actor", F.lit(")")))
        .when(~F.col("eligible_default"), NONISOLATED)
        .when(nested & ~has_c, NONISOLATED)
        .when(nested & c.isNull(), wait)
        .when(nested & (c == NONISOLATED), NONISOLATED)
        .otherwise(default)
    )


#: One isolation of each class, by the column that holds what a declaration makes of it (null: the isolation itself).
_PROBES = {"of_actor": "actor(?)", "of_global": "globalActor(?)", "of_none": NONISOLATED, "of_unspecified": UNSPECIFIED}


def _applied(iso: Column, prefix: str = "") -> Column:
    """What a declaration's function makes of an isolation."""
    kind = F.when(is_actor(iso), F.col(prefix + "of_actor")).when(is_global_actor(iso), F.col(prefix + "of_global"))
    kind = kind.when(iso == NONISOLATED, F.col(prefix + "of_none")).otherwise(F.col(prefix + "of_unspecified"))
    return F.coalesce(kind, iso)


def _with_parents(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    c = resolved.select(F.col("usr").alias("container"), F.col("iso").alias("c_iso"))
    s = resolved.select(F.col("usr").alias("superclass"), F.col("iso").alias("s_iso"))
    return rows.join(c, "container", "left").join(s, "superclass", "left")


def resolve(declarations: DataFrame, conformances: DataFrame, default: str = NONISOLATED) -> DataFrame:
    """usr and iso of every declaration (one row a usr; merge collisions first)."""
    rows = lineage.cut(prepared(declarations, conformances))
    parents = rows.select(F.col("container").alias("usr")).union(rows.select("superclass")).where("usr IS NOT NULL").distinct()
    types = rows.join(parents, "usr", "left_semi")
    resolved = lineage.cut(types.where("terminal IS NOT NULL").select("usr", F.col("terminal").alias("iso")))
    pending = lineage.cut(types.where("terminal IS NULL"))
    columns, left = pending.columns, pending.count()
    while left:
        step = lineage.cut(_with_parents(pending, resolved).withColumn("iso", decision(default)))
        now = step.where("iso IS NOT NULL").select("usr", "iso")
        chained = _chains(step.where("iso IS NULL"), default)
        found, rings = _follow(chained, now.unionByName(resolved))
        resolved = lineage.cut(resolved.unionByName(now).unionByName(found).unionByName(rings))
        pending = step.select(columns).join(resolved, "usr", "left_anti")
        after = pending.count()
        if after == left:
            resolved = lineage.cut(resolved.unionByName(_tangled(pending, resolved, default)))
            pending = pending.join(resolved, "usr", "left_anti")
            after = pending.count()
        pending, left = lineage.cut(pending), after
    others = _with_parents(rows.join(parents, "usr", "left_anti"), resolved)
    return resolved.unionByName(others.select("usr", decision(default).alias("iso")))


def _chains(waiting: DataFrame, default: str) -> DataFrame:
    """usr, up (the one undecided parent) and the function of its isolation, of declarations that lack one parent."""
    c_open = F.col("container").isNotNull() & F.col("c_iso").isNull()
    s_open = F.col("superclass").isNotNull() & F.col("s_iso").isNull()
    one = waiting.where((c_open & ~s_open) | (s_open & ~c_open))
    made = {}
    for name, probe in _PROBES.items():
        value = decision(default, F.when(c_open, probe).otherwise(F.col("c_iso")), F.when(s_open, probe).otherwise(F.col("s_iso")))
        made[name] = F.nullif(value, F.lit(probe)) if name in ("of_actor", "of_global") else value
    return lineage.cut(one.select("usr", F.when(c_open, F.col("container")).otherwise(F.col("superclass")).alias("up"), *[v.alias(k) for k, v in made.items()]))


def _follow(chains: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usr, iso) of the declarations whose chain ends at a decided one, and of those on rings."""
    n, steps, state = chains.count(), 1, chains
    while True:
        above = state.select(F.col("usr").alias("up"), F.col("up").alias("_up"), *[F.col(k).alias(f"_{k}") for k in _PROBES])
        joined = state.join(above, "up", "left")
        # First what the parent makes of the isolation above it, then what the declaration makes of that.
        made = {k: F.when(F.col("_up").isNull(), F.col(k)).when(F.col(f"_{k}").isNull(), F.col(k)).otherwise(_applied(F.col(f"_{k}"))) for k in _PROBES}
        more = joined.select("usr", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("more"), *[v.alias(k) for k, v in made.items()])
        more = lineage.cut(more)
        state = more.drop("more")
        steps *= 2
        if steps > 2 * n or not more.where("more").limit(1).count():
            break
    ends = decided.select(F.col("usr").alias("up"), F.col("iso").alias("end"))
    found = state.join(ends, "up").select("usr", _applied(F.col("end")).alias("iso"))
    # After as many steps as there are declarations, what has no end stands on a ring, and every member of one is stood on.
    on = state.join(chains.select(F.col("usr").alias("up")), "up", "left_semi").select(F.col("up").alias("usr")).distinct()
    ring = lineage.cut(chains.join(on, "usr", "left_semi"))
    return found, _rings(ring)


def _rings(ring: DataFrame) -> DataFrame:
    """usr and iso of the members of rings (usr, up and functions)."""
    n, steps = ring.count(), 1
    if not n:
        return ring.select("usr", F.lit(None).cast("string").alias("iso"))
    label = ring.select("usr", "up", F.col("usr").alias("ring"))
    while steps < n:
        above = label.select(F.col("usr").alias("up"), F.col("up").alias("_up"), F.col("ring").alias("_ring"))
        label = lineage.cut(label.join(above, "up").select("usr", F.col("_up").alias("up"), F.least("ring", "_ring").alias("ring")))
        steps *= 2

    def around(group: pd.DataFrame) -> pd.DataFrame:
        rows = {r.usr: r for r in group.itertuples()}
        order = [group["usr"].iloc[0]]
        while (up := rows[order[-1]].up) != order[0]:
            order.append(up)
        made = [tuple(None if pd.isna(v) else v for v in (getattr(rows[u], k) for k in _PROBES)) for u in order]
        values = [UNSPECIFIED] * len(order)
        # Of every member the functions of as many members as there are, composed by doubling.
        done, size = 0, len(order)
        while size >> done:
            if size >> done & 1:
                ahead = size & ~((2 << done) - 1)
                values = [_of(made[(k + ahead) % len(order)], v) for k, v in enumerate(values)]
            made = [tuple(made[k][i] if y is None else _of(made[k], y) for i, y in enumerate(made[(k + (1 << done)) % len(order)])) for k in range(len(order))]
            done += 1
        return pd.DataFrame({"usr": order, "iso": values})

    return ring.join(label.select("usr", "ring"), "usr").groupBy("ring").applyInPandas(around, "usr string, iso string")


def _of(made: tuple, iso: str) -> str:
    kind = 0 if iso.startswith("actor(") else 1 if iso.startswith("globalActor(") else 2 if iso == NONISOLATED else 3
    return iso if made[kind] is None else made[kind]


def _components(pending: DataFrame) -> DataFrame:
    """usr and component: the smallest usr that is linked to it by parents among them."""
    nodes = pending.select("usr", F.col("usr").alias("component"))
    links = pending.select("usr", F.explode(F.array("container", "superclass")).alias("other")).where("other IS NOT NULL")
    links = links.join(nodes.select(F.col("usr").alias("other")), "other", "left_semi")
    links = lineage.cut(links.select("usr", "other").union(links.select("other", "usr")).distinct())
    labels = lineage.cut(nodes)
    while True:
        near = links.join(labels.withColumnRenamed("usr", "other"), "other").select("usr", "component")
        after = labels.unionByName(near).groupBy("usr").agg(F.min("component").alias("component"))
        # A label is a usr too, whose own label is as good.
        held = labels.select(F.col("usr").alias("component"), F.col("component").alias("_jump"))
        after = lineage.cut(after.join(held, "component", "left").select("usr", F.least("component", F.coalesce("_jump", "component")).alias("component")))
        moved = after.join(labels.withColumnRenamed("component", "old"), "usr").where("component <> old").limit(1).count()
        labels = after
        if not moved:
            return labels


def _tangled(pending: DataFrame, resolved: DataFrame, default: str) -> DataFrame:
    """Exact walks for tangled rings and what they reach, each from itself with a guard against its own path.

    Every undecided declaration waits for one parent first; following those leads onto rings, by doubling. The rest, which is only
    below, is left for the passes.
    """
    rows = lineage.cut(_with_parents(pending, resolved))
    c_open = F.col("container").isNotNull() & F.col("c_iso").isNull()
    first = F.when(c_open & ~F.col("is_nested_type"), F.col("container"))
    first = F.coalesce(first, F.when(F.col("superclass").isNotNull() & F.col("s_iso").isNull(), F.col("superclass")), F.col("container"))
    state, n, steps = lineage.cut(rows.select("usr", first.alias("up"))), rows.count(), 1
    while steps <= n:
        above = state.select(F.col("usr").alias("up"), F.col("up").alias("_up"))
        state = lineage.cut(state.join(above, "up").select("usr", F.col("_up").alias("up")))
        steps *= 2
    core = lineage.cut(state.select(F.col("up").alias("usr")).distinct())
    while True:
        ups = rows.join(core, "usr", "left_semi").select(F.explode(F.array("container", "superclass")).alias("usr")).where("usr IS NOT NULL")
        new = lineage.cut(ups.distinct().join(rows, "usr", "left_semi").join(core, "usr", "left_anti"))
        if not new.limit(1).count():
            break
        core = lineage.cut(core.union(new))
    rows = rows.join(core, "usr", "left_semi")
    rows = rows.join(_components(lineage.cut(rows)), "usr")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        nodes = {r.usr: r for r in group.itertuples()}

        def iso(usr: str, path: frozenset):
            """A walk as a generator: it yields the declarations that it asks for, with its path, and is sent their isolation."""
            r = nodes[usr]
            known = lambda parent, decided: not pd.isna(parent) and not pd.isna(decided)
            c = s = None
            if not pd.isna(r.container) and not r.is_nested_type:
                c = r.c_iso if known(r.container, r.c_iso) else (yield r.container, path)
                if c.startswith("actor(") and not r.is_static_member or c.startswith("globalActor("):
                    return c
            if not pd.isna(r.superclass):
                s = r.s_iso if known(r.superclass, r.s_iso) else (yield r.superclass, path)
                if s.startswith("globalActor("):
                    return s
            if not pd.isna(r.conf_actor):
                return f"globalActor({r.conf_actor})"
            if not r.eligible_default:
                return NONISOLATED
            if r.is_nested_type:
                if pd.isna(r.container):
                    return NONISOLATED
                c = r.c_iso if known(r.container, r.c_iso) else (yield r.container, path)
                if c == NONISOLATED:
                    return NONISOLATED
            return default

        def run(usr: str) -> str:
            stack, said = [iso(usr, frozenset([usr]))], None
            while True:
                try:
                    asked, path = stack[-1].send(said)
                except StopIteration as end:
                    stack.pop()
                    said = end.value
                    if not stack:
                        return said
                    continue
                if asked in path:
                    said = UNSPECIFIED
                else:
                    stack.append(iso(asked, path | {asked}))
                    said = None

        return pd.DataFrame({"usr": list(nodes), "iso": [run(u) for u in nodes]})

    return rows.groupBy("component").applyInPandas(walk, "usr string, iso string")


def transitive(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """All (child, ancestor) pairs of an edge list, cycles guarded: semi-naive rounds that add only new pairs."""
    found = lineage.cut(edges.select(F.col(child).alias(child), F.col(parent).alias("ancestor")).where(f"{child} <> ancestor").distinct())
    fresh, every = found, found
    up = edges.select(F.col(child).alias("ancestor"), F.col(parent).alias("next"))
    while True:
        step = fresh.join(up, "ancestor").select(child, F.col("next").alias("ancestor")).where(f"{child} <> ancestor").distinct()
        fresh = lineage.cut(step.join(every, [child, "ancestor"], "left_anti"))
        if fresh.limit(1).count() == 0:
            return every
        every = every.unionByName(fresh)


def default_isolation(version: str, configured: str = NONISOLATED) -> str:
    """The rule set's default for a language version; ValueError outside the supported versions."""
    for low, high, takes_default in RULE_SETS:
        if _parts(low) <= _parts(version) <= _parts(high):
            return configured if takes_default else NONISOLATED
    raise ValueError(f"no rule set for version {version}")


#: Lowest and highest version of each rule set, and whether the module's default applies.
RULE_SETS = (("5.0", "5.10", False), ("6.0", "6.0", False), ("6.1", "6.1", False), ("6.2", "6.2", True), ("6.3", "6.3", True))


def _parts(version: str) -> list[int]:
    return [int(x) for x in version.split(".")]


def effective_version(language_mode: str, compiler: str) -> str:
    """The language mode below 6, else the compiler's version."""
    return language_mode if _parts(language_mode) < [6] else compiler


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")
