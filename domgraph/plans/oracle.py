"""DuckDB equivalents of the registered queries, assembled from shared pieces."""

from __future__ import annotations

from domgraph.operators import report
from domgraph.plans.facts import ctes

#: Rounds that the unrolled resolution takes; deeper than any chain of the test tables.
ROUNDS = 20

_CONF = """conf AS MATERIALIZED (
  SELECT usr, arg_min(protocol_global_actor_name, row(CASE WHEN same_file_as_primary THEN 0 ELSE 1 END, protocol_usr, idx)) AS conf_actor
  FROM conformance WHERE protocol_global_actor_name IS NOT NULL AND (same_file_as_primary OR same_context_as_witness) GROUP BY usr)"""

_PREPARED = """prepared AS MATERIALIZED (
  SELECT d.usr, CASE WHEN d.is_actor_type THEN 'actor(' || d.name || ')' WHEN d.explicit_isolation IS NOT NULL THEN d.explicit_isolation
                     ELSE d.enclosing_extension_isolation END AS terminal,
         c.usr AS container, s.usr AS superclass, d.is_static_member, d.is_nested_type, d.eligible_default, conf_actor
  FROM declaration d LEFT JOIN declaration c ON d.containing_type_usr = c.usr LEFT JOIN declaration s ON d.superclass_usr = s.usr
  LEFT JOIN conf ON conf.usr = d.usr)"""

_DECIDE = """CASE WHEN NOT is_nested_type AND container IS NOT NULL AND c.iso IS NULL THEN NULL
  WHEN NOT is_nested_type AND c.iso LIKE 'actor(%' AND NOT is_static_member THEN c.iso
  WHEN NOT is_nested_type AND c.iso LIKE 'globalActor(%' THEN c.iso
  WHEN superclass IS NOT NULL AND s.iso IS NULL THEN NULL
  WHEN s.iso LIKE 'globalActor(%' THEN s.iso
  WHEN conf_actor IS NOT NULL THEN 'globalActor(' || conf_actor || ')'
  WHEN NOT eligible_default THEN 'nonisolated'
  WHEN is_nested_type AND container IS NULL THEN 'nonisolated'
  WHEN is_nested_type AND c.iso IS NULL THEN NULL
  WHEN is_nested_type AND c.iso = 'nonisolated' THEN 'nonisolated'
  ELSE 'nonisolated' END"""


def resolved() -> str:
    """The isolation of every declaration as the table `resolved`, round by round."""
    rounds = ["r0 AS MATERIALIZED (SELECT usr, terminal AS iso FROM prepared)"]
    for k in range(1, ROUNDS + 1):
        rounds.append(
            f"r{k} AS MATERIALIZED (SELECT p.usr, coalesce(o.iso, {_DECIDE}) AS iso FROM prepared p JOIN r{k - 1} o ON o.usr = p.usr"
            f" LEFT JOIN r{k - 1} c ON c.usr = p.container LEFT JOIN r{k - 1} s ON s.usr = p.superclass)"
        )
    rounds.append(f"resolved AS MATERIALIZED (SELECT * FROM r{ROUNDS})")
    return ",\n".join([ctes("declaration", "conformance"), _CONF, _PREPARED, *rounds])


_CROSS = """crossing AS MATERIALIZED (
  SELECT e.*, coalesce(a.iso, 'unspecified') AS caller_isolation, coalesce(b.iso, 'unspecified') AS callee_isolation
  FROM call_edge e LEFT JOIN resolved a ON a.usr = e.caller_usr LEFT JOIN resolved b ON b.usr = e.callee_usr
  WHERE coalesce(a.iso, 'unspecified') <> coalesce(b.iso, 'unspecified'))"""

_CLASSIFIED = """classified AS MATERIALIZED (
  SELECT c.file, start_line, start_col, end_line, end_col, ordinal,
         CASE WHEN g.name IS NOT NULL THEN 'globalActor(' || signature_attribute || ')'
              WHEN call_receiver = 'DispatchQueue.main' AND call_member IN ('async', 'asyncAfter') THEN 'globalActor(MainActor)' END AS isolation_override
  FROM closure_literal c LEFT JOIN global_actor_name g ON g.name = c.signature_attribute)"""

_INSIDE = "(start_line, start_col) <= (p.line, p.col) AND (p.line, p.col) <= (end_line, end_col)"


def _innermost(sites: str) -> str:
    return f"""(SELECT file, line, col, isolation_override AS override FROM (
    SELECT p.file, p.line, p.col, isolation_override,
           row_number() OVER (PARTITION BY p.file, p.line, p.col ORDER BY start_line DESC, start_col DESC, ordinal DESC) AS nth
    FROM (SELECT DISTINCT file, line, col FROM {sites}) p JOIN classified k ON k.file = p.file AND {_INSIDE}) WHERE nth = 1)"""


def _awaited(sites: str) -> str:
    return f"""(SELECT DISTINCT p.file, p.line, p.col FROM (SELECT DISTINCT file, line, col FROM {sites}) p
    JOIN awaited_range k ON k.file = p.file AND {_INSIDE})"""


def _quoted(template: str, *values: str) -> str:
    parts = template.split("%s")
    out = [f"'{parts[0]}'"]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value, f"'{part}'"]
    return " || ".join(out)


def _isolated(column: str) -> str:
    return f"({column} LIKE 'actor(%' OR {column} LIKE 'globalActor(%')"


def reported() -> str:
    """The report's edges as the table `reported`."""
    a, b = "caller_isolation", "callee_isolation"
    risk = f"CASE WHEN {a} = 'nonisolated' AND {_isolated(b)} THEN 'high' WHEN {_isolated(a)} AND {_isolated(b)} THEN 'low' ELSE 'medium' END"
    text = f"""CASE WHEN is_unknown THEN '{report.UNKNOWN_TEXT}' WHEN risk = 'high' THEN {_quoted(report.HIGH_TEXT, b)}
      WHEN risk = 'low' AND {a} LIKE 'globalActor(%' AND {a} = {b} THEN {_quoted(report.SAME_TEXT, a)}
      WHEN risk = 'low' THEN {_quoted(report.LOW_TEXT, a, b)} ELSE {_quoted(report.MEDIUM_TEXT, a, b)} END"""
    return ",\n".join(
        [
            resolved(),
            ctes("call_edge", "closure_literal", "awaited_range", "global_actor_name", "unknown_usr"),
            _CROSS,
            _CLASSIFIED,
            f"""flagged AS MATERIALIZED (
  SELECT e.caller_usr, e.callee_usr, coalesce(o.override, e.caller_isolation) AS caller_isolation, e.callee_isolation, e.file, e.line,
         w.file IS NOT NULL AS is_awaited, (u.usr IS NOT NULL OR v.usr IS NOT NULL) AS is_unknown,
         coalesce(d.is_immutable_stored_property, false) AS immutable, coalesce(d.is_actor_initializer, false) AS initializer
  FROM crossing e
  LEFT JOIN {_innermost("crossing")} o ON o.file = e.file AND o.line = e.line AND o.col = e.col
  LEFT JOIN {_awaited("crossing")} w ON w.file = e.file AND w.line = e.line AND w.col = e.col
  LEFT JOIN unknown_usr u ON u.usr = e.caller_usr LEFT JOIN unknown_usr v ON v.usr = e.callee_usr
  LEFT JOIN declaration d ON d.usr = e.callee_usr)""",
            f"""reported AS MATERIALIZED (
  SELECT caller_usr, callee_usr, caller_isolation, callee_isolation, risk, {text} AS explanation, file, line, is_unknown, is_awaited
  FROM (SELECT *, {risk} AS risk FROM flagged
        WHERE is_unknown OR NOT (({_isolated(a)} AND {b} = 'nonisolated') OR immutable OR initializer)))""",
        ]
    )


_DRAWN = """points AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY usr, name) - 1 AS n FROM (
    SELECT d.usr, name, iso AS isolation FROM declaration d JOIN resolved r ON r.usr = d.usr
    UNION ALL SELECT DISTINCT usr, usr, 'unspecified' FROM (SELECT caller_usr AS usr FROM reported UNION SELECT callee_usr FROM reported)
    WHERE usr NOT IN (SELECT usr FROM declaration))),
drawn AS MATERIALIZED (
  SELECT e.*, row_number() OVER (ORDER BY caller_usr, callee_usr, e.file, e.line, risk, is_unknown, is_awaited) - 1 AS n, a.n AS a, b.n AS b,
         CASE WHEN is_unknown THEN '#9e9e9e' WHEN risk = 'high' THEN '#e53935' WHEN risk = 'medium' THEN '#fb8c00' ELSE '#43a047' END AS colour
  FROM reported e JOIN points a ON a.usr = caller_usr JOIN points b ON b.usr = callee_usr)"""

_UNCERTAIN = "(caller_isolation = 'unspecified' OR callee_isolation = 'unspecified' OR is_unknown)"

_ANCESTORS = """up(protocol, ancestor) AS (
  SELECT protocol, parent FROM protocol_parent UNION SELECT up.protocol, p.parent FROM up JOIN protocol_parent p ON p.protocol = up.ancestor)"""

_MATCHED = """matched AS MATERIALIZED (
  SELECT usr, file, line, col, real_usr FROM (
    SELECT *, row_number() OVER (PARTITION BY usr, file, line, col ORDER BY grade, real_usr) AS nth FROM (
      SELECT d.usr, d.file, d.line, d.col, s.usr AS real_usr,
             CASE WHEN n = 1 THEN 0 WHEN s.name = d.name THEN 1 WHEN starts_with(s.name, d.name || '(') THEN 2 END AS grade
      FROM declaration d
      JOIN (SELECT *, count(*) OVER (PARTITION BY file, line, col) AS n FROM indexed_symbol) s ON s.file = d.file AND s.line = d.line AND s.col = d.col)
    WHERE grade IS NOT NULL) WHERE nth = 1)"""

_CHAIN = """walk(usr, signal, superclass) AS (
  SELECT usr, explicit_isolation, superclass_usr FROM declaration WHERE usr LIKE 'P%'
  UNION ALL SELECT w.usr, d.explicit_isolation, d.superclass_usr FROM walk w JOIN declaration d ON d.usr = w.superclass WHERE w.signal IS NULL),
chain AS (SELECT usr, coalesce(max(signal), 'nonisolated') AS chain_isolation FROM walk GROUP BY usr)"""

#: Members by the definitions among their occurrences alone, from the rows that the relations are made of.
_EXTENDED = """extended AS (
  SELECT 'O' || CAST(o_orderkey AS STRING) AS member, 'N' || CAST(c_nationkey AS STRING) AS type_usr
  FROM orders JOIN customer ON c_custkey = o_custkey % 90 AND c_custkey < 70
  WHERE o_orderkey % 5 = 2 AND o_orderkey % 3 <> 0)"""

#: The shapes of the generated names, read by their known parts rather than by the grammar.
_FORMS = """forms AS MATERIALIZED (
  SELECT p_partkey, usr,
    CASE WHEN p_partkey % 9 = 0 THEN 's:So6CGSizeV' END AS struct,
    p_partkey % 9 = 1 AS constant,
    CASE WHEN p_partkey % 9 = 2 THEN regexp_extract(usr, '^(.*?O)8rawValue', 1) END AS swift_enum,
    CASE WHEN p_partkey % 9 = 2 THEN 'c:@M@MiniAnchorRepro@E@T' || CAST(p_partkey AS STRING) || 'x' END AS objc_enum,
    CASE WHEN p_partkey % 9 = 3 THEN left(usr, length(usr) - 14) END AS hashable,
    CASE WHEN p_partkey % 9 = 4 THEN left(usr, length(usr) - 1) || 'p' END AS subscript,
    CASE WHEN p_partkey % 9 = 5 THEN left(usr, length(usr) - 2) || 'pZ' END AS static,
    CASE WHEN p_partkey % 9 = 6 THEN 'c:objc(cs)T' || CAST(p_partkey AS STRING) || 'x(py)shortcutItem' END AS property,
    CASE WHEN p_partkey % 9 = 2 THEN substr(usr, 20) WHEN p_partkey % 9 = 3 THEN substr(usr, 8) WHEN p_partkey % 9 = 5 THEN substr(usr, 17) END AS suffix,
    CASE WHEN p_partkey % 9 = 8 THEN 'c:objc(cs)T' || CAST(p_partkey AS STRING) || 'x' ELSE usr END AS unqualified
  FROM mangled)"""
_FORM_COLUMNS = ("struct", "constant", "swift_enum", "objc_enum", "hashable", "subscript", "static", "property", "suffix", "unqualified")

ORACLES: dict[str, str] = {
    "resolve_hierarchy": f"WITH {resolved()} SELECT usr, iso FROM resolved",
    "cross_edges": f"WITH {resolved()}, {ctes('call_edge')}, {_CROSS} SELECT * FROM crossing",
    "closure_override": f"""WITH {ctes("call_edge", "closure_literal", "global_actor_name")}, {_CLASSIFIED}
SELECT * FROM {_innermost("call_edge")}""",
    "awaited_edges": f"WITH {ctes('call_edge', 'awaited_range')} SELECT * FROM {_awaited('call_edge')}",
    "risk_edges": f"WITH {reported()} SELECT * FROM reported",
    "severity_filter": f"WITH {reported()} SELECT * FROM reported WHERE risk = 'high' OR {_UNCERTAIN}",
    "synthetic_nodes": f"""WITH {reported()} SELECT DISTINCT usr, usr AS name, 'unspecified' AS isolation, '' AS file, 0 AS line
FROM (SELECT caller_usr AS usr FROM reported UNION SELECT callee_usr FROM reported) WHERE usr NOT IN (SELECT usr FROM declaration)""",
    "report_nodes": f"""WITH {reported()} SELECT d.usr, name, iso AS isolation, file, line FROM declaration d JOIN resolved r ON r.usr = d.usr
UNION ALL SELECT DISTINCT usr, usr, 'unspecified', '', 0
FROM (SELECT caller_usr AS usr FROM reported UNION SELECT callee_usr FROM reported) WHERE usr NOT IN (SELECT usr FROM declaration)""",
    "risk_summary": f"""WITH {reported()}, of_types AS (
  SELECT count(*) AS types_analyzed, count_if(is_actor_type) AS actors, count_if(iso = 'globalActor(MainActor)') AS main_actor_types
  FROM declaration d JOIN resolved r ON r.usr = d.usr
  WHERE is_actor_type OR superclass_usr IS NOT NULL OR is_nested_type OR d.usr IN (SELECT usr FROM conformance)
        OR d.usr IN (SELECT containing_type_usr FROM declaration WHERE containing_type_usr IS NOT NULL)
)
SELECT types_analyzed::BIGINT AS types_analyzed, actors::BIGINT AS actors, main_actor_types::BIGINT AS main_actor_types,
  (SELECT count_if(coalesce(iso, 'unspecified') = 'unspecified') FROM (SELECT caller_usr AS usr FROM call_edge UNION SELECT callee_usr FROM call_edge) e
   LEFT JOIN resolved r ON r.usr = e.usr)::BIGINT AS unspecified_isolation,
  (SELECT count(*) FROM reported)::BIGINT AS cross_actor_boundaries,
  (SELECT count_if(risk = 'high' AND NOT is_unknown) FROM reported)::BIGINT AS high_risk_boundaries
FROM of_types""",
    "uncertainty_rate": f"""WITH {reported()} SELECT count(*)::BIGINT AS total, count_if({_UNCERTAIN})::BIGINT AS n_uncertain,
  coalesce(count_if({_UNCERTAIN}) / nullif(count(*), 0) > {report.UNCERTAIN_FROM}, false) AS alarm FROM reported""",
    "severity_summary": f"""WITH {reported()}
SELECT 'low' AS level, risk, count(*)::BIGINT AS n FROM reported GROUP BY risk
UNION ALL SELECT 'medium', risk, count(*) FROM reported WHERE risk IN ('medium', 'high') OR {_UNCERTAIN} GROUP BY risk
UNION ALL SELECT 'high', risk, count(*) FROM reported WHERE risk = 'high' OR {_UNCERTAIN} GROUP BY risk""",
    "protocol_closure": f"WITH RECURSIVE {ctes('protocol_parent')}, {_ANCESTORS} SELECT protocol, ancestor FROM up WHERE protocol <> ancestor",
    "conformance_expansion": f"""WITH RECURSIVE {ctes("protocol_parent", "conformance")}, {_ANCESTORS},
reached AS (
  SELECT c.*, ancestor, row_number() OVER (PARTITION BY usr, ancestor ORDER BY idx) AS nth
  FROM conformance c JOIN up ON up.protocol = c.protocol_usr AND up.protocol <> ancestor
  WHERE NOT EXISTS (SELECT 1 FROM conformance o WHERE o.usr = c.usr AND o.protocol_usr = ancestor))
SELECT * FROM conformance UNION ALL
SELECT usr, idx, ancestor, NULL, same_file_as_primary, same_context_as_witness FROM reached WHERE nth = 1""",
    "location_link": f"WITH {ctes('declaration', 'indexed_symbol')}, {_MATCHED} SELECT * FROM matched",
    "own_identity": f"""WITH {ctes("declaration", "indexed_symbol")}, {_MATCHED}
SELECT coalesce(real_usr, d.usr) AS usr, name, d.file, d.line FROM declaration d LEFT JOIN matched m ON m.usr = d.usr""",
    "merge_collisions": f"""WITH {ctes("declaration")}, moved AS (
  SELECT * REPLACE (left(usr, 1) || CAST(ord % 500 AS STRING) AS usr) FROM declaration
)
SELECT usr, arg_min(name, ord) AS name, arg_min(explicit_isolation, ord) AS explicit_isolation, arg_min(containing_type_usr, ord) AS containing_type_usr,
  arg_min(superclass_usr, ord) AS superclass_usr, arg_min(enclosing_extension_isolation, ord) AS enclosing_extension_isolation,
  bool_or(is_actor_type) AS is_actor_type, bool_or(is_static_member) AS is_static_member, bool_or(is_nested_type) AS is_nested_type,
  bool_or(is_immutable_stored_property) AS is_immutable_stored_property, bool_or(is_actor_initializer) AS is_actor_initializer,
  bool_and(eligible_default) AS eligible_default, arg_min(file, ord) AS file, arg_min(line, ord) AS line, arg_min(col, ord) AS col, min(ord)::BIGINT AS ord
FROM moved GROUP BY usr""",
    "accessor_canon": f"""WITH {ctes("call_edge", "relation")}, owners AS (
  SELECT usr, coalesce(min(CASE WHEN occurrence_roles & 2 <> 0 THEN target_usr END), min(target_usr)) AS low,
         coalesce(max(CASE WHEN occurrence_roles & 2 <> 0 THEN target_usr END), max(target_usr)) AS high
  FROM relation WHERE role = 32768 GROUP BY usr
), one AS (SELECT usr, low FROM owners WHERE low = high)
SELECT coalesce(a.low, caller_usr) AS caller_usr, coalesce(b.low, callee_usr) AS callee_usr, file, line, col
FROM call_edge LEFT JOIN one a ON a.usr = caller_usr LEFT JOIN one b ON b.usr = callee_usr""",
    "setter_suppress": f"""WITH {ctes("call_edge")} SELECT * FROM call_edge e WHERE CAST(substr(callee_usr, 2) AS BIGINT) % 2 = 1
AND NOT EXISTS (SELECT 1 FROM call_edge g WHERE CAST(substr(g.callee_usr, 2) AS BIGINT) % 2 = 0 AND g.line % 20 = 0
                AND g.file = e.file AND g.line = e.line AND g.col = e.col)""",
    "call_graph_union": f"""WITH {ctes("call_edge", "declaration")} SELECT * FROM call_edge
WHERE callee_usr IN (SELECT usr FROM declaration) OR file IN (SELECT file FROM call_edge WHERE line % 3 = 0 AND col > 78)""",
    "base_of": f"""WITH {ctes("relation")} SELECT target_usr AS nominal, name, min(usr) AS base_usr FROM relation
WHERE role = 1024 GROUP BY target_usr, name HAVING count(DISTINCT usr) = 1""",
    "earliest_callsite": f"""WITH {ctes("call_edge")} SELECT callee_usr, file, line, col FROM (
  SELECT *, row_number() OVER (PARTITION BY callee_usr ORDER BY file, line, col) AS nth FROM call_edge) WHERE nth = 1""",
    "mangled_forms": f"WITH {ctes('mangled')}, {_FORMS} SELECT p_partkey, usr, {', '.join(_FORM_COLUMNS)} FROM forms",
    "matcher_chain": f"""WITH {ctes("mangled")}, {_FORMS},
known AS (SELECT DISTINCT coalesce(swift_enum, hashable) AS usr FROM forms WHERE p_partkey % 2 = 0 AND coalesce(swift_enum, hashable) IS NOT NULL),
bulk AS (SELECT DISTINCT coalesce(subscript, static, property) AS usr FROM forms WHERE p_partkey % 4 <> 1 AND coalesce(subscript, static, property) IS NOT NULL),
wanted AS (SELECT DISTINCT usr, struct, constant, swift_enum, hashable, subscript, static, property FROM forms)
SELECT w.usr,
  CASE WHEN e.usr IS NOT NULL THEN 'enum_accessor' WHEN h.usr IS NOT NULL THEN 'hash_accessor' WHEN struct IS NOT NULL THEN 'struct_member'
       WHEN constant THEN 'constant' WHEN s.usr IS NOT NULL THEN 'subscript' WHEN t.usr IS NOT NULL THEN 'static'
       WHEN p.usr IS NOT NULL THEN 'property' ELSE 'live_query' END AS matcher,
  CASE WHEN e.usr IS NOT NULL THEN swift_enum WHEN h.usr IS NOT NULL THEN hashable WHEN struct IS NOT NULL THEN struct
       WHEN constant THEN NULL WHEN s.usr IS NOT NULL THEN subscript WHEN t.usr IS NOT NULL THEN static
       WHEN p.usr IS NOT NULL THEN property END AS through,
  CASE WHEN e.usr IS NOT NULL THEN 'nonisolated' WHEN h.usr IS NOT NULL THEN NULL WHEN struct IS NOT NULL OR constant THEN 'nonisolated'
       WHEN coalesce(s.usr, t.usr, p.usr) IS NOT NULL THEN 'globalActor(MainActor)' END AS isolation
FROM wanted w LEFT JOIN known e ON e.usr = swift_enum LEFT JOIN known h ON h.usr = hashable
LEFT JOIN bulk s ON s.usr = subscript LEFT JOIN bulk t ON t.usr = static LEFT JOIN bulk p ON p.usr = property""",
    "sibling_alias": f"""WITH {ctes("mangled")} SELECT usr, 's:5MoyaX' || substr(usr, 8) AS sibling FROM mangled WHERE p_partkey % 9 = 3""",
    "inherit_chain": f"""WITH RECURSIVE {ctes("declaration")}, {_CHAIN} SELECT usr, chain_isolation FROM chain""",
    "bulk_lookup": f"""WITH RECURSIVE {ctes("declaration", "call_edge")}, {_CHAIN}
SELECT DISTINCT d.usr, coalesce(explicit_isolation, CASE WHEN chain_isolation LIKE 'globalActor(%' THEN chain_isolation END, 'nonisolated') AS isolation
FROM declaration d LEFT JOIN chain ON chain.usr = d.superclass_usr WHERE d.usr LIKE 'S%' AND d.usr IN (SELECT callee_usr FROM call_edge)""",
    "claim_once": f"""WITH {ctes("declaration")}, wanted AS (
  SELECT 'superclass' AS kind, superclass_usr AS target, CAST(is_nested_type AS INT) AS tier, file, line, col, usr FROM declaration
  WHERE explicit_isolation IS NULL AND enclosing_extension_isolation IS NULL AND superclass_usr IS NOT NULL
  UNION ALL SELECT 'container', containing_type_usr, CAST(is_static_member AS INT), file, line, col, usr FROM declaration
  WHERE explicit_isolation IS NULL AND enclosing_extension_isolation IS NULL AND containing_type_usr IS NOT NULL)
SELECT kind, target, usr, tier FROM (SELECT *, row_number() OVER (PARTITION BY kind, target ORDER BY tier, file, line, col, usr) AS nth FROM wanted) WHERE nth = 1""",
    "pair_fanout": f"""WITH {ctes("conformance", "declaration")}
SELECT c.usr, idx, protocol_usr, coalesce(protocol_global_actor_name, CASE WHEN n.usr IS NOT NULL THEN 'MainActor' END) AS protocol_global_actor_name,
  same_file_as_primary, same_context_as_witness
FROM conformance c LEFT JOIN declaration d ON d.usr = c.usr
LEFT JOIN declaration n ON n.usr LIKE 'N%' AND n.usr = coalesce(d.containing_type_usr, c.usr) AND protocol_usr = 'Q' || CAST(n.ord % 7 AS STRING)""",
    "unknown_propagation": f"""WITH {ctes("declaration")}, failed AS (
  SELECT usr FROM declaration WHERE usr LIKE 'C%' AND ord % 19 = 0 OR usr LIKE 'N%' AND ord % 6 = 0)
SELECT usr FROM failed UNION SELECT usr FROM declaration WHERE containing_type_usr IN (SELECT usr FROM failed)""",
    "overlay_merge": f"""WITH {ctes("declaration")}, base AS (
  SELECT usr, CASE WHEN ord % 7 = 0 THEN 'globalActor(Updated)' ELSE explicit_isolation END AS explicit_isolation,
         CASE WHEN ord % 5 <> 0 THEN file END AS file, ord FROM declaration)
SELECT usr, CASE WHEN file IS NULL AND ord % 3 = 0 THEN 'globalActor(Backfilled)' ELSE explicit_isolation END AS explicit_isolation, file FROM base
UNION ALL SELECT 'new' || usr, 'globalActor(Backfilled)', NULL FROM base WHERE ord % 6 = 0""",
    "manifest_diff": f"""WITH {ctes("manifest_old", "manifest_new")}
SELECT coalesce(o.file, n.file) AS file, CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM manifest_old o FULL JOIN manifest_new n ON n.file = o.file WHERE o.content_hash IS DISTINCT FROM n.content_hash""",
    "balanced_chunks": f"""WITH {ctes("call_edge")}, ranked AS (
  SELECT file, dense_rank() OVER (ORDER BY file) - 1 AS place, (SELECT count(DISTINCT file) FROM call_edge) AS n FROM call_edge)
SELECT least(7, place // greatest(1, n // 8))::INT AS chunk, count(DISTINCT file)::BIGINT AS files, count(*)::BIGINT AS items FROM ranked GROUP BY 1""",
    "closest_name": """WITH wanted AS (SELECT substr(n_name, 2) || 'x' AS requested FROM nation), pairs AS (
  SELECT requested, n_name AS name, levenshtein(requested, n_name) AS distance FROM wanted, nation),
best AS (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY distance, name) AS nth FROM pairs)
SELECT requested, CASE WHEN distance <= greatest(1, length(requested) // 3) THEN name END AS suggestion FROM best WHERE nth = 1""",
    # Units of modules M1 and M3 and of the system are read in order; a record counts in the first of them that holds it.
    "scope_filter": f"""WITH {ctes("occurrence")}, allowed AS (SELECT * FROM occurrence WHERE is_system OR module = 'M1' OR module = 'M3'),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY record ORDER BY module, is_system) AS unit FROM allowed)
SELECT usr, name, file, line, col FROM ranked WHERE unit = 1 AND roles & 2 <> 0""",
    "skipped_units": f"""WITH {ctes("occurrence")} SELECT count(DISTINCT module)::BIGINT AS skipped FROM occurrence WHERE NOT is_system AND module IN ('M0', 'M2', 'M4')""",
    # From the rows that the calls are made of; rows of one order, line and column are one occurrence.
    "call_projection": """WITH rows AS (
  SELECT *, 'F' || CAST(l_orderkey % 97 AS STRING) AS file, (l_linenumber * 10)::INT AS line, (l_partkey % 80 + 1)::INT AS col FROM lineitem
), told AS (
  SELECT l_orderkey, line, col, 1 AS nth, 'C' || CAST(l_partkey % 30 AS STRING) AS caller FROM rows WHERE l_suppkey % 3 = 0
  UNION ALL SELECT l_orderkey, line, col, 2, 'C' || CAST((l_suppkey + l_linenumber) % 40 AS STRING) FROM rows WHERE l_suppkey % 7 <> 0
), callers AS (
  SELECT l_orderkey, line, col, caller FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, line, col ORDER BY nth, caller) AS k FROM told) WHERE k = 1
), called AS (SELECT caller, l_orderkey, file, line, col FROM rows JOIN callers USING (l_orderkey, line, col) WHERE l_partkey % 3 <> 0)
SELECT caller AS caller_usr, 'O' || CAST(l_orderkey AS STRING) AS callee_usr, file, line, col FROM called s
WHERE l_orderkey % 9 <> 1 OR NOT EXISTS (SELECT 1 FROM called g WHERE g.l_orderkey % 9 = 2 AND g.file = s.file AND g.line = s.line AND g.col = s.col)""",
    "extended_type": f"""WITH {_EXTENDED} SELECT member, type_usr FROM extended""",
    "extension_containers": f"""WITH {_EXTENDED}, {ctes("declaration")}
SELECT d.usr, CASE WHEN ord % 2 = 0 THEN coalesce(type_usr, 'syntactic:' || containing_type_usr) ELSE containing_type_usr END AS containing_type_usr
FROM declaration d LEFT JOIN extended ON member = d.usr WHERE d.usr LIKE 'O%'""",
    "conformance_actor": f"""WITH {ctes("conformance")}
SELECT usr, idx, 'syntactic:' || protocol_usr AS protocol_usr, coalesce(protocol_global_actor_name,
    CASE WHEN protocol_usr = 'Q1' THEN 'DataActor' WHEN protocol_usr = 'Q4' THEN 'IndexActor'
         WHEN protocol_usr = 'Q2' AND usr LIKE '%1' THEN 'MainActor' WHEN protocol_usr = 'Q5' AND usr NOT LIKE '%1' THEN 'DataActor' END) AS protocol_global_actor_name,
  same_file_as_primary, same_context_as_witness
FROM conformance""",
    "demangled_sibling": f"""WITH {ctes("mangled")}, known AS (
  SELECT p_partkey % 500 AS n, min('d' || usr) AS sibling FROM mangled WHERE p_partkey % 3 = 0 GROUP BY 1 HAVING count(*) = 1)
SELECT usr, sibling FROM mangled JOIN known ON n = p_partkey % 300 WHERE p_partkey % 4 = 0""",
    "external_needs": f"""WITH {ctes("declaration", "conformance")}, open AS (
  SELECT * FROM declaration WHERE explicit_isolation IS NULL AND enclosing_extension_isolation IS NULL),
have AS (SELECT usr FROM declaration WHERE ord % 4 <> 0 OR ord % 8 = 0)
SELECT usr, 'superclass' AS kind, superclass_usr AS target, NULL AS pair_of FROM open WHERE superclass_usr IS NOT NULL AND superclass_usr NOT IN (SELECT usr FROM have)
UNION ALL SELECT usr, 'container', containing_type_usr, NULL FROM open WHERE containing_type_usr IS NOT NULL AND containing_type_usr NOT IN (SELECT usr FROM have)
UNION ALL SELECT c.usr, 'pair', protocol_usr, coalesce(containing_type_usr, c.usr) FROM conformance c JOIN open o ON o.usr = c.usr
WHERE protocol_global_actor_name IS NULL AND (same_file_as_primary OR same_context_as_witness)
  AND protocol_usr NOT IN ('s:s8SendableP', 's:s16SendableMetatypeP')
  AND NOT EXISTS (SELECT 1 FROM declaration p WHERE p.usr = protocol_usr AND p.ord % 4 <> 0)""",
    "query_outcomes": f"""WITH {ctes("declaration")}
SELECT usr, CASE WHEN ord % 3 = 0 THEN 'nonisolated' WHEN ord % 2 = 0 THEN 'globalActor(MainActor)' END AS isolation, ord % 3 <> 0 AND ord % 2 <> 0 AS is_unknown
FROM declaration WHERE usr LIKE 'P%'""",
    "merged_modules": """SELECT 'u' || CAST(o_orderkey % 700 AS STRING) AS usr, 'globalActor(A' || CAST(max(o_orderkey) % 9 AS STRING) || ')' AS isolation,
  bool_or(o_orderkey % 50 = 0) AS is_protocol FROM orders GROUP BY o_orderkey % 700""",
    "statistics_delta": """WITH a AS (SELECT event_type AS kind, count(*) AS n FROM events WHERE event_id % 3 = 0 AND event_type <> 'click' GROUP BY 1),
b AS (SELECT event_type AS kind, count(*) AS n FROM events WHERE event_id % 5 = 0 AND event_type <> 'view' GROUP BY 1)
SELECT coalesce(a.kind, b.kind) AS kind, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta FROM a FULL JOIN b ON a.kind = b.kind""",
    "preferred_arguments": """WITH rows AS (SELECT 'src/T' || CAST(p_partkey % 6 AS STRING) || '/f' || CAST(p_partkey % 101 AS STRING) AS file,
  'T' || CAST(p_partkey % 8 AS STRING) AS target, p_partkey AS ordinal, '-a' || CAST(p_partkey AS STRING) AS args FROM part),
flagged AS (SELECT *, string_split(file, '/')[2] = target AS inside FROM rows)
SELECT file, CASE WHEN count(*) FILTER (inside) = 1 THEN arg_min(args, ordinal) FILTER (inside) ELSE arg_min(args, ordinal) END AS args FROM flagged GROUP BY file""",
    "sanitized_arguments": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-c ' END
  || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-O ' || p_brand || ' ' END || '-g' AS args FROM part""",
    "module_eligibility": """SELECT p_partkey, p_size % 4 NOT IN (0, 1) AND p_size % 7 <> 0 AND p_size % 5 <> 0 AS eligible FROM part""",
    "mermaid_lines": f"""WITH {reported()}, {_DRAWN}
SELECT 0 AS section, 0::BIGINT AS n, 'flowchart LR' AS line
UNION ALL SELECT 1, n, '    n' || n || '["' || replace(name, '"', '\'\'') || '<br/>' || replace(isolation, '"', '\'\'') || '"]' FROM points
UNION ALL SELECT 2, n, '    n' || a || ' --> n' || b FROM drawn
UNION ALL SELECT 3, n, '    linkStyle ' || n || ' stroke:' || colour || ',stroke-width:2px' || CASE WHEN is_unknown THEN ',stroke-dasharray:5 5' ELSE '' END FROM drawn""".replace("\\'", "'"),
    "dot_lines": f"""WITH {reported()}, {_DRAWN}
SELECT 0 AS section, 0::BIGINT AS n, 'digraph IsolationMap {{' AS line UNION ALL SELECT 0, 1, '    rankdir=LR;' UNION ALL SELECT 3, 0, '}}'
UNION ALL SELECT 1, n, '    "' || usr || '" [label="' || name || '\\n' || isolation || '"];' FROM points
UNION ALL SELECT 2, n, '    "' || caller_usr || '" -> "' || callee_usr || '" [color="' || colour || '", penwidth='
  || CASE WHEN is_unknown THEN '1.0' WHEN risk = 'high' THEN '2.5' WHEN risk = 'medium' THEN '1.5' ELSE '1.0' END
  || ', label="' || CASE WHEN is_unknown THEN 'unknown' ELSE risk END || '"' || CASE WHEN is_unknown THEN ', style=dashed' ELSE '' END || '];' FROM drawn""",
    "reference_rewrite": f"""WITH {ctes("reference")}
SELECT c_custkey, CASE WHEN file = 'F3' THEN ref
  WHEN c_custkey % 3 = 0 AND c_custkey % 40 % 6 = 0 AND o.s_suppkey IS NOT NULL THEN 's:o' || CAST(c_custkey % 40 AS STRING)
  WHEN c_custkey % 3 = 0 AND c_custkey % 40 % 2 = 0 AND o.s_suppkey IS NOT NULL THEN 's:t' || CAST(c_custkey % 40 AS STRING)
  WHEN c_custkey % 3 = 1 AND nested.n = 1 THEN 's:i' || CAST(nested.only AS STRING)
  WHEN ref = 'syntactic:Out3.In3' THEN 's:i3' ELSE ref END AS ref, file
FROM reference LEFT JOIN supplier o ON o.s_suppkey = c_custkey % 40
LEFT JOIN (SELECT s_suppkey % 40 AS k, count(*) AS n, min(s_suppkey) AS only FROM supplier WHERE s_suppkey < 50 GROUP BY 1) nested ON k = c_custkey % 60""",
    "live_answers": """SELECT CASE WHEN p_partkey % 3 = 1 THEN 's:4Mod' || CAST(p_partkey AS STRING) ELSE 's:So' || CAST(length(CAST(p_partkey AS STRING)) + 2 AS STRING) || 'T' || CAST(p_partkey AS STRING) || 'xa3oneABvgZ' END AS target_usr,
  CASE WHEN p_partkey % 3 = 1 THEN 's:4Mod' || CAST(p_partkey AS STRING) || '::SYNTHESIZED::s:x' WHEN p_partkey % 6 = 0 THEN 'c:@E@x' ELSE 'c:@y' END AS usr,
  CASE WHEN p_partkey % 6 = 0 THEN 'two' ELSE 'one' END AS name
FROM part WHERE p_partkey % 3 <> 2""",
    "fragment_isolation": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'globalActor(MainActor)'
  WHEN p_partkey % 5 = 2 AND p_partkey % 4 IN (1, 2) THEN 'globalActor(A' || CAST(p_partkey % 4 AS STRING) || ')' ELSE 'nonisolated' END AS isolation FROM part""",
    "scheme_list": """SELECT p.n_name AS name, t.n_name AS target, 'Sources/' || t.n_name AS path FROM nation p JOIN nation t ON t.n_name = p.n_name WHERE p.n_nationkey % 5 = 0
UNION ALL SELECT p.n_name, t.n_name, 'Sources/' || t.n_name FROM nation p JOIN nation t ON t.n_name = 'FRANCE' WHERE p.n_nationkey % 5 = 0
UNION ALL SELECT n_name, n_name, 'Sources/' || n_name FROM nation WHERE n_nationkey % 5 <> 0""",
    "first_arguments": """SELECT '/sdk/' || CAST(min(p_partkey) AS STRING) AS value, '-sdk' AS flag FROM part WHERE p_partkey > 17 UNION ALL SELECT NULL, '-target'""",
    "first_file_wins": f"""WITH {ctes("conformance")} SELECT protocol_usr AS protocol, 'A' || min(usr) AS actor FROM conformance
WHERE protocol_global_actor_name IS NOT NULL GROUP BY protocol_usr""",
    "text_decisions": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 7 AS STRING) || '.2' END AS version,
  CASE WHEN p_partkey % 2 = 0 THEN 'ios' ELSE 'macosx' END AS platform, 'a_b_' || CAST(p_partkey AS STRING) || '_c' AS sanitized,
  left(sha256('a b-' || CAST(p_partkey AS STRING) || '.c'), 8) AS identity,
  CASE p_partkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 + length(CAST(p_partkey AS STRING)) + 1 + 1 WHEN 3 THEN 2 + length(CAST(p_partkey AS STRING)) + 1 + 8 + 1 END::INT AS "offset",
  'a b' || chr(92) || CAST(p_partkey AS STRING) AS plain, p_partkey % 2 = 0 AS struct_member FROM part""",
    "work_items": f"""WITH {ctes("call_edge")}, items AS (SELECT DISTINCT callee_usr AS usr, file, line, col FROM call_edge),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY file) - 1 AS place, (SELECT count(DISTINCT file) FROM items) AS n FROM items),
dealt AS (SELECT usr, file, line, col, least(7, place // greatest(1, n // 8))::INT AS chunk FROM ranked)
SELECT *, (row_number() OVER (PARTITION BY chunk ORDER BY file, line, col, usr) - 1)::INT AS nth FROM dealt""",
    "live_files": f"""WITH {ctes("call_edge", "declaration")} SELECT count(DISTINCT file)::BIGINT AS files FROM call_edge
WHERE callee_usr NOT IN (SELECT usr FROM declaration)""",
    "output_tails": """SELECT doc_id, md5(right(text, 4000)) AS tail, CASE doc_id % 3 WHEN 0 THEN 'arm64-apple-ios17.0' WHEN 1 THEN 'arm64-apple-macosx17.0' END AS triple FROM documents""",
    # A customer's place has one symbol, another of other names, or both; the second alone counts whatever its name.
    "unresolved_placeholders": """SELECT 'syntactic:C' || CAST(c_custkey AS STRING) AS usr, 'customer.src' AS file, (c_custkey + 1)::INT AS line FROM customer
WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0 AND c_custkey % 3 <> 0""",
    "merged_conformances": f"""WITH {ctes("conformance")}
SELECT 'C' || CAST(CAST(substr(usr, 2) AS BIGINT) % 100 AS STRING) AS usr,
  (row_number() OVER (PARTITION BY CAST(substr(usr, 2) AS BIGINT) % 100 ORDER BY CAST(substr(usr, 2) AS BIGINT), idx) - 1)::INT AS idx, protocol_usr
FROM conformance""",
}
