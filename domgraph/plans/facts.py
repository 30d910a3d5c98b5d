"""Fact tables derived from the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def _declared(usr: str, name: str, file: str, line: str, **columns: str) -> str:
    values = {
        "explicit_isolation": "CAST(NULL AS STRING)",
        "is_actor_type": "false",
        "containing_type_usr": "CAST(NULL AS STRING)",
        "is_static_member": "false",
        "superclass_usr": "CAST(NULL AS STRING)",
        "eligible_default": "true",
        "enclosing_extension_isolation": "CAST(NULL AS STRING)",
        "is_nested_type": "false",
        "is_immutable_stored_property": "false",
        "is_actor_initializer": "false",
    } | columns
    listed = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return f"SELECT {usr} AS usr, {name} AS name, {listed}, '{file}' AS file, CAST({line} + 1 AS INT) AS line, 1 AS col, CAST({line} AS BIGINT) AS ord"


def _key(prefix: str, column: str) -> str:
    return f"'{prefix}' || CAST({column} AS STRING)"


def _half(column: str) -> str:
    return f"CAST(floor({column} / 2) AS BIGINT)"


FACTS: dict[str, str] = {
    "declaration": " UNION ALL ".join(
        [
            _declared(_key("R", "r_regionkey"), "r_name", "region.src", "r_regionkey", is_actor_type="r_regionkey % 5 = 0") + " FROM region",
            _declared(
                _key("N", "n_nationkey"),
                "n_name",
                "nation.src",
                "n_nationkey",
                containing_type_usr=_key("R", "n_regionkey"),
                explicit_isolation="CASE WHEN n_nationkey % 7 = 0 THEN 'globalActor(MainActor)' END",
                is_nested_type="n_nationkey % 2 = 1",
            )
            + " FROM nation",
            _declared(
                _key("C", "c_custkey"),
                "c_name",
                "customer.src",
                "c_custkey",
                containing_type_usr=_key("N", "c_nationkey"),
                explicit_isolation="CASE WHEN c_custkey % 11 = 0 THEN 'nonisolated' END",
                is_static_member="c_mktsegment = 'BUILDING'",
                eligible_default="c_custkey % 13 <> 0",
                enclosing_extension_isolation="CASE WHEN c_custkey % 17 = 3 THEN 'globalActor(DataActor)' END",
            )
            + " FROM customer",
            _declared(
                _key("S", "s_suppkey"),
                "s_name",
                "supplier.src",
                "s_suppkey",
                superclass_usr=_key("P", "s_suppkey"),
                containing_type_usr=_key("N", "s_nationkey"),
                is_nested_type="s_suppkey % 3 = 0",
            )
            + " FROM supplier",
            _declared(
                _key("P", "p_partkey"),
                "p_name",
                "part.src",
                "p_partkey",
                superclass_usr=f"CASE WHEN p_partkey >= 1 AND p_partkey % 29 <> 0 THEN {_key('P', _half('p_partkey'))} END",
                explicit_isolation="CASE WHEN p_partkey % 37 = 5 THEN 'globalActor(DataActor)' WHEN p_partkey = 0 THEN 'globalActor(MainActor)'"
                " WHEN p_partkey % 5 = 2 THEN 'nonisolated' END",
                is_actor_type="p_partkey % 23 = 11",
            )
            + " FROM part",
            _declared(
                _key("O", "o_orderkey"),
                _key("order", "o_orderkey"),
                "orders.src",
                "o_orderkey",
                containing_type_usr=_key("C", "o_custkey"),
                is_immutable_stored_property="o_orderstatus = 'F'",
                is_actor_initializer="o_orderpriority = '1-URGENT'",
            )
            + " FROM orders",
        ]
    ),
    "conformance": f"""
        SELECT {_key("C", "c_custkey")} AS usr, 0 AS idx, {_key("Q", "c_custkey % 7")} AS protocol_usr,
               CASE WHEN c_custkey % 3 = 0 THEN 'MainActor' END AS protocol_global_actor_name,
               c_custkey % 2 = 0 AS same_file_as_primary, c_custkey % 4 = 1 AS same_context_as_witness
        FROM customer WHERE c_custkey % 5 = 1
        UNION ALL
        SELECT {_key("C", "c_custkey")}, 1, {_key("Q", "c_custkey % 5")}, 'IndexActor', c_custkey % 3 = 0, true
        FROM customer WHERE c_custkey % 10 = 6
        UNION ALL
        SELECT {_key("C", "c_custkey")}, 2, CASE WHEN c_custkey % 20 = 1 THEN 's:s8SendableP' WHEN c_custkey % 20 = 6 THEN 's:s16SendableMetatypeP'
               ELSE {_key("N", "c_nationkey")} END, CAST(NULL AS STRING), c_custkey % 2 = 1, c_custkey % 3 = 1
        FROM customer WHERE c_custkey % 5 = 1""",
    "call_edge": f"""
        SELECT {_key("O", "l_orderkey")} AS caller_usr,
               CASE WHEN l_partkey % 41 = 0 THEN {_key("X", "l_partkey")} WHEN l_partkey % 2 = 0 THEN {_key("P", "l_partkey")}
                    WHEN l_partkey % 3 = 0 THEN {_key("O", "l_partkey")} ELSE {_key("S", "l_suppkey")} END AS callee_usr,
               {_key("F", "l_orderkey % 97")} AS file, CAST(l_linenumber * 10 + l_suppkey % 10 AS INT) AS line, CAST(l_partkey % 80 + 1 AS INT) AS col
        FROM lineitem""",
    "closure_literal": f"""
        SELECT {_key("F", "event_id % 97")} AS file, CAST(10 + event_id % 60 AS INT) AS start_line, CAST(1 + event_id % 40 AS INT) AS start_col,
               CAST(10 + event_id % 60 + event_id % 7 AS INT) AS end_line, CAST(30 + event_id % 50 AS INT) AS end_col,
               CASE WHEN event_id % 5 = 0 THEN 'MainActor' WHEN event_id % 5 = 1 THEN 'Sendable' END AS signature_attribute,
               CASE WHEN event_id % 3 = 0 THEN 'DispatchQueue.main' WHEN event_id % 3 = 1 THEN 'DispatchQueue.global()' END AS call_receiver,
               CASE WHEN event_id % 2 = 0 THEN 'async' ELSE 'sync' END AS call_member, CAST(event_id AS INT) AS ordinal
        FROM events""",
    "awaited_range": f"""
        SELECT {_key("F", "event_id % 97")} AS file, CAST(10 + event_id % 70 AS INT) AS start_line, CAST(1 + event_id % 30 AS INT) AS start_col,
               CAST(10 + event_id % 70 + event_id % 2 AS INT) AS end_line, CAST(20 + event_id % 60 AS INT) AS end_col
        FROM events""",
    "global_actor_name": "SELECT 'MainActor' AS name UNION ALL SELECT 'DataActor' UNION ALL SELECT 'IndexActor'",
    "unknown_usr": f"SELECT {_key('P', 'p_partkey')} AS usr FROM part WHERE p_size > 40",
    "manifest_old": f"""
        SELECT {_key("doc", "doc_id")} AS file, SHA256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS content_hash
        FROM documents WHERE doc_id % 11 <> 0""",
    "manifest_new": f"SELECT {_key('doc', 'doc_id')} AS file, SHA256(text) AS content_hash FROM documents WHERE doc_id % 13 <> 0",
    "indexed_symbol": f"""
        SELECT {_key("s:C", "c_custkey")} AS usr, c_name AS name, 'customer.src' AS file, CAST(c_custkey + 1 AS INT) AS line, 1 AS col
        FROM customer WHERE c_custkey % 7 <> 0
        UNION ALL
        SELECT {_key("s:G", "c_custkey")}, CASE WHEN c_custkey % 2 = 0 THEN 'getter:' || c_name ELSE c_name || '(as:)' END,
               'customer.src', CAST(c_custkey + 1 AS INT), 1
        FROM customer WHERE c_custkey % 3 = 0""",
    "protocol_parent": f"""
        SELECT {_key("Q", "p_partkey")} AS protocol, {_key("Q", _half("p_partkey"))} AS parent FROM part WHERE p_partkey >= 1
        UNION ALL SELECT 'Q1', 'Q7'""",
    "occurrence": f"""
        SELECT {_key("O", "l_orderkey")} AS usr,
               CASE WHEN l_orderkey % 9 = 1 THEN 'setter:' WHEN l_orderkey % 9 = 2 THEN 'getter:' ELSE '' END || {_key("order", "l_orderkey")} AS name,
               CAST(CASE WHEN l_partkey % 3 = 0 THEN 2 WHEN l_partkey % 3 = 1 THEN 32 ELSE 34 END AS BIGINT) AS roles,
               {_key("F", "l_orderkey % 97")} AS file, CAST(l_linenumber * 10 AS INT) AS line, CAST(l_partkey % 80 + 1 AS INT) AS col,
               {_key("M", "l_suppkey % 5")} AS module, l_suppkey % 11 = 0 AS is_system, {_key("rec", "l_orderkey % 1000")} AS record
        FROM lineitem""",
    # Relations of occurrences: callers of each call, accessors of properties, bases, extensions.
    "relation": f"""
        SELECT {_key("O", "l_orderkey")} AS usr, CAST(8192 AS BIGINT) AS role, {_key("C", "(l_suppkey + l_linenumber) % 40")} AS target_usr,
               {_key("c", "(l_suppkey + l_linenumber) % 40")} AS target_name, CAST(32 AS BIGINT) AS occurrence_roles, 2 AS ordinal,
               {_key("rec", "l_orderkey % 1000")} AS record, {_key("F", "l_orderkey % 97")} AS file, CAST(l_linenumber * 10 AS INT) AS line,
               CAST(l_partkey % 80 + 1 AS INT) AS col, {_key("order", "l_orderkey")} AS name
        FROM lineitem WHERE l_suppkey % 7 <> 0
        UNION ALL
        SELECT {_key("O", "l_orderkey")}, 8192, {_key("C", "l_partkey % 30")}, {_key("c", "l_partkey % 30")}, 32, 1,
               {_key("rec", "l_orderkey % 1000")}, {_key("F", "l_orderkey % 97")}, CAST(l_linenumber * 10 AS INT), CAST(l_partkey % 80 + 1 AS INT),
               {_key("order", "l_orderkey")}
        FROM lineitem WHERE l_suppkey % 3 = 0
        UNION ALL
        SELECT {_key("O", "o_orderkey")}, 32768, {_key("V", "o_custkey % 50")}, {_key("v", "o_custkey % 50")},
               CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 4 END, CAST(o_orderkey % 100 AS INT), 'rec', 'orders.src', CAST(o_orderkey AS INT), 1, {_key("order", "o_orderkey")}
        FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL
        SELECT {_key("O", "o_orderkey")}, 32768, {_key("V", "o_custkey % 70")}, {_key("v", "o_custkey % 70")},
               CASE WHEN o_orderkey % 8 = 0 THEN 2 ELSE 4 END, CAST(o_orderkey % 100 + 1 AS INT), 'rec', 'orders.src', CAST(o_orderkey AS INT), 1, {_key("order", "o_orderkey")}
        FROM orders WHERE o_orderkey % 6 = 0
        UNION ALL
        SELECT {_key("s:B", "c_custkey % 40")}, 1024, {_key("N", "c_nationkey")}, {_key("N", "c_nationkey")}, 4, CAST(c_custkey AS INT),
               'rec', 'customer.src', CAST(c_custkey AS INT), 1, {_key("B", "c_custkey % 33")}
        FROM customer WHERE c_custkey % 2 = 0
        UNION ALL
        SELECT {_key("O", "o_orderkey")}, 512, {_key("E", "o_custkey % 90")}, {_key("e", "o_custkey % 90")}, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 2 END,
               CAST(o_custkey % 10 AS INT), 'rec', 'orders.src', CAST(o_orderkey AS INT), 1, {_key("order", "o_orderkey")}
        FROM orders WHERE o_orderkey % 5 = 2
        UNION ALL
        SELECT {_key("O", "o_orderkey")}, 512, {_key("E", "o_custkey % 60")}, {_key("e", "o_custkey % 60")}, 4, -1, 'rec', 'orders.src',
               CAST(o_orderkey AS INT), 1, {_key("order", "o_orderkey")}
        FROM orders WHERE o_orderkey % 10 = 2
        UNION ALL
        SELECT {_key("N", "c_nationkey")}, 16384, {_key("E", "c_custkey")}, {_key("e", "c_custkey")}, 4, 0, 'rec', 'customer.src', CAST(c_custkey AS INT), 1, {_key("N", "c_nationkey")}
        FROM customer WHERE c_custkey < 70""",
    "reference": f"""
        SELECT c_custkey, 'syntactic:' || CASE WHEN c_custkey % 3 = 0 THEN {_key("Top", "c_custkey % 40")} WHEN c_custkey % 3 = 1 THEN {_key("In", "c_custkey % 60")}
               ELSE {_key("Out3.In", "c_custkey % 9")} END AS ref, {_key("F", "c_custkey % 7")} AS file
        FROM customer""",
    "placeholder_name": f"""
        SELECT 'map' AS kind, {_key("syntactic:Top", "s_suppkey")} AS usr, {_key("s:t", "s_suppkey")} AS real_usr FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'map', {_key("syntactic:Out", "s_suppkey")} || {_key(".In", "s_suppkey % 40")}, {_key("s:i", "s_suppkey")} FROM supplier WHERE s_suppkey < 50
        UNION ALL SELECT 'override', {_key("syntactic:Top", "s_suppkey")}, {_key("s:o", "s_suppkey")} FROM supplier WHERE s_suppkey % 6 = 0""",
    "cursor_answer": f"""
        SELECT CASE WHEN p_partkey % 3 = 1 THEN {_key("s:4Mod", "p_partkey")} ELSE 's:So' || CAST(length(nm) AS STRING) || nm || 'a3oneABvgZ' END AS target_usr, k AS ordinal,
               CASE WHEN p_partkey % 3 = 1 AND k = 1 THEN {_key("s:4Mod", "p_partkey")} || '::SYNTHESIZED::s:x' WHEN k = 1 THEN 'c:@y' ELSE 'c:@E@x' END AS usr,
               CASE WHEN k = 1 THEN 'one' ELSE 'two' END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'source.lang.objc' ELSE 'source.lang.swift' END AS decl_lang,
               '$sSo' || CAST(length(nm) AS STRING) || nm || 'amD' AS container_type_usr, CAST(NULL AS STRING) AS symbol_graph, CAST(NULL AS STRING) AS annotated_xml
        FROM (SELECT p_partkey, 'T' || CAST(p_partkey AS STRING) || 'x' AS nm, 0 AS k FROM part
              UNION ALL SELECT p_partkey, 'T' || CAST(p_partkey AS STRING) || 'x', 1 FROM part WHERE p_partkey % 6 <> 0) answered""",
    "mangled": f"""
        SELECT p_partkey, CASE p_partkey % 9
          WHEN 0 THEN 's:So6CGSizeV' || CAST(length(nm) AS STRING) || nm || '14CoreFoundation7CGFloatVvg'
          WHEN 1 THEN 's:So' || CAST(length(nm) AS STRING) || nm || 'SSvg'
          WHEN 2 THEN 's:15MiniAnchorRepro' || CAST(length(nm) AS STRING) || nm || 'O8rawValueSSvg'
          WHEN 3 THEN 's:4Moya' || CAST(length(nm) AS STRING) || nm || 'C9hashValueSivg'
          WHEN 4 THEN 's:So12NSDictionaryC10FoundationE' || nm || 'cig'
          WHEN 5 THEN 's:12YandexPaySDK' || CAST(length(nm) AS STRING) || nm || 'C8instanceACvgZ'
          WHEN 6 THEN 's:So' || CAST(length(nm) AS STRING) || nm || 'C12shortcutItemSo021UIApplicationShortcutE0CSgvg'
          WHEN 7 THEN 's:So' || CAST(length(nm) + 40 AS STRING) || nm || 'Vvg'
          ELSE 'c:@CM@Mod@@objc(cs)' || nm END AS usr
        FROM (SELECT p_partkey, p_brand AS b, 'T' || CAST(p_partkey AS STRING) || 'x' AS nm FROM part) named""",
}


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fact table over the Parquet files of sf_dir."""
    # The one function whose name differs between the engines.
    sql = re.sub(r"SHA256\((.*?)\) AS", r"sha2(\1, 256) AS", FACTS[name])
    # Tables are named by their files, so that the session keeps no views.
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"FROM {t}\b", sql)}
    for table in found:
        sql = re.sub(rf"FROM {table}\b", f"FROM {{{table}}}", sql)
    return spark.sql(sql, **found)


def ctes(*names: str) -> str:
    """The named facts as DuckDB common table expressions."""
    return ",\n".join(f"{n} AS MATERIALIZED ({FACTS[n]})" for n in names)
