"""Schemas of the fact tables, as DDL."""

DECLARATION = (
    "usr string, name string, explicit_isolation string, is_actor_type boolean, containing_type_usr string,"
    " is_static_member boolean, superclass_usr string, eligible_default boolean, enclosing_extension_isolation string,"
    " is_nested_type boolean, file string, line int, col int, is_immutable_stored_property boolean,"
    " is_actor_initializer boolean, ord bigint"
)
CONFORMANCE = (
    "usr string, idx int, protocol_usr string, protocol_global_actor_name string, same_file_as_primary boolean, same_context_as_witness boolean"
)
CALL_EDGE = "caller_usr string, callee_usr string, file string, line int, col int"
INDEXED_SYMBOL = "usr string, name string, file string, line int, col int"
OCCURRENCE = "usr string, name string, roles bigint, file string, line int, col int, module string, is_system boolean, record string"
#: A relation belongs to one occurrence, which record, file, line, col and usr tell; name is that of the occurrence's symbol.
RELATION = (
    "usr string, role bigint, target_usr string, target_name string, occurrence_roles bigint, ordinal int, record string, file string, line int, col int,"
    " name string"
)
CLOSURE_LITERAL = (
    "file string, start_line int, start_col int, end_line int, end_col int, signature_attribute string, call_receiver string,"
    " call_member string, ordinal int"
)
AWAITED_RANGE = "file string, start_line int, start_col int, end_line int, end_col int"
MANIFEST = "file string, content_hash string"
SYMBOL_GRAPH = (
    "symbols array<struct<identifier: struct<precise: string>, kind: struct<identifier: string>,"
    " declarationFragments: array<struct<kind: string, spelling: string, preciseIdentifier: string>>>>,"
    " relationships array<struct<kind: string, source: string, target: string>>"
)
CURSOR_ANSWER = (
    "target_usr string, ordinal int, usr string, name string, decl_lang string, container_type_usr string, symbol_graph string, annotated_xml string"
)

#: Role bits of the index.
DEFINITION, CALL = 1 << 1, 1 << 5
CHILD_OF, BASE_OF, CALLED_BY, EXTENDED_BY, ACCESSOR_OF = 1 << 9, 1 << 10, 1 << 13, 1 << 14, 1 << 15
