"""Source files -> fact tables (S3, X1-X13, P11, F37, W6): one pass over the files, one written table, a view of it for each relation."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domgraph import lineage, schemas
from domgraph.sources import syntax

_PLACE = "file string, start_line int, start_col int, end_line int, end_col int"
#: Schemas of the extracted relations; `ord` tells the order of files and, in a file, of declarations.
RELATIONS = {
    "declaration": schemas.DECLARATION,
    "conformance": "usr string, ord bigint, idx int, protocol_usr string, protocol_global_actor_name string, same_file_as_primary boolean,"
    " same_context_as_witness boolean",
    "protocol_actor": "protocol string, actor string, file string",
    "protocol_requirement_actor": "protocol string, requirement string, actor string, file string",
    "protocol_parent": "protocol string, parent string",
    "global_actor_name": "name string",
    "closure_literal": f"{_PLACE}, signature_attribute string, call_receiver string, call_member string, ordinal int",
    "awaited_range": _PLACE,
}
#: Declarations to a file in `ord`.
_ORD_BITS = 32


@dataclass
class Facts:
    """The relations of a project's sources."""

    declaration: DataFrame
    conformance: DataFrame
    protocol_actor: DataFrame
    protocol_requirement_actor: DataFrame
    protocol_parent: DataFrame
    global_actor_name: DataFrame
    closure_literal: DataFrame
    awaited_range: DataFrame


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _rows(platform: str | None):
    names = {k: _columns(v) for k, v in RELATIONS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth, file, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                base = nth.as_py() << _ORD_BITS
                kinds, rows = [], []
                for kind, found in syntax.File(text.as_py(), file.as_py(), platform).rows.items():
                    for row in found:
                        row = dict(zip(names[kind], row, strict=True))
                        if "ord" in row:
                            row["ord"] += base
                        kinds.append(kind)
                        rows.append(json.dumps(row))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(rows, pa.string())], ["relation", "row"])

    return run


def facts(files: DataFrame, platform: str | None = None) -> Facts:
    """The facts of files (file, text); files without a text (that are no UTF-8) give none.

    platform (iOS, macOS, tvOS or watchOS): only the clauses of conditional compilation that hold for it count.
    """
    read = files.where("text IS NOT NULL").select("file", "text")
    numbered = lineage.numbered(read, ["file"], "nth").select("nth", "file", "text")
    every = lineage.cut(numbered.mapInArrow(_rows(platform), "relation string, row string"))
    found = {k: every.where(F.col("relation") == k).select(F.from_json("row", v).alias("r")).select("r.*") for k, v in RELATIONS.items()}
    return Facts(**(found | {"global_actor_name": found["global_actor_name"].distinct()}))
