"""Readers of project inputs: source files, symbol graphs, build logs, settings, schemes, packages and manifests."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domgraph import schemas
from domgraph.operators.resolve import first_by

#: Folders that hold no sources of the project.
SKIPPED = (".build", ".swiftpm", ".git", "DerivedData")


def source_files(spark: SparkSession, root: str, suffix: str = "swift") -> DataFrame:
    """File, content and content_hash of the sources under root; files that are no UTF-8 have a null text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    parts = F.split("path", "/")
    inside = ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED]))
    text = F.when(F.expr("is_valid_utf8(CAST(content AS STRING))"), F.col("content").cast("string"))
    return files.where(inside).select(F.col("path").alias("file"), "content", text.alias("text"), F.sha2("content", 256).alias("content_hash"))


def symbol_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols (usr, kind, fragments) and relationships (kind, source, target) of symbol-graph documents."""
    graphs = spark.read.schema(schemas.SYMBOL_GRAPH).option("multiLine", True).option("pathGlobFilter", "*.symbols.json").json(path)
    symbols = graphs.select(F.explode("symbols").alias("s")).select(
        F.col("s.identifier.precise").alias("usr"), F.col("s.kind.identifier").alias("kind"), F.col("s.declarationFragments").alias("fragments")
    )
    return symbols, graphs.select(F.inline("relationships"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line of a text, with numbers that ascend in file order. The file is read in splits, as any text is."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def tokens(line: str) -> list[str]:
    """words of a shell-like line: quotes group, a backslash takes the next character as it is."""
    out: list[str] = []
    word: list[str] | None = None
    quote = ""
    escaped = False
    for c in line:
        if escaped:
            word = [*(word or []), c]
            escaped = False
        elif c == "\\" and quote != "'":
            escaped = True
        elif quote:
            if c == quote:
                quote = ""
            else:
                word = [*(word or []), c]
        elif c in "\"'":
            quote, word = c, word or []
        elif c in " \t":
            if word is not None:
                out.append("".join(word))
            word = None
        else:
            word = [*(word or []), c]
    return out if word is None else [*out, "".join(word)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_tokens(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else tokens(x))


def package_build_log(spark: SparkSession, path: str) -> DataFrame:
    """File and args from the front-end calls of a package's build log; the last call of a file counts.

    A call is a line whose first word ends in swift-frontend and that has -frontend. With -primary-file the files it names
    belong to it; else, with -wmo, all its sources do; another call compiles no file.
    """
    calls = lines(spark, path).where(F.col("line").contains("swift-frontend"))
    calls = calls.select("line_no", split_tokens("line").alias("all")).withColumn("args", F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))))
    command = F.get("all", 0).endswith("swift-frontend") & F.array_contains("args", "-frontend")
    calls = calls.where(command)
    primary = F.transform(
        F.filter(F.arrays_zip(F.col("args").alias("flag"), F.slice("args", 2, F.size("args")).alias("value")), lambda p: p["flag"] == "-primary-file"),
        lambda p: p["value"],
    )
    sources = F.filter("args", lambda a: a.endswith(".swift"))
    files = calls.select("line_no", "args", F.explode(F.when(F.size(primary) > 0, primary).when(F.array_contains("args", "-wmo"), sources)).alias("file"))
    files = files.where("file IS NOT NULL")
    return files.groupBy("file").agg(F.max_by("args", "line_no").alias("args"))


def project_build_log(spark: SparkSession, path: str) -> DataFrame:
    """Args, file_list and ordinal of the compiler calls of a project's build log."""
    calls = lines(spark, path).where(F.col("line").contains("builtin-Swift-Compilation --"))
    calls = calls.select(F.col("line_no").alias("ordinal"), split_tokens(F.substring_index("line", "builtin-Swift-Compilation -- ", -1)).alias("args"))
    lists = F.filter("args", lambda a: a.startswith("@"))
    return calls.withColumn("file_list", F.substring(F.get(lists, 0), 2, 1 << 20))


def response_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_list and file, one a line, trimmed and unescaped; blank lines are dropped and a missing list is an error."""
    read = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file_list"), F.explode(F.split("value", "\n")).alias("line"))
    return read.select("file_list", F.regexp_replace(F.trim("line"), r"\\(.)", "$1").alias("file")).where("file <> ''")


def arguments(calls: DataFrame, listed: DataFrame) -> DataFrame:
    """File and args: of the last call whose list holds the file."""
    return calls.join(listed, "file_list").groupBy("file").agg(F.max_by("args", "ordinal").alias("args"))


def enough_files(args: DataFrame, least: int = 10) -> bool:
    """Whether the log covered a build; fewer files ask for a clean one."""
    return args.limit(least).count() >= least


def build_settings(spark: SparkSession, path: str) -> DataFrame:
    """Key and value of KEY = value lines; the first of a key counts."""
    rows = lines(spark, path)
    pattern = r"^\s*([A-Z][A-Z0-9_]*) = (.*?)\s*$"
    pairs = rows.where(F.col("line").rlike(pattern)).select("line_no", F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))
    return first_by(pairs, ["key"], [F.col("line_no")]).select("key", "value")


def scheme_targets(spark: SparkSession, path: str) -> DataFrame:
    """Blueprint names that an XML scheme refers to, in order."""
    rows = spark.read.format("xml").option("rowTag", "BuildableReference").schema("_BlueprintName string, _BuildableName string").load(path)
    return rows.select(F.col("_BlueprintName").alias("name"), F.col("_BuildableName").alias("product"))


def package(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Products (name, targets) and targets (name, path, sources) of a package description."""
    schema = "products array<struct<name: string, targets: array<string>>>, targets array<struct<name: string, path: string, sources: array<string>>>"
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    return read.select(F.inline("products")), read.select(F.inline("targets"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of the last run; None if there is none that can be read."""
    from pyspark.errors import AnalysisException

    try:
        read = spark.read.schema(schemas.MANIFEST).json(path)
    except AnalysisException:
        return None
    return None if read.where("file IS NULL OR content_hash IS NULL").limit(1).count() else read


def module_names(spark: SparkSession, path: str) -> DataFrame:
    """Modules that module maps declare."""
    pattern = r"^\s*(?:framework\s+)?module\s+([A-Za-z_][A-Za-z0-9_]*)"
    return lines(spark, path).select(F.regexp_extract("line", pattern, 1).alias("module")).where("module <> ''").distinct()


def simulator(spark: SparkSession, path: str) -> str | None:
    """The platform of the first destination that is a simulator."""
    found = lines(spark, path).where(F.col("line").rlike("platform:[^,}]*Simulator"))
    row = found.agg(F.min_by(F.regexp_extract("line", r"platform:\s*([^,}]+)", 1), "line_no").alias("platform")).first()
    return row.platform.strip() if row.platform else None


def demangled(answers: DataFrame) -> DataFrame:
    """Usr and demangled from the lines `in ---> out` of a demangler."""
    return answers.where(F.col("line").contains(" ---> ")).select(
        F.substring_index("line", " ---> ", 1).alias("usr"), F.substring_index("line", " ---> ", -1).alias("demangled")
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def attribute_names(annotated: pd.Series) -> pd.Series:
    """Attribute names in an annotated declaration, in order; null if the XML can't be read."""

    def names(text: str | None) -> list[str] | None:
        try:
            root = ElementTree.fromstring(text) if text else None
        except ElementTree.ParseError:
            return None
        return None if root is None else ["".join(e.itertext()).strip().lstrip("@") for e in _attributes(root)]

    return annotated.map(names)


def _attributes(root: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for element in root.iter():
        if element.tag.endswith(("syntaxtype.attribute.name", "decl.attribute.name")):
            yield element


def byte_offset(text: Column, line: Column, col: Column) -> Column:
    """the byte offset of a 1-based line and UTF-8 column; null beyond the last line."""
    rows = F.split(text, "\n")
    before = F.aggregate(F.slice(rows, F.lit(1), line - 1), F.lit(0), lambda n, row: n + F.octet_length(row) + 1)
    return F.when((line >= 1) & (line <= F.size(rows)), before + col - 1)


#: What a target triple calls each platform.
_SYSTEMS = {"iOS": "ios", "macOS": "macosx", "tvOS": "tvos", "watchOS": "watchos"}


def triple_of(platform: Column, architecture: str, version: str) -> Column:
    """the target triple of a platform by name, null for another."""
    system = F.create_map(*[F.lit(x) for pair in _SYSTEMS.items() for x in pair])[platform]
    return F.concat(F.lit(f"{architecture}-apple-"), system, F.lit(version))


def last_output(text: Column, most: int = 4000) -> Column:
    """The end of a process's output that an error quotes."""
    return F.right(text, F.lit(most))


def platform_of(triple: Column) -> Column:
    """the platform's name in a target triple, its version dropped."""
    return F.regexp_extract(triple, r"^[^-]+-[^-]+-([a-z]+)", 1)
