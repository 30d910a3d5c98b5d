"""Content manifests, what to do about a stale index, balanced chunks of files, and small decisions over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgraph.lineage import numbered


def manifest(files: DataFrame) -> DataFrame:
    """File and the SHA-256 of its content."""
    return files.select("file", F.sha2("content", 256).alias("content_hash"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files that are new, changed or gone."""
    a = old.select("file", F.col("content_hash").alias("_old"))
    b = new.select("file", F.col("content_hash").alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    rows = a.join(b, "file", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return rows.select("file", change.alias("change"))


def freshness(old: DataFrame | None, new: DataFrame) -> tuple[str, list[str]]:
    """fresh, noManifest, or stale with the changed files in order."""
    if old is None:
        return "noManifest", []
    changed = manifest_diff(old, new).select("file").orderBy("file")
    names = [r.file for r in changed.toLocalIterator()]
    return ("stale", names) if names else ("fresh", [])


def action(index_exists: bool, state: str, force: bool, auto: bool) -> str:
    """what a run does about its index."""
    if force:
        return "rebuild"
    if not index_exists or state == "noManifest":
        return "build" if auto else "ask"
    if state == "fresh":
        return "proceed"
    return "rebuild" if auto else "stop"


def balanced_chunks(items: DataFrame, n: int) -> DataFrame:
    """Items (file, ...) with their chunk: whole files in order, about as many files a chunk."""
    files = numbered(items.select("file").distinct(), ["file"], "place")
    size = F.greatest(F.lit(1), F.floor(F.lit(files.count()) / n))
    place = F.col("place")
    chunks = files.select("file", F.least(F.lit(n - 1), F.floor(place / size)).cast("int").alias("chunk"))
    return items.join(chunks, "file")


def closest_name(requested: DataFrame, available: DataFrame) -> DataFrame:
    """requested and the closest available name within max(1, a third of the length), else null; ties go to the smaller."""
    most = F.greatest(F.lit(1), F.floor(F.char_length("requested") / 3)).cast("int")
    # A name within so many edits is at most so much longer or shorter, so names meet by length.
    wanted = requested.select("requested", most.alias("most"), F.char_length("requested").alias("n")).distinct()
    lengths = wanted.withColumn("length", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - F.col("most")), F.col("n") + F.col("most"))))
    names = available.select("name", F.char_length("name").alias("length")).distinct()
    near = lengths.join(names, "length").withColumn("distance", F.levenshtein("requested", "name")).where("distance <= most")
    best = near.groupBy("requested").agg(F.min(F.struct("distance", "name")).alias("best"))
    return wanted.select("requested").join(best, "requested", "left").select("requested", F.col("best.name").alias("suggestion"))


def statistics_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """A10: kind and after less before, missing counting zero."""
    a = before.select("kind", F.col("n").alias("_a"))
    b = after.select("kind", F.col("n").alias("_b"))
    return a.join(b, "kind", "full_outer").select("kind", (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("delta"))


def schemes(products: DataFrame, targets: DataFrame) -> DataFrame:
    """Products and the targets that are no product, with their source folders; unknown target names are dropped.

    products: name, targets (array). targets: name, path.
    """
    listed = products.select("name", F.explode("targets").alias("target")).join(targets.select(F.col("name").alias("target"), "path"), "target")
    alone = targets.join(products.select("name"), "name", "left_anti").select(F.col("name").alias("target"), "name", "path")
    return listed.select("target", "name", "path").unionByName(alone).select("name", "target", "path")


def preferred_arguments(candidates: DataFrame) -> DataFrame:
    """For each file the only candidate whose target is a component of its path, else the first.

    candidates: file, target, ordinal, args.
    """
    inside = F.array_contains(F.split("file", "/"), F.col("target"))
    best = candidates.groupBy("file").agg(
        F.count_if(inside).alias("n"),
        F.min_by("args", F.when(inside, F.col("ordinal"))).alias("named"),
        F.min_by("args", "ordinal").alias("first"),
    )
    return best.select("file", F.when(F.col("n") == 1, F.col("named")).otherwise(F.col("first")).alias("args"))


def first_arguments(args: DataFrame, flag: str) -> DataFrame:
    """The value after the flag in the first file that has arguments, null if it lacks the flag."""
    first = args.agg(F.min_by("args", "ord").alias("args"))
    at = F.array_position("args", flag)
    return first.select(F.when(at > 0, F.try_element_at("args", (at + 1).cast("int"))).alias("value"))


def sanitized(args: str) -> Column:
    """Arguments without front-end flags and their values."""
    state = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, arg: Column) -> Column:
        flag = arg.isin(*FRONTEND_FLAGS, *FRONTEND_OPTIONS)
        keep = ~acc["skip"] & ~flag
        return F.struct(
            (~acc["skip"] & arg.isin(*FRONTEND_OPTIONS)).alias("skip"),
            F.when(keep, F.concat(acc["kept"], F.array(arg))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(args, state, step, lambda acc: acc["kept"])


#: Front-end flags without and with a value.
FRONTEND_FLAGS = (
    "-frontend",
    "-incremental",
    "-primary-file",
    "-enable-objc-interop",
    "-empty-abi-descriptor",
    "-enable-anonymous-context-mangled-names",
    "-disable-clang-spi",
    "-index-system-modules",
    "-fretain-comments-from-system-headers",
)
FRONTEND_OPTIONS = (
    "-emit-dependencies-path",
    "-emit-reference-dependencies-path",
    "-new-driver-path",
    "-target-sdk-version",
    "-target-sdk-name",
    "-serialize-diagnostics-path",
    "-working-directory",
)


def default_eligible(kind: Column, in_actor: Column, direct_conformances: Column) -> Column:
    """Whether a declaration takes the module's default."""
    bound = F.exists(direct_conformances, lambda c: c.isin("Sendable", "SendableMetatype"))
    return ~(kind.isin("typealias", "enum_case", "accessor") | in_actor | bound)


def compiler_version(text: str) -> Column:
    """the version in a compiler's banner, null without one."""
    found = F.regexp_extract(text, r"Swift version (\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found)


def sanitized_name(text: str) -> Column:
    """letters and digits, everything else an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def path_identity(path: str) -> Column:
    """F32: the first eight digits of the path's hash."""
    return F.left(F.sha2(path, 256), F.lit(8))


def unescaped(text: str) -> Column:
    """backslash escapes replaced by what they escape."""
    return F.regexp_replace(text, r"\\(.)", "$1")
