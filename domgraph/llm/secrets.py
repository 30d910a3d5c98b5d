"""Secret scans with corpus-wide ownership frequency, in DataFrame operations alone.

Base spans are the matches of three patterns. Their places come from cutting the text at the matches: the lengths of pieces and
matches, added up, are the offsets. Runs that must have a least length are matched with it, which finds the same runs;
assignments are matched as they stand and filtered afterwards, since a short value takes its characters with it.

Every candidate value (the values of the base spans, and other long tokens that mix digits with both cases of
letters) is hashed and counted across the corpus: documents, repositories and owners that hold it, each distinct pair combined
before it is shuffled. A value that at most `most_owners` owners and `most_repositories` repositories hold is
owner-specific and looks live; one that more hold is a widely copied example. The other long tokens
become spans of kind `owned` when they are owner-specific and don't overlap a base span, which a join by text and stretch of
256 characters tells.

Defined results: a null or empty text has no spans; a null source or repository counts as one owner of its own; repeated
rows are scanned each and count as one repository; a very long text is one row to the patterns, and its spans are rows of
their own after that; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgraph.llm import scratch

#: The patterns, the group that holds the secret, and the least length of that group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LONG = r"[A-Za-z0-9+/_-]{20,}"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "owned")

_CELL_BITS = 8
_SPAN = "struct<start: bigint, rank: int, end: bigint, value: string>"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _sum(lengths: Column, first: Column, n: Column) -> Column:
    """The sum of n lengths from the first (counted from 1) on."""
    return F.aggregate(F.slice(lengths, first, n), F.lit(0).cast("bigint"), lambda total, x: total + x)


def _matches(text: str, pattern: str, group: int, rank: int) -> Column:
    """An array of (start, rank, end, value) of all matches; value is the group's text.

    A match starts after the pieces and matches before it. Their lengths are added up within blocks of about the square root of
    their number and over the blocks, so that a text of many matches takes their number to the power of 1.5 in steps.
    """
    regex = F.lit(pattern)
    pieces = F.split(text, pattern, -1)
    # The pattern looks at nothing outside its match, so the group can be read from the match alone.
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m

    def placed(found: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(found))).cast("int")
        gaps = F.transform(F.slice(pieces, 1, F.size(found)), lambda p: F.char_length(p).cast("bigint"))
        sizes = F.transform(found, lambda m: F.char_length(m).cast("bigint"))
        both = F.struct(found.alias("found"), width.alias("width"), gaps.alias("gaps"), sizes.alias("sizes"), F.zip_with(gaps, sizes, lambda g, s: g + s).alias("steps"))
        return _let(both, blocked)

    def blocked(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(s["found"]) - 1) / s["width"]).cast("int"))
        sums = F.transform(blocks, lambda j: _sum(s["steps"], j * s["width"] + 1, s["width"]))
        return _let(sums, lambda t: _let(F.transform(blocks, lambda j: _sum(t, F.lit(1), j)), lambda bases: spans(s, bases)))

    def spans(s: Column, bases: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            block = (i / s["width"]).cast("int")
            inside = _sum(s["steps"], block * s["width"] + 1, i - block * s["width"])
            start = F.get(bases, block) + inside + F.get(s["gaps"], i)
            end = start + F.get(s["sizes"], i)
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), value(m).alias("value"))

        return F.transform(s["found"], span)

    every = _let(F.regexp_extract_all(text, regex, F.lit(0)), placed)
    # Few texts have a match; the others need no steps.
    return F.when(F.regexp_like(text, regex), every).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """row (its number), doc_id, owner, repository, base (spans) and long (other long tokens, as spans) of every document."""
    texts = docs.select(
        "doc_id",
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    assign = F.filter(_matches("text", ASSIGN, 2, 0), lambda s: F.char_length(s["value"]) >= ASSIGN_LEAST)
    mixed = lambda s: F.regexp_like(s["value"], F.lit("[0-9]")) & F.regexp_like(s["value"], F.lit("[a-z]")) & F.regexp_like(s["value"], F.lit("[A-Z]"))
    found = texts.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "owner",
        "repository",
        assign.alias("assign"),
        _matches("text", ACCESS, 0, 1).alias("access"),
        _matches("text", HEX, 0, 2).alias("hex"),
        F.filter(_matches("text", LONG, 0, 3), mixed).alias("long"),
    )
    found = found.withColumn("base", F.concat("assign", "access", "hex"))
    sizes = [F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("row", "doc_id", "owner", "repository", *sizes, "base", "long")


def _cells(spans: DataFrame) -> DataFrame:
    """Spans (row, span) once for each stretch of the text that they touch."""
    cells = F.sequence(F.shiftright("span.start", _CELL_BITS), F.shiftright(F.col("span.end") - 1, _CELL_BITS))
    return spans.select("row", "span", F.explode(cells).alias("cell"))


def candidate_spans(found: DataFrame) -> DataFrame:
    """row, owner, repository and span of the base spans, and of the other long tokens that overlap none of them."""
    exploded = lambda rows, name: rows.select("row", "owner", "repository", F.explode(name).alias("span"))
    both = found.where("size(long) > 0")
    near = _cells(exploded(both, "base")).select("row", "cell", F.col("span.start").alias("start"), F.col("span.end").alias("end"))
    hit = _cells(exploded(both, "long")).join(near, ["row", "cell"]).where("start < span.end AND span.start < end")
    hit = hit.select("row", F.col("span.start").alias("at")).distinct()
    long = exploded(both, "long").withColumn("at", F.col("span.start")).join(hit, ["row", "at"], "left_anti").drop("at")
    return exploded(found, "base").unionByName(long)


def ownership(spans: DataFrame) -> DataFrame:
    """hash of each candidate value with n_docs, n_repositories and n_owners that hold it."""
    values = spans.select("row", "owner", "repository", "hash").distinct()
    by_repository = values.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n_docs"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n_docs").alias("n_docs"), F.count("*").alias("n_repositories"))
    return by_owner.groupBy("hash").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_repositories").alias("n_repositories"), F.count("*").alias("n_owners")
    )


def scan(
    docs: DataFrame, *, owner: str = "source", repository: str = "doc_id", most_owners: int = 1, most_repositories: int = 3
) -> DataFrame:
    """Spans of every document, and how many of its candidate values are owner-specific or widely copied.

    doc_id, n_assign, n_access, n_hex, base_sha256, spans (all of them), n_owned, n_live, n_copied.
    """
    found = scratch.table(candidates(docs, owner, repository), "candidates")
    spans = candidate_spans(found).withColumn("hash", F.sha2(F.col("span.value"), 256))
    spans = scratch.table(spans, "candidate-spans")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    # Written before the join, so that it is a plain one of two written tables, which Spark can split.
    counts = scratch.table(ownership(spans).select("hash", live.alias("live")), "ownership")
    judged = spans.join(counts, "hash")
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("span.rank") == 3) & F.col("live"), F.col("span"))).alias("owned"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    none = F.array().cast(f"array<{_SPAN}>")
    joined = found.join(by_row, "row", "left").withColumn("owned", F.coalesce("owned", none))
    return joined.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "owned")).alias("spans"),
        F.size("owned").cast("bigint").alias("n_owned"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
