"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the size of everything; a target stops
at `most_passes` times its source's size and the excess is shared again by weight until none is above.

Blocks. Each source's documents, in an order shuffled by a hash of doc_id and text, are laid end to end and cut into blocks of equal
numbers of words, about `block_words` each and at least `least_blocks` where the source has as many words.

Schedule. Slots are the points of the binary van der Corput sequence. A source owns an interval of the
cumulative weights as long as its number of slots, so that slot i goes to the source that owns the bit-reversed i; its slots, ranked
in the sequence's order, take its blocks one after another, round after round, and the last takes only what the target
still lacks. Ranks come in two steps (counts of the slots of a stretch, then ranks within it), and so do the documents' places
within a source (sums of a range of hashes, then sums within it). Stretches and ranges number about the square root of what
they divide, so no task holds a whole source.

Defined results: a null or empty text has size 0 and is never taken; sources of size 0 have target 0; a null doc_id is
placed like any other, by its text; repeated rows are placed one after another; a very long text is counted and hashed by the
JVM; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domgraph.llm import scratch


@dataclass(frozen=True)
class Settings:
    """Parameters of the mix."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most_passes: int = 3
    block_words: int = 512
    least_blocks: int = 64
    seed: str = "mix"


def words(text: str) -> Column:
    """The number of maximal runs of characters other than space and bytes 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _null_last(name: str) -> list[Column]:
    return [F.col(name).isNull().asc(), F.col(name).asc()]


def targets(sizes: DataFrame, settings: Settings) -> DataFrame:
    """source, source_size, target from sizes (source, source_size): one row a source."""
    order = Window.orderBy(*_null_last("source"))
    cycle = F.array(*[F.lit(w) for w in settings.weights])
    weighed = sizes.select(
        "source",
        "source_size",
        F.get(cycle, (F.row_number().over(order) - 1) % len(settings.weights)).alias("weight"),
        (F.col("source_size") * settings.most_passes).cast("double").alias("most"),
    )
    weighed = scratch.table(weighed, "weights")
    # Sources at their most leave the sharing; the rate only grows, so each round adds to them until none is above.
    rate, at_most = -1.0, -1
    while True:
        free = F.col("most") > rate * F.col("weight")
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(~free, F.col("most")).otherwise(0.0)).alias("full"),
            F.sum(F.when(free, F.col("weight")).otherwise(0.0)).alias("shared"),
            F.count_if(~free).alias("at_most"),
        ).first()
        if row.at_most == at_most or not row.shared:
            break
        at_most, rate = row.at_most, ((row["all"] or 0) - row.full) / row.shared
    return weighed.select("source", "source_size", F.round(F.least(F.col("most"), F.lit(rate) * F.col("weight")), 6).alias("target"))


def _places(sized: DataFrame, settings: Settings, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source (`at`), and the totals of each source's ranges of hashes."""
    digits = 0
    while 16 ** (2 * digits) < n_rows:
        digits += 1
    keyed = sized.withColumn("range", F.left("key", F.lit(digits)))
    totals = keyed.groupBy("source", "range").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    totals = totals.select(
        "source",
        "range",
        F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"),
        F.sum("total").over(whole).alias("source_size"),
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("nth", F.row_number().over(within)).withColumn("inside", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    return placed, totals


def schedule(plan: DataFrame, settings: Settings) -> DataFrame:
    """source, block, slot, take: every slot with the block that it takes and how many of the block's words.

    plan: source, source_size, target, n_blocks, n_slots, lo (the start of its interval).
    """
    spark = plan.sparkSession
    slots = plan.agg(F.sum("n_slots")).first()[0] or 0
    bits = max(1, (max(slots, 2) - 1).bit_length())
    cell = bits // 2
    intervals = plan.where("n_slots > 0").withColumn(
        "cell", F.explode(F.sequence(F.shiftright("lo", cell), F.shiftright(F.col("lo") + F.col("n_slots") - 1, cell)))
    )
    points = spark.range(slots).withColumn("cell", F.shiftright("id", cell))
    # The sequence's index of a point is the point with its bits reversed.
    index = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("bigint")
    owned = (
        points.join(intervals, "cell")
        .where((F.col("id") >= F.col("lo")) & (F.col("id") < F.col("lo") + F.col("n_slots")))
        .select("source", "source_size", "target", "n_blocks", "n_slots", index.alias("slot"))
        .withColumn("stretch", F.shiftright("slot", cell))
    )
    counts = owned.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("source").alias("source_b"), F.col("stretch").alias("stretch_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    ranked = owned.withColumn("inside", inside)
    same = ranked["source"].eqNullSafe(bases["source_b"]) & (ranked["stretch"] == bases["stretch_b"])
    ranked = ranked.join(bases, same).withColumn("rank", F.col("base") + F.col("inside"))
    block = F.col("rank") % F.col("n_blocks")
    start, stop = _edge(block), _edge(block + 1)
    done = F.floor(F.col("rank") / F.col("n_blocks")) * F.col("source_size") + start
    take = F.least(stop - start, F.round("target").cast("bigint") - done)
    return ranked.select("source", block.alias("block"), "slot", take.alias("take")).where("take > 0")


def _edge(block: Column) -> Column:
    """The first word of a block of the source; the hair keeps blocks of one word apart."""
    return F.floor(block.cast("double") / F.col("n_blocks") * F.col("source_size") + 1e-6).cast("bigint")


def mix(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every document."""
    settings = settings or Settings()
    # The text's hash keeps rows that share a doc_id, or have none, from meeting in one range of hashes.
    key = F.md5(F.concat(F.lit(settings.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    sized = scratch.table(
        docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), words("text").alias("size"), key.alias("key")), "sizes"
    )
    goals = scratch.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), settings), "targets")
    size = F.col("source_size")
    n_blocks = F.greatest(F.round(size / settings.block_words), F.least(size, F.lit(settings.least_blocks))).cast("bigint")
    plan = goals.withColumn("n_blocks", n_blocks)
    n_slots = F.ceil(F.try_divide(F.round("target") * F.col("n_blocks"), size))
    plan = plan.withColumn("n_slots", F.when(size > 0, F.least(n_slots, F.col("n_blocks") * settings.most_passes)).otherwise(0).cast("bigint"))
    before = Window.orderBy(*_null_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    plan = scratch.table(plan.withColumn("lo", F.coalesce(F.sum("n_slots").over(before), F.lit(0))), "plan")
    # What each block gives in all: whole rounds, and in one block of a source a part of a round.
    drawn = schedule(plan, settings).groupBy("source", "block").agg(F.sum("take").alias("drawn"))
    drawn = drawn.select(F.col("source").alias("source_d"), "block", "drawn")

    placed, ranges = _places(sized, settings, sized.count())
    facts = ranges.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    facts = facts.select(
        F.col("r.source").alias("source_r"), F.col("range").alias("range_r"), "base", "r.source_size", "target", "n_blocks"
    )
    rows = placed.join(facts, placed["source"].eqNullSafe(facts["source_r"]) & (placed["range"] == facts["range_r"]))
    rows = rows.select(
        "source", "range", "nth", "doc_id", "size", "source_size", "target", "n_blocks", (F.col("base") + F.col("inside")).alias("at")
    )
    block_of = lambda word: F.floor(F.try_divide(word.cast("double"), size) * F.col("n_blocks"))
    pieces = rows.withColumn(
        "block",
        F.explode_outer(
            F.when(
                F.col("size") > 0,
                F.sequence(
                    F.greatest(block_of(F.col("at")) - 1, F.lit(0)),
                    F.least(block_of(F.col("at") + F.col("size") - 1) + 1, F.col("n_blocks") - 1),
                ),
            )
        ),
    )
    start, stop = _edge(F.col("block")), _edge(F.col("block") + 1)
    pieces = pieces.withColumn("start", start).withColumn("length", stop - start)
    pieces = pieces.withColumn("from", F.greatest("at", "start")).withColumn("to", F.least(F.col("at") + F.col("size"), F.col("start") + F.col("length")))
    pieces = pieces.where("block IS NULL OR from < to")
    joined = pieces.join(drawn, pieces["source"].eqNullSafe(drawn["source_d"]) & (pieces["block"] == drawn["block"]), "left")
    # `drawn` is a number of whole rounds of the block and a beginning of it.
    rounds = F.floor(F.coalesce("drawn", F.lit(0)) / F.col("length"))
    rest = F.coalesce("drawn", F.lit(0)) - rounds * F.col("length")
    part = F.greatest(F.lit(0), F.least(F.col("to"), F.col("start") + rest) - F.col("from"))
    took = F.when(F.col("size") > 0, rounds * (F.col("to") - F.col("from")) + part).otherwise(0).cast("bigint")
    return (
        joined.withColumn("took", took)
        .groupBy("source", "range", "nth", "doc_id", "size", "source_size", "target")
        .agg(F.sum("took").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def repeat_by_mix(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """All columns of the documents, each as often as the mix takes it, to the nearest whole number.

    Rows without doc_id take part like others; rows that share a doc_id share the words taken of all of them.
    """
    rows = mix(docs, settings).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = rows.where("size > 0").select("doc_id", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    # The document is one column here, so none of its own can have the name of another.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    joined = whole.join(times, whole["doc.doc_id"].eqNullSafe(times["doc_id"]))
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("doc.*")
