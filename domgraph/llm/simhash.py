"""SimHash near-duplicates: fingerprints, a binary-trie self-join under a Hamming budget, and components.

Fingerprints are computed once and written to the shared scratch folder; everything after that handles distinct
fingerprints only, so thousands of copies cost one row.

Self-join. Two fingerprints within `budget` bits agree entirely in at least one of budget + 1 blocks of bits. Each
fingerprint therefore enters budget + 1 tries, rotated so that the block comes first; the block is the trie's root and
its fingerprints meet in one partition. A root with more than `most_in_root` fingerprints is split again by its next bits:
a fingerprint is at home in its own part and visits the parts within the budget, so no part needs them all. In a
partition tries are traversed together, some whole roots at a time, level by level: pairs of nodes descend to pairs of children, differing
bits accumulate, and a pair is dropped once its bits exceed the budget. Fingerprints of several kinds (the slices of `similar_links`) have
tries of their own: the kind is their top bits, which must agree.

Components. Each such piece reports a spanning forest of the links it found (union-find over its own
links), then the forests' edges are contracted: nodes hook to their smallest neighbours, hooks are followed to their roots, and only
edges between different roots go on to the next round, so all rounds together join a small multiple of the edges; every round is
written to the scratch folder, so a lost executor repeats one round at most.

Defined results: a text without words (null, empty, white space) has fingerprint zero and links like any other; a null
doc_id counts as larger than all others; repeated rows give repeated result rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from domgraph.llm import hashing, scratch

BITS = 64
#: Fixed value: the seed of the shingles' hashes.
SEED = 42
_SHINGLES_AT_ONCE = 1 << 17
_ROWS_AT_ONCE = 1 << 14
#: Bits of a slice's fingerprint; the slice's number stands above them.
_SLICE_BITS = 40
_SHINGLES_IN_ORDERS = 256
_CACHED_BYTES = 8 << 20


def _shingle_bounds(text: str | None, words_in_shingle: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's words (A-Z in lower case) joined by spaces, and where each shingle starts and ends in it."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    starts, ends = hashing.runs(~hashing.SPACE[data])
    if not len(starts):
        return b"", starts, ends
    # Each word with the one character of white space that follows it.
    kept = ~hashing.SPACE[data]
    kept[ends[:-1]] = True
    joined = data[kept]
    stops = np.cumsum(ends - starts + 1)
    joined[stops[:-1] - 1] = 32
    n = min(words_in_shingle, len(starts))
    return joined.tobytes(), np.concatenate(([0], stops[:-1]))[: len(starts) - n + 1], stops[n - 1 :] - 1


def _hashed(joined: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    pairs = zip(starts.tolist(), stops.tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(starts))


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The unsigned SimHash of a whole text."""
    joined, starts, stops = _shingle_bounds(text, words_in_shingle)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), _SHINGLES_AT_ONCE):
        hashes = _hashed(joined, starts[k : k + _SHINGLES_AT_ONCE], stops[k : k + _SHINGLES_AT_ONCE])
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts)).view(np.uint64)[0])


def _fingerprints(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words_in_shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _fingerprints(words_in_shingle), "doc_id bigint, fp bigint"
    )


def _blocks(budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """First bit from the top and width of each block."""
    cuts = np.linspace(0, bits, budget + 2).astype(int).tolist()
    return list(zip(cuts[:-1], np.diff(cuts).tolist(), strict=True))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_links(groups: np.ndarray, values: np.ndarray, home: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of all pairs of one group within the budget, one of them at home, by joint traversal.

    Rows are sorted by (group, value); the values of a group agree in their top `depth` bits unless some are visitors.
    """
    n = len(values)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.zeros(0, int)
    stops = np.append(starts[1:], n)
    many = stops - starts > 1
    pairs = np.stack([starts, stops, starts, stops, np.zeros_like(starts)])[:, many]
    found: list[np.ndarray] = []
    for bit in range(depth, BITS + 1):
        la, ra, lb, rb, wrong = pairs
        sizes = (ra - la) * (rb - lb)
        leaf = (sizes <= 16) | (bit == BITS)
        # Few enough: compare the fingerprints themselves.
        a0, b0, w, n_pairs = la[leaf], lb[leaf], (rb - lb)[leaf], sizes[leaf]
        k = np.arange(n_pairs.sum()) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs)
        a = np.repeat(a0, n_pairs) + k // np.repeat(w, n_pairs)
        b = np.repeat(b0, n_pairs) + k % np.repeat(w, n_pairs)
        ok = (a < b) & (home[a] | home[b])
        a, b = a[ok], b[ok]
        near = _popcount(values[a] ^ values[b]) <= budget
        found.append(np.stack([a[near], b[near]]))
        if bit == BITS or leaf.all():
            break
        la, ra, lb, rb, wrong = pairs[:, ~leaf]
        ma, mb = _halves(values, la, ra, bit), _halves(values, lb, rb, bit)
        same = (la == lb) & (ra == rb)
        other = ~same
        pairs = np.concatenate(
            [
                np.stack([la, ma, lb, mb, wrong]),
                np.stack([ma, ra, mb, rb, wrong]),
                np.stack([la, ma, mb, rb, wrong + 1]),
                np.stack([ma, ra, lb, mb, wrong + 1])[:, other],
            ],
            axis=1,
        )
        alive = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= budget)
        alone = (pairs[0] == pairs[2]) & (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        pairs = pairs[:, alive & ~alone]
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
    return both[0], both[1]


def _halves(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where bit (from the top) turns to one in each sorted range; values of a range agree above it."""
    lo, hi = lo.copy(), hi.copy()
    shift, one = np.uint64(BITS - 1 - bit), np.uint64(1)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        is_one = np.zeros(len(lo), bool)
        is_one[open_] = (values[mid[open_]] >> shift) & one == one
        hi = np.where(open_ & is_one, mid, hi)
        lo = np.where(open_ & ~is_one, mid + 1, lo)
    return lo


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (a, b) with the smallest node that it reaches."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if (label == before).all():
            break
    return nodes, nodes[label]


def _forest_of(budget: int, kind_bits: int, trie: np.ndarray, root: np.ndarray, part: np.ndarray, visits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """The spanning forest of the links within whole groups of rows."""
    fps = fp.view(np.uint64)
    ends, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bits = BITS - kind_bits
    low = np.uint64((1 << bits) - 1)
    for k, (first, width) in enumerate(_blocks(budget, bits)):
        own = trie == k
        if not own.any():
            continue
        value = np.uint64(0) + fps[own]
        if first:
            rotated = ((value << np.uint64(first)) | ((value & low) >> np.uint64(bits - first))) & low
            value = (value & ~low) | rotated
        r, p, v = root[own], part[own], visits[own]
        order = np.lexsort((value, p, r))
        value, r, p, v = value[order], r[order], p[order], v[order]
        if len(value) > 1:
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])))
            a, b = trie_links(np.cumsum(new), value, ~v, kind_bits + width, budget)
            original = fp[own][order]
            ends.append(original[a])
            links.append(original[b])
    # Unsigned order does not matter here: any root serves.
    nodes, roots = forest(np.concatenate(ends), np.concatenate(links))
    apart = nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], ["a", "b"])


def _join_groups(budget: int, kind_bits: int):
    """Forests of rows that come sorted by (root, trie, part), about _ROWS_AT_ONCE rows of whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, most = 0, _ROWS_AT_ONCE
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
            n += batch.num_rows
            if n < most:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in rows[:3]]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield _forest_of(budget, kind_bits, *(x[:cut] for x in rows))
            held, n = [[x[cut:] for x in rows]], n - cut
            most = max(_ROWS_AT_ONCE, 2 * n)
        if n:
            yield _forest_of(budget, kind_bits, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(fps: DataFrame, budget: int = 2, most_in_root: int = 4096, kind_bits: int = 0) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` whose components are those of all pairs within the budget.

    Fingerprints that differ in their top `kind_bits` bits are of different kinds and never linked.
    """
    tries = None
    bits = BITS - kind_bits
    low = F.shiftleft("fp", kind_bits)
    kind = F.shiftrightunsigned("fp", bits) if kind_bits else F.lit(0).cast("bigint")
    for k, (first, width) in enumerate(_blocks(budget, bits)):
        root = F.shiftleft(kind, width).bitwiseOR(F.shiftrightunsigned(F.shiftleft(low, first), BITS - width))
        used = (first + width) % bits
        rest = F.shiftleft(low, used).bitwiseOR(F.shiftrightunsigned(low, bits - used)) if used else low
        one = fps.select("fp", F.lit(k).alias("trie"), root.alias("root"), rest.alias("rest"))
        tries = one if tries is None else tries.unionByName(one)
    large = (
        tries.groupBy("trie", "root")
        .count()
        .where(F.col("count") > most_in_root)
        .select("trie", "root", F.least(F.ceil(F.log2(F.col("count") / most_in_root)) + 2, F.lit(20)).cast("int").alias("more"))
    )
    # At most (budget + 1) / most_in_root of the fingerprints are such roots; written, so that Spark knows their size and joins
    # them as it allows.
    large = scratch.table(large, "large-roots")
    joined = tries.join(large, ["trie", "root"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
    joined = joined.withColumn("part", F.expr(f"CASE WHEN more > 0 THEN shiftrightunsigned(rest, {BITS} - more) ELSE 0L END"))
    masks = F.expr(
        "CASE WHEN more = 0 THEN array(0L) ELSE concat(array(0L),"
        " transform(sequence(0, more - 1), i -> shiftleft(1L, i)),"
        " flatten(transform(sequence(0, more - 1), i -> transform(sequence(0, i),"
        " j -> IF(i = j, 0L, shiftleft(1L, i) | shiftleft(1L, j)))))) END"
    )
    if budget != 2:
        raise ValueError("parts of large roots are laid out for a budget of 2")
    parts = (
        joined.withColumn("mask", F.explode(F.array_distinct(masks)))
        .select("trie", "root", F.expr("part ^ mask").alias("part"), (F.col("mask") != 0).alias("visits"), "fp")
    )
    dealt = parts.repartition("trie", "root", "part").sortWithinPartitions("root", "trie", "part")
    return dealt.mapInArrow(_join_groups(budget, kind_bits), "a bigint, b bigint")


def _rooted(hooks: DataFrame) -> DataFrame:
    """fp and root of hooks (fp, root: a smaller node), with each hook followed to the node that has none; two steps a round."""
    hooks = scratch.table(hooks.select("fp", "root", F.lit(True).alias("more")), "hooks")
    while True:
        once, twice = hooks.select(F.col("fp").alias("root"), F.col("root").alias("up")), hooks.select(F.col("fp").alias("up"), F.col("root").alias("top"))
        moved = hooks.where("more").join(once, "root", "left").join(twice, "up", "left")
        moved = moved.select("fp", F.coalesce("top", "up", "root").alias("root"), F.col("top").isNotNull().alias("more"))
        after = scratch.table(moved.unionByName(hooks.where("NOT more")), "hooks")
        more = after.where("more").limit(1).count()
        scratch.drop(hooks)
        hooks = after
        if not more:
            return hooks


def smallest_reachable(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """fp and component, the least label among the nodes that each linked fp reaches.

    nodes: fp, least (its label, as its smallest doc_id); without it a node's label is itself. Only linked fingerprints are returned.

    The graph is contracted: each node hooks to its smallest neighbour if that is smaller than itself, hooks are followed to their
    roots, and the edges go on between the roots, those within one root dropped. Two rounds leave half of the nodes at most, so all
    rounds together join a small multiple of the edges, however large a component is.
    """
    rest = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = scratch.table(rest, "edges")
    rounds: list[DataFrame] = []
    while True:
        # An edge's larger end has a smaller neighbour, so it has a hook.
        hooks = _rooted(rest.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("root")))
        rounds.append(hooks)
        high, low = (hooks.select(F.col("fp").alias(end), F.col("root").alias(name)) for end, name in (("b", "high"), ("a", "low")))
        ends = rest.join(high, "b").join(low, "a", "left").select(F.coalesce("low", "a").alias("a"), F.col("high").alias("b"))
        after = scratch.table(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        scratch.drop(rest)
        rest = after
        if not rest.limit(1).count():
            break
    scratch.drop(rest)
    # A round's nodes are roots of the rounds before it, so those follow its hooks.
    rooted = rounds[-1].select("fp", "root")
    for hooks in reversed(rounds[:-1]):
        later = rooted.select(F.col("fp").alias("root"), F.col("root").alias("last"))
        earlier = hooks.select("fp", "root").join(later, "root", "left").select("fp", F.coalesce("last", "root").alias("root"))
        rooted = scratch.table(earlier.unionByName(rooted), "roots")
    rooted = rooted.unionByName(rooted.select(F.col("root").alias("fp"), "root").distinct())
    if nodes is None:
        return scratch.table(rooted.withColumnRenamed("root", "component"), "labels")
    rooted = scratch.table(rooted.join(nodes, "fp"), "roots")
    # Written before the join, so that it is a plain one of two shuffled tables, which Spark can split where a component is large.
    least = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")
    return scratch.table(rooted.join(least, "root").select("fp", "component"), "labels")


def components(fps: DataFrame, budget: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row of fps (doc_id, fp)."""
    last = F.lit(2**63 - 1)
    nodes = scratch.table(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", last)).alias("least")), "nodes")
    labels = smallest_reachable(nodes, links(nodes.select("fp"), budget))
    final = nodes.join(labels, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    # Written before the join, so that it is a plain one of two shuffled tables, which Spark can split.
    final = scratch.table(final, "final")
    return fps.join(final, "fp").select("doc_id", "fp", F.nullif("component_id", last).alias("component_id"))


def near_duplicates(docs: DataFrame, *, words_in_shingle: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every document."""
    fps = scratch.table(fingerprints(docs, words_in_shingle), "fingerprints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return components(fps, budget).select("doc_id", hexed.alias("fingerprint"), "component_id")


def _shingles(text: str | None, words_in_shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    joined, starts, stops = _shingle_bounds(text, words_in_shingle)
    return np.unique(_hashed(joined, starts, stops))


#: Odd multipliers, each of which puts a text's shingles in another order (of 32 bits, which processors multiply several at a time).
_ORDERS = (np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SPREAD = np.uint32(0x846CA68B)
_BY_ORDER = np.arange(len(_ORDERS), dtype=np.uint64) << np.uint64(32)


def slice_fingerprints(hashes: np.ndarray, slices: int, shingles: int) -> np.ndarray:
    """The fingerprints of a text's distinct shingle hashes, each below its number: the SimHash of all, then those of the slices.

    A slice is `shingles` shingles, each the first in an order of its own, and each votes alone on its share of the bits. A bit thus
    differs between two texts of similarity s with probability (1 - s) / 2, whatever their length, less than where many vote.
    """
    bits = np.uint64((1 << _SLICE_BITS) - 1)
    ones = np.zeros(BITS, np.int64)
    orders = _ORDERS[: slices * shingles, None]
    first = np.full(slices * shingles, 2**32 - 1, np.uint32)
    for k in range(0, len(hashes), _SHINGLES_IN_ORDERS):
        some = hashes[k : k + _SHINGLES_IN_ORDERS]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        order = (some ^ some >> np.uint64(32)).astype(np.uint32) * orders
        order ^= order >> np.uint32(15)
        order *= _SPREAD
        np.minimum(first, order.min(axis=1), out=first)
    whole = np.packbits(ones * 2 > len(hashes)).view(np.uint64) & bits
    share = _SLICE_BITS // shingles
    votes = (hashing.mix(first.astype(np.uint64) + _BY_ORDER[: len(first)]) >> np.uint64(BITS - share)).reshape(slices, shingles)
    sliced = np.bitwise_or.reduce(votes << (np.arange(shingles, dtype=np.uint64) * np.uint64(share)), axis=1)
    number = np.arange(slices + 1, dtype=np.uint64) << np.uint64(_SLICE_BITS)
    return (number | np.concatenate([whole, sliced])).view(np.int64)


def _slices(words_in_shingle: int, slices: int, shingles: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, ends = [], [np.zeros(0, np.int64)], [0]
            for text in batch.column(1):
                hashes = _shingles(text.as_py(), words_in_shingle)
                sizes.append(len(hashes))
                # A text without shingles is like no other, so it meets none.
                if len(hashes):
                    found.append(slice_fingerprints(hashes, slices, shingles))
                ends.append(ends[-1] + (slices + 1 if len(hashes) else 0))
            fps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), fps], ["node", "shingles", "fps"])

    return run


def _similar(words_in_shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            keep = []
            for a, b, *texts in zip(*batch.columns, strict=True):
                sets = []
                for node, text in zip((a.as_py(), b.as_py()), texts, strict=True):
                    if node not in known:
                        if held > _CACHED_BYTES:
                            known, held = {}, 0
                        known[node] = _shingles(text.as_py(), words_in_shingle)
                        held += known[node].nbytes
                    sets.append(known[node])
                x, y = sets
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * max(1, len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _hashes(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingles(x.as_py(), words_in_shingle).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    return run


def links_between(
    sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, similarity: float, fps: np.ndarray | None = None, budget: int = 0
) -> list[tuple[int, int]]:
    """Links (positions) that join what the pairs of at least the similarity join, beyond the components known already.

    Pairs are those of different sides, or all if there is one side, and those within the budget if there are fingerprints. Each set is
    held against all others that verified links have not joined to it; the sets of the commonest shingles come first, as they join most.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holder = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(shingle, kind="stable")
    holders, ends = holder[order], np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    label = np.unique(component, return_inverse=True)[1]
    halves = side.min() != side.max()
    held_with = np.diff(ends)
    is_own = np.zeros(len(held_with), bool)
    common = np.add.reduceat(held_with[shingle], starts[:-1]) / sizes
    waiting = np.ones(len(sets), bool)
    found: list[tuple[int, int]] = []
    for k in np.argsort(-common, kind="stable").tolist():
        waiting[k] = False
        others = waiting & (label != label[k])
        if halves:
            others &= side != side[k]
        if fps is not None:
            others &= np.bitwise_count(fps ^ fps[k]) <= budget
        near = np.flatnonzero(others)
        if not len(near):
            continue
        own = shingle[starts[k] : starts[k + 1]]
        if sizes[near].sum() < held_with[own].sum():
            is_own[own] = True
            at = np.cumsum(sizes[near]) - sizes[near]
            met = np.add.reduceat(is_own[np.concatenate([shingle[starts[x] : starts[x + 1]] for x in near.tolist()])], at, dtype=np.int64)
            is_own[own] = False
        else:
            met = np.bincount(np.concatenate([holders[ends[x] : ends[x + 1]] for x in own.tolist()]), minlength=len(sets))[near]
        alike = near[met >= similarity * (sizes[near] + sizes[k] - met)]
        for other in alike.tolist():
            if label[other] != label[k]:
                found.append((k, other))
                label[label == label[other]] = label[k]
        if (label == label[0]).all():
            break
    return found


def _links_in_block(similarity: float, budget: int):
    def run(block: pa.Table) -> pa.Table:
        node, component, side, fps = (block.column(c).to_numpy() for c in ("node", "component", "side", "fp"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in block.column("hashes")]
        found = np.array(links_between(sets, component, side, similarity, fps.view(np.uint64), budget), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[found].min(axis=1), pa.int64()), "b": pa.array(node[found].max(axis=1), pa.int64())})

    return run


def similar_links(
    texts: DataFrame, *, words_in_shingle: int, similarity: float, slices: int, shingles: int, budget: int = 2, block_bytes: int = 4 << 20
) -> DataFrame:
    """Links (a, b) between the nodes of texts (node, text: distinct texts) whose components are those of all pairs that are within
    the budget by one of their fingerprints and of at least the similarity.

    At a similarity of 0.8 two whole-text fingerprints differ in about 10 of 64 bits, where a trie prunes nothing. So
    beside the fingerprint of the whole text there are those of slices, some of which differ in few bits. All of them go through the
    trie self-join under the budget, each number in tries of its own; its components are groups of texts. Word shingles are
    held against word shingles within the groups in two steps. First each text is compared with two nodes of each
    of its groups, the smallest and the one that meets most texts in all its groups (the original of a group of variants).
    Then, in a group that these links leave in different components, the pairs within the budget are compared, in blocks of about
    `block_bytes` of shingle hashes, block against block.
    """
    parts = texts.select("node", "text").mapInArrow(
        _slices(words_in_shingle, slices, shingles), "node bigint, shingles bigint, fps array<bigint>"
    )
    parts = scratch.table(parts.select("node", "shingles", F.explode("fps").alias("fp")), "slices")
    nodes = scratch.table(parts.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("texts")), "nodes")
    met = links(nodes.select("fp"), budget, kind_bits=BITS - _SLICE_BITS)
    met = smallest_reachable(nodes.select("fp", "least"), met)
    # A group is named by its fingerprints' number and its smallest node.
    groups = nodes.join(met, "fp", "left").where("texts > 1 OR component IS NOT NULL")
    groups = groups.select("fp", F.shiftrightunsigned("fp", _SLICE_BITS).alias("slice"), F.coalesce("component", "least").alias("least"), "texts")
    groups = scratch.table(groups, "groups")
    sizes = groups.groupBy("slice", "least").agg(F.sum("texts").alias("size"))
    groups = groups.join(sizes, ["slice", "least"]).drop("texts")
    members = scratch.table(parts.join(groups, "fp"), "members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    central = members.where("node <> least").join(weights, "node").groupBy("slice", "least").agg(F.max_by("node", F.struct("weight", "node")).alias("central"))
    members = scratch.table(members.join(central, ["slice", "least"]), "centred")
    met = members.select("node", F.explode(F.array("least", "central")).alias("other")).where("node <> other")
    pairs = scratch.table(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    known = scratch.table(texts.join(wanted, "node", "left_semi").select("node", "text"), "texts")
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(known.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    first = both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(words_in_shingle, similarity), "a bigint, b bigint")
    first = scratch.table(first, "links")

    labels = smallest_reachable(None, first)
    labels = labels.select(F.col("fp").alias("node"), "component")
    inner = members.where("size > 3 AND node <> least AND node <> central").join(labels, "node", "left")
    inner = inner.select("slice", "least", "fp", "node", "shingles", F.coalesce("component", "node").alias("component"))
    parted = inner.groupBy("slice", "least").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.sum("shingles") * 8 / block_bytes).alias("blocks")
    )
    inner = inner.join(parted.where("low < high").select("slice", "least", "blocks"), ["slice", "least"])
    inner = scratch.table(inner.withColumn("side", F.expr("pmod(xxhash64(node), blocks)")), "parted")
    # Each member goes to its own block and to that of every pair of blocks with it.
    inner = inner.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    inner = inner.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    left = scratch.table(
        texts.join(inner.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_hashes(words_in_shingle), "node bigint, hashes binary"),
        "hashes",
    )
    second = inner.join(left, "node").select("slice", "least", "i", "j", "node", "component", "side", "fp", "hashes")
    second = second.groupBy("slice", "least", "i", "j").applyInArrow(_links_in_block(similarity, budget), "a bigint, b bigint")
    return first.unionByName(second)


def keep_first(docs: DataFrame, *, words_in_shingle: int = 5, similarity: float = 0.8, slices: int = 30, shingles: int = 8) -> DataFrame:
    """All columns of one document of each group of near-duplicates, that of the smallest doc_id.

    Groups are the components of links of at least the similarity (of sets of word shingles), found by the trie self-join of
    SimHash fingerprints and checked on the shingles; equal texts are one node. A document is its doc_id: rows that share one
    stay or go together, and rows without one stay. Texts without words are equal texts.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    same = scratch.table(rows.select("doc", "t1", "t2"), "text-hashes")
    nodes = scratch.table(same.groupBy("t1", "t2").agg(F.min("doc").alias("node")), "distinct-texts")
    texts = rows.join(nodes.select(F.col("node").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("node"), "text")
    settings = {"words_in_shingle": words_in_shingle, "similarity": similarity, "slices": slices, "shingles": shingles}
    labels = smallest_reachable(None, similar_links(texts, **settings))
    copies = same.join(nodes, ["t1", "t2"]).where("doc <> node").select("doc")
    near = labels.where("fp <> component").select(F.col("fp").alias("doc"))
    gone = copies.union(near).distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc"], "left_anti").select(docs.columns)
