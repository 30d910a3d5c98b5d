"""Benchmark decontamination by the q-gram lemma.

A region of a document that lies within e edits of a benchmark item of m characters shares at least
m + 1 - q * (e + 1) character q-grams with it, all of them on the e + 1 diagonals (document position less item
position) that the alignment passes. Diagonals are taken in overlapping bands of 2e + 1, each e + 1 further than the last, so
every alignment lies whole in one of them. Every document is scanned once: its q-grams are looked up among the
benchmark's, the positions that share a q-gram are counted per item and band, and bands that reach the item's bound are
verified by an alignment of the whole item inside the band.

e is `edits` of an item's length, rounded down, for every item. q is at most `q`, and less for a short item: the largest
that leaves the bound an eighth of the item (an item of which no edit is allowed is its own q-gram, if it is short enough).

Bounds. An item's positions are indexed in blocks of e + 1, of which a q-gram is listed once however often it
occurs there, so a position of a document meets an item at most m / (e + 1) times, about a dozen. Hits are
counted slab by slab of about `_SLAB` and a band's count is dropped as soon as its end is passed. So neither a run of one
character nor a q-gram that every item holds takes more memory than a slab.

Characters are code points; A-Z compares as a-z and any of bytes 9 to 13 as a space, so offsets are those of the
original text. The benchmark is taken in blocks of at most `block_chars` characters, ordered by item; `_BLOCKS_AT_ONCE` blocks are
broadcast at once and each group of documents is held against them one after another, so that the documents are read once for
`_BLOCKS_AT_ONCE` * `block_chars` characters of benchmark.

Defined results: null and empty texts contain nothing; a null or empty item matches nothing; any other item, of one
character too, matches wherever it stands within its edits; repeated items are each reported, and so are
repeated documents; of overlapping regions of an item only the one with the least edits is; very long texts are scanned slab by slab; an empty table on either side gives no rows; a null doc_id or item_id is
carried along. `keep_uncontaminated` judges every row by its own text, so rows that share a doc_id or have none don't touch each
other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domgraph.llm import hashing

_SEPARATOR = 0x110000
_CHUNK_CHARS = 256 << 10
_GROUP_CHARS = 8 << 20
_BITMAP_BITS = 22
_SLAB = 1 << 20
_BLOCKS_AT_ONCE = 8
_HIT_SCHEMA = "item_id bigint, start bigint, end bigint, edits int, item_chars int"


def code_points(text: str) -> np.ndarray:
    """Folded code points, one for each of the text's."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    points[(points >= 9) & (points <= 13)] = 32
    points[(points >= 65) & (points <= 90)] += 32
    return points


def qgram_hashes(sums: np.ndarray, q: int) -> np.ndarray:
    """The hash of the q-gram at each position, from the prefix sums of the code points."""
    n = max(0, len(sums) - q)
    return (sums[q : q + n] - sums[:n]) * hashing.scale(n)


def gram_size(m: int, e: int, most: int) -> int:
    """The q of an item of m code points and e edits."""
    if not e:
        return min(m, most)
    return next(q for q in range(most, 0, -1) if q == 1 or 8 * (m + 1 - q * (e + 1)) >= m)


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, most: int) -> tuple[int, int, int]:
    """The least edits from the item to any part of the text whose alignment keeps to diagonals low to low + 2 * most, and that
    part's bounds; `most` + 1 if there are more."""
    width = 2 * most + 1
    far = most + 1
    across = np.arange(width)
    # Cell k of row i is text position i + low + k: how many of the item's first i characters were aligned up to there.
    place = low + across
    cost = np.where((place >= 0) & (place <= len(text)), 0, far).astype(np.int64)
    begin = np.clip(place, 0, len(text))
    for i, char in enumerate(item, 1):
        at = i + place
        inside = (at >= 1) & (at <= len(text))
        swap = cost + np.where(inside, text[np.clip(at - 1, 0, len(text) - 1)] != char, far)
        drop = np.append(cost[1:] + 1, far)
        take = swap <= drop
        best = np.where(take, swap, drop)
        origin = np.where(take, begin, np.append(begin[1:], 0))
        best[(at < 0) | (at > len(text))] = far
        # Insertions run along the row: the best start of a run is a running minimum.
        source = np.minimum.accumulate((best - across) * width + across) % width
        cost = np.minimum(best[source] + across - source, far)
        cost[(at < 0) | (at > len(text))] = far
        begin = origin[source]
        if cost.min() > most:
            return far, 0, 0
    k = int(cost.argmin())
    return int(cost[k]), int(begin[k]), len(item) + low + k


class Index:
    """The q-grams of some benchmark items, sorted by hash, for each q."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, edits: float):
        self.items = [(i, code_points(t)) for i, t in items if t]
        self.budgets = np.array([int(len(p) * edits) for _, p in self.items], np.int64)
        self.lengths = np.array([len(p) for _, p in self.items], np.int64)
        self.sizes = np.array([gram_size(m, e, q) for m, e in zip(self.lengths.tolist(), self.budgets.tolist(), strict=True)], np.int64)
        self.least = self.lengths + 1 - self.sizes * (self.budgets + 1)
        self.steps = self.budgets + 1
        self.grams = {size: self._sorted(np.flatnonzero(self.sizes == size), size) for size in sorted(set(self.sizes.tolist()))}

    def _sorted(self, numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """hashes, item and block of the items' q-grams in order of hash, and a bitmap of the hashes."""
        found = [qgram_hashes(hashing.prefix_sums(self.items[i][1]), size) for i in numbers.tolist()]
        hashes = np.concatenate(found)
        item = np.repeat(numbers, [len(x) for x in found])
        block = np.concatenate([np.arange(len(x)) for x in found]) // self.steps[item]
        order = np.lexsort((block, item, hashes))
        hashes, item, block = hashes[order], item[order], block[order]
        fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1]) | (block[1:] != block[:-1])))
        hashes, item, block = hashes[fresh], item[fresh], block[fresh]
        bitmap = np.zeros(1 << _BITMAP_BITS, bool)
        bitmap[(hashes >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)] = True
        return hashes, item, block, bitmap

    def scan(self, texts: list[str]) -> list[tuple]:
        """(text number, item_id, start, end, edits, item length) of the regions found in each text.

        A very long text is taken in windows that overlap by what the longest region needs; a region counts in the window
        in whose own part it starts.
        """
        if not self.items:
            return []
        overlap = int((self.lengths + 2 * self.budgets).max()) + 1
        window = max(_CHUNK_CHARS, 4 * overlap)
        whole = [(k, t) for k, t in enumerate(texts) if len(t) <= window]
        rounds = [([k for k, _ in whole], 0, [t for _, t in whole], window)]
        rounds += [
            ([k], at, [t[at : at + window]], window if at + window >= len(t) else window - overlap)
            for k, t in enumerate(texts)
            if len(t) > window
            for at in range(0, len(t) - overlap, window - overlap)
        ]
        # (text number, item number, start, end, edits, item_id)
        hits = [
            (numbers[row], i, base + start, base + end, cost, name)
            for numbers, base, parts, own in rounds
            for (row, i, end), (name, start, cost) in self._scan(parts).items()
            if start < own
        ]
        found: list[tuple] = []
        for hit in sorted(hits, key=lambda x: x[:5]):
            # Of regions of one item that overlap the one with the least edits stands.
            if found and found[-1][:2] == hit[:2] and hit[2] < found[-1][3]:
                found[-1] = min(found[-1], hit, key=lambda x: x[4])
            else:
                found.append(hit)
        rows = [(row, name, start, end, cost, int(self.lengths[i])) for row, i, start, end, cost, name in found]
        return sorted(rows, key=lambda x: (x[0], x[2], x[3], -1 if x[1] is None else x[1]))

    def _scan(self, texts: list[str]) -> dict[tuple, tuple]:
        """(item_id, start, edits) of each (text number, item number, end) found."""
        parts = [code_points(t) for t in texts]
        found: dict[tuple, tuple] = {}
        if not any(len(p) for p in parts):
            return found
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        points = np.concatenate([x for p in parts for x in (p, np.array([_SEPARATOR], np.uint32))])
        sums = hashing.prefix_sums(points)
        last: dict[tuple, tuple[int, int, int]] = {}
        for size in self.grams:
            for item, row, band in self._candidates(size, sums, begins):
                self._verify(item, row, band, points[begins[row] : begins[row + 1] - 1], found, last)
        return found

    def _candidates(self, size: int, sums: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, row, band) of the bands that reach their item's bound. A band counts the positions of its row that share a
        q-gram with the item on its diagonals, each position once."""
        hashes, items, blocks, bitmap = self.grams[size]
        grams = qgram_hashes(sums, size)
        at = np.flatnonzero(bitmap[(grams >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
        at, lo, counts = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            return
        row = np.searchsorted(begins, at, "right") - 1
        n_rows, n_points = len(begins) - 1, int(begins[-1])
        longest = int(self.lengths.max()) + 2
        bands = np.int64(n_points + longest + 4)
        held_key, held_count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        first = 0
        while first < len(at):
            # One position alone may meet more entries than a slab has: every item at most a dozen times.
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _SLAB, "right")))
            n = counts[first:last]
            entry = np.repeat(lo[first:last], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, place, owner = items[entry], np.repeat(at[first:last], n), np.repeat(row[first:last], n)
            # floor(position / step) - floor(item position / step) is the diagonal's band or the next.
            top = (place - begins[owner]) // self.steps[item] - blocks[entry] + longest
            key = (item * np.int64(n_rows) + owner) * bands
            key = np.concatenate([key + top, key + top - 1, key + top - 2])
            pair = np.lexsort((np.tile(place, 3), key))
            key, place = key[pair], np.tile(place, 3)[pair]
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])))
            key = np.concatenate([held_key, key[fresh]])
            weight = np.concatenate([held_count, np.ones(int(fresh.sum()), np.int64)])
            held_key, back = np.unique(key, return_inverse=True)
            held_count = np.bincount(back, weights=weight).astype(np.int64)
            # A band ends where its last diagonal leaves the item.
            item, owner = np.divmod(held_key // bands, n_rows)
            stop = begins[owner] + (held_key % bands - longest + 3) * self.steps[item] + self.lengths[item]
            over = stop <= at[last - 1] if last < len(at) else np.ones(len(held_key), bool)
            reached = over & (held_count >= self.least[item])
            yield from zip(item[reached].tolist(), owner[reached].tolist(), (held_key % bands - longest)[reached].tolist(), strict=True)
            held_key, held_count = held_key[~over], held_count[~over]
            first = last

    def _verify(self, i: int, row: int, band: int, text: np.ndarray, found: dict, last: dict) -> None:
        name, wanted = self.items[i]
        most, m = int(self.budgets[i]), len(wanted)
        low = band * (most + 1)
        high = low + 2 * most
        # Bands come in order of diagonal. One that holds the exact copy found last, or whose regions all begin inside the
        # region found last, has nothing to add.
        start, end, cost = last.get((row, i), (-1, -1, 1))
        if end >= 0 and (cost == 0 and low <= start or low > start + most) and low + most < end:
            return
        starts = np.arange(max(low, 0), min(high, len(text) - m) + 1)
        starts = starts[(text[starts] == wanted[0]) & (text[starts + m - 1] == wanted[-1])]
        at = next((s for s in starts.tolist() if np.array_equal(text[s : s + m], wanted)), None)
        if at is not None:
            hit = (name, at, 0)
        else:
            left, right = max(0, low), min(len(text), high + m)
            if not most or right <= left:
                return
            cost, s, e = banded_distance(wanted, text[left:right], low - left, most)
            if cost > most:
                return
            hit, at = (name, left + s, cost), left + e - m
        key = (row, i, at + m)
        last[row, i] = (hit[1], at + m, hit[2])
        found[key] = min(found.get(key, hit), hit, key=lambda x: (x[2], x[1]))


def _groups(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches whose texts have about _GROUP_CHARS characters together, with the texts."""
    for batch in batches:
        texts = enumerate(x.as_py() or "" for x in batch.column(at).cast(pa.string()))
        for part in hashing.chunks(texts, 1, _GROUP_CHARS):
            yield batch.slice(part[0][0], len(part)), [t for _, t in part]


def _hits(indices: list, texts: list[str]) -> list[tuple]:
    """What all blocks of the benchmark find in the texts; of several blocks one is held at a time."""
    found: list[tuple] = []
    for shared in indices:
        index = shared.value
        for part in hashing.chunks(enumerate(texts), 1, _CHUNK_CHARS):
            found += [(part[0][0] + row, *rest) for row, *rest in index.scan([t for _, t in part])]
        if len(indices) > 1:
            del index, shared._value
    return sorted(found, key=lambda x: x[0])


def _scan(indices: list) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _groups(batches, 1):
            hits = _hits(indices, texts)
            if hits:
                at, *rest = (list(x) for x in zip(*hits, strict=True))
                columns = [batch.column(0).take(pa.array(at))]
                columns += [pa.array(v, t) for v, t in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "end", "edits", "item_chars"])

    return scan


def _keep(indices: list, at: int) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _groups(batches, at):
            kept = np.ones(len(texts), bool)
            kept[[x[0] for x in _hits(indices, texts)]] = False
            yield batch.filter(pa.array(kept))

    return keep


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held: list[tuple] = []
    size = 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row.text) > block_chars:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


def _indices(benchmark: DataFrame, q: int, edits: float, block_chars: int) -> Iterator[list]:
    """Broadcast indices of the benchmark's blocks, so many as one reading of the documents takes."""
    held: list = []
    for items in _blocks(benchmark, block_chars):
        held.append(benchmark.sparkSession.sparkContext.broadcast(Index(items, q, edits)))
        if len(held) == _BLOCKS_AT_ONCE:
            yield held
            held = []
    if held:
        yield held


def contaminated_regions(
    docs: DataFrame, benchmark: DataFrame, *, q: int = 10, edits: float = 0.08, block_chars: int = 1 << 20
) -> DataFrame:
    """doc_id, item_id, start and end (code points, end exclusive), edits and item_chars of every region found."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], f"doc_id {kind}, {_HIT_SCHEMA}")
    for indices in _indices(benchmark, q, edits, block_chars):
        found = found.unionByName(texts.mapInArrow(_scan(indices), f"doc_id {kind}, {_HIT_SCHEMA}"))
    return found


def keep_uncontaminated(
    docs: DataFrame, benchmark: DataFrame, *, q: int = 10, edits: float = 0.08, block_chars: int = 1 << 20
) -> DataFrame:
    """All columns of the rows in whose text no region was found."""
    at = docs.columns.index("text")
    for indices in _indices(benchmark, q, edits, block_chars):
        docs = docs.mapInArrow(_keep(indices, at), docs.schema)
    return docs
