"""Exact n-gram Jaccard join with a count-vector R-tree.

Every document is the set of its 5-word shingles; equal sets become one. Two
sets that reach the wanted similarity share one of the first fifth of their
shingles in any fixed order of all shingles, so sets meet in blocks by those.
The order puts shingles that are frequent in the corpus last, by a count sketch
of fixed size, so common passages make no blocks of their own.

Shingles are hashed into groups; a set's counts by group are a point. Within a
block the points make an R-tree. The summed coordinate minima of the upper
corners of two nodes bound the overlap of all sets below them, so a descent by
pairs of nodes leaves few pairs of sets. A block passes on as many of these as
join what is left; what they join is parted further by a tree over whole count
vectors, and sets that then are still joined are a family.

A family's texts are compared in one place, by a tree of the same kind. A pair
is tested only while its ends aren't linked through others, first on hashes,
then on the words; so a family yields at most one link for each of its sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from acrelight.llm.common import components, documents, id_text, stage, stage_alone

U = np.uint64
WORDS = 5
#: Coordinates of a point.
GROUPS = 64
SKETCH_BITS = 20
#: Shingles count as frequent if their cell lies so many standard deviations of even counts over the mean.
FREQUENT = 5
#: What one task compares at once: so many sets, and so many bytes of text.
TILE_SETS, TILE_BYTES = 4096, 8_000_000
#: A larger block's sets are first dealt out to tiles so many times.
TURNS = 3
LEAF = 32
#: Blocks of up to so many links are compared once for all that have the same sets.
SAME = 64
#: Cells of a table of sets by shingles that are worked on at once.
BITS = 1 << 24
#: Texts are worked on together, about so many bytes at a time.
TOGETHER = 1_500_000
#: Set filters have so many bits.
FILTER_BITS = 24


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: A random 64-bit value for each byte at each of the first places of a word; capital letters have their small letter's.
PLACES = 64
VALUES = np.random.default_rng(23).integers(0, 2**64, (PLACES, 256), dtype=np.uint64)
VALUES[:, 65:91] = VALUES[:, 97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), a word's hash being the sum of its bytes' values at their places.

    Places beyond the table mix a byte's value with the place, so each has values of its own.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    inside = ~SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[:1].any():
        edge = np.r_[0, edge]
    begin, end = edge[::2], edge[1::2]
    sizes = end - begin
    starts = np.cumsum(np.r_[0, [len(x) + 1 for x in texts]])
    counts = np.diff(np.searchsorted(begin, starts))
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), counts
    letters = data[inside]
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    values = VALUES.reshape(-1)[(np.minimum(at, PLACES - 1) << 8) | letters]
    far = np.flatnonzero(at >= PLACES)
    if len(far):
        values[far] = mixed(values[far] + mixed(at[far].astype(np.uint64)))
    return mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64)), counts


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z as small letters."""
    return text.lower().split()


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    word, counts = word_hashes(texts)
    h = np.full(max(0, len(word) - words + 1), words, dtype=np.uint64)
    for j in range(words):
        h = (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15) + word[j : j + len(h)]
    h = mixed(h)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            own = np.sort(h[at : at + n - words + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own)
        elif n:
            out.append(np.frombuffer(hashlib.blake2b(word[at : at + n].tobytes(), digest_size=8).digest(), dtype="<u8"))
        else:
            out.append(word[:0])
        at += n
    return out


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``TOGETHER`` bytes."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > TOGETHER:
            yield first, i
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield first, len(sizes)


def text_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def name_of(hashes: np.ndarray) -> bytes:
    """128 bits of a cryptographic digest of a set's hashes."""
    return hashlib.sha256(hashes.tobytes()).digest()[:16]


def route_of(name: bytes) -> int:
    """A set's name for finding its partners, an even number; two sets may share it, and are told apart by their names."""
    return int.from_bytes(name[:8], "little", signed=True) & ~1


def prefix_of(hashes: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The shingles by which a set must meet every set that is ``percent`` similar: the first ones, frequent ones last."""
    n = len(hashes)
    return np.r_[hashes[~often], hashes[often]][: n + (-percent * n // 100) + 1]


def group_counts(hashes: np.ndarray) -> bytes:
    """Counts by as many groups as half the set's size, as bytes; groups halve into those of half as many."""
    groups = GROUPS
    while groups < len(hashes) // 2 and groups < 1 << 20:
        groups *= 2
    while True:
        counts = np.bincount((hashes >> U(65 - groups.bit_length())).astype(np.int64), minlength=groups)
        if counts.max() <= 255:
            return counts.astype(np.uint8).tobytes()
        groups *= 2


def short_counts(fine: bytes, most: int = 256) -> bytes:
    """A count vector folded to at most ``most`` groups, as far as counts stay bytes."""
    v = np.frombuffer(fine, dtype=np.uint8)
    while len(v) > most and (folded := v.reshape(-1, 2).sum(axis=1)).max() <= 255:
        v = folded.astype(np.uint8)
    return v.tobytes()


def common_counts(vectors: list[bytes]) -> np.ndarray:
    """Count vectors as rows, at the coarsest one's groups."""
    sizes = list(map(len, vectors))
    groups = min(sizes)
    if groups == max(sizes):
        return np.frombuffer(b"".join(vectors), dtype=np.uint8).reshape(len(vectors), groups).astype(np.int16)
    return np.array([np.frombuffer(v, dtype=np.uint8).reshape(groups, -1).sum(axis=1, dtype=np.int16) for v in vectors])


class CountTree:
    """An R-tree over count vectors, each node split at the median of its widest coordinate.

    A node has the upper corner of its points, their least and greatest size, and
    two children or a leaf's points.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        self.root = self.grow(np.arange(len(sizes)))

    def grow(self, at: np.ndarray) -> tuple:
        points, sizes = self.counts[at], self.sizes[at]
        upper = points.max(axis=0)
        below: tuple = ()
        if len(at) > LEAF:
            axis = int((upper - points.min(axis=0)).argmax())
            order = at[np.argsort(points[:, axis], kind="stable")]
            below = (self.grow(order[: len(at) // 2]), self.grow(order[len(at) // 2 :]))
        return upper, int(sizes.min()), int(sizes.max()), below, at

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices of points that may be ``percent`` similar, each pair once, by a descent in pairs of nodes."""
        waiting = [(self.root, self.root)]
        while waiting:
            a, b = waiting.pop()
            if 100 * a[2] < percent * b[1] or 100 * b[2] < percent * a[1]:
                continue
            if a is not b and not possible(int(np.minimum(a[0], b[0]).sum()), a[1], b[1], percent):
                continue
            if not a[3] and not b[3]:
                i, j = (a[4], b[4])
                bound = np.minimum(self.counts[i][:, None, :], self.counts[j][None, :, :]).sum(axis=2)
                x, y = np.nonzero(possible(bound, self.sizes[i][:, None], self.sizes[j][None, :], percent))
                if a is b:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    yield i[x], j[y]
            elif a is b:
                waiting += [(a[3][0], a[3][1]), (a[3][1], a[3][1]), (a[3][0], a[3][0])]
            elif b[3] and (not a[3] or len(b[4]) >= len(a[4])):
                waiting += [(a, b[3][0]), (a, b[3][1])]
            else:
                waiting += [(a[3][0], b), (a[3][1], b)]


def possible(overlap, a, b, percent: int):
    """Whether sets of sizes a and b that share at most ``overlap`` may be ``percent`` similar."""
    return (100 + percent) * overlap >= percent * (a + b)


def word_shingles(text: bytes, words: int) -> set:
    w = words_of(text)
    return set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else {tuple(w)}


def similar_words(a: bytes, b: bytes, words: int, percent: int) -> bool:
    """The exact test, on the words themselves."""
    x, y = word_shingles(a, words), word_shingles(b, words)
    return 100 * len(x & y) >= percent * len(x | y)


def link_sets(texts: list[bytes], sets: list[np.ndarray], label: np.ndarray, percent: int, words: int) -> list[tuple[int, int]]:
    """Links that join all similar sets whose ``label`` differs; ``label`` is brought up to date."""
    sizes = np.array(list(map(len, sets)))
    flat = np.concatenate(sets)
    names, of, often = np.unique(flat, return_inverse=True, return_counts=True)
    # only shingles of several sets can be common; each of those has a column
    column = np.cumsum(often > 1) - 1
    shared = often[of] > 1
    owner, at = np.repeat(np.arange(len(sets)), sizes)[shared], column[of[shared]]
    width = -(-int((often > 1).sum()) // 64) + 1
    links: list[tuple[int, int]] = []

    def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common shingles of pairs: set bits of both rows, by so many columns at a time as fit in ``BITS``."""
        out = np.zeros(len(a), dtype=np.int64)
        rows, place = np.unique(np.r_[a, b], return_inverse=True)
        x, y = place[: len(a)], place[len(a) :]
        row = np.full(len(sets), -1)
        row[rows] = np.arange(len(rows))
        mine = row[owner] >= 0
        own, col = row[owner[mine]], at[mine]
        step = max(1, BITS // (64 * len(rows)))
        for first in range(0, width, step):
            here = (col >> 6 >= first) & (col >> 6 < first + step)
            bits = np.zeros((len(rows), min(step, width - first) * 64), dtype=bool)
            bits[own[here], col[here] - 64 * first] = True
            packed = np.packbits(bits, axis=1).view(np.uint64)
            for k in range(0, len(a), 256):
                out[k : k + 256] += np.bitwise_count(packed[x[k : k + 256]] & packed[y[k : k + 256]]).sum(axis=1, dtype=np.int64)
        return out

    def test(a: np.ndarray, b: np.ndarray) -> None:
        good = possible(overlaps(a, b), sizes[a], sizes[b], percent)
        for i, j in zip(a[good].tolist(), b[good].tolist()):
            if label[i] != label[j] and similar_words(texts[i], texts[j], words, percent):
                label[label == label[j]] = label[i]
                links.append((i, j))

    counts = common_counts([short_counts(group_counts(x)) for x in sets])
    for a, b in CountTree(counts, sizes).pairs(percent):
        # one pair for each pair of labels first; it often makes the others needless
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            continue
        x, y = label[a], label[b]
        _, first = np.unique(np.minimum(x, y) * len(sets) + np.maximum(x, y), return_index=True)
        test(a[first], b[first])
        left = np.ones(len(a), dtype=bool)
        left[first] = False
        left &= label[a] != label[b]
        if left.any():
            test(a[left], b[left])
    return links


def pair_bounds(vectors: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summed minima of pairs of whole count vectors, each pair at its coarser one's groups."""
    sizes = np.array(list(map(len, vectors)))
    out = np.zeros(len(a), dtype=np.int64)
    for groups in np.unique(np.minimum(sizes[a], sizes[b])).tolist():
        at = np.flatnonzero(np.minimum(sizes[a], sizes[b]) == groups)
        step = max(1, (1 << 22) // groups)
        for first in range(0, len(at), step):
            some = at[first : first + step]
            used, place = np.unique(np.r_[a[some], b[some]], return_inverse=True)
            counts = np.array([np.frombuffer(vectors[i], dtype=np.uint8).reshape(groups, -1).sum(axis=1, dtype=np.uint16) for i in used.tolist()])
            for k in range(0, len(some), 64):
                x, y = place[: len(some)][k : k + 64], place[len(some) :][k : k + 64]
                out[some[k : k + 64]] = np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64)
    return out


def may_link(vectors: list[bytes], sizes: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that join all whose ``label`` differs and whose counts don't rule a link out: those of a common size in the tree, then whole ones."""
    out: list[tuple[int, int]] = []
    for a, b in CountTree(common_counts(list(map(short_counts, vectors))), sizes).pairs(percent):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            continue
        may = possible(pair_bounds(vectors, a, b), sizes[a], sizes[b], percent)
        a, b = a[may], b[may]
        while len(a) and (apart := label[a] != label[b]).any():
            a, b = a[apart], b[apart]
            label[label == label[b[0]]] = label[a[0]]
            out.append((int(a[0]), int(b[0])))
    return out


def set_table(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (doc_id, text, own) with the size, names and counts of each row's set, a number ``at`` of its own, and rows of the count sketch with a block number."""
    added = {"n": pa.int64(), "sid": pa.binary(), "route": pa.int64(), "fine": pa.binary(), "short": pa.binary(), "block": pa.int32(), "cells": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        given: list[pa.Field] = []
        for batch in batches:
            given = list(batch.schema)
            texts = text_bytes(batch.column(1))
            for lo, hi in slices(list(map(len, texts))):
                sets = shingle_sets(texts[lo:hi], words)
                sketch += np.bincount((np.concatenate(sets) & U((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
                names = [name_of(x) if len(x) else None for x in sets]
                fine = [group_counts(x) if len(x) else None for x in sets]
                columns = [list(map(len, sets)), names, [x and route_of(x) for x in names], fine, [x and short_counts(x) for x in fine], [None] * len(sets), [None] * len(sets)]
                yield pa.record_batch([*batch.slice(lo, hi - lo).columns, *(pa.array(x, t) for x, t in zip(columns, added.values()))], names=[f.name for f in given] + list(added))
        if sketch.any():
            nulls = [pa.nulls(256, t) for t in [*(f.type for f in given), *list(added.values())[:-2]]]
            cells = [x.tobytes() for x in sketch.astype("<u4").reshape(256, -1)]
            yield pa.record_batch([*nulls, pa.array(range(256), pa.int32()), pa.array(cells, pa.binary())], names=[f.name for f in given] + list(added))

    nullable = [StructField(f.name, f.dataType, True) for f in rows.schema]
    kinds = {"n": LongType(), "sid": BinaryType(), "route": LongType(), "fine": BinaryType(), "short": BinaryType(), "block": IntegerType(), "cells": BinaryType()}
    schema = StructType([*nullable, *(StructField(n, t, True) for n, t in kinds.items())])
    return rows.mapInArrow(run, schema).withColumn("at", F.monotonically_increasing_id())


def frequent_cells(table: DataFrame) -> np.ndarray:
    """The sketch's cells well over the mean as bits: of one size for every corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(*(c.to_pylist() for c in batch.columns)):
                total[block] = total.get(block, 0) + np.frombuffer(cells, dtype="<u4").astype(np.int64)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["block", "cells"])

    rows = table.where("block is not null").select("block", "cells")
    counts = np.zeros((256, (1 << SKETCH_BITS) // 256), dtype=np.int64)
    for block, cells in rows.repartition(16, "block").mapInArrow(add, "block int, cells binary").collect():
        counts[block] = np.frombuffer(cells, dtype="<i8")
    flat = counts.reshape(-1)
    return flat > flat.mean() + FREQUENT * max(1.0, flat.mean()) ** 0.5


def edge_batch(key: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    last = pa.nulls(len(key), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.record_batch([pa.array(key, pa.int64()), pa.array(a, pa.int64()), last], names=["key", "a", "b"])


def block_edges(table: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """(key, a, b): routes of different sets that share a block, joined to trees of the block's sets.

    Each batch joins its own sets of a block to one of them and sends only that
    one on, so a block that very many sets share brings few rows together.
    """
    bits = table.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            once = dict(zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))))
            routes, texts = list(once), list(once.values())
            keys: list[np.ndarray] = []
            for lo, hi in slices(list(map(len, texts))):
                for hashes in shingle_sets(texts[lo:hi], words):
                    keys.append(prefix_of(hashes, often[(hashes & U((1 << SKETCH_BITS) - 1)).astype(np.int64)], percent))
            if not keys:
                continue
            key, a = np.concatenate(keys).astype(np.int64), np.repeat(np.array(routes, dtype=np.int64), list(map(len, keys)))
            order = np.argsort(key, kind="stable")
            key, a = key[order], a[order]
            fresh = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(fresh)
            lead = a[np.repeat(first, np.diff(np.r_[first, len(key)]))]
            if not fresh.all():
                yield edge_batch(key[~fresh], lead[~fresh], a[~fresh])
            yield edge_batch(key[first], a[first], None)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ready = np.asarray(batch.column(2).is_valid())
            if ready.any():
                yield batch.filter(pa.array(ready))
            key, a = (np.asarray(c)[~ready] for c in batch.columns[:2])
            if not len(key):
                continue
            if held is not None:
                key, a = np.r_[held[0], key], np.r_[held[1], a]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lead = a[np.repeat(first, np.diff(np.r_[first, len(key)]))]
            keep = lead != a
            yield edge_batch(key[keep], lead[keep], a[keep])
            held = key[-1:], lead[-1:]

    rows = table.where("n > 0").select("route", "text").mapInArrow(within, "key long, a long, b long")
    return rows.repartition(F.coalesce("b", "key")).sortWithinPartitions("key").mapInArrow(across, "key long, a long, b long")


def filter_bits(values: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A packed bit for each cell of the one long column of ``values``; tasks build it by ranges, so its size is all that reaches the driver."""
    low = 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cell in zip(*(c.to_numpy() for c in batch.columns)):
                found.setdefault(int(block), np.zeros(1 << low, dtype=bool))[cell] = True
        if found:
            yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], names=["block", "bits"])

    cell = F.shiftright(F.col(values.columns[0]), 1).bitwiseAND((1 << bits) - 1)
    cells = values.select(cell.alias("cell")).distinct().select(F.shiftright("cell", low).cast("int").alias("block"), F.col("cell").bitwiseAND((1 << low) - 1).cast("int").alias("cell"))
    out = np.zeros((1 << (bits - low), 1 << (low - 3)), dtype=np.uint8)
    for block, packed in cells.repartition("block").mapInArrow(run, "block int, bits binary").collect():
        out[block] = np.frombuffer(packed, dtype=np.uint8)
    return out.reshape(-1)


def wanted_sets(table: DataFrame, family: DataFrame) -> DataFrame:
    """(key, sid, text, size): each set whose route is in ``family`` (route, key), once; its text compressed, its size before that.

    Each task sends a set once, as far as it remembers, so copies of one text are
    few where they meet; texts are shuffled by route alone, for the join too.
    """
    sent = table.sparkSession.sparkContext.broadcast(filter_bits(family.select("route")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in batches:
            at = (np.asarray(batch.column(1)) >> 1) & ((1 << FILTER_BITS) - 1)
            batch = batch.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            keep = []
            for sid in batch.column(0).to_pylist():
                keep.append(sid not in told)
                told.add(sid)
            if len(told) > 500_000:
                told = set()
            batch = batch.filter(pa.array(keep, pa.bool_()))
            texts = text_bytes(batch.column(2))
            yield pa.record_batch([*batch.columns[:2], pa.array([zlib.compress(x, 1) for x in texts], pa.binary()), pa.array(list(map(len, texts)), pa.int64())], names=["sid", "route", "text", "size"])

    found = table.where("n > 0").select("sid", "route", "text").mapInArrow(run, "sid binary, route long, text binary, size long").repartition("route")
    once = found.groupBy("route", "sid").agg(F.first("text").alias("text"), F.first("size").alias("size"))
    return once.join(family, "route").select("key", "sid", "text", "size")


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole count vectors don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, fine_a, fine_b = batch.columns
            overlap = np.array([int(np.minimum(*common_counts(list(x))).sum()) for x in zip(fine_a.to_pylist(), fine_b.to_pylist())], dtype=np.int64)
            keep = pa.array(possible(overlap, np.asarray(n_a), np.asarray(n_b), percent), pa.bool_())
            yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])

    side = lambda x, *c: points.select(F.col("route").alias(x), *(F.col(n).alias(f"{n}_{x}") for n in c))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    sized = pairs.join(side("a", "n"), "a").join(side("b", "n"), "b").where(near)
    return sized.join(side("a", "fine"), "a").join(side("b", "fine"), "b").select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(run, "a long, b long")


def compared(rows: DataFrame, compare, kind: str) -> DataFrame:
    """(a, b): what ``compare`` finds within each ``at`` of ``rows`` (at, id, root, n, content); sets of equal ``root`` are joined already.

    ``content`` is the least that a comparison needs of a set. ``compare`` takes contents, sizes and labels, and returns
    pairs of places. One ``at`` is held at a time.
    """
    types = {"long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        held: list[tuple] = []

        def close() -> list[tuple]:
            names = {root: i for i, root in enumerate(dict.fromkeys(x[1] for x in held))}
            if len(names) == 1:
                return []
            label = np.array([names[x[1]] for x in held])
            return [(held[i][0], held[j][0]) for i, j in compare([x[3] for x in held], np.array([x[2] for x in held]), label)]

        found: list[tuple] = []
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                for at, *row in zip(*(c.to_pylist() for c in batch.slice(first, 500).columns)):
                    if at != last and held:
                        found += close()
                        held = []
                    last = at
                    held.append(row)
            if found:
                yield pa.record_batch([pa.array(x, types[kind]) for x in zip(*found)], names=["a", "b"])
                found = []
        if held and (found := close()):
            yield pa.record_batch([pa.array(x, types[kind]) for x in zip(*found)], names=["a", "b"])

    dealt = rows.select("at", "id", "root", "n", "content").repartition("at").sortWithinPartitions("at")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def compared_blocks(members: DataFrame, compare, kind: str, most: int, room: int) -> DataFrame:
    """(a, b): pairs that join, in each ``key`` of the staged ``members`` (key, id, size, n, content), all that ``compare`` joins.

    A block of up to ``most`` members and ``room`` bytes is compared in one task.
    Larger ones are dealt out to tiles by hash, several times over, which joins
    nearly all that belongs together. Then those outside a block's largest
    joined part are compared with all, tile by tile: rows grow with the block,
    and with the square only of what stays apart.
    """

    def tiles(count: Column, size: Column) -> Column:
        return F.greatest(F.ceil(count / most), F.ceil(size / room), F.lit(1)).cast("int")

    blocks = stage(members.groupBy("key").agg(F.count("*").alias("n"), tiles(F.count("*"), F.sum("size")).alias("tiles")).where("n > 1"))
    spot = lambda part, i, j: F.concat_ws(":", F.col("key").cast("string"), F.lit(part).cast("string"), i.cast("string"), j.cast("string"))
    tile = lambda n, *more: F.pmod(F.xxhash64("id", *more), n)
    zero = F.lit(0)
    placed = members.join(blocks.select("key", "tiles"), "key")
    whole = placed.where("tiles = 1").select(spot(0, zero, zero).alias("at"), "id", F.col("id").alias("root"), "n", "content")
    links = compared(whole, compare, kind)
    if blocks.where("tiles > 1").isEmpty():
        return links
    large = stage(placed.where("tiles > 1"))
    turns = large.withColumn("turn", F.explode(F.array(*map(F.lit, range(TURNS)))))
    near = turns.select(spot(1, F.col("turn"), tile(F.col("tiles"), "turn", "key")).alias("at"), "id", F.col("id").alias("root"), "n", "content")
    links = stage(links.unionByName(compared(near, compare, kind)))
    roots = components(links).select(F.col("sid").alias("id"), "root")
    rooted = stage(large.join(roots, "id", "left").select("key", "id", "size", "n", "content", F.coalesce("root", "id").alias("root")))
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    total = parts.groupBy("key").agg(F.max(F.struct("n", "root", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts"))
    apart = stage(total.where("parts > 1").select("key", F.col("top.root").alias("main"), tiles(F.col("top.n"), F.col("top.size")).alias("mains"), tiles(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("others")))
    rows = rooted.join(apart, "key").withColumn("other", F.col("root") != F.col("main")).withColumn("tile", F.when(F.col("other"), tile(F.col("others"))).otherwise(tile(F.col("mains"))))
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    own = F.col("tile")
    beside = F.when(F.col("other"), F.transform(upto("mains"), lambda j: spot(2, own, j))).otherwise(F.transform(upto("others"), lambda i: spot(2, i, own)))
    others = F.transform(F.filter(upto("others"), lambda j: F.col("other") & (j != own)), lambda j: spot(3, F.least(own, j), F.greatest(own, j)))
    return links.unionByName(compared(rows.select("id", "root", rows["n"], "content", F.explode(F.concat(beside, others)).alias("at")), compare, kind))


def linked_sets(table: DataFrame, percent: int, words: int, most: int, room: int) -> DataFrame:
    """(sid, root): the sets of the staged ``table`` that link with another, and the least set that each reaches."""
    points = stage(table.where("n > 0").groupBy("sid").agg(*(F.first(c).alias(c) for c in ("route", "n", "fine", "short"))))

    def tree(contents: list[bytes], sizes: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
        return may_link(contents, sizes, label, percent)

    def exact(contents: list[bytes], sizes: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
        texts = list(map(zlib.decompress, contents))
        sets = [x for lo, hi in slices(list(map(len, texts))) for x in shingle_sets(texts[lo:hi], words)]
        return link_sets(texts, sets, label, percent, words)

    def met() -> DataFrame:
        edges = stage(block_edges(table, frequent_cells(table), words, percent))
        # a block of two sets is one pair, tried once for all blocks; in larger ones the tree decides, once for blocks of the same sets
        sizes = stage(edges.groupBy("key").agg(F.count("*").alias("links"), F.first("a").alias("a"), F.first("b").alias("b")))
        alone = sizes.where("links = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        inside = edges.join(sizes.where("links > 1").select("key", "links"), "key")
        few = inside.where(F.col("links") <= SAME).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("ids"))
        several = few.groupBy("ids").agg(F.min("key").alias("key")).select("key", F.explode("ids").alias("id"))
        many = inside.where(F.col("links") > SAME).select("key", F.explode(F.array("a", "b")).alias("id")).distinct()
        vectors = points.select(F.col("route").alias("id"), F.col("short").alias("content"), "n", F.lit(256).alias("size"))
        members = stage(several.unionByName(many).join(vectors, "id"))
        return bounded(alone, points, percent).unionByName(compared_blocks(members, tree, "long", most, room))

    candidates = stage_alone(met)
    # whole count vectors, each sent once, part what the short ones of the blocks could not
    loose = components(candidates).select(F.col("sid").alias("route"), F.col("root").alias("key"))
    whole = points.join(loose, "route").select("key", F.col("route").alias("id"), F.octet_length("fine").alias("size"), "n", F.col("fine").alias("content"))
    family = components(stage(compared_blocks(stage(whole), tree, "long", most, room))).select(F.col("sid").alias("route"), F.col("root").alias("key"))
    sets = stage(wanted_sets(table, family))
    texts = sets.select("key", F.col("sid").alias("id"), "size", F.col("size").alias("n"), F.col("text").alias("content"))
    return components(stage(compared_blocks(texts, exact, "binary", most, room)))


def similar_groups(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", most: int = TILE_SETS, room: int = TILE_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Documents link when their shingle sets have a Jaccard similarity of at least
    ``percent`` in a hundred; ``component_id`` is the least doc_id that links
    reach. Null and empty texts have no shingles and link with nothing; rows
    with equal texts or equal doc_ids each keep their own row. A null doc_id is
    never a component's least while another is there. Other columns of ``docs``
    are left behind, whatever their names. A text of any length is one whole
    set. Shingles count as equal in ``n_shingles`` if their 64-bit hashes are; a
    link is always tested on the words. One task compares
    up to ``most`` sets of ``room`` bytes at a time.
    """
    table = stage(set_table(id_text(docs, id_col, text_col), words))
    rows = table.where("block is null").select("doc_id", F.col("n").alias("n_shingles"), "sid")
    labels = stage_alone(lambda: linked_sets(table, percent, words, most, room))
    # the least doc_id of each set, then of all sets that are linked; each a table of its own, so a join with it can split a frequent set
    least = stage(rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least")))
    roots = stage(labels.join(least, "sid").groupBy("root").agg(F.min("least").alias("component_id")))
    linked = stage(labels.join(roots, "root").select("sid", "component_id"))
    of_sets = stage(least.join(linked, "sid", "left").select("sid", F.coalesce("component_id", "least").alias("component_id")))
    none = rows.where("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("sid is not null").join(of_sets, "sid").select("doc_id", "n_shingles", "component_id").unionByName(none)


def keep_one_of_similar(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", most: int = TILE_SETS, room: int = TILE_BYTES) -> DataFrame:
    """One row of each group of similar documents, in all its columns, and every row without words.

    A group is what links of ``similar_groups`` reach, exact copies included; its
    row is one of the least doc_id, a null doc_id being the last; equal ids go by
    their text's hash, and of fully equal rows one stays. Different texts that
    share a doc_id, or have none, are documents of their own.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.col(text_col).isNull().alias("no text"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), own.alias("own"))
    table = stage(set_table(rows, words))
    labels = stage_alone(lambda: linked_sets(table, percent, words, most, room))
    turn = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("tie"), "at")
    first = stage(table.where("n > 0").groupBy("sid").agg(F.min(turn).alias("first")))
    kept = first.join(labels, "sid", "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first")).select("first.at")
    found = table.where("n > 0").join(kept, "at", "left_semi").unionByName(table.where("n = 0"))
    text = F.when(~F.col("own.`no text`"), F.col("text"))
    return found.select(*(text.alias(c) if c == text_col else F.col(f"own.`{c}`") for c in docs.columns))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))
