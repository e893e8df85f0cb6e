"""Repeated passages by a hash-compared suffix sort.

A passage of ``LENGTH`` bytes is removed wherever it has already started
earlier. Sorting every suffix of a corpus would move each text many times over,
so only some suffixes are sorted, chosen by content: every window of ``LENGTH``
bytes has an anchor, its least k-gram by hash. Equal windows have equal anchors
in the same place, and neighbouring windows mostly share one.

Anchors meet by their k-gram. Where all windows of an anchor repeat an earlier
place as a whole, 128 bits of a cryptographic digest of their bytes show it. The others, at the ends of
repeated passages, are sorted with their surroundings: suffixes from the anchor
on, and reversed prefixes before it. The sort is a mergesort; two suffixes are
compared by binary search for the longest common extension over prefix
polynomial hashes. Extensions of neighbours are then verified on the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.llm.common import documents, stage

LENGTH, KGRAM = 100, 32
SPAN = LENGTH - KGRAM + 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64
#: About so many anchors are sorted at once.
CHUNK = 20_000
FILTER_BITS = 26
#: With more places than this around one k-gram, their windows are dealt out by digest over all tasks, with the same result.
HOT = 20_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Hasher:
    """Prefix polynomial hashes modulo 2^64 of random byte values."""

    def __init__(self, seed: int = 5):
        self.values = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[U(1), np.full(n, BASE, dtype=np.uint64)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[U(1), np.full(n, INVERSE, dtype=np.uint64)], dtype=np.uint64)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """Sums s with s[y] - s[x], times the inverse power of x, the hash of data[x:y]."""
        if len(data) >= len(self.power):
            self.grow(2 * len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=sums[1:])
        return sums

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, position, first start, last start) of each anchor, over all windows in order."""
        n = len(data)
        if n < LENGTH:
            return tuple(np.zeros((4, 0), dtype=np.int64))
        sums = self.prefixes(data)
        kgrams = mixed((sums[KGRAM:] - sums[:-KGRAM]) * self.inverse[: n - KGRAM + 1])
        least, at = kgrams, np.arange(len(kgrams), dtype=np.int32)
        width = 1
        while width < SPAN:
            step = min(width, SPAN - width)
            other = least[step:] < least[:-step]
            least, at = np.where(other, least[step:], least[:-step]), np.where(other, at[step:], at[:-step])
            width += step
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, n - LENGTH]
        position = at[first].astype(np.int64)
        return kgrams[position].astype(np.int64), position, first, last


def digest_of(window: bytes, shape: int = 0) -> bytes:
    """128 bits that name a string and, with ``shape``, where in it an anchor is."""
    return hashlib.blake2b(window + shape.to_bytes(2, "little"), digest_size=16).digest()


def merged(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges joined where they touch within a document."""
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    if not len(doc):
        return doc, lo, end
    fresh = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(fresh)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    starts = np.r_[True, fresh[1:] | (lo[1:] > reach[:-1])]
    first = np.flatnonzero(starts)
    return doc[first], lo[first], np.maximum.reduceat(end, first)


def place_of(position: np.ndarray, back: np.ndarray, front: np.ndarray) -> np.ndarray:
    """An anchor's place in one number: position, how far back its windows reach, how near they end."""
    return (position << 7 | back) << 7 | front


def place_parts(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 14, (place >> 7) & 127, place & 127


MARKS = "key long, context binary, doc long, place long, ends long"
MARK_NAMES = ["key", "context", "doc", "place", "ends"]


def mark_batch(key, context, doc, place, ends=None) -> pa.RecordBatch:
    last = pa.nulls(len(key), pa.int64()) if ends is None else pa.array(ends)
    return pa.record_batch([pa.array(key, pa.int64()), pa.array(context, pa.binary()), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), last], names=MARK_NAMES)


def cover_batch(doc, lo, end) -> pa.RecordBatch:
    """Ranges to remove, as marks that carry their end; dealt out by document."""
    doc, lo, end = merged(doc, lo, end)
    zero = np.zeros_like(doc)
    return mark_batch(mixed(doc.astype(np.uint64)).astype(np.int64), [b""] * len(doc), doc, place_of(lo, zero, zero), end)


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of every text; within a batch, all but the first of equal ones become ranges to remove at once."""
    hasher = Hasher()
    for batch in batches:
        docs = batch.column(0).to_pylist()
        order = sorted(range(len(docs)), key=docs.__getitem__)
        seen: set[bytes] = set()
        parts: list[tuple] = []
        size = 0
        for step, i in enumerate(order):
            text = batch.column(1)[i].as_buffer()
            raw = text.to_pybytes() if text is not None else b""
            key, position, first, last = hasher.anchors(np.frombuffer(raw, dtype=np.uint8))
            context, keep = [], np.ones(len(key), dtype=bool)
            shape = ((position - first) * SPAN + (position - last)).tolist()
            for at, (a, b, n) in enumerate(zip(first.tolist(), (last + LENGTH).tolist(), shape)):
                name = digest_of(raw[a:b], n)
                context.append(name)
                if name in seen:
                    keep[at] = False
                else:
                    seen.add(name)
            parts.append((key, position, first, last, np.full(len(key), docs[i], dtype=np.int64), keep, context))
            size += len(raw)
            if size > 16_000_000 or step == len(order) - 1:
                key, position, first, last, doc, keep = map(np.concatenate, list(zip(*parts))[:6])
                names = [x for p in parts for x, k in zip(p[6], p[5].tolist()) if k]
                yield mark_batch(key[keep], names, doc[keep], place_of(position, position - first, position - last)[keep])
                yield cover_batch(doc[~keep], first[~keep], last[~keep] + LENGTH)
                parts, size, seen = [], 0, set()


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted marks, ranges for anchors whose context came before, and the first of each context where a k-gram has several.

    Holds one row from batch to batch, so a k-gram of any frequency will do.
    """
    held: tuple | None = None
    before = False
    for batch in batches:
        if not batch.num_rows:
            continue
        ready = np.asarray(batch.column(4).is_valid())
        if ready.any():
            yield batch.filter(pa.array(ready))
            batch = batch.filter(pa.array(~ready))
        key, doc, place = (np.asarray(batch.column(c)) for c in (0, 2, 3))
        context = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, 2)
        if held is not None:
            key, context, doc, place = (np.concatenate([h, x]) for h, x in zip(held, (key, context, doc, place)))
        if not len(key):
            continue
        fresh = np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1]).any(axis=1)]
        position, back, front = place_parts(place[~fresh])
        yield cover_batch(doc[~fresh], position - back, position - front + LENGTH)
        at = np.flatnonzero(fresh)
        same = key[at][1:] == key[at][:-1]
        edge = np.r_[before, same] | np.r_[same, False]
        out = at[:-1][edge[:-1]]
        yield mark_batch(key[out], [b""] * len(out), doc[out], place[out])
        held, before = tuple(x[at[-1] : at[-1] + 1] for x in (key, context, doc, place)), bool(edge[-1])
    if held is not None and before:
        yield mark_batch(held[0], [b""], held[2], held[3])


class SuffixOrder:
    """Strings sorted within groups, with the longest common prefix of neighbours.

    ``text`` holds a string in each row, of ``size`` bytes; rows of a group are
    adjacent. ``order`` lists the rows sorted; ``common[i]`` is the length that
    rows order[i - 1] and order[i] share, -1 at the start of a group.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, group: np.ndarray, hasher: Hasher):
        n, width = text.shape
        self.text, self.size = text, size
        self.sums = np.zeros((n, width + 1), dtype=np.uint64)
        np.cumsum(hasher.values[text] * hasher.power[:width], axis=1, out=self.sums[:, 1:])
        self.steps = max(1, int(width).bit_length())
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[start, n])
        begin, end = np.repeat(start, sizes), np.repeat(start + sizes, sizes)
        order, run = np.arange(n), 1
        while run < sizes.max(initial=0):
            order = self.merge_runs(order, begin, end, run)
            run *= 2
        self.order = order
        self.common = np.full(n, -1, dtype=np.int64)
        inner = np.setdiff1d(np.arange(n), start)
        self.common[inner] = self.verified_common(order[inner - 1], order[inner])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common prefixes by binary search over hashes."""
        low, high = np.zeros(len(x), dtype=np.int64), np.minimum(self.size[x], self.size[y])
        for _ in range(self.steps):
            middle = (low + high + 1) >> 1
            equal = self.sums[x, middle] == self.sums[y, middle]
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def precedes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether string x sorts before y; equal strings by row."""
        common = self.extension(x, y)
        last = self.text.shape[1] - 1
        a = np.where(common < self.size[x], self.text[x, np.minimum(common, last)].astype(np.int64), -1)
        b = np.where(common < self.size[y], self.text[y, np.minimum(common, last)].astype(np.int64), -1)
        return (a < b) | ((a == b) & (x < y))

    def merge_runs(self, order: np.ndarray, begin: np.ndarray, end: np.ndarray, run: int) -> np.ndarray:
        """One level of the mergesort: each string finds its rank in the neighbouring run of its group."""
        at = np.flatnonzero(end - begin > run)
        first, stop = begin[at], end[at]
        mine = (at - first) // run
        low = np.minimum(first + (mine ^ 1) * run, stop)
        high = np.minimum(low + run, stop)
        base, left = low.copy(), low
        while (open_ := left < high).any():
            middle = (left + high) >> 1
            less = np.zeros(len(at), dtype=bool)
            less[open_] = self.precedes(order[middle[open_]], order[at[open_]])
            left, high = np.where(open_ & less, middle + 1, left), np.where(open_ & ~less, middle, high)
        out = order.copy()
        own = at - (first + mine * run)
        out[first + (mine & ~1) * run + own + (left - base)] = order[at]
        return out

    def verified_common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefixes checked on the bytes; a collision of hashes is put right."""
        common = self.extension(x, y)
        differ = (self.text[x] != self.text[y]) & (np.arange(self.text.shape[1]) < common[:, None])
        wrong = differ.any(axis=1)
        common[wrong] = differ[wrong].argmax(axis=1)
        return common

    def classes(self, length: int) -> np.ndarray:
        """For each row a number that rows with the same first ``length`` bytes share."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.cumsum(self.common < length)
        return out


def repeated_windows(group: np.ndarray, doc: np.ndarray, place: np.ndarray, after: np.ndarray, before: np.ndarray, hasher: Hasher) -> pa.RecordBatch:
    """Ranges of windows that an earlier member of their group has too.

    ``after`` holds the bytes from each anchor on, ``before`` the bytes in front
    of it backwards. A window that starts r bytes before its anchor is the same
    as another's if r bytes before and LENGTH - r bytes after are the same.
    """
    position, back, front = place_parts(place)
    forward = SuffixOrder(after, LENGTH - front, group, hasher)
    reverse = SuffixOrder(before, back, group, hasher)
    earliest = np.lexsort((place, doc))
    out = []
    repeated = np.zeros((len(doc), SPAN + 1), dtype=bool)
    for r in range(SPAN):
        have = earliest[(front[earliest] <= r) & (r <= back[earliest])]
        if len(have) < 2:
            continue
        same = forward.classes(LENGTH - r)[have] * (len(doc) + 1) + reverse.classes(r)[have]
        _, first = np.unique(same, return_index=True)
        later = np.ones(len(have), dtype=bool)
        later[first] = False
        repeated[have[later], r] = True
    edges = np.diff(np.pad(repeated, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    for_row, least = np.nonzero(edges == 1)
    _, most = np.nonzero(edges == -1)
    out = (doc[for_row], position[for_row] - (most - 1), position[for_row] - least + LENGTH)
    return cover_batch(*out)


def sort_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of anchors sorted by k-gram, some whole groups at a time."""
    hasher = Hasher()

    def compare(rows: pa.Table) -> pa.RecordBatch:
        key, doc, place = (rows.column(c).to_numpy() for c in ("key", "doc", "place"))
        around = np.frombuffer(b"".join(rows.column("around").to_pylist()), dtype=np.uint8).reshape(len(key), SPAN - 1 + LENGTH)
        return repeated_windows(np.cumsum(np.r_[True, key[1:] != key[:-1]]), doc, place, around[:, SPAN - 1 :], around[:, SPAN - 2 :: -1], hasher)

    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        starts = np.flatnonzero(np.r_[last is None or key[0] != last, key[1:] != key[:-1]])
        done = 0
        for s in starts[:: max(1, CHUNK // 64)].tolist():
            if n + s - done >= CHUNK:
                held.append(batch.slice(done, s - done))
                yield compare(pa.Table.from_batches(held))
                held, n, done = [], 0, s
        held.append(batch.slice(done))
        n += batch.num_rows - done
        last = key[-1]
    if held:
        yield compare(pa.Table.from_batches(held))


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each anchor of a text, zeros beyond what its windows cover."""
    for batch in batches:
        keys, docs, places, around = [], [], [], []
        for doc, data, anchors in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = data.as_buffer().to_pybytes() if data.as_buffer() is not None else b""
            for x in anchors:
                position, back, front = (int(v) for v in place_parts(np.int64(x["place"])))
                keys.append(x["key"])
                docs.append(doc)
                places.append(x["place"])
                around.append(bytes(SPAN - 1 - back) + data[position - back : position - front + LENGTH] + bytes(front))
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(around, pa.binary())], names=["key", "doc", "place", "around"])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, doc, lo) of every window of each anchor, by the digest of its bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, place = (np.asarray(batch.column(c)) for c in (1, 2))
        position, back, front = place_parts(place)
        around = batch.column(3).to_pylist()
        for r in range(SPAN):
            at = np.flatnonzero((front <= r) & (r <= back))
            s = SPAN - 1 - r
            names = [digest_of(around[i][s : s + LENGTH]) for i in at.tolist()]
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(doc[at]), pa.array(position[at] - r)], names=["window", "doc", "lo"])


def repeated_by_digest(around: DataFrame) -> DataFrame:
    """(doc, range) of windows that start earlier too: a window's first place is found before rows are shuffled."""
    rows = stage(around.mapInArrow(windows, "window binary, doc long, lo long"))
    first = stage(rows.groupBy("window").agg(F.min(F.struct("doc", "lo")).alias("first")))
    later = rows.join(first, "window").where(F.struct("doc", "lo") > F.col("first"))
    return later.select("doc", F.struct("lo", (F.col("lo") + LENGTH).alias("ends")).alias("range"))


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
RESULT_KINDS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
RESULT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, data, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = data.as_py() or b""
            at, cut, spans, kept = 0, 0, 0, []
            for lo, end in sorted((x["lo"], x["ends"]) for x in ranges):
                if lo > at or not spans:
                    kept.append(data[at:lo])
                    spans += 1
                    cut += end - lo
                elif end > at:
                    cut += end - at
                at = max(at, end)
            kept.append(data[at:])
            out.append((doc_id, len(data), cut, spans, b"".join(kept)))
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), RESULT_TYPES)], names=RESULT)


def sieve(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may be in ``wanted``, and the others.

    The filter has one size for every corpus, so it may go to every task; tasks
    build its parts. Where it lets a document pass for nothing, the join behind
    it drops it.
    """
    low = 15
    cell = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found.setdefault(at >> low, np.zeros(1 << low, dtype=bool))[at & ((1 << low) - 1)] = True
        if found:
            yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], names=["block", "bits"])

    cells = wanted.select(cell.alias("cell")).distinct().repartition(F.shiftright("cell", low))
    bits = np.zeros((1 << (FILTER_BITS - low), 1 << (low - 3)), dtype=np.uint8)
    for block, packed in cells.mapInArrow(pack, "block int, bits binary").collect():
        bits[block] = np.frombuffer(packed, dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def passing(keep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.asarray(batch.column(3))
                found = (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                yield batch.select([0, 1, 2]).filter(pa.array(found == keep))

        return docs.select("doc", "doc_id", "data", cell.alias("cell")).mapInArrow(run, "doc long, doc_id long, data binary")

    return passing(True), passing(False)


def ordered_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, data): ``doc`` is a number of its own for each row, in the order of documents.

    Where doc_ids are such numbers they serve. Else rows are sorted over all tasks
    by doc_id, null first, then by their text's hash, and numbered as they come;
    fully equal rows in any order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "data")
    turn = rows.withColumn("tie", F.xxhash64("data")).withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))
    order = ["doc_id", "tie", "turn"]
    sorted_ = turn.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(sorted_.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "data"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every text as UTF-8 bytes without what is repeated.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a
    smaller doc_id, or before in the same document. Null and empty texts, and
    texts under LENGTH bytes, lose nothing. Null doc_ids come first. Rows that
    share a doc_id, or have none, are documents of their own, ordered by their
    text's hash; so a repeated row loses all if it has LENGTH bytes. A text holds
    at most 2 GB. Other columns of ``docs`` are left behind, whatever their names.
    """
    source = ordered_documents(docs, id_col, text_col)
    dealt = source.select("doc", "data").mapInArrow(find_anchors, MARKS).repartition("key").sortWithinPartitions("key", "context", "doc", "place")
    marks = stage(dealt.mapInArrow(resolve, MARKS).drop("context"))
    ends = marks.where("ends is null").select("doc", "key", "place")
    frequent = stage(ends.groupBy("key").count().where(F.col("count") > hot).select("key"))
    edges = stage(ends.groupBy("doc").agg(F.collect_list(F.struct("key", "place")).alias("anchors")))
    texts, _ = sieve(source, edges.select("doc"))
    around = texts.join(edges, "doc").select("doc", "data", "anchors").mapInArrow(contexts, "key long, doc long, place long, around binary")
    some = not frequent.isEmpty()
    around = stage(around) if some else around
    sorted_ = around.join(frequent, "key", "left_anti") if some else around
    late = sorted_.repartition("key").sortWithinPartitions("key").mapInArrow(sort_edges, MARKS).drop("context")
    covers = marks.where("ends is not null").unionByName(late).select("doc", F.struct(F.shiftright("place", 14).alias("lo"), "ends").alias("range"))
    if some:
        covers = covers.unionByName(repeated_by_digest(around.join(frequent, "key", "left_semi").select("key", "doc", "place", "around")))
    ranges = stage(covers.groupBy("doc").agg(F.collect_set("range").alias("ranges")))
    cut, whole = sieve(source, ranges.select("doc"))
    none = F.array().cast(ranges.schema["ranges"].dataType)
    changed = cut.join(ranges, "doc", "left").select("doc_id", "data", F.coalesce("ranges", none).alias("ranges")).mapInArrow(removed, RESULT_KINDS)
    zero = F.lit(0).cast("long")
    same = whole.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("data").alias("kept"))
    return changed.unionByName(same)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
