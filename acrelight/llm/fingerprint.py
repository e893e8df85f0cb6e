"""Order MinHash fingerprints: signatures that follow edit distance.

A text's k-mers are numbered by occurrence, so repeats count. For each of many
hash functions the ``tuple_size`` smallest numbered k-mers are put back in text
order and hashed as one tuple. Two texts agree on a component when they share
those k-mers in the same order, which a set-based sketch would not notice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.llm.common import documents, id_text, stage

KMER = 12
COMPONENTS = 64
TUPLE = 2
#: So many hash values are worked on at once.
TOGETHER = 1 << 16


class OrderMinHash:
    """Signatures of ``components`` 16-bit values as hex; a text without characters has all zeros.

    A text shorter than a k-mer counts as one k-mer. ``seed`` fixes the hash functions.
    """

    def __init__(self, kmer: int = KMER, components: int = COMPONENTS, tuple_size: int = TUPLE, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.kmer, self.components, self.tuple_size = kmer, components, tuple_size
        self.factors = draw.integers(0, 2**32, components, dtype=np.uint32) | np.uint32(1)
        self.masks = draw.integers(0, 2**32, components, dtype=np.uint32)

    def numbered_kmers(self, text: str) -> np.ndarray:
        """32-bit hashes of the k-mers with their occurrence numbers, in text order."""
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        k = min(self.kmer, len(codes))
        n = len(codes) - k + 1
        base, h = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h *= base
            h += codes[j : j + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        in_order = np.sort(h)
        if (repeated := in_order[1:][in_order[1:] == in_order[:-1]]).size:
            at = np.flatnonzero(np.isin(h, repeated))
            at = at[np.argsort(h[at], kind="stable")]
            starts = np.r_[True, h[at][1:] != h[at][:-1]]
            first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            h[at] += (np.arange(len(at)) - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(32)).astype(np.uint32)

    def __call__(self, text: str) -> str:
        if not text:
            return "0000" * self.components
        kmers = self.numbered_kmers(text)
        picked = np.empty((self.components, min(self.tuple_size, len(kmers))), dtype=np.int64)
        step = max(1, TOGETHER // len(kmers))
        for first in range(0, self.components, step):
            some = slice(first, first + step)
            v = (kmers[None, :] ^ self.masks[some, None]) * self.factors[some, None]
            for i in range(picked.shape[1]):
                picked[some, i] = at = v.argmin(axis=1)
                v[np.arange(len(v)), at] = 0xFFFFFFFF
        picked.sort(axis=1)
        mixed = np.zeros(self.components, dtype=np.uint64)
        for i in range(picked.shape[1]):
            mixed = (mixed ^ kmers[picked[:, i]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        out = ((mixed >> np.uint64(40)) & np.uint64(0xFFFF)).astype(">u2")
        return out.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal components of two fingerprints."""
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text, of any length; null texts count as empty, repeated rows are kept, other columns left behind."""
    types = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(sketch, texts), pa.string())], schema=types)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


PAIRS = "edge int, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PAIR_TYPES = pa.schema([("edge", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared(sketch: OrderMinHash, text: str, own: str, following: str, other: str) -> tuple:
    """n_chars to near_next of ``text`` with fingerprint ``own``, followed by a text with fingerprint ``other``."""
    changed = len(text) // 4
    edited = text[: len(text) - changed] + following[:changed]
    edited_print = sketch(edited)
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), own, edited_print, likeness(own, edited_print), likeness(own, other)


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form and how near both and the next document are.

    The edited form has its last quarter replaced by the start of the next
    document by doc_id, the first following the last; equal doc_ids go by their
    text's hash, null doc_ids come first. One range shuffle puts neighbours
    together; each task holds two texts at a time. Only the first and last
    document of each task, two rows a task, meet in a second small job. An empty
    table gives no rows; a lone document is its own neighbour. Null texts count as
    empty; other columns of ``docs`` are left behind, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, part = OrderMinHash(), TaskContext.get().partitionId()
        before: tuple | None = None
        nothing = (None,) * 6
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                here = (doc_id, text, sketch(text))
                if before is None:
                    out.append((1, part, doc_id, text, *nothing))
                else:
                    out.append((0, part, before[0], None, *compared(sketch, *before[1:], text, here[2])))
                before = here
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), PAIR_TYPES.types)], schema=PAIR_TYPES)
        if before is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((2, part, before[0], before[1], *nothing), PAIR_TYPES.types)], schema=PAIR_TYPES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash()
        for batch in batches:
            out = []
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((doc_id, *compared(sketch, text, sketch(text), following, sketch(following))))
            if out:
                yield pa.record_batch([pa.array(x, PAIR_TYPES.field(n).type) for x, n in zip(zip(*out), RESULT)], names=RESULT)

    spark = docs.sparkSession
    keyed = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows = stage(ordered.mapInArrow(run, PAIRS))
    used = sorted(r[0] for r in rows.where("edge = 1").select("part").collect())
    follow = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "part int, next int")
    last = rows.where("edge = 2").select("part", "doc_id", "text")
    first = rows.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    edges = last.join(F.broadcast(follow), "part").join(first, "next").select("doc_id", "text", "following")
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in RESULT)
    return rows.where("edge = 0").select(*RESULT).unionByName(edges.mapInArrow(meet, kinds))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(documents(spark, sf_dir))
