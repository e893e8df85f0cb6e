"""Media columns by content-defined chunking.

A payload is cut where a rolling gear hash of its last 32 bytes has its high
bits clear, so equal passages give equal chunks wherever they stand. Joins over
chunk digests find the chunks that occur more than once; each of those bodies
is stored once in a chunk table. Bodies that occur once stay in their
document's own row. An ordered chunk list per document rebuilds the payload,
and every body read back is verified against its digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.llm.common import documents, id_text, stage

FRAME = 576
LEAST, USUAL, MOST = 256, 1024, 8192
#: Bits of the shared-digest filter that tasks get; its size is the same for every input.
FILTER_BITS = 26
GEAR = np.random.default_rng(19).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(text: str) -> bytes:
    """UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576."""
    data = text.encode()
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def cut_points(data: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """The ends of the chunks of ``data``: content-defined, at least ``least`` bytes but for the last, at most ``most``."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    found = (np.flatnonzero(h >> np.uint32(32 - (usual - 1).bit_length()) == 0) + 1).tolist()
    cuts, last = [], 0
    for at in found:
        while at - last > most:
            last += most
            cuts.append(last)
        if at - last >= least:
            last = at
            cuts.append(last)
    while len(data) - last > most:
        last += most
        cuts.append(last)
    return cuts if last == len(data) else [*cuts, len(data)]


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


def cell(key: bytes) -> int:
    return int.from_bytes(key[:8], "little") & ((1 << FILTER_BITS) - 1)


def shared_filter(digests: DataFrame) -> np.ndarray:
    """One bit for each hash cell, set where a digest occurs twice.

    Its size is fixed, so it may go to every task. A set bit may also be another
    digest's; such a chunk takes the shared path for nothing, with the same result.
    """
    words = 1 << 12
    twice = digests.groupBy("digest", "cell").count().where("count > 1").select("cell").distinct()
    packed = twice.groupBy((F.col("cell") / words).cast("int").alias("block")).agg(F.collect_set((F.col("cell") % words).cast("int")).alias("cells"))
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for block, cells in packed.toLocalIterator():
        bits[block * words + np.array(cells)] = True
    return np.packbits(bits)


def unit_of(chunk: bytes) -> bytes:
    """A chunk as it is stored: its length as a little-endian unsigned 32-bit integer, then its 8-bit samples."""
    return struct.pack("<I", len(chunk)) + chunk


def chunk_of(unit: bytes) -> bytes:
    """The samples of a stored unit, whose length must be the one that it states."""
    if len(unit) < 4 or struct.unpack_from("<I", unit)[0] != len(unit) - 4:
        raise ValueError("a stored unit is damaged")
    return unit[4:]


ROWS = "doc_id long, row binary, n_bytes long, chunk_list array<struct<digest:binary,length:int,shared:boolean>>, bodies binary"
ROW_TYPES = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("n_bytes", pa.int64()), ("chunk_list", pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("shared", pa.bool_())]))), ("bodies", pa.binary())])


class MediaStore:
    """Staged tables: ``rows``, one for each input row, with its chunk list and its private bodies; ``chunks``, shared bodies by digest."""

    def __init__(self, rows: DataFrame, chunks: DataFrame):
        self.rows, self.chunks = rows, chunks

    def read(self) -> DataFrame:
        """(doc_id, n_bytes, pieces): the bodies in order, private ones from the row, shared ones by joins with the chunk table.

        Rows without shared chunks take no join. Equal payloads fetch their
        chunks once. A frequent chunk's or payload's rows are split by adaptive
        execution; what meets for one row is its own payload.
        """
        rows = self.rows
        own = rows.where(~F.exists("chunk_list", lambda c: c["shared"]))
        mixed = rows.where(F.exists("chunk_list", lambda c: c["shared"]))
        wanted = mixed.select("row", F.explode(F.array_distinct(F.transform(F.filter("chunk_list", lambda c: c["shared"]), lambda c: c["digest"]))).alias("digest")).distinct()
        fetched = stage(wanted.join(self.chunks, "digest").groupBy("row").agg(F.collect_list(F.struct("digest", "body")).alias("fetched")))
        none = F.lit(None).cast(fetched.schema["fetched"].dataType)
        return mixed.join(fetched, "row", "left").select(*rows.columns, "fetched").unionByName(own.withColumn("fetched", none))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> MediaStore:
    """Chunk and store the payload of every text.

    A null text counts as empty; repeated rows are stored each with its own list.
    Other columns of ``docs`` are left behind, whatever their names. A text of
    any length is one payload, held by one task at a time.
    """
    source = id_text(docs, id_col, text_col)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [digest(x) for text in batch.column(1) for x in chunks_of(payload_of(text.as_py()))]
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(map(cell, keys), pa.int32())], names=["digest", "cell"])

    bits = source.sparkSession.sparkContext.broadcast(shared_filter(source.mapInArrow(digests, "digest binary, cell int")))

    def is_shared(key: bytes) -> bool:
        at = cell(key)
        return bool(bits.value[at >> 3] >> (7 - (at & 7)) & 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                bodies = chunks_of(payload_of(text))
                keys = list(map(digest, bodies))
                shared = list(map(is_shared, keys))
                name = digest(b"".join(keys))[:16]
                out.append((doc_id, name, len(text.encode()), [{"digest": k, "length": len(x) + 4, "shared": s} for k, x, s in zip(keys, bodies, shared)], b"".join(unit_of(x) for x, s in zip(bodies, shared) if not s)))
                if len(out) == 1000:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), ROW_TYPES.types)], schema=ROW_TYPES)
                    out = []
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), ROW_TYPES.types)], schema=ROW_TYPES)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in batches:
            out = {}
            for text in batch.column(1):
                for x in chunks_of(payload_of(text.as_py())):
                    if is_shared(k := digest(x)) and k not in told:
                        out[k] = unit_of(x)
            told = told | out.keys() if len(told) < 500_000 else set(out)
            yield pa.record_batch([pa.array(out, pa.binary()), pa.array(out.values(), pa.binary())], names=["digest", "body"])

    chunks = source.mapInArrow(bodies, "digest binary, body binary").groupBy("digest").agg(F.first("body").alias("body"))
    return MediaStore(stage(source.mapInArrow(rows, ROWS)), stage(chunks))


def samples_feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and the most frequent value of the 8-bit samples."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    values, n = np.arange(256), len(payload)
    mean = float(counts @ values) / n
    deviation = (max(0.0, float(counts @ (values * values)) / n - mean * mean)) ** 0.5
    share = counts[counts > 0] / n
    return f"{mean:.4f} {deviation:.4f} {-float((share * np.log2(share)).sum()):.4f} {int(counts.argmax())}"


def read_back(media: MediaStore) -> DataFrame:
    """Digests and features of every payload, from the stored bytes alone.

    The stored form of a payload is the sequence of its stored units, in the
    order of its chunk list, as ``unit_of`` makes them: ``media_*`` are of these
    bytes. A unit that is missing, or whose chunk doesn't have its digest, fails
    the job. An empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc_id, n_bytes, wanted, private, fetched = (batch.column(c)[i].as_py() for c in ("doc_id", "n_bytes", "chunk_list", "bodies", "fetched"))
                have = {x["digest"]: x["body"] for x in fetched or ()}
                pieces, at = [], 0
                for c in wanted:
                    if c["shared"]:
                        body = have[c["digest"]]
                    else:
                        body = private[at : at + c["length"]]
                        at += c["length"]
                    if digest(chunk_of(body)) != c["digest"]:
                        raise ValueError(f"document {doc_id}: a stored chunk is damaged")
                    pieces.append(body)
                payload = b"".join(map(chunk_of, pieces))
                framed = b"".join(pieces)
                out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(framed), hashlib.sha256(framed).hexdigest(), samples_feature(payload)))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return media.read().select("doc_id", "n_bytes", "chunk_list", "bodies", "fetched").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(documents(spark, sf_dir)))
