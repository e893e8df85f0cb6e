"""Byte-level BPE with a two-tier lookup.

Most pre-tokens of a text are themselves in the vocabulary. A minimal perfect
hash over the vocabulary resolves those in one probe and one comparison. Only
the others are merged, with a heap of candidate pairs over a doubly linked list
of byte pieces.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from acrelight.llm.common import documents, id_text

MASK = (1 << 64) - 1
#: Up to so many new words of a text are matched one by one.
FEW = 8
ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"
ENCODED_TYPES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash of fixed keys by levels of collision-free bits.

    Each level hashes the remaining keys into a bit array twice their number;
    keys alone in their bit stay there, the others go to the next level. A key's
    index is the number of bits set before its own, so indices are 0 to n - 1.
    """

    def __init__(self, keys: list[bytes]):
        hashes = np.array([self.hashed(k) for k in keys], dtype=np.uint64)
        if len(set(hashes.tolist())) != len(keys):
            raise ValueError("two keys have the same 64-bit hash")
        # most foreign keys have a place here that no key has
        self.few = (1 << (16 * len(keys)).bit_length()) - 1
        taken = np.zeros(self.few + 1, dtype=bool)
        taken[(hashes & np.uint64(self.few)).astype(np.int64)] = True
        self.taken = taken.tobytes()
        self.levels: list[tuple[int, int, list[int]]] = []
        index = np.empty(len(keys), dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        while len(left):
            size = 2 * len(left) + 1
            slot = self.mixed_all(hashes[left], len(self.levels)) % np.uint64(size)
            slot = slot.astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            place = np.where(alone, base + np.cumsum(alone) - 1, -1).astype(np.int32)
            self.levels.append(((len(self.levels) * 0x9E3779B97F4A7C15) & MASK, size, place.tolist()))
            stays = alone[slot]
            index[left[stays]] = place[slot[stays]]
            base += int(alone.sum())
            left = left[~stays]
        self.index = index

    @staticmethod
    def hashed(key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key)

    @staticmethod
    def mixed_all(h: np.ndarray, level: int) -> np.ndarray:
        h = h ^ np.uint64((level * 0x9E3779B97F4A7C15) & MASK)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))

    def __call__(self, key: bytes) -> int:
        """The key's index; for a foreign key any index or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        if not self.taken[h & self.few]:
            return -1
        for salt, size, place in self.levels:
            x = h ^ salt
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
            at = place[(x ^ (x >> 31)) % size]
            if at >= 0:
                return at
        return -1


class Codec:
    """Encodes pre-tokens to ids by ``ranks`` and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = list(ranks)
        self.ranks = ranks
        self.of_two = [[ranks.get(bytes((x, y)), -1) for y in range(256)] for x in range(256)]
        self.hash = PerfectHash(tokens)
        self.keys: list[bytes] = [b""] * len(tokens)
        self.ids = [0] * len(tokens)
        for i, token in zip(self.hash.index.tolist(), tokens):
            self.keys[i], self.ids[i] = token, ranks[token]
        self.bytes_of: dict[int, bytes] = {rank: token for token, rank in ranks.items()}

    def encode_piece(self, piece: bytes) -> list[int]:
        at = self.hash(piece)
        if at >= 0 and self.keys[at] == piece:
            return [self.ids[at]]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is left: O(n log n) for n bytes.

        The heap holds rank * n + start of each pair, whole numbers in place of
        tuples. An entry counts while it is that of the pair that starts there.
        """
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        rank_of = self.ranks.get
        current, heap = [], []  # current: the entry of the pair that starts here, -1 if none
        for a, (x, y) in enumerate(zip(piece, piece[1:])):
            rank = self.of_two[x][y]
            if rank >= 0:
                rank = rank * n + a
                heap.append(rank)
            current.append(rank)
        current.append(-1)
        heapify(heap)
        while heap:
            entry = heappop(heap)
            a = entry % n
            if current[a] != entry:
                continue
            b = end[a]
            c = end[a] = end[b]
            current[b] = current[a] = -1
            if c < n:
                before[c] = a
                rank = rank_of(piece[a : end[c]])
                if rank is not None:
                    current[a] = entry = rank * n + a
                    heappush(heap, entry)
            if a:
                b = before[a]
                current[b] = -1
                rank = rank_of(piece[b:c])
                if rank is not None:
                    current[b] = entry = rank * n + b
                    heappush(heap, entry)
        ids, a = [], 0
        while a < n:
            b = end[a]
            ids.append(self.ranks[piece[a:b]])
            a = b
        return ids


class PieceIds(dict):
    """Pre-tokens met so far and their ids, as little-endian unsigned 32-bit bytes; forgets all when full, so its memory is bounded.

    The limit is such that the rare words of several tasks fit. Unlike lists, bytes are nothing that the garbage collector goes through again and again.
    """

    def __init__(self, codec: Codec, limit: int = 1_200_000):
        super().__init__()
        self.codec, self.limit = codec, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_piece(piece.encode())
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class SpacedIds(dict):
    """Ids of words that follow a space, that space included, as ``PieceIds`` holds those of pre-tokens.

    Only for a pattern of which every match ends before a space that a visible
    character follows, and may begin with that space: then words between such
    spaces are matched alike alone. Texts with other spaces are matched whole.
    """

    def __init__(self, pieces: PieceIds, pattern: str, limit: int = 600_000):
        import regex

        super().__init__()
        self.codec, self.piece, self.split, self.limit = pieces.codec, pieces.__getitem__, regex.compile(pattern).findall, limit
        self.other = regex.compile(r" (?:\s|\Z)").search

    def __missing__(self, word: str) -> bytes:
        ids = self.matched(" " + word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids

    def matched(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def encode(self, text: str) -> bytes:
        if self.other(text):
            return self.matched(text)
        words = text.split(" ")
        new = [word for word in islice(words, 1, None) if word not in self]
        if len(new) > FEW:
            self.learn(list(dict.fromkeys(new)))
        return self.matched(words[0]) + b"".join(map(self.__getitem__, islice(words, 1, None)))

    def learn(self, new: list[str]) -> None:
        """Takes up words, which are matched all at once: a match that begins with a space begins a word."""
        if len(self) + len(new) > self.limit:
            self.clear()
        pieces, at = self.split(" " + " ".join(new)), 0
        for word in new:
            ids, at = self.piece(pieces[at]), at + 1
            while at < len(pieces) and pieces[at][0] != " ":
                ids, at = ids + self.piece(pieces[at]), at + 1
            if len(word) <= 64:
                self[word] = ids


@lru_cache(maxsize=1)
def known_words(ranks_path: str, changed: int, pattern: str) -> SpacedIds:
    """What a worker knows of words, kept from task to task; ``changed`` is when the file at ``ranks_path`` was written."""
    return SpacedIds(PieceIds(Codec(read_ranks(ranks_path))), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spaced: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes
    that they stand for. ``ranks_path`` is readable on every worker. A null or
    empty text has no tokens; repeated rows are encoded each for itself.
    ``spaced`` patterns are those of ``SpacedIds``, which takes them faster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_words(ranks_path, os.stat(ranks_path).st_mtime_ns, pattern)
        bytes_of = words.codec.bytes_of
        ids_of = words.encode if spaced else words.matched

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), ENCODED_TYPES.types)], schema=ENCODED_TYPES)

        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py())
                out.append((doc_id, len(ids) // 4, ids, decode(ids, bytes_of)))
                held += len(ids) // 4
                if held > 4_000_000:
                    yield batch_of(out)
                    out, held = [], 0
            if out:
                yield batch_of(out)

    return id_text(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(ids: bytes, bytes_of: dict[int, bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    coded = encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, spaced=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
