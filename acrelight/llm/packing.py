"""Packing token sequences by cutting-stock column generation.

Documents are tokenised and cut into whole sequences, then, where more than half
a sequence is left, at half a sequence: pieces of up to half a sequence fill
patterns with hardly any padding. The pieces' lengths, in units of a few tokens, form a histogram whose size is fixed
by the sequence length. Over it a linear program chooses how often to use each
filling pattern of a sequence; a knapsack dynamic program prices new patterns.
The rounded patterns are runs of ranks within each length class, so every piece
finds its sequence from its rank alone, by a join with the small pattern table.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelight.llm.common import documents, id_text, stage

SEQUENCE = 2048
UNIT = 8
#: About so many pieces of one length class are ranked in one task.
RANKED = 500_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
PIECE_TYPES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


class WordIds(dict):
    """White-space separated words and their ids, as little-endian unsigned 32-bit bytes; forgets all when full, so its memory is bounded.

    New words of plain Latin letters, digits and symbols skip the tokenizer's
    normaliser, which leaves these alone but for case: they are split here, by
    the tokenizer's own pattern, and go straight to its model. Their parts are
    remembered as well, since a word has many forms by case and punctuation.
    """

    def __init__(self, tokenizer, limit: int = 600_000, parts_limit: int = 1_000_000):
        super().__init__()
        import json

        import regex

        self.tokenizer, self.limit, self.parts_limit = tokenizer, limit, parts_limit
        self.parts: dict[str, bytes] = {}
        stages = json.loads(tokenizer.to_str())
        splits = stages["pre_tokenizer"]["pretokenizers"]
        own = [x["type"] for x in stages["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        # without U+0130, whose lower case is two characters
        self.plain = regex.compile("[\\x21-\\x7e\\xa1-\\u012f\\u0131-\\u024f]+").fullmatch if own else lambda word: None
        self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall if own else None
        # byte-level BPE spells bytes as characters: printable ones as themselves, the rest from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = sorted(set(range(256)) - set(shown))
        self.spelled = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.model = tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if self.plain(word) and "<|" not in word:
            found = b"".join(map(self.part, self.split(word.lower())))
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = found
        return found

    def part(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            ids = [token.id for token in self.model(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.spelled))]
            if len(self.parts) >= self.parts_limit:
                self.parts.clear()
            found = self.parts[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found


@lru_cache(maxsize=1)
def known_words(vocabulary: str, changed: int) -> WordIds:
    """What a worker knows of words, kept from task to task; ``changed`` is when the file ``vocabulary`` was written."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(vocabulary))


def white_space_words(text: str) -> list[str]:
    """Words between Unicode white space; unlike ``str.split``, control characters 28 to 31 don't separate."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        import regex

        return regex.findall(r"\P{White_Space}+", text)
    return text.split()


def cuts(n: int, sequence: int) -> Iterator[tuple[int, int]]:
    """Where to cut ``n`` tokens: whole sequences, then half a sequence if more than that is left."""
    a = 0
    while a < n:
        b = min(n, a + (sequence if n - a >= sequence else sequence // 2))
        yield a, b
        a = b


def tokenize_pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) pieces of every document.

    ``vocabulary`` is the path of a tokenizers file whose pre-tokenizer never
    crosses white space, on every worker. ``ids`` holds little-endian unsigned
    32-bit ids; each document ends with ``end_id``. A null or empty text gives
    one piece of that id alone; an empty table no pieces; repeated rows and
    null doc_ids are kept as they are. A text of any length is tokenised whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = known_words(vocabulary, os.stat(vocabulary).st_mtime_ns), struct.pack("<I", end_id)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(map(words.__getitem__, white_space_words(text.as_py()))) + end
                n = len(ids) // 4
                for a, b in cuts(n, sequence):
                    out.append((doc_id, a, b - a, n, ids[4 * a : 4 * b]))
                held += n
                if held > 4_000_000:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), PIECE_TYPES.types)], schema=PIECE_TYPES)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), PIECE_TYPES.types)], schema=PIECE_TYPES)

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The unbounded knapsack: most value in ``capacity`` units, where u units are worth ``value[u]``."""
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        sums = best[c - 1 :: -1] + value[1 : c + 1]
        u = int(sums.argmax())
        if sums[u] > best[c - 1]:
            best[c], taken[c] = sums[u], u + 1
        else:
            best[c] = best[c - 1]
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if u := int(taken[c]):
            pattern[u] = pattern.get(u, 0) + 1
            c -= u
        else:
            c -= 1
    return float(best[capacity]), pattern


def relaxed_patterns(demand: dict[int, int], capacity: int, gap: float, rounds: int) -> list[tuple[dict[int, int], float]]:
    """Column generation for min sum(x) with patterns covering ``demand``: a revised simplex over one row per length class.

    Ends once the dual bound is within ``gap`` of the value, or after ``rounds``
    new patterns for each class; an early end costs padding, never a piece.
    """
    units = sorted(demand)
    row = {u: i for i, u in enumerate(units)}
    patterns = [{u: capacity // u} for u in units]
    inverse = np.diag([1.0 / (capacity // u) for u in units])
    x = inverse @ np.array([demand[u] for u in units], dtype=float)
    for _ in range(rounds * len(units) + 50):
        prices = inverse.sum(axis=0)
        value = np.full(capacity + 1, -np.inf)
        value[units] = np.where(prices > 1e-12, prices, -np.inf)
        worth, pattern = best_pattern(value, capacity)
        if worth <= 1 + gap:
            break
        column = np.zeros(len(units))
        for u, n in pattern.items():
            column[row[u]] = n
        step = inverse @ column
        usable = step > 1e-9
        ratio = np.full(len(units), np.inf)
        ratio[usable] = x[usable] / step[usable]
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        x = np.maximum(x - ratio[leaves] * step, 0)
        x[leaves] = ratio[leaves]
        inverse[leaves] /= step[leaves]
        others = step.copy()
        others[leaves] = 0
        inverse -= np.outer(others, inverse[leaves])
        patterns[leaves] = pattern
    return list(zip(patterns, x))


def whole_patterns(demand: dict[int, int], capacity: int, gap: float = 1e-3, rounds: int = 12) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often to use them, for exactly ``demand`` pieces of each class.

    Rounds the linear program down; what is left, a few pieces of each class, is
    filled largest first.
    """
    left = {u: n for u, n in demand.items() if n > 0}
    chosen: list[tuple[dict[int, int], int]] = []
    if capacity in left:
        chosen.append(({capacity: 1}, left.pop(capacity)))
    if not left:
        return chosen
    for pattern, x in relaxed_patterns(left, capacity, gap, rounds):
        times = min([int(x + 1e-9), *(left.get(u, 0) // n for u, n in pattern.items())])
        if times > 0:
            chosen.append((pattern, times))
            for u, n in pattern.items():
                left[u] -= n * times
    while left := {u: n for u, n in left.items() if n > 0}:
        room, pattern = capacity, {}
        for u in sorted(left, reverse=True):
            if n := min(left[u], room // u):
                pattern[u] = n
                room -= n * u
        times = min(left[u] // n for u, n in pattern.items())
        chosen.append((pattern, times))
        for u, n in pattern.items():
            left[u] -= n * times
    return chosen


def staged_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces`` as a table, each with a number of its own that also deals them out evenly, whatever their content."""
    return stage(pieces.withColumn("_turn", F.xxhash64(F.monotonically_increasing_id())))


def assign_sequences(pieces: DataFrame, sequence: int = SEQUENCE, unit: int = UNIT, ranked: int = RANKED) -> DataFrame:
    """``staged_pieces`` with sequence_id and offset.

    The driver sees counts by length class and sends back the pattern runs: both
    bounded by the sequence length, whatever the input. Pieces are ranked within
    class and salt; there are as many salts as leave about ``ranked`` pieces to
    each, so a class that holds most pieces is spread over many tasks.
    """
    spark = pieces.sparkSession
    capacity = sequence // unit
    of_class = F.ceil(F.col("length") / unit).cast("int").alias("_class")
    demand = dict(sorted(tuple(r) for r in pieces.groupBy(of_class).count().collect()))
    salts = max(64, -(-max(demand.values(), default=0) // ranked))
    salted = pieces.withColumn("_class", of_class).withColumn("_salt", F.pmod("_turn", F.lit(salts)).cast("int"))
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(demand, 0)
    sequences = 0
    for pattern, times in whole_patterns(demand, capacity):
        for u, n in pattern.items():
            runs.append((u, used[u], used[u] + n * times, n, sequences))
            used[u] += n * times
        sequences += times
    counts = salted.groupBy("_class", "_salt").count()
    upto = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("_class", "_salt", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_first"))
    slots = spark.createDataFrame(runs, "_class int, _from long, _to long, _each long, _base long")
    placed = (
        salted.withColumn("_at", F.row_number().over(Window.partitionBy("_class", "_salt").orderBy("_turn")) - 1)
        .join(ranks, ["_class", "_salt"])
        .withColumn("_rank", F.col("_first") + F.col("_at"))
        .join(F.broadcast(slots), "_class")
        .where("_rank >= _from and _rank < _to")
        .withColumn("sequence_id", F.expr("_base + (_rank - _from) div _each"))
    )
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    own = [c for c in pieces.columns if c != "_turn"]
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*own, "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces with their ids, sequence_id and offset: training sequences as rows.

    Nulls, repeated rows and long texts are as in ``tokenize_pieces``; other
    columns of ``docs`` are left behind, whatever their names.
    """
    return assign_sequences(staged_pieces(tokenize_pieces(docs, vocabulary, sequence, end_id, id_col, text_col)), sequence)


def packed_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As ``pack``, with the checksum of each piece's ids in place of the ids."""
    pieces = tokenize_pieces(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assign_sequences(staged_pieces(pieces))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
