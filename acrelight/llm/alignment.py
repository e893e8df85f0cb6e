"""Cross-tokenizer alignment by external spill counting.

Two tokenizers cut the same bytes. Where tokens of both end, the pair of ids is
linked. A task aligns blocks of documents and spills each block's records: for
every document the numbers of its pairs with their counts, which stay with the
block, and the block's own pairs in side-major order, second tokenizer's id
first. These are radix-partitioned by that id into zstd runs; whoever has a
radix merges its runs by a heap, which counts each pair over the corpus and, at
the end of each id, knows the id's highest count. Both go back, run by run, to
the blocks that the runs are from, where they add up for each document.

A pair that every document has costs a radix one record for each block, however
many documents there are, so no id's group holds more than a small share.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import count, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.llm.common import documents, id_text, stage

#: A block ends after so many words; a task remembers so many distinct ones, and cuts texts at so many characters.
BLOCK_WORDS = 500_000
KNOWN_WORDS = 250_000
SLICE = 1 << 20
BETWEEN = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: New words are given to the tokenizers so many at once.
JOINED = 500
#: About so many records of a radix are merged in one task.
MERGED = 1_000_000
LEAST_RADIXES = 64
SPILLED = "block long, doc_id long, n_a long, n_b long, n_groups long, groups string, n_pairs long, records binary"
SPILLED_TYPES = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("n_pairs", pa.int64()), ("records", pa.binary())])
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long"
COUNTED_TYPES = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one zstd frame; whole numbers in order are stored by their steps."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpacked(data: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, dtype=t, count=n, offset=at))
        at += n * np.dtype(t).itemsize
    return out


def plain(word: str) -> bool:
    """Whether a word may be joined with others: a space or line feed, then no white space at either end, and no mark that stands for a space."""
    return len(word) > 1 and word[0] in " \n" and not word[1].isspace() and not word[-1].isspace() and "▁" not in word


class Aligner:
    """Aligns words, each with the space or line feed before it, and remembers them.

    No token of either tokenizer goes on over a lone space or line feed between
    two characters that are no white space: the first one's pattern ends there;
    no piece of the second has a space within, nor a line feed at all. So both
    end with each word, and a text's alignment is that of its words in order.
    """

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = sorted(set(range(256)) - set(shown))
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = {i: token.encode() if token in special else bytes(byte_of[c] for c in token) for token, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces of the second tokenizer go on over spaces")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.pairs: list[int] = []
        self.n_pairs: list[int] = []
        self.bad: set[int] = set()

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, a space put before it, some at a time."""
        text, at = " " + text, 0
        while at < len(text):
            cut = BETWEEN.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            yield BETWEEN.split(text[at:end])
            at = end

    def learn(self, words: list[str]) -> None:
        """Align new words, those of ``plain`` many at a time, in the order given."""
        first = next((i for i, w in enumerate(words) if not plain(w)), len(words))
        for at in range(0, first, JOINED):
            part = words[at : min(at + JOINED, first)]
            if not self.align("".join(part), [len(w.encode()) for w in part]):
                for word in part:
                    self.learn_alone(word)
        for word in words[first:]:
            self.learn_alone(word)

    def learn_alone(self, word: str) -> None:
        if not self.align(word, [len(word.encode())]):
            self.bad.add(len(self.groups))
            self.remember([], 0, 0)

    def remember(self, groups: list[str], n_a: int, n_b: int) -> None:
        self.groups.append(";".join(groups))
        self.n_pairs.append(len(groups))
        self.n_a.append(n_a)
        self.n_b.append(n_b)

    def align(self, text: str, sizes: list[int]) -> bool:
        """Align a text that consists of words of ``sizes`` bytes; whether both tokenizers give its bytes back."""
        a_bytes, b_bytes, data = self.a_bytes, self.b_bytes, text.encode()
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        # the second tokenizer puts a space before what it is given; before a line feed, that is a token by itself
        b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        if b"".join(map(a_bytes.__getitem__, a)) != data or b"".join(map(b_bytes.__getitem__, b)) != data:
            return False
        ends, pair = iter(sizes), self.pairs.append
        out, own, other, n_a, n_b, a_end, b_end, rest = [], "", "", 0, 0, 0, 0, iter(b)
        word_end = next(ends)
        for i in a:
            a_end += len(a_bytes[i])
            n_a += 1
            own = f"{own},{i}" if own else str(i)
            while b_end < a_end:
                j = next(rest)
                b_end += len(b_bytes[j])
                n_b += 1
                other = f"{other},{j}" if other else str(j)
            if a_end == b_end:
                out.append(f"{own}|{other}")
                pair(j << 32 | i)
                own = other = ""
                if a_end == word_end:
                    self.remember(out, n_a, n_b)
                    out, n_a, n_b = [], 0, 0
                    word_end += next(ends, 0)
        return True


class Spill:
    """A block of documents: their words, and in the end their records."""

    def __init__(self, aligner: Aligner, keep_groups: bool):
        self.aligner, self.keep_groups = aligner, keep_groups
        self.rows: list[tuple] = []
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        aligner = self.aligner
        held, seen, texts, good = [], hashlib.sha256(), [], text != ""
        for words in aligner.words(text) if good else ():
            fresh = [w for w in dict.fromkeys(words) if w not in aligner.number]
            if fresh:
                fresh.sort(key=plain, reverse=True)
                aligner.number.update(zip(fresh, count(len(aligner.groups))))
                aligner.learn(fresh)
            at = list(map(aligner.number.__getitem__, words))
            if aligner.bad and not aligner.bad.isdisjoint(at):
                good = False
                break
            part = ";".join(map(aligner.groups.__getitem__, at))
            seen.update((b";" if held else b"") + part.encode())
            if self.keep_groups:
                texts.append(part)
            held.append(np.array(at, dtype=np.int64))
        groups = "" if not good else ";".join(texts) if self.keep_groups else seen.hexdigest()
        self.words.append(np.concatenate(held) if good else np.zeros(0, dtype=np.int64))
        self.size += len(self.words[-1])
        self.rows.append((doc_id, groups))

    def finish(self, block: int) -> Iterator[pa.RecordBatch]:
        """The documents' rows with their records, then a row with the block's pairs."""
        lengths, n_a, n_b = (np.array(x, dtype=np.int64) for x in (self.aligner.n_pairs, self.aligner.n_a, self.aligner.n_b))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.array(self.aligner.pairs, dtype=np.int64)
        words = np.concatenate(self.words) if self.words else np.zeros(0, dtype=np.int64)
        mask = np.zeros(len(lengths), dtype=bool)
        mask[words] = True
        pairs = np.unique(flat[np.repeat(mask, lengths)]) if len(flat) else flat
        number = np.searchsorted(pairs, flat) if len(pairs) else flat
        total = np.zeros(len(pairs), dtype=np.int64)
        out, held = [], 0
        for (doc_id, groups), own in zip(self.rows, self.words):
            counts = int(n_a[own].sum()), int(n_b[own].sum()), int(lengths[own].sum())
            if len(own):
                size = lengths[own]
                first = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                pair, n = np.unique(number[first + np.arange(len(first))], return_counts=True)
                total[pair] += n
                records = packed(np.diff(pair, prepend=0).astype("<u4"), n.astype("<u4"))
            else:
                records = b""
            out.append((block, doc_id, *counts, groups, None, records))
            held += len(records) + len(groups)
            if held > 16 << 20 or len(out) >= 10_000:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), SPILLED_TYPES.types)], schema=SPILLED_TYPES)
                out, held = [], 0
        out.append((block, None, None, None, None, None, len(pairs), packed(pairs.astype("<i8"), total.astype("<i8"))))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), SPILLED_TYPES.types)], schema=SPILLED_TYPES)


def spill(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool, id_col: str, text_col: str) -> DataFrame:
    """The staged table of spilled blocks: documents' rows, and one row with the pairs of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(a_path, b_path)
        gc.freeze()  # both vocabularies stay to the end of the task
        block = TaskContext.get().partitionId() << 32
        held = Spill(aligner, keep_groups)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.add(doc_id, text.as_py())
                full = len(aligner.groups) >= KNOWN_WORDS
                if full or held.size >= BLOCK_WORDS:
                    yield from held.finish(block)
                    held, block = Spill(aligner, keep_groups), block + 1
                if full:
                    aligner.forget()
        if held.rows:
            yield from held.finish(block)

    return stage(id_text(docs, id_col, text_col).mapInArrow(run, SPILLED))


def radix_runs(spilled: DataFrame, radixes: int) -> DataFrame:
    """(radix, block, run): each block's pairs parted by the second tokenizer's id, with their counts and places, in side-major order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, records in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs, n = unpacked(records.as_py(), "<i8", "<i8")
                digit = (pairs >> 32) % radixes
                rows = []
                for radix in np.unique(digit).tolist():
                    at = np.flatnonzero(digit == radix)
                    rows.append((radix, block, packed(pairs[at], n[at], at.astype("<u4"))))
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["radix", "block", "run"])

    return spilled.where(F.col("n_pairs").isNotNull()).select("block", "records").mapInArrow(run, "radix int, block long, run binary")


def merged(runs: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, dict]]:
    """(block, contribution, highest) of each run of a radix: for its pairs their places, counts over all runs, and whether they are their id's highest."""
    parts = [unpacked(data, "<i8", "<i8", "<u4") for _, data in runs]
    totals = [np.zeros(len(p[0]), dtype=np.int64) for p in parts]
    best = [np.zeros(len(p[0]), dtype=bool) for p in parts]
    streams = [zip(p[0].tolist(), p[1].tolist(), repeat(i), count()) for i, p in enumerate(parts)]
    for _, side in groupby(heapq.merge(*streams), key=lambda x: x[0] >> 32):
        counted = []
        for _, same in groupby(side, key=itemgetter(0)):
            found = list(same)
            counted.append((sum(map(itemgetter(1), found)), found))
        highest = max(map(itemgetter(0), counted))
        for total, found in counted:
            for _, _, i, at in found:
                totals[i][at], best[i][at] = total, total == highest
    for i, (block, _) in enumerate(runs):
        yield block, packed(parts[i][2], totals[i].astype("<i8"), best[i].astype("u1"))


def merge(runs: DataFrame) -> DataFrame:
    """(block, contribution) of every run; all runs of a radix meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radix, held = None, []

        def batch_of() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*merged(held)), (pa.int64(), pa.binary()))], names=["block", "contribution"])

        for batch in batches:
            for own, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                if own != radix and held:
                    yield batch_of()
                    held = []
                radix = own
                held.append((block, data))
        if held:
            yield batch_of()

    return runs.repartition("radix").sortWithinPartitions("radix").mapInArrow(run, "block long, contribution binary")


def counted(spilled: DataFrame, contributions: DataFrame) -> DataFrame:
    """The documents' rows with the sums of what came back to their block."""
    none = lambda kind: F.lit(None).cast(kind)
    back = contributions.select("block", none("long").alias("doc_id"), none("long").alias("n_a"), none("long").alias("n_b"), none("long").alias("n_groups"), none("string").alias("groups"), F.col("contribution").alias("records"), F.lit(0).alias("kind"))
    rows = spilled.where(F.col("n_pairs").isNull()).drop("n_pairs").withColumn("kind", F.lit(1)).select(*back.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total, best = None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            out = []
            for block, doc_id, n_a, n_b, n_groups, groups, records, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if block != here:
                    here, total, best = block, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                if kind == 0:
                    at, n, high = unpacked(records, "<u4", "<i8", "u1")
                    if at[-1] >= len(total):
                        more = int(at[-1]) + 1 + len(total) // 2 - len(total)
                        total, best = np.pad(total, (0, more)), np.pad(best, (0, more))
                    total[at], best[at] = n, high
                elif not records:
                    out.append((doc_id, n_a, n_b, n_groups, groups, 0, 0, 0))
                else:
                    step, n = unpacked(records, "<u4", "<u4")
                    pair, n = np.cumsum(step, dtype=np.int64), n.astype(np.int64)
                    out.append((doc_id, n_a, n_b, n_groups, groups, int(n.sum()), int(n @ best[pair]), int(n @ total[pair])))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), COUNTED_TYPES.types)], schema=COUNTED_TYPES)

    return rows.unionByName(back).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, COUNTED)


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum) of every row.

    ``groups`` lists a text's groups of ids as ``a1,a2|b1;a3|b2,b3``; without
    ``keep_groups`` it is their SHA-256 in hexadecimal digits, so they needn't be
    moved. A text that is null or empty, or that either tokenizer doesn't give
    back byte by byte, has no tokens: its counts are 0 and ``groups`` is empty.
    Rows that share an id, or have none, and equal rows are counted each. Other
    columns are left behind. A text of any length is aligned whole, some words at
    a time; only a single word must fit a task. Both files are readable on every worker.
    """
    spilled = spill(docs, a_path, b_path, keep_groups, id_col, text_col)
    records = spilled.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).head()[0]
    radixes = max(LEAST_RADIXES, -(-records // MERGED))
    return counted(spilled, stage(merge(radix_runs(spilled, radixes))))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
