"""Phrase collocation mining by SON partitioning.

The rows are parted into a few shards. Each shard is mined completely, level by
level, at the support divided by the number of shards: a phrase that reaches the
support in all rows reaches that share of it in some shard, so the union of what
the shards find has every frequent phrase. A shard where a phrase isn't found
has fewer than that share of it, which bounds the phrase's count; where the bound
is below the support, it goes. A last pass counts all of the union over all
rows, exactly. A shard is a key of a distributed count, not a task, so it may
have any size and the lowered support stays above one. Texts are turned into
numbers of words once, in runs that a task can hold, which are staged.

Between the levels go bit filters of one size for every corpus. A bit that other
phrases set too lets a phrase be counted for nothing; the exact count drops it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelight.llm.common import documents, stage
from acrelight.llm.shingles import filter_bits

FILTER_BITS = 26
#: A task counts about so many words at once, and cuts texts at so many bytes.
RUN_WORDS = 3_000_000
SLICE = 1 << 20
#: A language's phrases are ranked in so many parts, of which each sends on no more than the ranks asked for.
RANKED = 32
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
WORDS = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
BETWEEN = re.compile(rb"[ \t.,;:!?\n-\r]")


class Numbers(dict):
    """Words and their numbers from 1 on, in order of their first occurrence; separators are 0."""

    def __init__(self) -> None:
        super().__init__((bytes([c]), 0) for c in SEPARATORS)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - len(SEPARATORS) + 1
        return number

    def words(self) -> list[bytes]:
        return [b"", *list(self)[len(SEPARATORS) :]]


class Texts:
    """Texts of one language as numbers of their words, 0 where a piece ends."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.size = Numbers(), [], 0

    def add(self, text: str) -> None:
        data, at = text.encode().lower(), 0  # of bytes, this lowers A to Z alone
        while at < len(data):
            cut = BETWEEN.search(data, at + SLICE) if len(data) - at > SLICE else None
            end = cut.start() if cut else len(data)
            tokens = WORDS.findall(data, at, end)
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), dtype="<i4", count=len(tokens)))
            self.size += len(tokens)
            at = end
        self.parts.append(np.zeros(1, dtype="<i4"))

    def packed(self) -> tuple[bytes, bytes]:
        """Their words, a line each, and the numbers, both as zstd frames."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return pack(b"\n".join(self.numbers.words()[1:])), pack(np.concatenate(self.parts).tobytes())


class Run:
    """Packed texts of one language and shard, opened."""

    def __init__(self, lang: str, shard: int, words: bytes, ids: bytes):
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        spelled = unpack(words)
        self.lang, self.shard, self.words = lang, shard, [b"", *(spelled.split(b"\n") if spelled else [])]
        self.ids = np.frombuffer(unpack(ids), dtype="<i4").astype(np.int64)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], dtype=np.uint64)

    def grams(self, at: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(numbers of their words, counts) of the phrases of ``length`` words that start at ``at``."""
        size = len(self.words)
        if size**length >= 1 << 63:
            found, count = np.unique(np.stack([self.ids[at + j] for j in range(length)]), axis=1, return_counts=True)
            return list(found), count
        code = self.ids[at]
        for j in range(1, length):
            code = code * size + self.ids[at + j]
        code, count = np.unique(code, return_counts=True)
        parts = []
        for _ in range(length):
            code, last = np.divmod(code, size)
            parts.append(last)
        return parts[::-1], count

    def hashed(self, parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(parts[0]), dtype=np.uint64)
        for numbers in parts:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[numbers]
        return out ^ (out >> np.uint64(31))

    def starts(self, filters: list[np.ndarray]) -> np.ndarray:
        """Where phrases of one word more than the levels of ``filters`` start, all of whose parts of those levels pass them."""
        alive = self.ids > 0
        for length, bits in enumerate(filters, 1):
            if length == 1:
                alive &= passes(bits, self.hashed([np.arange(len(self.words))]))[self.ids]
            else:
                at = np.flatnonzero(alive)
                alive[at] = passes(bits, self.hashed([self.ids[at + j] for j in range(length)]))
            alive[:-1] &= alive[1:]  # the phrase that begins one word later passes too
            alive[-1] = False
        return np.flatnonzero(alive)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = ((hashes >> np.uint64(1)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


RUNS = "lang string, shard int, words binary, ids binary"


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """The staged runs of rows (lang, text), each of a bounded size: (lang, shard, words, ids). A task's runs are of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() % shards
        held: dict[str, Texts] = {}
        size = 0

        def batch_of(lang: str) -> pa.RecordBatch:
            words, ids = held[lang].packed()
            return pa.record_batch([pa.array([lang]), pa.array([shard], pa.int32()), pa.array([words], pa.binary()), pa.array([ids], pa.binary())], names=["lang", "shard", "words", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts = held.setdefault(lang, Texts())
                before = texts.size
                texts.add(text.as_py())
                size += texts.size - before
                if size >= RUN_WORDS:
                    yield from map(batch_of, held)
                    held.clear()
                    size = 0
        yield from map(batch_of, held)

    return stage(rows.mapInArrow(run, RUNS))


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Run(*(batch.column(c)[i].as_py() for c in range(4)))


def texts_of(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, text) of the rows with a text."""
    text = F.col(text_col)
    return docs.where(text.isNotNull() & (text != "")).select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text.alias("text"))


def word_counts(runs: DataFrame) -> DataFrame:
    """(lang, phrase, hash, f) of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches):
            n = np.bincount(run.ids, minlength=len(run.words))[1:]
            if len(n):
                hashes = run.hashed([np.arange(1, len(run.words))]).view(np.int64)
                yield pa.record_batch([pa.array([run.lang] * len(n), pa.string()), pa.array(run.words[1:], pa.binary()).cast(pa.string()), pa.array(hashes), pa.array(n)], names=["lang", "phrase", "hash", "f"])

    return runs.mapInArrow(count, "lang string, phrase string, hash long, f long").groupBy("lang", "phrase", "hash").agg(F.sum("f").alias("f"))


def locally_frequent(runs: DataFrame, filters: list, least: int, shards: int) -> DataFrame:
    """(hash) of the phrases of one word more than ``filters`` has levels, that a shard finds and that may reach ``least`` in all.

    A shard finds what it has ``least / shards``
    times, rounded up; of what it doesn't find it has at most one less.
    """
    length, support = len(filters) + 1, -(-least // shards)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches):
            at = run.starts([x.value for x in filters])
            if len(at):
                parts, count = run.grams(at, length)
                yield pa.record_batch([pa.array(np.full(len(count), run.shard, dtype=np.int32)), pa.array(run.hashed(parts).view(np.int64)), pa.array(count)], names=["shard", "hash", "n"])

    found = runs.mapInArrow(mine, "shard int, hash long, n long").groupBy("shard", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    bound = F.sum("n") + (shards - F.count("*")) * (support - 1)
    return found.groupBy("hash").agg(bound.alias("most")).where(F.col("most") >= least).select("hash")


def global_counts(runs: DataFrame, filters: list) -> DataFrame:
    """(lang, phrase, words, f) over all runs of the phrases that pass the filters of all their levels, of two words and more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [x.value for x in filters]
        for run in runs_of(batches):
            words = np.array([w.decode() for w in run.words], dtype=object)
            for length in range(2, len(bits) + 1):
                at = run.starts(bits[: length - 1])
                at = at[passes(bits[length - 1], run.hashed([run.ids[at + j] for j in range(length)]))] if len(at) else at
                if not len(at):
                    break
                parts, n = run.grams(at, length)
                phrases = list(map(" ".join, zip(*(words[p].tolist() for p in parts))))
                yield pa.record_batch([pa.array([run.lang] * len(n), pa.string()), pa.array(phrases, pa.string()), pa.array(np.full(len(n), length, dtype=np.int32)), pa.array(n)], names=["lang", "phrase", "words", "f"])

    return runs.mapInArrow(count, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3, shards: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of one to ``longest`` words that occur ``least`` times in their language, and (lang, n), the words of each.

    A null text is empty, a null language ``und``. Empty texts and tables give
    nothing. Repeated rows count each. Other columns are left behind, whatever
    their names. A text of any length is cut between words, never within one.
    """
    runs = numbered(texts_of(docs, lang_col, text_col), shards)
    context = docs.sparkSession.sparkContext
    words = stage(word_counts(runs))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    filters = [context.broadcast(filter_bits(frequent.select("hash"), FILTER_BITS))]
    for _ in range(2, longest + 1):
        filters.append(context.broadcast(filter_bits(stage(locally_frequent(runs, filters, least, shards)), FILTER_BITS)))
    phrases = global_counts(runs, filters).where(F.col("f") >= least)
    return stage(frequent.select("lang", "phrase", F.lit(1).alias("words"), "f").unionByName(phrases)), totals


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact for counts up to 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, contained: int = 50, top: int = 2000, shards: int = 5, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by the score of their weakest cut.

    A phrase of ``a`` occurrences, cut into parts of ``l`` and ``r``, scores
    1000000 * a * a / (l * r), rounded down; its lowest-scoring cut counts, the
    first of equal ones. A phrase within a longer one that has at least
    ``contained`` percent of its occurrences is left out. Ties go by occurrences,
    then by the phrase's bytes. See ``phrase_counts`` for odd inputs.
    """
    counts, totals = phrase_counts(docs, least, longest, shards, lang_col, text_col)
    words = F.split("phrase", " ")
    candidates = counts.where("words > 1").withColumnRenamed("f", "a")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    k = F.col("k")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("left"), part(k + 1, F.col("words") - k).alias("right"))
    known = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    inside = candidates.where("words > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * contained))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)).alias("part"))
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
numbered AS (SELECT lang, piece, row_number() OVER () AS p FROM pieces),
split AS (SELECT lang, p, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM (SELECT lang, p, string_split_regex(piece, '[\x20\x09]+') AS x FROM numbered)),
words AS (SELECT lang, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM split WHERE w <> '' WINDOW o AS (PARTITION BY p ORDER BY i)),
counts AS (SELECT lang, a AS phrase, 1 AS words, count(*) AS f FROM words GROUP BY lang, a
  UNION ALL SELECT lang, a || ' ' || b, 2, count(*) FROM words WHERE b IS NOT NULL GROUP BY lang, a, b
  UNION ALL SELECT lang, a || ' ' || b || ' ' || c, 3, count(*) FROM words WHERE c IS NOT NULL GROUP BY lang, a, b, c),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:words], ' ') AS tail FROM candidates, (VALUES (1), (2)) t(k) WHERE k < words),
heads AS MATERIALIZED (SELECT c.*, x.f AS l FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head),
scored AS (SELECT c.lang, c.phrase, c.a, k, l, y.f AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l AS HUGEINT) * y.f) AS score
  FROM heads c JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE words = 3) GROUP BY lang, phrase),
kept AS (SELECT k.* FROM weakest k LEFT JOIN inside i ON i.lang = k.lang AND i.phrase = k.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * k.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
