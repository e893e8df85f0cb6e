"""Quality by co-training of a text view and a metadata view.

Two logistic models see disjoint features of a document: its text, by how it is
written and by the words in it, and what is known about it otherwise (language,
source, length). Trained first on labelled rows, each labels those rows of the
whole corpus that it is sure of for the other, over several rounds; a round's
sums over all rows make one Newton step. A last model calibrates and combines
both views on rows that neither was trained on, and scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.llm.common import documents, stage

#: At most so many labelled rows are used to fit; pseudo-labels come from all rows.
SAMPLE = 20_000
#: Words are counted by so many cells of a hash; the table has one size for every corpus.
CELLS = 1 << 14
ROUNDS = 4
#: A view labels pool rows for the other only beyond the score at which it was this precise on labelled rows.
SURE = 0.97
SOURCES, LANGS = 32, 16


def character_classes() -> np.ndarray:
    """Class of each code point of the basic plane: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 ASCII symbol."""
    kinds = np.zeros(0x10000, dtype=np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        kinds[c] = 1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit() else 4 if ch.isspace() else 5 if c < 128 else 0
    return kinds


def cell_of(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % CELLS


def text_view(text: str, kinds: np.ndarray, odds: np.ndarray) -> list[float]:
    """Shares and means that don't depend on the topic, and little on the length, and the mean and least log odds of the words."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n = max(1, len(codes))
    seen = np.bincount(kinds[np.minimum(codes, 0xFFFF)], minlength=6) / n
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    counts = Counter(words)
    lengths = list(map(len, words)) or [0]
    odd = sum(not x[-1].isalnum() and x[-1] not in ".,;:?!)\"'" for x in words)
    twice = sum(a == b for a, b in zip(words, words[1:]))
    top = max(counts.values(), default=0)
    ends = sum(x[-1] in ".?!" for x in words)
    repeated = len(lines) - len(set(lines))
    doubled = sum(len(x) > 2 and x[-1] in "!?.*#$%&|" and x[-2] in "!?.*#$%&|" for x in words)
    worth = [odds[cell_of(x)] for x in counts] or [0.0]
    return [float(np.mean(worth)), float(min(worth)), *seen[1:].tolist(), sum(lengths) / w, sum(x <= 3 for x in lengths) / w, odd / w, twice / w, top / w, len(counts) / w**0.8, ends / w, repeated / len(lines), doubled / w, max(lengths) / n, float(np.log1p(w / len(lines)))]


TEXT_FEATURES = 18


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (SOURCES + LANGS + 3)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1.0
    size = float(np.log1p(max(0, n_chars or 0)))
    out[-3:] = [size, size * size, float(n_chars is None)]
    return out


def word_odds(docs: DataFrame, told: DataFrame) -> np.ndarray:
    """Log odds of good quality by cell of words, from the texts of the labelled rows in ``told``: how many texts of each class hold a word of the cell.

    ``told`` is bounded by the sample's size, so it may be broadcast; tasks add up
    tables of fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS + 1))
        for batch in batches:
            for text, quality in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[quality, list({cell_of(x) for x in (text or "").split()})] += 1
                total[quality, CELLS] += 1
        if total.any():
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.join(F.broadcast(told), "doc_id").select("text", "quality").mapInArrow(count, "part int, sums binary")
    total = summed(found, (2, CELLS + 1)).get(0, np.zeros((2, CELLS + 1)))
    bad, good = total + 0.5
    return np.log(good[:CELLS] / (good[CELLS] + 1)) - np.log(bad[:CELLS] / (bad[CELLS] + 1))


def summed(sums: DataFrame, shape: tuple[int, ...]) -> dict[int, np.ndarray]:
    """The sum of the arrays of each ``part`` of (part, sums), added up by tasks before a row for each of these reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(data)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sums"])

    out: dict[int, np.ndarray] = {}
    for part, data in sums.repartition(16).mapInArrow(add, "part int, sums binary").collect():
        out[part] = out.get(part, 0) + np.frombuffer(data).reshape(shape)
    return out


def features(docs: DataFrame, odds: np.ndarray) -> DataFrame:
    """(doc_id, text_view array, meta_view array); absent metadata columns count as null."""
    types = pa.schema([("doc_id", pa.int64()), ("text_view", pa.list_(pa.float32())), ("meta_view", pa.list_(pa.float32()))])
    column = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = character_classes()
        for batch in batches:
            ids, texts, langs, sources, sizes = batch.columns
            seen = [text_view(t.as_py() or "", kinds, odds) for t in texts]
            known = [meta_view(*x) for x in zip(langs.to_pylist(), sources.to_pylist(), sizes.to_pylist())]
            yield pa.record_batch([ids, pa.array(seen, pa.list_(pa.float32())), pa.array(known, pa.list_(pa.float32()))], schema=types)

    rows = docs.select(column("doc_id", "long"), column("text", "string"), column("lang", "string"), column("source", "string"), column("n_chars", "long"))
    return rows.mapInArrow(run, "doc_id long, text_view array<float>, meta_view array<float>")


class Logistic:
    """Ridge logistic regression on standardised features and their squares, by Newton steps."""

    def __init__(self, squares: bool = True, ridge: float = 1.0, steps: int = 25):
        self.squares, self.ridge, self.steps = squares, ridge, steps

    def spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z * z] if self.squares else [np.ones((len(z), 1)), z])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self.spread(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(self.steps):
            if self.step(*self.sums(x, y)) < 1e-6:
                break
        return self

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss over rows, at the present weights; both add up over parts of a table."""
        z = self.spread(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return z.T @ (p - y), (z * (p * (1 - p) + 1e-6)[:, None]).T @ z

    def step(self, gradient: np.ndarray, curve: np.ndarray) -> float:
        """One Newton step from sums; the largest change of a weight."""
        penalty = np.full(len(gradient), self.ridge)
        penalty[0] = 1e-6
        change = np.linalg.solve(curve + np.diag(penalty), gradient + penalty * self.weights)
        self.weights = self.weights - change
        return float(np.abs(change).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.spread(x) @ self.weights, -30, 30)


@dataclass
class Quality:
    """The fitted views and their combination; ``score`` gives the probability that a document is good."""

    text: Logistic
    meta: Logistic
    both: Logistic

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.meta.logit(meta)
        sure = lambda z: 1 / (1 + np.exp(-z))
        return sure(a), sure(b), sure(self.both.logit(np.column_stack([a, b])))


def sure_from(logit: np.ndarray, y: np.ndarray, precise: float) -> float:
    """The lowest score such that rows above it are ``precise`` right on labelled rows, and at least 20 of them; infinite without one."""
    order = np.argsort(-logit)
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= precise) & (np.arange(len(y)) >= 20))
    return float(logit[order[good[-1]]]) if len(good) else np.inf


def pseudo_sums(seen: DataFrame, models: dict[str, Logistic], least: dict[str, tuple[float, float]], told: frozenset[int] = frozenset()) -> dict[int, np.ndarray]:
    """Newton sums of each view by class over all rows that the other view is sure of, and how many rows these are.

    Rows whose doc_id was ``told``, the sample of labels, give no pseudo-labels:
    some of them check the models.

    Part 2 * view + class; a part's array has the count, the gradient and the
    curvature, filled up to the wider view's size. ``least`` has a view's least
    scores for the classes good and bad, the latter of the opposite sign.
    """
    width = max(len(m.weights) for m in models.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, width + 1, width + 1))
        for frame in frames:
            x = dict(zip(("text", "meta"), arrays(frame[~frame["doc_id"].isin(told)])))
            for v, (name, other) in enumerate((("text", "meta"), ("meta", "text"))):
                z = models[other].logit(x[other])
                for label, sure in ((0, -z >= least[other][1]), (1, z >= least[other][0])):
                    if sure.any():
                        gradient, curve = models[name].sums(x[name][sure], np.full(int(sure.sum()), float(label)))
                        part, n = total[2 * v + label], len(gradient)
                        part[0, 0] += sure.sum()
                        part[0, 1 : n + 1] += gradient
                        part[1 : n + 1, 1 : n + 1] += curve
        yield pd.DataFrame({"part": range(4), "sums": [x.tobytes() for x in total]})

    return summed(seen.mapInPandas(run, "part int, sums binary"), (width + 1, width + 1))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, seen: DataFrame, told: frozenset[int] = frozenset(), rounds: int = ROUNDS, seed: int = 3) -> Quality | None:
    """Fit on labelled rows and on pseudo-labels of all other rows of ``seen``; None unless there are four labelled rows of each class.

    Of the labelled rows three fifths fit the views, a fifth sets how sure a view
    must be, and a fifth, which decides nothing else, calibrates the two together.

    Pseudo-labels of a class weigh together at most as much as its labelled
    rows, however many they are, so they don't shift the share of the classes.
    """
    if len(np.unique(y)) < 2 or min(np.bincount(y.astype(int), minlength=2)) < 4:
        return None
    part = np.random.default_rng(seed).permutation(len(y)) % 5
    train, check, last = part > 1, part == 0, part == 1
    views = {"text": text, "meta": meta}
    models = {name: Logistic().fit(x[train], y[train]) for name, x in views.items()}
    count = np.bincount(y[train].astype(int), minlength=2)
    for _ in range(rounds):
        known = {name: m.logit(views[name][check]) for name, m in models.items()}
        least = {name: (sure_from(z, y[check] == 1, SURE), sure_from(-z, y[check] == 0, SURE)) for name, z in known.items()}
        if not np.isfinite(list(least.values())).any():
            break
        added = pseudo_sums(seen, models, least, told)
        for v, name in enumerate(views):
            gradient, curve = models[name].sums(views[name][train], y[train])
            n = len(gradient)
            for label in (0, 1):
                sums = added.get(2 * v + label)
                if sums is not None and sums[0, 0]:
                    share = min(1.0, count[label] / sums[0, 0])
                    gradient, curve = gradient + share * sums[0, 1 : n + 1], curve + share * sums[1 : n + 1, 1 : n + 1]
            models[name].step(gradient, curve)
    held = np.column_stack([models[n].logit(views[n][last]) for n in ("text", "meta")])
    return Quality(models["text"], models["meta"], Logistic(squares=False).fit(held, y[last]))


def arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    width = (TEXT_FEATURES, SOURCES + LANGS + 3)
    return tuple(np.array(frame[c].tolist(), dtype=float).reshape(-1, w) for c, w in zip(("text_view", "meta_view"), width))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Quality | None, np.ndarray, DataFrame]:
    """(model, word odds, staged features of all rows) from at most ``sample`` labelled doc_ids, chosen by a hash.

    A third of these give the word odds, and the others the models, which so see
    odds of words as strange as in any text. Equal doc_ids of ``labels`` count
    once, with their lowest quality; null labels don't count. Rows that share a
    labelled doc_id count as one.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    turn = F.xxhash64("doc_id")
    some = stage(given.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(turn).limit(sample))
    first = F.pmod(F.shiftright(turn, 20), F.lit(3)) == 0
    odds = word_odds(docs, some.where(first))
    seen = stage(features(docs, odds))
    # the sample has at most ``sample`` rows, so it may be broadcast
    known = seen.join(F.broadcast(some.where(~first)), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text_view", "meta_view")).alias("x"))
    frame = known.select("doc_id", "quality", "x.*").toPandas().sort_values("doc_id")
    told = frozenset(r[0] for r in some.select("doc_id").collect())  # of the sample's size
    return co_train(*arrays(frame), frame.quality.to_numpy(dtype=float), seen, told), odds, seen


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every document.

    ``keep`` is whether the calibrated probability of good quality is at least
    ``least``. Null texts and metadata have features of their own; without
    labels of both classes all scores are null and every document is kept. Rows
    that share a doc_id are scored each by its own text; a text of any length is
    seen whole, and further columns are left behind.
    """
    model, _, seen = fit(docs, labels, sample)
    kinds = "doc_id long, text_score double, meta_score double, score double, keep boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64")})
            if model is None:
                yield out.assign(text_score=np.nan, meta_score=np.nan, score=np.nan, keep=True)
            else:
                a, b, c = model.score(*arrays(frame))
                yield out.assign(text_score=a, meta_score=b, score=c, keep=c >= least)

    return seen.mapInPandas(run, kinds).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("text_score", "meta_score", "score")})


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, n_chars) that the classifier accepts.

    Features are computed once to fit the model, and once more where each row is
    judged, so no text is shuffled and rows that share a doc_id don't meet.
    """
    model, odds, _ = fit(docs, labels, sample)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = character_classes()
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = np.array([text_view(t.as_py() or "", kinds, odds) for t in batch.column("text")])
            known = np.array([meta_view(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))])
            yield batch.filter(pa.array(model.score(seen, known)[2] >= least))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
