"""Collocations against a plain count, for any number of shards."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from tests.oracle import spark_rows, sql_rows

from acrelight.llm import entry, phrases

from .conftest import SCHEMA, with_clashes


def brute(rows, least=10, longest=3, contained=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def rows_of(n, seed=1):
    draw = random.Random(seed)
    some = ["the", "The", "of", "Straße", "É", "漢字", "x1", "a\u00a0b", "new", "york", "city", "\x1f", "<b>"]
    text = lambda: "".join(draw.choice(some) + draw.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "\u2028"]) for _ in range(draw.randrange(60)))
    return [(draw.choice(["en", "en", "en", "de", None, ""]), draw.choice([text(), text(), text(), None, "", "new york city " * 4])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, text, lang, None, None) for i, (lang, text) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("shards", "longest", "top"), [(4, 3, 2000), (1, 2, 5), (7, 4, 2000)])
def test_collocations_equal_a_plain_count(spark, shards, longest, top):
    rows = rows_of(300)
    found = phrases.collocations(with_clashes(frame(spark, rows)), longest=longest, shards=shards, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, longest=longest, top=top)


def test_texts_are_cut_between_words_and_runs_anywhere(spark, monkeypatch):
    rows = rows_of(60, seed=3) + [("en", "new york city " * 500), ("en", "y" * 3000)]
    whole = brute(rows, least=3)
    monkeypatch.setattr(phrases, "SLICE", 50)
    counts, totals, held, batches = Counter(), Counter(), {}, []
    for lang, text in rows:
        if text:
            held.setdefault("und" if lang is None else lang, phrases.Texts()).add(text)
        if sum(t.size for t in held.values()) > 200:
            batches += [pa.record_batch([[k], [0], [words], [ids]], names=["lang", "shard", "words", "ids"]) for k, t in held.items() for words, ids in [t.packed()]]
            held = {}
    batches += [pa.record_batch([[k], [0], [words], [ids]], names=["lang", "shard", "words", "ids"]) for k, t in held.items() for words, ids in [t.packed()]]
    for run in phrases.runs_of(iter(batches)):
        at = run.starts([])
        totals[run.lang] += len(at)
        (numbers,), n = run.grams(at, 1)
        for i, c in zip(numbers.tolist(), n.tolist()):
            counts[run.lang, run.words[i].decode()] += c
    wanted = Counter()
    for lang, text in rows:
        for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
            wanted["und" if lang is None else lang, w] += 1
    assert counts == wanted
    assert whole


def test_empty_tables_and_texts_have_no_phrases(spark, empty_docs):
    assert phrases.collocations(empty_docs).collect() == []
    assert phrases.collocations(frame(spark, [("en", ""), (None, None), ("de", " .,")])).collect() == []


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 10**14, 10**14 + 7, 3 * 10**14
    assert spark.range(1).select(phrases.score(F.lit(a), F.lit(l), F.lit(r))).head()[0] == 1_000_000 * a * a // (l * r)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(entry.queries()["op11_collocations"](spark, sf)) == sql_rows(entry.oracle_sql()["op11_collocations"], sf)
