"""Groups of copies against all pairs of samples that share a passage."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.test_hard_cases import frame, words

from acrelight.llm import line_templates
from acrelight.llm.common import text_keys


def all_groups(docs):
    """{k1: least k1 that links reach} with each pair of texts compared that shares a hash of its sample."""
    passages = F.transform(F.array_remove(F.split("text", line_templates.PASSAGE_END), ""), lambda x: F.xxhash64(x))
    rows = docs.select(text_keys(F.col("text"))[0], F.slice(F.array_sort(F.array_distinct(passages)), 1, line_templates.SKETCH).alias("s")).collect()
    samples = {r["k1"]: set(r["s"]) for r in rows if r["s"]}
    holders = defaultdict(list)
    for k, sample in samples.items():
        for h in sample:
            holders[h].append(k)
    root = {k: k for k in samples}

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, sample in samples.items():
        shared = defaultdict(int)
        for h in sample:
            for b in holders[h]:
                if b > a:
                    shared[b] += 1
        for b, n in shared.items():
            other = samples[b]
            if n >= line_templates.COPIED * max(len(sample), len(other)):
                both = sorted(sample | other)[: line_templates.SKETCH]
                if len(sample & other & set(both)) >= line_templates.COPIED * len(both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    linked = {k: top(k) for k in samples}
    sizes = defaultdict(int)
    for r in linked.values():
        sizes[r] += 1
    return {k: r for k, r in linked.items() if sizes[r] > 1}


def test_groups_of_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    wanted = all_groups(docs)
    assert dict(line_templates.copy_groups(docs).collect()) == wanted and wanted


def test_chains_and_short_texts_and_common_passages(spark):
    draw = random.Random(7)
    texts = []
    for size, step in ((48, 8), (24, 4), (12, 2), (6, 1), (3, 1)):
        # each text is like its neighbours alone
        line = [words(draw, 6) for _ in range(size + 40 * step)]
        texts += ["\n".join(line[i * step : i * step + size]) for i in range(40)]
    few = [words(draw, 6) for _ in range(12)]
    texts += ["\n".join(draw.sample(few, draw.randrange(1, 6))) for _ in range(150)]
    texts += ["\n".join([*few, *(words(draw, 6) for _ in range(draw.randrange(3, 9)))]) for _ in range(60)]
    docs = frame(spark, texts)
    assert dict(line_templates.copy_groups(docs).collect()) == all_groups(docs)


def test_a_pair_is_tried_once_and_only_if_its_bits_allow(spark, monkeypatch):
    draw = random.Random(11)
    base = [words(draw, 6) for _ in range(40)]
    # copies of one text that are nearly all too different from each other to be linked
    texts = ["\n".join(words(draw, 6) if draw.random() < 0.2 else line for line in base) for _ in range(200)]
    docs, tried = frame(spark, texts), []
    whole = type(docs).distinct
    monkeypatch.setattr(type(docs), "distinct", lambda self: (tried.append(self.count()) if self.columns == ["a", "b"] else None) or whole(self))
    assert dict(line_templates.copy_groups(docs).collect()) == all_groups(docs)
    # there are 19900 pairs; before, those of each shared block were tried, 49615 in all
    assert max(tried) < 19900


def test_texts_are_cut_and_masked_once(spark, monkeypatch):
    class Staged(Exception):
        pass

    def staged(df):
        raise Staged(df._jdf.queryExecution().optimizedPlan().toString())

    docs = spark.range(3).select(F.concat(F.lit("a word 7\n"), F.col("id").cast("string")).alias("text")).repartition(2)
    assert line_templates.masked_lines(docs)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    monkeypatch.setattr(line_templates, "stage", staged)
    with pytest.raises(Staged) as plan:
        line_templates.copy_groups(docs)
    assert str(plan.value).count("array_distinct(") == 1


def test_cheaper_patterns_cut_alike(spark):
    odd = ["", "\n", "e \n d", "e\n\n  g\td e", "\n\n", "deg deg\n\x0b e", "e", "e ", "a  b\tc\r", "d e 　g ", " \n e\ne \x0cq", "dd  gg\r\n\r\n", "a e\0b\nc", "ede d\neg\n\nx \ny"]
    texts = spark.createDataFrame([(x,) for x in odd], "text string")
    assert texts.where(F.split("text", r"[deg]\s+|\n\s*") != F.split("text", line_templates.PASSAGE_END)).count() == 0
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"))
    assert lines.where(F.split("line", r"\s+") != line_templates.tokens_of(F.col("line"))).count() == 0
