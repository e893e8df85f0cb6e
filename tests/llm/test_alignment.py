"""Alignment against whole texts given to both tokenizers, and a plain count."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from acrelight.llm import alignment, entry

from .conftest import with_clashes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    byte_of = dict(zip(map(chr, shown), shown)) | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
    name = {i: t for t, i in a.get_vocab().items()}

    def both(text):
        """Ids and bytes of the tokens of a whole text."""
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
        return [(i, bytes(byte_of[c] for c in name[i])) for i in x], [(i, spelled(b.id_to_piece(i))) for i in y]

    return both


def brute(rows, both):
    out, counts = [], Counter()
    for doc_id, text in rows:
        a, b = both(text) if text else ([], [])
        groups, links = [], []
        if text and b"".join(x[1] for x in a) == b"".join(x[1] for x in b) == (" " + text).encode():
            ends = {}
            end = 0
            for j, (_, t) in enumerate(b):
                end += len(t)
                ends[end] = j
            end = p = q = 0
            for i, (_, t) in enumerate(a):
                end += len(t)
                if end in ends:
                    j = ends[end]
                    groups.append(",".join(str(x[0]) for x in a[p : i + 1]) + "|" + ",".join(str(x[0]) for x in b[q : j + 1]))
                    links.append((a[i][0], b[j][0]))
                    p, q = i + 1, j + 1
        else:
            a = b = []
        counts.update(links)
        out.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted(
        ((d, n_a, n_b, len(g), ";".join(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)) for d, n_a, n_b, g, links in out),
        key=str,
    )


def texts(seed=4):
    draw = random.Random(seed)
    pieces = ["the", "hello", "Straße", "漢字", "😀", "don't", "they've", "x" * 40, "12345", "a.b", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "—", "<|endoftext|>", "<s>", "</s>", "<0x41>", "é", "e\u0301", "ﬁ", "   ", "'s", "()", "\u200b", "\x00"]
    made = ["".join(draw.choice(pieces) + draw.choice([" ", " ", " ", "", "  "]) for _ in range(draw.randrange(1, 80))) for _ in range(150)]
    return [*made, "▁", "a ▁ b", "", None, " ", "  ", " lead", "trail ", "\n", "one", "x" * 3000, "hello the " * 2000]


def test_alignment_equals_whole_texts_and_a_plain_count(spark, tokens):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "hello"), (None, "hello"), (3, "hello world")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = brute(rows, tokens)
    assert sum(x[1] > 0 for x in wanted) > 100
    assert sorted(map(tuple, alignment.align(docs, A, B).collect()), key=str) == wanted
    hashed = sorted(map(tuple, alignment.align(docs, A, B, keep_groups=False).collect()), key=str)
    assert hashed == sorted(((*x[:4], hashlib.sha256(x[4].encode()).hexdigest() if x[1] else "", *x[5:]) for x in wanted), key=str)


def test_blocks_radixes_and_slices_of_any_size_count_alike(spark, tokens, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(9))]
    wanted = brute(rows, tokens)
    monkeypatch.setattr(alignment, "SLICE", 30)
    aligner = alignment.Aligner(A, B)
    blocks, held = [], alignment.Spill(aligner, True)
    for i, (doc_id, text) in enumerate(rows):
        held.add(doc_id, text or "")
        if i % 7 == 6:
            blocks.append(held)
            done = [b for batch in held.finish(len(blocks)) for b in batch.to_pylist()]
            blocks[-1] = done
            held = alignment.Spill(aligner, True)
            if i % 3 == 0:
                aligner.forget()
    blocks.append([b for batch in held.finish(len(blocks) + 1) for b in batch.to_pylist()])
    spilled = spark.createDataFrame([tuple(r.values()) for block in blocks for r in block], alignment.SPILLED)
    for radixes in (1, 5, 64):
        found = alignment.counted(spilled, alignment.merge(alignment.radix_runs(spilled, radixes)))
        assert sorted(map(tuple, found.collect()), key=str) == wanted


def test_odd_tables(spark, odd_docs, empty_docs, tokens):
    assert alignment.align(empty_docs, A, B).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, alignment.align(odd_docs, A, B).collect()), key=str) == brute(rows, tokens)


def test_query_covers_a_whole_table(spark, tokens):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = entry.queries()["op12_alignment"](spark, sf)
    wanted = [(d, a, b, g, len_, best, total, hashlib.sha256(text.encode()).hexdigest() if a else "") for d, a, b, g, text, len_, best, total in brute(rows, tokens)]
    assert sorted(map(tuple, found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == sorted(wanted, key=str)
