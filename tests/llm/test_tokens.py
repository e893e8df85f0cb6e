"""Packing and byte-level BPE against the libraries whose vocabularies they use."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from acrelight.llm import bpe, packing

from .conftest import with_clashes

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check_packing(docs, found):
    tokenizer = Tokenizer.from_file(WORDS)
    wanted = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        wanted[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    # pieces of documents that share id and length are told apart by being taken in turn
    by_doc = {}
    for r in sorted(found, key=lambda r: (str(r["doc_id"]), r["doc_tokens"], r["start"])):
        by_doc.setdefault((r["doc_id"], r["doc_tokens"], r["start"], r["length"]), []).append(r["ids_crc32"])
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        while at < len(ids):
            length = next(n for d, t, s, n in by_doc if (d, t, s) == (r["doc_id"], len(ids), at))
            by_doc[r["doc_id"], len(ids), at, length].remove(zlib.crc32(ids[at : at + length].tobytes()))
            at += length
        assert at == len(ids)
    assert not any(by_doc.values())
    used = {}
    for r in found:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_packs_odd_documents(odd_docs):
    docs = with_clashes(odd_docs)
    check_packing(docs, packing.packed_digests(docs, WORDS).collect())


def test_packs_nothing(empty_docs):
    assert packing.packed_digests(empty_docs, WORDS).count() == 0


def test_pieces_keep_their_ids(odd_docs):
    tokenizer = Tokenizer.from_file(WORDS)
    docs = odd_docs.where("doc_id = 7 or doc_id = 1")
    rows = packing.pack(docs, WORDS).orderBy("doc_id", "start").collect()
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = b"".join(bytes(r["ids"]) for r in rows if r["doc_id"] == doc_id)
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["İstanbul ǅ ß ﬁ é Å", "a\x1cb\x85c d e", "<|endoftext|> x<|startoftext|>y", "don't we'll 12345 !?… ñÑ", "İ́ ①② Ⅷ", ""])
def test_words_apart_give_the_tokenizers_ids(text):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = packing.WordIds(tokenizer)
    assert np.frombuffer(b"".join(ids[w] for w in packing.white_space_words(text)), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_forms_of_a_word_reach_the_model_once():
    ids = packing.WordIds(Tokenizer.from_file(WORDS))
    seen, model = [], ids.model
    ids.model = lambda piece: seen.append(piece) or model(piece)
    for word in ("hovelike", "Hovelike", "HOVELIKE", "hovelike,", "hovelike."):
        ids[word]
    assert len(seen) == len(set(seen)) and seen.count("hovelike") == 1


def test_packing_workers_know_words_of_earlier_tasks(monkeypatch):
    class Docs:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(packing, "id_text", lambda *args: Docs())
    task = packing.tokenize_pieces(None, WORDS)
    batch = pa.record_batch({"doc_id": [1], "text": ["a hovelikest 日本hovelikest"]})
    first = list(task([batch]))
    monkeypatch.setattr(packing.WordIds, "__missing__", lambda *args: pytest.fail("tokenised again"))
    assert list(task([batch])) == first


def test_patterns_cover_the_demand_with_little_waste():
    draw = random.Random(4)
    demand = Counter(min(256, max(1, int(draw.lognormvariate(4, 0.9)))) for _ in range(20_000))
    chosen = packing.whole_patterns(dict(demand), 256)
    covered = Counter()
    for pattern, times in chosen:
        assert sum(u * n for u, n in pattern.items()) <= 256
        for u, n in pattern.items():
            covered[u] += n * times
    assert covered == demand
    assert sum(t for _, t in chosen) * 256 < 1.02 * sum(u * n for u, n in demand.items())


def test_bpe_matches_tiktoken(odd_docs):
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    docs = with_clashes(odd_docs)
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    wanted = Counter()
    for (doc_id, text), n in texts.items():
        ids = codec.encode_ordinary(text)
        wanted[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text.encode()] += n
    found = Counter((r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), bytes(r["decoded"])) for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect())
    assert found == wanted


def test_bpe_of_nothing(empty_docs):
    assert bpe.encode(empty_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    perfect = bpe.PerfectHash(keys)
    assert sorted(map(perfect, keys)) == list(range(5000))


def test_merges_of_random_bytes():
    ranks = bpe.read_ranks(RANKS)
    codec, other = bpe.Codec(ranks), tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(2)
    for n in (1, 2, 3, 50, 3000):
        piece = "".join(draw.choice("abcdeft hé") for _ in range(n))
        assert codec.encode_piece(piece.encode()) == other.encode_ordinary(piece)


def test_words_after_spaces_give_the_whole_texts_ids():
    codec, other = bpe.Codec(bpe.read_ranks(RANKS)), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    words = bpe.SpacedIds(bpe.PieceIds(codec), public_tokenizers.PATTERN)
    draw = random.Random(3)
    parts = [" ", " ", " ", "  ", "\n", " \n", "\t", "\xa0", "\u3000", "\x1c", "'s", "'", "don't", "Über", "日本", "12", "²", "é", "e\u0301", ",", "...", "a", "hovel"]
    texts = ["", " ", " a", "a ", *("".join(draw.choices(parts, k=draw.randint(1, 30))) for _ in range(3000))]
    assert sum(words.other(text) is None for text in texts) > 300
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == other.encode_ordinary(text), text


def test_known_words_are_not_matched_again():
    words = bpe.SpacedIds(bpe.PieceIds(bpe.Codec(bpe.read_ranks(RANKS))), public_tokenizers.PATTERN)
    seen, split = [], words.split
    words.split = lambda text: seen.append(text) or split(text)
    words.encode("so much so much so much")
    assert seen == ["so", " much", " so"]


def test_new_words_of_a_text_are_matched_at_once():
    words = bpe.SpacedIds(bpe.PieceIds(bpe.Codec(bpe.read_ranks(RANKS))), public_tokenizers.PATTERN)
    seen, split = [], words.split
    words.split = lambda text: seen.append(text) or split(text)
    words.encode("so " + " ".join(f"hovel{c}, hovel{c}" for c in "abcdefghijkl"))
    assert len(seen) == 2


def test_workers_know_words_of_earlier_tasks(monkeypatch):
    class Docs:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(bpe, "id_text", lambda *args: Docs())
    task = bpe.encode(None, RANKS, public_tokenizers.PATTERN, spaced=True)
    batch = pa.record_batch({"doc_id": [1], "text": ["a hovelikest hovelikest"]})
    first = list(task([batch]))
    monkeypatch.setattr(bpe.Codec, "merge", lambda *args: pytest.fail("merged again"))
    assert list(task([batch])) == first


def test_words_are_forgotten_when_full():
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    words = bpe.SpacedIds(bpe.PieceIds(bpe.Codec(bpe.read_ranks(RANKS)), limit=7), public_tokenizers.PATTERN, limit=5)
    draw = random.Random(5)
    for _ in range(300):
        text = " ".join("".join(draw.choices("ab'c,\né", k=draw.randint(1, 4))) for _ in range(12))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == codec.encode_ordinary(text)
