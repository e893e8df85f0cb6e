"""Media, fingerprints, similar groups and repeated passages against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from acrelight.llm import fingerprint, media, shingles, suffixes

from .conftest import SCHEMA, with_clashes


def near_copies(spark, seed=0, n=60):
    """Texts of common passages, edited copies, exact copies and texts of their own."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    prose = lambda k: [draw.choice(vocabulary) for _ in range(k)]
    passage, base = prose(60), prose(150)
    rows = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            text = prose(draw.randint(1, 120))
        elif kind == 1:
            text = prose(20) + passage + prose(30)
        elif kind == 2:
            text = list(base)
            for _ in range(draw.randint(0, 8)):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
        elif kind == 3:
            text = list(base)
        else:
            text = prose(3) + ["é"] * draw.randint(0, 150)
        rows.append((n - i, " ".join(text), "en", "s", 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_payloads_come_back(spark, odd_docs):
    docs = with_clashes(odd_docs.unionByName(near_copies(spark)))
    wanted = Counter()
    for r in docs.collect():
        data = (r["text"] or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        wanted[r["doc_id"], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media.samples_feature(payload)] += 1
    found = media.read_back(media.store(docs)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) for r in found) == wanted
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"]) for r in found}) == len({r["payload_sha256"] for r in found})


def test_no_payloads(empty_docs):
    assert media.read_back(media.store(empty_docs)).count() == 0


def test_cuts_follow_content():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    a, b = media.chunks_of(data), media.chunks_of(b"some bytes in front" + data)
    assert b"".join(a) == data and max(map(len, a)) <= media.MOST
    assert len(set(a) & set(b)) > 0.9 * len(a)
    assert media.chunks_of(b"x" * 100_000)[0] == b"x" * media.MOST


def test_shared_bodies_are_stored_once(spark):
    docs = near_copies(spark)
    store = media.store(docs)
    assert store.chunks.count() == store.chunks.select("digest").distinct().count()
    total = sum(len(r["bodies"]) for r in store.rows.collect()) + sum(len(r["body"]) for r in store.chunks.collect())
    assert total < 0.8 * sum(-(-len(r["text"].encode()) // 576) * 576 for r in docs.collect())


def test_media_columns_are_of_the_stored_bytes(spark):
    docs = near_copies(spark)
    store = media.store(docs)
    shared = {bytes(r["digest"]): bytes(r["body"]) for r in store.chunks.collect()}
    stored = Counter()
    for r in store.rows.collect():
        at, units = 0, []
        for c in r["chunk_list"]:
            unit = shared[bytes(c["digest"])] if c["shared"] else bytes(r["bodies"])[at : at + c["length"]]
            at += 0 if c["shared"] else c["length"]
            units.append(unit)
        assert at == len(r["bodies"])
        whole = b"".join(units)
        stored[r["doc_id"], len(whole), hashlib.sha256(whole).hexdigest()] += 1
    assert stored == Counter((r["doc_id"], r["media_bytes"], r["media_sha256"]) for r in media.read_back(store).collect())


def test_a_damaged_unit_fails_the_job(spark):
    store = media.store(near_copies(spark).limit(3))
    for change in ("concat(left(bodies, 10), unhex('00'), substr(bodies, 12))", "left(bodies, length(bodies) - 1)"):
        with pytest.raises(Exception, match="damaged"):
            media.read_back(media.MediaStore(store.rows.selectExpr("doc_id", "row", "n_bytes", "chunk_list", f"if(length(bodies) > 0, {change}, bodies) as bodies"), store.chunks)).collect()


def test_fingerprints_of_neighbours(spark, odd_docs):
    docs = near_copies(spark).unionByName(odd_docs.where("doc_id = 7").selectExpr("1000 as doc_id", "text", "lang", "source", "n_chars"))
    texts = dict(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    ids = list(texts)
    sketch = fingerprint.OrderMinHash()
    found = {r["doc_id"]: r for r in fingerprint.edited_neighbours(with_clashes(docs)).collect()}
    assert len(found) == len(ids)
    for i, doc_id in enumerate(ids):
        text, other = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 4] + other[: len(text) // 4]
        r = found[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (sketch(text), sketch(edited))
        assert r["near_next"] == fingerprint.likeness(sketch(text), sketch(other))


def test_fingerprints_of_odd_documents(odd_docs, empty_docs):
    assert fingerprint.edited_neighbours(odd_docs).count() == odd_docs.count()
    assert fingerprint.edited_neighbours(odd_docs.where("doc_id = 1")).first()["near_next"] == 1.0
    assert fingerprint.edited_neighbours(empty_docs).count() == 0
    assert fingerprint.fingerprints(odd_docs).count() == odd_docs.count()


def test_order_matters_to_fingerprints():
    sketch = fingerprint.OrderMinHash()
    draw = random.Random(1)
    parts = ["".join(draw.choice("abcdefgh ") for _ in range(40)) for _ in range(40)]
    text, turned = "".join(parts), "".join(parts[20:] + parts[:20])
    near = "".join(parts[:39])
    assert fingerprint.likeness(sketch(text), sketch(near)) > 0.8 > fingerprint.likeness(sketch(text), sketch(turned))


def brute_groups(rows):
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    return Counter((rows[i][0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i in range(len(rows)))


def test_similar_groups(spark, odd_docs):
    for seed in range(2):
        docs = with_clashes(near_copies(spark, seed, 80).unionByName(odd_docs))
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        # rows that share a doc_id are told apart here by their place, so they are left to the next test
        found = Counter(map(tuple, shingles.similar_groups(docs).collect()))
        assert found == brute_groups(rows)


def test_similar_groups_at_the_threshold(spark):
    base = [f"w{i}" for i in range(4 + 90)]
    rows = [(1, " ".join(base), None, None, None)]
    rows += [(10 + k, " ".join(base[: 94 - k]) + "".join(f" v{k}x{i}" for i in range(k)), None, None, None) for k in range(1, 20)]
    rows += [(40, "A b C", None, None, None), (41, "a B c", None, None, None), (42, "a b", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, shingles.similar_groups(docs).collect())) == brute_groups([r[:2] for r in rows])


def test_no_similar_groups(empty_docs):
    assert shingles.similar_groups(empty_docs).count() == 0


def test_tree_finds_all_close_points():
    draw = np.random.default_rng(3)
    counts = draw.poisson(2, (500, shingles.GROUPS))
    counts[250:] = counts[:250] + draw.poisson(0.05, (250, shingles.GROUPS))
    sizes = counts.sum(axis=1)
    tree = shingles.CountTree(counts, sizes)
    found = {(int(i), int(j)) for a, b in tree.pairs(80) for i, j in zip(a, b)}
    wanted = {(i, j) for i in range(500) for j in range(500) if i != j and 180 * np.minimum(counts[i], counts[j]).sum() >= 80 * (sizes[i] + sizes[j])}
    assert wanted <= found | {(j, i) for i, j in found} and not found & {(j, i) for i, j in found}


def brute_removal(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        out.append((doc_id, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def removed(docs, **how):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(docs, **how).collect()), key=str)


def test_repeats_go(spark):
    draw = random.Random(9)
    prose = lambda n: "".join(draw.choice("abcde fghé") for _ in range(n))
    common = [prose(draw.choice([99, 100, 101, 130, 400])) for _ in range(6)]
    rows = [(100 - i, prose(draw.randint(0, 60)) + "".join(draw.choice([*common, prose(40)]) for _ in range(4)) + prose(draw.randint(0, 60)), None, None, None) for i in range(60)]
    rows += [(500, "xy" * 400, None, None, None), (501, "z" * 1000, None, None, None), (502, rows[3][1], None, None, None), (503, "", None, None, None), (504, None, None, None, None)]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA))
    wanted = brute_removal([r[:2] for r in rows])
    assert removed(docs) == wanted
    assert removed(docs, hot=3) == wanted


def test_repeated_rows_and_null_ids(spark, odd_docs, empty_docs):
    assert removed(odd_docs) == brute_removal([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert removed(empty_docs) == []


def test_suffix_order_against_sorting():
    draw = np.random.default_rng(5)
    text = draw.integers(97, 99, (300, 40), dtype=np.uint8)
    size = draw.integers(0, 41, 300)
    text[np.arange(40) >= size[:, None]] = 0
    group = np.sort(draw.integers(0, 9, 300))
    order = suffixes.SuffixOrder(text, size, group, suffixes.Hasher())
    own = [bytes(text[i, : size[i]]) for i in range(300)]
    assert order.order.tolist() == sorted(range(300), key=lambda i: (group[i], own[i], i))
    for k in range(1, 300):
        a, b = order.order[k - 1], order.order[k]
        if group[a] == group[b]:
            n = next((i for i, (x, y) in enumerate(zip(own[a], own[b])) if x != y), min(len(own[a]), len(own[b])))
            assert order.common[k] == n
