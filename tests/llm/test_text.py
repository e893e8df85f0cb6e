"""Line templates, licences, personal data and quality on small fixtures."""

import hashlib
import random
import re

import numpy as np

from acrelight.llm import licenses, line_templates, pii, quality

from .conftest import SCHEMA, with_clashes


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(n))


def test_templates_go_and_copies_stay(spark):
    draw = random.Random(1)
    rows = []
    for i in range(30):
        body = [words(draw, 12) for _ in range(4)]
        body.insert(2, f"Page {i} of {i + 7} printed by host{i}")
        body.insert(1, f"Welcome back to our lovely site dear {words(draw, 1)} today")
        rows.append((i, "\n".join(body), "en", "s", 1))
    copy = "\n".join(words(draw, 12) for _ in range(5))
    rows += [(100 + i, copy, "en", "s", 1) for i in range(20)]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA))
    found = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert len(found) == 50
    for i, text, *_ in rows[:30]:
        assert found[i]["text"] == "\n".join(x for x in text.split("\n") if not x.startswith(("Page", "Welcome")))
        assert found[i]["n_dropped"] == 2
    assert all(found[100 + i]["text"] == copy for i in range(20))


def test_near_copies_do_not_hide_a_recurring_line(spark):
    draw = random.Random(11)
    footer = "all rights of this page stay with its owner"
    rows = [(i, "\n".join([words(draw, 12) for _ in range(6)] + [footer]), "en", "s", 1) for i in range(100)]
    original = [words(draw, 12) for _ in range(12)]
    for i in range(400):
        body = list(original)
        body[draw.randrange(12)] = words(draw, 12)
        rows.append((1000 + i, "\n".join(body + [footer]), "en", "s", 1))
    found = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i] == text.removesuffix("\n" + footer) for i, text, *_ in rows)


def test_shared_headers_and_blank_lines(spark):
    for head, own, blank in ((3, 1, ""), (3, 4, ""), (5, 4, ""), (2, 1, ""), (1, 4, "\n"), (3, 1, "\n")):
        draw = random.Random(12)
        header = [words(draw, 12) for _ in range(head)]
        rows = [(i, ("\n" + blank).join(header + [words(draw, 12) for _ in range(own)]), "en", "s", 1) for i in range(100)]
        found = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
        for i, text, *_ in rows:
            kept = [x for x in found[i].split("\n") if x]
            assert kept == text.split("\n" + blank)[head:], (head, own, blank)


def test_many_templates_in_one_leaf(spark):
    draw = random.Random(13)
    templates = ["you can now " + words(draw, 8) for _ in range(40)] + [f"{{0}} {{1}} {{2}} {words(draw, 8)}" for _ in range(40)]
    rows = []
    for i in range(400):
        line = templates[i % 80].format(i, f"{i}:00", f"id{i}") + " " + words(draw, 1) + f"x{chr(97 + i % 26)}" + words(draw, 1)
        rows.append((i, "\n".join([words(draw, 20), line, words(draw, 20)]), "en", "s", 1))
    found = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        first, _, last = text.split("\n")
        assert found[i] == first + "\n" + last


def test_lines_of_odd_documents(odd_docs, empty_docs):
    found = line_templates.drop_recurring_lines(odd_docs)
    assert sorted(map(str, (r["text"] for r in found.collect()))) == sorted(map(str, (r["text"] for r in odd_docs.collect())))
    assert line_templates.drop_recurring_lines(empty_docs).count() == 0


def test_licences(spark):
    rows = [
        (1, licenses.MIT_BODY.upper().replace(",", " ;"), None, None, None),
        (2, "Copyright (c) 2020 Somebody\n" + licenses.MIT_BODY.replace("sublicense", "sublicence"), None, None, None),
        (3, "some text\nreleased under the mit licence\nmore", None, None, None),
        (4, "Released under the MIT License.", None, None, None),
        (4, "Released under the MIT License.", None, None, None),
        (5, "Released under the MIT License. And more.", None, None, None),
        (None, None, None, None, None),
    ]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA))
    found = sorted((r["doc_id"], r["unit"], r["license_id"], r["n"]) for r in licenses.scan_licenses(docs).collect())
    assert found == [(1, "text", "MIT", 1), (2, "text", "MIT", 1), (3, "line", "MIT", 1), (4, "line", "MIT", 2), (4, "text", "MIT", 2)]


def test_known_texts_have_one_canonical_form(spark):
    from pyspark.sql import functions as F

    texts = [x for t in (licenses.NOTICES, licenses.TEXTS) for xs in t.values() for x in xs]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(licenses.canonical(F.col("t"))).collect()]
    assert found == list(map(licenses.canonical_text, texts))


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end()))
    return [f"{PATTERNS[r][0]}:{s}:{e}" for s, r, e in sorted(out)]


def test_base_spans(spark, odd_docs):
    draw = random.Random(3)
    rows = [(2000 + i, "".join(draw.choice(["a", "b@c.d", "@", ".", "1", "22", "+1", " ", "-", "(", "é😀", "4111111111111111", "192.168.0.1", "_", "%x"]) for _ in range(60)), None, None, None) for i in range(300)]
    rows += [(1000, "a@b.co_x@d.com a@b c@d.e", None, None, None), (1001, "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1", None, None, None), (1002, "9" * 4000 + "." + "8" * 4000, None, None, None), (1003, "a" * 20000, None, None, None)]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA).unionByName(odd_docs))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = pii.span_digests(docs).collect()
    assert len(found) == len(rows) + odd_docs.count()
    for r in found:
        wanted = base_spans(texts[r["doc_id"]]) if r["doc_id"] is not None else []
        assert r["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest(), r["doc_id"]
        assert set(wanted) <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x.startswith(k + ":") for x in wanted) for k, _ in PATTERNS]


def test_judging_learns_secrets_and_redaction_cuts_them(spark):
    draw = random.Random(5)
    token = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(32))
    rows = [(i, f"{words(draw, 9)} token = \"{token()}\" 😀 mail me{i}@x.org or 5-{i}", None, None, None) for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, text, *_ in rows:
        assert clean[i] == re.sub(r"me\d+@x.org", "<EMAIL>", re.sub(r"token = \"[0-9a-f]{32}", "<SECRET>", text))


def test_long_secrets_are_one_span(spark):
    draw = random.Random(8)
    token = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(300))
    rows = [(i, f"{words(draw, 9)} token = {token()} end", None, None, None) for i in range(90)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(clean[i] == re.sub("token = [0-9a-f]{300}", "<SECRET>", text) for i, text, *_ in rows)


def test_redaction_of_odd_documents(odd_docs, empty_docs):
    assert sorted(str(r["text"]) for r in pii.redact(odd_docs).collect()) == sorted(str(r["text"]) for r in odd_docs.collect())
    assert pii.redact(empty_docs).count() == 0
    assert pii.span_digests(empty_docs).count() == 0


def test_quality_on_held_out_documents(spark):
    draw = random.Random(6)
    rows, told = [], []
    for i in range(600):
        good = i % 4 > 0
        text = words(draw, 60).capitalize() + "." if good else " ".join(w + draw.choice(["$$$", "###"]) for w in words(draw, 60).split())
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
        if i < 300:
            told.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(told + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["keep"] for r in quality.score_documents(with_clashes(docs), labels).collect()}
    right = [found[i] == (i % 4 > 0) for i in range(300, 600)]
    assert np.mean(right) > 0.97
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, k in found.items() if k}


def test_quality_without_labels(spark, odd_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.score_documents(odd_docs, none).collect()
    assert len(found) == odd_docs.count() and all(r["keep"] and r["score"] is None for r in found)
    assert quality.score_documents(empty_docs, none).count() == 0
    assert quality.keep_good(odd_docs, none).count() == odd_docs.count()


def test_pseudo_labels_are_summed_over_rows_without_labels(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    widths = (quality.TEXT_FEATURES, quality.SOURCES + quality.LANGS + 3)
    views = [draw.normal(size=(60, w)).astype(np.float32) for w in widths]
    y = (views[0][:, 0] + views[1][:, 0] > 0).astype(float)
    models = {n: quality.Logistic().fit(x.astype(float), y) for n, x in zip(("text", "meta"), views)}
    rows = [(None if i == 7 else i, views[0][i].tolist(), views[1][i].tolist()) for i in range(60)]
    seen = spark.createDataFrame(rows, "doc_id long, text_view array<float>, meta_view array<float>").repartition(3)
    told, least = frozenset(range(0, 60, 4)), {"text": (0.5, 0.25), "meta": (0.1, np.inf)}
    found = quality.pseudo_sums(seen, models, least, told)
    free = np.array([i for i in range(60) if i not in told])
    wide = dict(zip(("text", "meta"), (x[free].astype(float) for x in views)))
    for v, (name, other) in enumerate((("text", "meta"), ("meta", "text"))):
        z = models[other].logit(wide[other])
        for label, sure in ((0, -z >= least[other][1]), (1, z >= least[other][0])):
            sums = found[2 * v + label]
            assert sums[0, 0] == sure.sum()
            if sure.any():
                gradient, curve = models[name].sums(wide[name][sure], np.full(int(sure.sum()), float(label)))
                n = len(gradient)
                np.testing.assert_allclose(sums[0, 1 : n + 1], gradient)
                np.testing.assert_allclose(sums[1 : n + 1, 1 : n + 1], curve)
