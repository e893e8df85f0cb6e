"""Personal data by generated candidates and boosted trees, with DataFrame functions only.

Patterns with high recall propose spans, which may overlap. Spans that pass the
exact rules of the four base kinds are always reported. All others are judged by
boosted trees over how a span is written and what stands around it.

The trees learn from texts in which personal data and look-alikes are planted,
so a span's label is what was planted, not a rule that the span passes. For each
generator a threshold is calibrated on planted texts held out. What is found in
a document depends on that document alone. The trees are applied as one SQL
expression.
"""

from __future__ import annotations

import math
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelight.llm.common import documents, stage, text_key

KINDS = ["email", "ip", "card", "phone"]
#: The base rules, written so that no start is tried twice: a match can only begin where its first run of characters does.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further generators, and the kind of what they find.
WIDER = {
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[ ]?[:=][ ]?[\"']?[A-Za-z0-9_/+=-]{8,}+",
    "mailbox": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[a-z0-9-]++ ?(?:\(dot\)|\[dot\]|\.) ?[a-z]{2,}+",
    "call": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "account": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,}+(?: ?[0-9]{1,3})?(?![A-Z0-9])",
}
ORDER = [*KINDS, *WIDER]
FEATURES = ["size", "marks", "digits", "letters", "loose", "cue", "left", "right"]
#: So many texts are planted to fit the trees.
SAMPLE = 3000
#: Words that tell of personal data, right before a span or within the text before it.
CUE_WORDS = "token|secret|password|passwd|key|card|visa|account|acct|bank|phone|telephone|tel|call|cell|mobile|fax|dial|ring|text|reach|mail|contact|ssn|social security|iban|ip|host"
CUES = rf"(?i)({CUE_WORDS})[^a-z0-9]{{0,4}}$"
NEAR_CUES = rf"(?i)\b({CUE_WORDS})s?\b"
#: A span's context is so many characters before it.
CONTEXT = 40
TREES, RATE, PRECISE = 40, 0.4, 0.9


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a span passes the rule of its base kind; false for other kinds."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def candidates(texts: DataFrame) -> DataFrame:
    """(k, kind, start, end, base, features): every generated span of every text, once for equal texts.

    A span's start is the length of all that stands before it: the pieces
    between matches and the matches themselves, added up by a window over the
    text's matches.
    """
    likely = F.col("text").rlike(r"[0-9@]|(?i)\(at\)|\[at\]|(token|secret|password|passwd|key) ?[:=]")
    split = texts.where(likely).select(
        text_key(F.col("text")).alias("k"),
        *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"matches_{kind}") for kind, p in (BASE | WIDER).items()),
        *(F.split("text", p).alias(f"pieces_{kind}") for kind, p in (BASE | WIDER).items()),
    )

    def placed_in(kind: str) -> Column:
        pieces = F.col(f"pieces_{kind}")
        return F.transform(f"matches_{kind}", lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m.alias("match"), F.length(F.get(pieces, i)).alias("gap"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("after")))

    each = split.select("k", F.explode(F.concat(*map(placed_in, ORDER))).alias("x")).select("k", "x.*")
    once = each.groupBy("k", "kind", "i").agg(*(F.first(c).alias(c) for c in ("match", "gap", "before", "after"))).repartition("k")
    upto = Window.partitionBy("k", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    beside = lambda c: F.when(c == "", 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)
    features = {
        "size": F.least(F.floor(size / 4), F.lit(7)).cast("int"),
        "marks": F.least(F.length(F.regexp_replace("match", "[A-Za-z0-9]", "")), F.lit(9)).cast("int"),
        "digits": F.when(digits == 0, 0).otherwise(1 + F.least(F.floor(4 * digits / size), F.lit(3))).cast("int"),
        "letters": F.col("match").rlike("[A-Z]").cast("int") + 2 * F.col("match").rlike("[a-z]").cast("int"),
        "loose": F.col("match").rlike(r"\. | \.").cast("int"),
        "cue": F.when(F.col("before").rlike(CUES), 2).when(F.col("before").rlike(NEAR_CUES), 1).otherwise(0),
        "left": beside(F.right("before", F.lit(1))),
        "right": beside(F.col("after")),
    }
    placed = once.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    return placed.select("k", "kind", "start", "end", valid(F.col("kind"), F.col("match")).alias("base"), *(c.alias(n) for n, c in features.items()))


def grow_trees(x: np.ndarray, yes: np.ndarray, no: np.ndarray, trees: int, rate: float) -> tuple[float, list[tuple]]:
    """Boosted trees of depth two for logistic loss over weighted rows ``x`` of small integers.

    A tree is (feature, value, low, high); low and high, the sides below and
    from the value on, are each (feature, value, low score, high score).
    """
    base = math.log((yes.sum() + 1) / (no.sum() + 1))
    score, grown, weight = np.full(len(x), base), [], yes + no

    def best(rows: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> tuple:
        leaf = lambda m: gradient[m].sum() / (curve[m].sum() + 1.0)
        gain = lambda m: gradient[m].sum() ** 2 / (curve[m].sum() + 1.0)
        found = (-1.0, 0, 0, leaf(rows), leaf(rows))
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[1:]:
                low, high = rows & (x[:, f] < v), rows & (x[:, f] >= v)
                if (g := gain(low) + gain(high)) > found[0] + 1e-9:
                    found = (g, f, int(v), float(leaf(low)), float(leaf(high)))
        return found[1:]

    every = np.ones(len(x), dtype=bool)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = yes - weight * p, weight * p * (1 - p)
        f, v, _, _ = best(every, gradient, curve)
        sides = [best(m, gradient, curve) for m in (x[:, f] < v, x[:, f] >= v)]
        grown.append((f, v, *sides))
        for m, (g, w, low, high) in zip((x[:, f] < v, x[:, f] >= v), sides):
            score[m] += rate * np.where(x[m, g] < w, low, high)
    return base, grown


def tree_score(names: list[str], base: float, trees: list[tuple], rate: float) -> Column:
    """The trees' sum as a column."""
    total = F.lit(base)
    for f, v, low, high in trees:
        side = lambda s: F.when(F.col(names[s[0]]) < s[1], rate * s[2]).otherwise(rate * s[3])
        total = total + F.when(F.col(names[f]) < v, side(low)).otherwise(side(high))
    return total


def planted(n: int, seed: int = 17) -> list[tuple[str, list[tuple[str, str]]]]:
    """``n`` texts, each with the (kind, span) of the personal data planted in it; half of the texts have look-alikes instead."""
    draw = random.Random(seed)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    of = lambda alphabet, k: "".join(draw.choice(alphabet) for _ in range(k))
    word = lambda: of("abcdefghijklmnopqrstuvwxyz", draw.randint(2, 9))
    words = lambda: " ".join(word() for _ in range(draw.randint(3, 9)))

    def card(good: bool) -> str:
        body = digits(15)
        total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(body)))
        return body + str((-total + (0 if good else draw.randint(1, 9))) % 10)

    name = lambda: draw.choice(["token", "secret", "password", "api_key", "api-key", "access_key", "Password", "TOKEN"])
    equals = lambda: draw.choice([" = ", ": ", "=", ":", ' = "'])
    token = lambda: of(draw.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]), draw.choice([16, 20, 24, 32, 40, 64, 128]))
    call = lambda: draw.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(str(draw.randint(200, 999)), digits(3), digits(4))
    account = lambda: of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2) + digits(2) + draw.choice(["", " "]).join(["", *(digits(4) for _ in range(draw.randint(3, 6)))])
    number = lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"
    # what a person makes up: words, capitals and digits mixed
    chosen = lambda: draw.choice([lambda: word() + digits(draw.randint(1, 4)) + word(), lambda: word().capitalize() + word() + digits(draw.randint(2, 4)), lambda: of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4) + digits(4) + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4) + digits(4)])()[:40].ljust(9, "7")
    between = lambda: draw.choice([" ", ": ", " - ", " is ", " no. ", f" {word()} ", f" {word()} {word()} "])
    cue = lambda *names: draw.choice(names) + between()
    maybe = lambda *names: cue(*names) if draw.random() < 0.5 else ""
    # (kind, what stands before it, the span), then look-alikes of the same form
    real = [
        lambda: ("secret", "", name() + equals() + draw.choice([token, chosen])()),
        lambda: ("mailbox", maybe("mail", "contact", "Contact"), draw.choice(["{} (at) {} (dot) {}", "{}[at]{}[dot]{}", "{} (at) {}.{}"]).format(word(), word(), draw.choice(["com", "org", "net", "example"]))),
        lambda: ("call", cue("phone", "tel", "call", "mobile", "cell", "fax", "text", "reach", "dial"), call()),
        lambda: ("number", cue("ssn", "SSN", "social security"), number()),
        lambda: ("account", cue("iban", "IBAN", "account", "bank", "acct"), account()),
        lambda: ("email", "", f"{word()}@{word()}.org"),
        lambda: ("ip", "", ".".join(str(draw.randint(0, 255)) for _ in range(4))),
        lambda: ("card", cue("card", "visa"), card(True)),
        lambda: ("phone", "", f"+{draw.randint(1, 9)} ({digits(3)}) {digits(3)}-{digits(4)}"),
    ]
    alike = [
        lambda: ("", "", name() + equals() + of("abcdefghijklmnopqrstuvwxyz", draw.randint(8, 16))),
        lambda: ("", "", f"{word()} (at) {word()}. {word()}"),
        lambda: ("", word() + " " + word() + " ", call()),
        lambda: ("", word() + " ", call()),
        lambda: ("", word() + " ", number()),
        lambda: ("", word() + " ", account()),
        lambda: ("", word() + " ", of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2) + digits(2) + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 12)),
        lambda: ("", "", f"{draw.randint(256, 999)}.{digits(1)}.{digits(2)}.{digits(1)}"),
        lambda: ("", draw.choice(["card ", word() + " "]), card(False)),
        lambda: ("", "", f"+{digits(1)} {digits(3)}-{digits(2)}"),
    ]
    out = []
    for i in range(n):
        kind, before, span = draw.choice((real, alike)[i % 2])()
        quote = '"' if '"' in span else ""
        # a span may begin or end its text or line
        lead, rest = draw.choice(["", f"{words()}\n", *[f"{words()} "] * 4]), draw.choice(["", ".", *[f"{mark}{words()}" for mark in (" ", ". ", ", ", "\n")]])
        out.append((f"{lead}{before}{span}{quote}{rest}", [(kind, span)] if kind else []))
    return out


@cache
def fitted(spark: SparkSession, sample: int = SAMPLE, trees: int = TREES, precise: float = PRECISE) -> tuple[float, list[tuple], dict[str, float]]:
    """(base score, trees, threshold by kind), fitted on ``sample`` planted texts of which each third is held out.

    A kind's threshold is the lowest score from which on its held-out spans are
    planted ones at least ``precise`` of the time, and of which itself at least
    half are, halfway to the next lower one; a kind without one has none.
    """
    told = {text: spans for text, spans in planted(sample)}
    texts = spark.createDataFrame([(x,) for x in told], "text string")
    spans = candidates(texts).join(texts.withColumn("k", text_key(F.col("text"))), "k").orderBy("text", "kind", "start").collect()
    label = np.array([(r["kind"], r["text"][r["start"] : r["end"]]) in told[r["text"]] for r in spans], dtype=float)
    x = np.array([[ORDER.index(r["kind"]), *(r[f] for f in FEATURES)] for r in spans])
    held = np.array([list(told).index(r["text"]) // 2 % 3 == 0 for r in spans])
    start, grown = grow_trees(x[~held], label[~held], 1 - label[~held], trees, RATE)
    scores = np.full(len(x), start)
    for f, v, *sides in grown:
        for m, (g, w, low, high) in zip((x[:, f] < v, x[:, f] >= v), sides):
            scores[m] += np.where(x[m, g] < w, RATE * low, RATE * high)
    least: dict[str, float] = {}
    for code, kind in enumerate(ORDER):
        mine = held & (x[:, 0] == code)
        order = np.argsort(-scores[mine], kind="stable")
        s, good = scores[mine][order], label[mine][order].cumsum()
        last = np.r_[s[1:] < s[:-1] - 1e-9, True][: len(s)]
        ends = np.flatnonzero(last)
        own = np.diff(np.r_[0, good[ends]]) >= 0.5 * np.diff(np.r_[-1, ends])
        fine = ends[own & (good[ends] >= precise * (ends + 1))]
        if len(fine):
            below = s[s < s[fine[-1]] - 1e-9]
            least[kind] = float(s[fine[-1]] + below[0]) / 2 if len(below) else float(s[fine[-1]]) - 1e-6
    return start, grown, least


def judge(spans: DataFrame, trees: int = TREES, precise: float = PRECISE, sample: int = SAMPLE) -> DataFrame:
    """``spans`` with ``chosen``, whether a span is reported: base spans are, others if their score reaches their kind's threshold."""
    start, grown, least = fitted(spans.sparkSession, sample, trees, precise)
    coded = spans.withColumn("of", F.array_position(F.lit(ORDER), F.col("kind")).cast("int") - 1)
    scored = coded.withColumn("score", tree_score(["of", *FEATURES], start, grown, RATE))
    accept = F.lit(False)
    for kind, score in least.items():
        accept = accept | ((F.col("kind") == kind) & (F.col("score") >= score))
    return scored.withColumn("chosen", F.col("base") | accept).select(*spans.columns, "chosen")


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k, kind, rank, start, end, base): the reported spans of each text, by its key; code points, end exclusive."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = judge(candidates(texts)).where("chosen")
    return spans.select("k", "kind", F.array_position(F.lit(ORDER), F.col("kind")).cast("int").alias("rank"), "start", "end", "base")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and span lists of every document; a null text counts as empty, equal rows each have their own result.

    Only the two columns named are read, so others may have any name. Texts and
    their spans are of any length and number.
    """
    spans = find_spans(docs, text_col)
    found = stage(spans.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "base"))).alias("found")))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("k"))
    rows = ids.join(found, "k", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span of ``text_col`` replaced by its kind in angle brackets.

    Overlapping spans become one, named by the first. All rows and columns stay,
    whatever their names; a null text stays null, repeated rows each get their
    own result. Texts and their spans are of any length and number.
    """
    turn = Window.partitionBy("k").orderBy("start", "rank", "end")
    upto = turn.rowsBetween(Window.unboundedPreceding, -1)
    spans = find_spans(docs, text_col).withColumn("reach", F.max("end").over(upto))
    pieces = spans.withColumn("piece", F.sum(F.when(F.col("reach") > F.col("start"), 0).otherwise(1)).over(turn))
    merged = pieces.groupBy("k", "piece").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.min_by("kind", F.struct("start", "rank", "end")).alias("kind"))
    gone = stage(merged.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("found")))
    text = F.col(f"row.`{text_col}`")
    # four bytes a code point, so a piece is cut out without reading what stands before it
    wide = F.encode(text, "UTF-32")
    cut = lambda a, n: F.decode(F.substring(wide, 4 * a + 1, 4 * n), "UTF-32")
    until = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("found", i - 1)["end"])
    part = lambda s, i: F.concat(cut(until(i), s["start"] - until(i)), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
    rest = cut(F.element_at("found", -1)["end"], F.length(text))
    clean = F.when(F.col("found").isNull(), text).otherwise(F.concat(F.array_join(F.transform("found", part), ""), rest))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("k"))
    return keyed.join(gone, "k", "left").select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(documents(spark, sf_dir))
