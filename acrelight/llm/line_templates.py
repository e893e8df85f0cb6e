"""Line dedup by a log-template tree, with DataFrame functions only.

A line's place in the tree is its token count, then its leading tokens, with
tokens that hold digits as variables. Within such a leaf two things make a
template: the masked line itself, if it recurs; else the positions whose tokens
are the most widespread in the leaf stay and all others become variables. Masked
tokens count neither way.
Templates that recur across unrelated documents are dropped from all of them.

Copies of a document are not unrelated. Texts are cut into passages by content;
texts that have most passages in common are linked, and all that links reach is
one group. A template recurs by the number of different groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.llm.common import components, documents, stage, stage_alone, text_keys

#: Tokens that hold a digit.
VARIABLE = r"(?<!\S)[^\s\d]*+\d\S*"
LEADING = 3
LEAST_DOCS = 4
#: A passage ends with its line, blank lines included, or with a word that ends so.
PASSAGE_END = r"[deg\n](?:(?<=\n)|(?=\s))\s*+"
#: Texts are copies if this share of the passages of both is common, by their least ``SKETCH`` hashes.
COPIED = 0.62
SKETCH = 48
#: A block's texts that are still apart are dealt out to joins of about so many.
TOGETHER = 1000
#: So much of a generalised template is constant.
CONSTANT = 0.7
#: Further shares that are tried, so a widespread value of a variable doesn't part a template's lines in all of them.
SHARES = [CONSTANT, 0.8, 0.9]
KEY = ["k1", "k2"]


def tokens_of(masked: Column) -> Column:
    """What lies between white space in a line; where that is single spaces alone, no pattern is needed."""
    other = F.lit(False)
    for space in ("  ", "\t", "\r", "\f", "\x0b"):
        other = other | masked.contains(space)
    return F.when(other, F.split(masked, r"\s+")).otherwise(F.split(masked, " "))


def leaf_of(tokens: Column, leading: int) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, leading))


def masked_lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, i, masked, mask) for each line that isn't blank."""
    lines = docs.select(*text_keys(F.col("text")), F.transform(F.split("text", "\n"), lambda x: F.trim(F.when(x.rlike("[0-9]"), F.regexp_replace(x, VARIABLE, "<*>")).otherwise(x))).alias("lines"))
    # a text has a line at least; without outer, Spark first masks all lines once more to see that
    each = lines.select(*KEY, F.posexplode_outer("lines").alias("i", "masked")).where(F.trim("masked", F.lit(" \t\r\f\x0b")) != "")
    return each.withColumn("mask", F.xxhash64("masked"))


def copy_groups(docs: DataFrame) -> DataFrame:
    """(k1, root) of each text that is a near copy of another; equal ``root`` is one group.

    A text's least passage hashes are a sample of its passages; texts whose
    samples are similar enough are linked, and all that links reach is a group.
    Two such samples share one of the rarest hashes of both, as many as may be
    missing and one more, so texts meet in blocks by these. Hashes that one text
    alone has are rarest and make no block, so most texts are in none.

    First each text meets one that leads its largest block. Then two texts lead
    each block, others in each, and are compared with those still apart from them.
    What is apart then within a block is compared in all pairs.
    """
    passages = F.transform(F.array_remove(F.split("text", PASSAGE_END), ""), lambda x: F.xxhash64(x))
    sketch = F.slice(F.sort_array(F.array_distinct(passages)), 1, SKETCH)
    # empty samples are dropped by what explodes them; dropped here, Spark would work out each sample twice
    texts = stage(docs.select(text_keys(F.col("text"))[0], sketch.alias("sketch")))
    at = texts.select("k1", F.size("sketch").alias("size"), F.explode("sketch").alias("hash"))
    often = at.groupBy("hash").agg(F.count("*").alias("n"), F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("hash", "n")
    bits = lambda half: F.bit_or(F.expr(f"CASE WHEN (hash & 64) = {half} THEN shiftleft(1L, CAST(hash & 63 AS INT)) ELSE 0L END"))
    held = at.join(often, "hash").groupBy("k1", "size").agg(F.sort_array(F.collect_set(F.struct("n", "hash"))).alias("held"), bits(0).alias("s1"), bits(64).alias("s2"))
    least = lambda size: F.ceil(F.lit(COPIED) * size).cast("int")
    own = F.col("size") - F.size("held")
    missing = F.col("size") - least(F.col("size"))
    point = F.struct("k1", "size", own.alias("own"), "s1", "s2").alias("point")
    points = stage(held.where(own <= missing).select(point, F.slice("held", 1, missing + 1 - own)["hash"].alias("keys")))

    # of points alone: most texts are in no block
    samples = stage(texts.join(points.select("point.k1").distinct(), "k1", "left_semi").groupBy("k1").agg(F.first("sketch").alias("sketch")))

    def near(a: str, b: str) -> Column:
        """Whether two points may be linked; hashes of one's own and bits of the others bound how many they don't share.

        Of all hashes of both, ``SKETCH`` or fewer are looked at; if fewer, they are what both have less what is common.
        """
        of = lambda c: F.col(f"{a}.{c}") + F.col(f"{b}.{c}")
        apart = of("own") + sum(F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("s1", "s2"))
        common = F.greatest(least(F.greatest(f"{a}.size", f"{b}.size")), F.least(least(F.lit(SKETCH)), F.ceil(of("size") * COPIED / (1 + COPIED)).cast("int")))
        return apart <= of("size") - 2 * common

    def similar(pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs``, of points, that are linked, by their samples."""
        may = stage(pairs.select(F.least("a.k1", "b.k1").alias("a"), F.greatest("a.k1", "b.k1").alias("b")).distinct())
        wanted = may.select(F.col("a").alias("k1")).union(may.select("b")).distinct()
        once = stage(samples.join(wanted, "k1", "left_semi"))
        beside = lambda x: once.select(F.col("k1").alias(x), F.col("sketch").alias(f"sketch_{x}"))
        both = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
        common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), "both"))
        return stage(may.join(beside("a"), "a").join(beside("b"), "b").withColumn("both", both).where(common >= COPIED * F.size("both")).select("a", "b"))

    # who leads goes by the block's hash, so a text has other leaders in each of its blocks
    turned = F.struct(F.col("a.k1").bitwiseXOR(F.col("hash")).alias("turn"), "a")
    widest = points.select(F.col("point").alias("a"), F.element_at("keys", -1).alias("hash"))
    heads = widest.groupBy("hash").agg(F.min(turned)["a"].alias("b"))
    links = similar(widest.join(heads, "hash").where((F.col("a.k1") != F.col("b.k1")) & near("a", "b")).select("a", "b"))
    rooted = lambda df, roots: df.join(roots.withColumnRenamed("sid", "k1"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    own_root = rooted(points.withColumn("k1", F.col("point.k1")), components(links))
    rows = stage(own_root.select("k1", F.struct("point.*", "root").alias("a"), F.explode("keys").alias("hash")))
    blocks = rows.groupBy("hash").agg(F.min(turned)["a"].alias("low"), F.max(turned)["a"].alias("high"), F.count("*").alias("n"), F.min("a.root").alias("r1"), F.max("a.root").alias("r2"))
    blocks = stage(blocks.where("r1 <> r2").drop("r1", "r2"))
    met = rows.join(blocks, "hash").select("a", F.explode(F.array("low", "high")).alias("b"))
    links = stage(links.unionByName(similar(met.where((F.col("a.root") != F.col("b.root")) & near("a", "b")))))
    roots = components(links)
    # a block of up to three texts is done; in larger ones, pairs of texts that don't lead and are still apart
    large = blocks.where("n > 3").select("hash", F.col("low.k1").alias("low"), F.col("high.k1").alias("high"))
    rest = rows.join(large, "hash").where("k1 <> low and k1 <> high").select("hash", "k1")
    rest = stage(rooted(rest, roots).select("hash", "k1", "root"))
    parts = rest.groupBy("hash").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.ceil(F.count("*") / TOGETHER).cast("int").alias("tiles")).where("r1 <> r2").select("hash", "tiles")
    open_rows = stage(rest.join(parts, "hash").join(points.withColumn("k1", F.col("point.k1")), "k1"))
    side = lambda x: (F.col("hash"), F.col("point").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("root", "keys")))
    one = open_rows.select(F.pmod(F.xxhash64("k1"), "tiles").cast("int").alias("tile"), *side("a")).alias("one")
    other = open_rows.select(F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), *side("b")).alias("other")
    # a pair is tried in the first of the blocks that it shares, if its bits don't part it
    first = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("one.hash")
    tried = F.expr("one.hash = other.hash and one.tile = other.tile and a.k1 < b.k1 and root_a <> root_b") & near("a", "b") & first
    more = similar(one.join(other, tried).select("a", "b"))
    if more.isEmpty():
        return roots.select(F.col("sid").alias("k1"), "root")
    return components(stage(links.unionByName(more))).select(F.col("sid").alias("k1"), "root")


def recurring(lines: DataFrame, name: str, least_docs: int) -> DataFrame:
    """(name) of the values of ``name`` that recur across unrelated documents.

    Counts go by value and group first, so a value that most documents hold is
    spread over as many groups.
    """
    once = lines.select(name, "group").distinct()
    return once.groupBy(name).agg(F.count("*").alias("apart")).where(F.col("apart") >= least_docs).select(name)


def dropped_lines(docs: DataFrame, leading: int = LEADING, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(k1, k2, dropped): for each text with such lines, the positions of lines of recurring templates."""
    known = stage(masked_lines(docs).withColumn("leaf", leaf_of(tokens_of(F.col("masked")), leading)))
    groups = stage_alone(lambda: copy_groups(docs))
    grouped = lambda lines, name: lines.select("k1", name).join(groups, "k1", "left").select(name, F.coalesce("root", "k1").alias("group"))
    exact = stage(recurring(grouped(known, "mask"), "mask", least_docs))
    rest = known.drop("masked").join(exact, "mask", "left_anti")
    leaves = stage(recurring(grouped(rest, "leaf"), "leaf", least_docs))

    # lines of recurring leaves: their unmasked tokens by position, with the number of groups that hold them there
    open_lines = stage(known.join(leaves, "leaf").join(exact, "mask", "left_anti").select(*KEY, "i", "leaf", tokens_of(F.col("masked")).alias("tokens")))
    at_place = open_lines.select(*KEY, "i", "leaf", F.posexplode("tokens").alias("at", "token")).where(~F.col("token").contains("<*>"))
    at_place = stage(at_place.select(*KEY, "i", "leaf", F.xxhash64("leaf", "at", "token").alias("place")))
    held = grouped(at_place, "place").distinct().groupBy("place").agg(F.count("*").alias("n"))
    placed = at_place.join(held, "place").groupBy(*KEY, "i", "leaf").agg(F.sort_array(F.collect_list(F.struct("n", "place")), asc=False).alias("places"))

    def shape(share: float) -> Column:
        """The leaf with all tokens as widespread as the last of the ``share`` most widespread ones; null if that one doesn't recur."""
        least = F.element_at("places", F.ceil(F.size("places") * F.lit(round(100 * share)) / 100).cast("int"))["n"]
        kept = F.filter("places", lambda x: x["n"] >= least)
        return F.when(least >= least_docs, F.xxhash64("leaf", F.array_sort(F.transform(kept, lambda x: x["place"]))))

    shapes_of = F.array_distinct(F.array_compact(F.array(*map(shape, SHARES))))
    general = stage(placed.select(*KEY, "i", F.explode(shapes_of).alias("shape")))
    shapes = recurring(grouped(general, "shape"), "shape", least_docs)

    gone = known.drop("masked").join(exact, "mask", "left_semi").select(*KEY, "i").unionByName(general.join(shapes, "shape", "left_semi").select(*KEY, "i"))
    return gone.groupBy(*KEY).agg(F.array_sort(F.collect_set("i")).alias("dropped"))


def drop_recurring_lines(docs: DataFrame, leading: int = LEADING, least_docs: int = LEAST_DOCS, text_col: str = "text") -> DataFrame:
    """``docs`` with lines of recurring templates removed from ``text_col``, and columns n_lines and n_dropped.

    Every row stays, in all its other columns, whatever their names; only a
    column of the input called n_lines or n_dropped gives way to the new one. A
    text of nothing but recurring lines becomes empty, a null text stays null
    with no lines. Equal texts are one document when counting, and get the same
    result. Blank lines are never dropped. Lines end at a line feed; a text may
    have any number of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = stage_alone(lambda: dropped_lines(docs.select(text.alias("text")), leading, least_docs))
    lines = F.split(F.col(f"row.`{text_col}`"), "\n")
    # what lies between one dropped line and the next
    before = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.get("dropped", j - 1))
    after = lambda j: F.coalesce(F.get("dropped", j), F.size(lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("dropped")), lambda j: F.slice(lines, before(j) + 2, after(j) - before(j) - 1)))
    whole = F.col(f"row.`{text_col}`")
    clean = F.when(F.col("dropped").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    counts = {"n_lines": F.when(whole.isNull(), 0).otherwise(F.size(lines)), "n_dropped": F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))}
    own = [clean.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in counts]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *text_keys(text))
    return keyed.join(gone, KEY, "left").select(*own, *(c.alias(n) for n, c in counts.items()))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
