"""Features of captured web pages: walk scores, crime indices, schools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelight.functions.values import blank_to_null, extracted, half_up, slug
from acrelight.operators import html as H
from acrelight.operators.features import nonzero
from acrelight.sources.shared import stage


def visible_text(html: Column) -> Column:
    """A page's text: no scripts, styles or tags, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def walk_scores(pages: DataFrame) -> DataFrame:
    """(page_id, walk_score, transit_score, bike_score): from image texts, then the page's text if there is no walk score."""
    html, text = F.col("html"), F.col("_text")
    image = lambda kind: extracted(html, rf'(?i)<img[^>]*alt="(\d+) {kind} Score').try_cast("int")
    prose = lambda kind: extracted(text, rf"(?i){kind} Score[:\s]+(\d+)").try_cast("int")
    walk = F.col("_walk")
    seen = H.once(pages, "page_id", "html", image("Walk").alias("_walk"))
    seen = seen.withColumn("_text", F.when(walk.isNull(), visible_text(html)))
    each = {n: F.when(walk.isNotNull(), image(k)).otherwise(F.coalesce(prose(k), image(k))) for n, k in (("walk_score", "Walk"), ("transit_score", "Transit"), ("bike_score", "Bike"))}
    return H.once(seen, "page_id", *(c.alias(n) for n, c in each.items()))


def crime_total(violent: Column, theft: Column) -> Column:
    """The mean of both indices to one place; null unless both are there."""
    return half_up((violent + theft) / 2, 1)


NUMBER = r"(\d+(?:\.\d+)?)"
KINDS = ("violent", "property", "total")


def _first(values: Column) -> Column:
    """The first of an array that is there and not zero."""
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != 0)), F.lit(0))


def _last(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))


def _number(c: Column, before: str = "", after: str = "") -> Column:
    return extracted(c, rf"(?i){before}{NUMBER}{after}").try_cast("double")


def crime_indices(pages: DataFrame) -> DataFrame:
    """(page_id, violent_crime_index, property_crime_index, total_crime_index, tier) by the first of four tiers with either index.

    1 labels of charts, but for the nation's, whose mean is the total; 2 what the
    page's text states, and for what it doesn't the cells of tables; 3 the prose
    of the section on crime, or of the page; 4 bars and charts by their attributes.
    A zero counts as missing when the next tier is asked. Pages without any stay, with nulls.
    A page is only looked through for the tiers up to its own.
    """
    html = F.col("html")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<[a-z][^<>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: F.contains(F.lower(t), F.lit("aria-label")) | t.rlike("(?i)^<img\\b"))
    labels = F.filter(F.transform(named, lambda t: F.coalesce(H.attribute(t, "aria-label"), H.attribute(t, "name"))), lambda x: ~F.lower(x).rlike("usa|united states"))
    chart = lambda k: _first(F.transform(F.filter("_labels", lambda x: F.contains(F.lower(x), F.lit(k))), lambda x: _number(x, rf"{k}[,\s]+")))
    text = F.col("_text")
    stated = {"violent": r"Violent\s*(?:Crime)?[:\s]+", "property": r"Property\s*(?:Crime)?[:\s]+", "total": r"(?:Total|Overall)\s*(?:Crime)?[:\s]+"}
    words = {"violent": ["violent"], "property": ["property"], "total": ["total", "overall"]}
    rows = F.filter(H.table_rows(html), lambda r: F.size(r) >= 2)
    cell = lambda k: _last(F.transform(F.filter("_rows", lambda r: F.lower(F.get(r, F.lit(0))).rlike("|".join(words[k]))), lambda r: _number(F.get(r, F.lit(1)))))
    table = lambda k: F.coalesce(nonzero(_number(text, stated[k])), cell(k))
    on_crime = lambda t: H.class_has(t, "crime") | F.contains(F.coalesce(H.attribute(t, "id"), F.lit("")), F.lit("crime"))
    section = H.elements(pages, on_crime, H.named("crime", attributes="class|id")).groupBy("page_id").agg(F.min_by("inner", "at").alias("_crime"))
    prose_text = F.col("_prose")
    after = {"violent": r"\s*(?:violent|for violent)", "property": r"\s*(?:property|for property)", "total": r"\s*(?:total|overall|crime index)"}
    rate = lambda k: _number(prose_text, rf"{k}\s*crime\s*(?:rate|index)?\s*(?:of|is|:)?\s*") if k != "total" else F.lit(None).cast("double")
    prose = lambda k: F.coalesce(nonzero(_number(prose_text, after=after[k])), rate(k))
    bars = F.filter(tags, lambda t: H.class_has(t, "progress", "meter", "bar") | (H.attribute(t, "role") == "progressbar"))
    length = lambda t: F.coalesce(blank_to_null(H.attribute(t, "aria-valuenow")), blank_to_null(H.attribute(t, "data-value")), blank_to_null(H.attribute(t, "data-percent")), extracted(H.attribute(t, "style"), rf"width\s*:\s*{NUMBER}"))
    of = {"violent": lambda x: F.contains(x, F.lit("violent")), "property": lambda x: F.contains(x, F.lit("property")) & ~F.contains(x, F.lit("violent"))}
    bar = lambda k: _last(F.transform(F.filter("_bars", lambda t: of[k](F.lower(F.coalesce(H.attribute(t, "aria-label"), F.lit(""))))), lambda t: _number(length(t))))
    charts = H.elements(pages, lambda t: H.class_has(t, "violent", "property"), H.named("violent", "property")).select("page_id", "at", F.lower(H.attribute(F.col("tag"), "class")).alias("c"), _number(H.first_text(F.col("inner"), r"(?is)<text\b[^>]*>(.*?)</text>", r'(?is)class\s*=\s*"[^"]*(?:chart|graph)-value[^"]*"[^>]*>(.*?)<')).alias("n"))
    drawn = charts.groupBy("page_id").agg(*(F.max_by("n", F.when(of[k](F.col("c")) & F.col("n").isNotNull(), F.col("at"))).alias(f"_{k}") for k in of))
    tiers = {1: chart, 2: table, 3: prose, 4: lambda k: F.coalesce(nonzero(F.col(f"_{k}")), bar(k)) if k in of else F.lit(None).cast("double")}
    found = pages.join(section, "page_id", "left").join(drawn, "page_id", "left")
    has = lambda n: nonzero(F.col(f"t{n}.violent")).isNotNull() | nonzero(F.col(f"t{n}.property")).isNotNull()
    # what each tier looks at
    given = {1: {"_labels": labels}, 2: {"_text": visible_text(html), "_rows": rows}, 3: {"_prose": F.coalesce(visible_text(F.col("_crime")), text)}, 4: {"_bars": bars}}
    for n, tier in tiers.items():
        asked = F.lit(True) if n == 1 else ~reduce(lambda a, b: a | b, map(has, range(1, n)))
        seen = H.once(found, *found.columns, *(F.when(asked, c).alias(name) for name, c in given[n].items()))
        each = F.struct(*((tier(k) if n > 1 or k != "total" else F.lit(None).cast("double")).alias(k) for k in KINDS))
        found = H.once(seen, *(c for c in seen.columns if c not in ("_labels", "_rows")), F.when(asked, each).alias(f"t{n}"))
    n = F.when(has(1), 1).when(has(2), 2).when(has(3), 3).when(has(4), 4)
    index = lambda k: F.when(has(1), F.col(f"t1.{k}")).when(has(2), F.col(f"t2.{k}")).when(has(3), F.col(f"t3.{k}")).when(has(4), F.col(f"t4.{k}"))
    total = F.when(has(1), crime_total(F.col("t1.violent"), F.col("t1.property"))).otherwise(index("total"))
    return H.once(found, "page_id", index("violent").alias("violent_crime_index"), index("property").alias("property_crime_index"), total.alias("total_crime_index"), n.alias("tier"))


SCHOOL_CARD = r'(?is)circle-rating--(\d+)"[^>]*>\s*(?:</span>)?\s*([^<]*)'


def school_cards(pages: DataFrame) -> DataFrame:
    """(page_id, at, rating, level, name) of the school cards of each page."""
    cards = F.regexp_extract_all("html", F.lit(SCHOOL_CARD), F.lit(0))
    found = pages.select("page_id", F.posexplode(cards).alias("at", "card"))
    name = F.trim(F.regexp_extract("card", SCHOOL_CARD, 2))
    level = F.when(F.lower(name).rlike("elementary|primary"), "elementary").when(F.lower(name).rlike("middle|junior"), "middle").when(F.lower(name).rlike("high|senior"), "high")
    return found.select("page_id", "at", F.regexp_extract("card", SCHOOL_CARD, 1).try_cast("double").alias("rating"), level.alias("level"), name.alias("name"))


def school_rating(elementary: Column, middle: Column, high: Column) -> Column:
    """The mean of elementary and high to one place; middle only without both; zero counts as missing."""
    e, m, h = (F.when(c > 0, c) for c in (elementary, middle, high))
    both = (e + h) / 2
    return half_up(F.coalesce(both, e, h, m), 1)


def school_ratings(cards: DataFrame) -> DataFrame:
    """(page_id, elementary, middle, high, average_rating): the first card of each level."""
    first = lambda level: F.min_by("rating", F.when(F.col("level") == level, F.col("at"))).alias(level)
    levels = cards.groupBy("page_id").agg(*map(first, ("elementary", "middle", "high")))
    return levels.withColumn("average_rating", school_rating(F.col("elementary"), F.col("middle"), F.col("high")))


def _level(text: Column, **words: str) -> Column:
    """The first level, in the order given, whose pattern is in the text."""
    out = None
    for level, pattern in words.items():
        test = text.rlike(pattern)
        out = F.when(test, level) if out is None else out.when(test, level)
    return out


SCHOOL_LINK = r'(?is)<a\b[^>]*href\s*=\s*"[^"]*/school/[^"]*"[^>]*>(.*?)</a>'
SCHOOL_NAME = [SCHOOL_LINK, r"(?is)<h[234]\b[^>]*>(.*?)</h[234]>", r'(?is)<\w+\b[^>]*class\s*=\s*"[^"]*name[^"]*"[^>]*>(.*?)</']
LISTED_NAME = r'(?is)<(h[1-4]|\w+(?=[^>]*class\s*=\s*"[^"]*(?:name|title))|a(?=[^>]*href\s*=\s*"[^"]*/school/))\b[^>]*>(.*?)</\1>'
LISTED_RATING = r'(?is)<(\w+)\b(?=[^>]*(?:class\s*=\s*"[^"]*(?:rating|score|circle)|data-rating))[^>]*>'


def assigned_schools(pages: DataFrame) -> DataFrame:
    """(page_id, at, name, rating, level, grades) of the schools that a page's list marks as assigned.

    A mark's card is the nearest element around it that has a rating or a link
    to a school, or is a school card. The mark's text tells the level, else the
    card's. Cards without a name of over two characters are left out.
    """
    lists = H.elements(pages, lambda t: H.class_is(t, "school-list"), H.named("school-list")).groupBy("page_id").agg(F.min_by("inner", "at").alias("html"))
    lists = stage(lists.where(F.col("html").rlike(H.named("assigned-tag"))))
    marks = H.elements(lists, lambda t: H.class_is(t, "assigned-tag")).select("page_id", F.col("at").alias("mark"), F.col("last").alias("mark_last"), F.lower(H.text_of(F.col("inner"))).alias("told"))
    around = H.elements(lists, lambda t: F.lit(True)).where(F.col("inner").rlike(r'circle-rating--search-page|(?is)<a\b[^>]*href\s*=\s*"[^"]*/school/') | H.class_is(F.col("tag"), "school-card"))
    near = marks.join(around, "page_id").where("at < mark and last > mark_last").groupBy("page_id", "mark", "told").agg(F.max_by("inner", "at").alias("card"))
    rating = extracted(extracted(F.col("card"), r'class\s*=\s*"([^"]*circle-rating--[^"]*)"'), r"circle-rating--(\d+)").try_cast("double")
    level = F.coalesce(_level(F.col("told"), elementary="elementary", high="high school|union high", middle="middle"), _level(F.lower(H.text_of(F.col("card"))), elementary="elementary school|pre-k", high="high school", middle="middle school"))
    found = near.select("page_id", F.col("mark").alias("at"), H.first_text(F.col("card"), *SCHOOL_NAME).alias("name"), rating.alias("rating"), level.alias("level"), F.lit(None).cast("string").alias("grades"))
    return found.where(F.length("name") > 2)


def listed_schools(pages: DataFrame) -> DataFrame:
    """(page_id, at, name, rating, level, grades) of the schools of a page's cards, of the first kind of card that it has, or of its tables without cards."""
    kinds = [
        lambda t: H.class_has(t, "school-card"), lambda t: H.class_has(t, "SchoolCard"), lambda t: F.contains(F.coalesce(H.attribute(t, "data-testid"), F.lit("")), F.lit("school")),
        lambda t: H.class_is(t, "school-list-item"), lambda t: H.class_is(t, "school-result"), lambda t: t.rlike("(?i)^<article") & H.class_has(t, "school"),
        lambda t: H.class_has(t, "school-listing"), lambda t: t.rlike("(?i)^<li") & H.class_has(t, "school"),
    ]
    any_kind = lambda t: reduce(lambda a, b: a | b, (kind(t) for kind in kinds))
    tag = F.col("tag")
    kind = reduce(lambda c, i: c.when(kinds[i](tag), i), range(1, len(kinds)), F.when(kinds[0](tag), 0))
    cards = H.elements(pages, any_kind, H.named("school", "SchoolCard", attributes="class|data-testid")).withColumns({"kind": kind, "name": blank_to_null(H.text_of(extracted(F.col("inner"), LISTED_NAME, 2)))}).where("name is not null")
    cards = stage(cards)
    first = cards.groupBy("page_id").agg(F.min("kind").alias("kind"))
    mark = F.regexp_extract("inner", LISTED_RATING, 0)
    shown = H.text_of(extracted(F.col("inner"), LISTED_RATING + r"(.*?)</\1>", 2))
    rating = F.coalesce(blank_to_null(H.attribute(mark, "data-rating")), blank_to_null(H.attribute(mark, "data-score")), extracted(shown, r"(\d+)\s*/\s*10"), extracted(shown, r"^(\d+)$"), extracted(H.attribute(mark, "aria-label"), r"(\d+)"))
    text, style = F.lower(H.text_of(F.col("inner"))), F.lower(F.coalesce(H.attribute(tag, "class"), F.lit("")))
    level = F.when(text.rlike("elementary") | style.rlike("elementary"), "elementary").when(text.rlike("middle") | style.rlike("middle"), "middle").when(text.rlike("high") | style.rlike("high"), "high").when(text.rlike("k-5|k-6"), "elementary").when(text.rlike("6-8|7-8"), "middle").when(text.rlike("9-12"), "high")
    grades = blank_to_null(H.text_of(extracted(F.col("inner"), r'(?is)<(\w+)\b[^>]*class\s*=\s*"[^"]*grade[^"]*"[^>]*>(.*?)</\1>', 2)))
    whole = lambda c: extracted(c, r"^\s*(\d+)").try_cast("double")
    carded = cards.join(first, ["page_id", "kind"]).select("page_id", "at", "name", whole(rating).alias("rating"), level.alias("level"), grades.alias("grades"))
    rows = pages.join(first, "page_id", "left_anti").select("page_id", F.posexplode(H.table_rows(F.col("html"))).alias("at", "r"))
    row = F.lower(F.array_join("r", " "))
    tabled = rows.select("page_id", "at", F.get("r", F.lit(0)).alias("name"), extracted(F.get("r", F.lit(1)), r"(\d+)").try_cast("double").alias("rating"), _level(row, elementary="elementary", middle="middle", high="high").alias("level"), F.lit(None).cast("string").alias("grades"))
    return carded.unionByName(tabled.where("name <> '' and rating is not null"))


def schools_by_level(cards: DataFrame) -> DataFrame:
    """(page_id, elementary, middle, high, average_rating): the first school of each level as (name, rating).

    Where both elementary and high are missing, the first whose name, or grades,
    tell one of them take the places.
    """
    name, grades = F.lower("name"), F.coalesce("grades", F.lit(""))
    tells = {
        "elementary": F.contains(name, F.lit("elementary")) | grades.rlike("K|1-|-5"),
        "high": (F.contains(name, F.lit("high")) & ~F.contains(name, F.lit("higher"))) | grades.rlike("9-|-12"),
    }
    school = F.struct("name", "rating")
    first = lambda test, n: F.min_by(school, F.when(test, F.col("at"))).alias(n)
    found = cards.groupBy("page_id").agg(*(first(F.col("level") == n, n) for n in ("elementary", "middle", "high")), *(first(test, f"_{n}") for n, test in tells.items()))
    none = F.col("elementary").isNull() & F.col("high").isNull()
    placed = found.withColumns({n: F.when(none, F.col(f"_{n}")).otherwise(F.col(n)) for n in tells}).drop(*(f"_{n}" for n in tells))
    return placed.withColumn("average_rating", school_rating(F.col("elementary.rating"), F.col("middle.rating"), F.col("high.rating")))


def combine_external(crime: DataFrame, schools: DataFrame, walk: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each key with crime, schools, walkScore, the errors of missing sources, and whether any source succeeded."""
    pack = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    out = pack(crime, "crime").join(pack(schools, "schools"), key, "full").join(pack(walk, "walkScore"), key, "full")
    errors = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(f"{n}: no data")) for n in ("crime", "schools", "walkScore"))))
    return out.withColumns({"errors": errors, "success": F.size(errors) < 3})


def location_slug(df: DataFrame) -> DataFrame:
    """Join keys to captured pages: city with underscores and hyphens, and the whole address."""
    return df.withColumns({"city_underscore": slug(F.col("city"), "_"), "city_hyphen": slug(F.col("city"), "-"), "address_slug": slug(F.concat_ws(" ", "street", "city", "state_abbr"), "-")})


def ocr_confidence(tokens: DataFrame) -> DataFrame:
    """(doc_id, confidence): the mean confidence without -1, to two places, 0 without any."""
    return tokens.groupBy("doc_id").agg(F.coalesce(half_up(F.avg(F.when(F.col("conf") != -1, F.col("conf"))), 2), F.lit(0.0)).alias("confidence"))
