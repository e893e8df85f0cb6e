"""Scorecard features from section tables and prose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelight import dims
from acrelight.functions.values import address_confidence, blank_to_null, extracted, full_address, parse_numeric
from acrelight.operators.tables import ROW, any_of, labelled, table_lookups

# Street words, and the patterns of addresses.
STREET_WORDS = "St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Rd|Road|Way|Ln|Lane|Ct|Court|Pl|Place|Cir|Circle"
STREET = rf"(?i)^(\d+\s+[\w\s]+(?:{STREET_WORDS})\.?(?:\s+[NESW]{{1,2}})?)"
STREET_AND_NAME = rf"(?i)^([\d\w\s]+(?:{STREET_WORDS})\.?(?:\s+[NESW]{{1,2}})?)\s*[-–]\s*(.+)\z"
CITY_STATE_AREA = r"^([A-Za-z\s]+),\s*([A-Za-z\s]+)\s*[-–]"
CITY_STATE = r"^([A-Za-z\s]+),\s*([A-Za-z\s]+)\z"
ZIP = r"\b(\d{5}(?:-\d{4})?)\b"
NAME_UNITS = r"(?i)^(.+?)\s+(\d+)\s+Unit\s+(?:Apartment|Building)"
# How prose tells shares of renters and vacancy.
RENT_SHARES = [r"(?i)(\d+(?:\.\d+)?)\s*%\s*(?:of\s+)?(?:households?\s+)?(?:now\s+)?rent", r"(?i)rent(?:er|al)?[:\s]+(\d+(?:\.\d+)?)\s*%"]
VACANCY = r"(?i)(?:submarket['s]?\s+)?vacancy\s+(?:rate\s+)?(?:of\s+|has\s+\w+\s+to\s+|is\s+|at\s+)?(\d+(?:\.\d+)?)\s*%"
# Utilities and pet restrictions.
UTILITIES = ["gas", "water", "electricity", "electric", "heat", "heating", "trash", "garbage", "sewer", "cable", "internet", "wifi"]
PET_RESTRICTIONS = [r"breed restrictions?", r"weight limit", r"max (\d+) pets?", r"pet deposit", r"pet rent"]


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def joined_prose(texts: DataFrame) -> DataFrame:
    """(doc_id, _text): a document's texts in order of their page and item, where they have these, then of the texts."""
    order = [c for c in ("src_ord", "page_number", "item_idx") if c in texts.columns]
    placed = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return texts.groupBy("doc_id").agg(F.array_join(F.transform(placed, lambda x: x["text"]), " ").alias("_text"))


def demographics_features(cells: DataFrame, texts: DataFrame | None = None, years: Sequence[str] = ("2024",)) -> DataFrame:
    """(doc_id, five 3-mile features): the last matching row wins; what is missing or zero is looked up in prose.

    ``cells`` have a label, and tie, which orders rows of the same place;
    ``texts`` (doc_id, text) is the section's prose. Only cells whose label
    matches are parsed, and one aggregation sees every cell once.
    """
    cells = cells if "label" in cells.columns else labelled(cells)
    cells = cells if "tie" in cells.columns else cells.withColumn("tie", F.lit(0))
    label = F.lower("label")
    here = (F.col("header") == "3 Mile") & (F.col("value") != "")
    has = lambda *words: F.coalesce(here & any_of(label, list(words)), F.lit(False))
    hits = {
        "population_3mile": has(*(f"{y} population" for y in years)) | F.coalesce(here & (label == "population"), F.lit(False)),
        "population_growth_3mile": has("pop growth", "population growth", "household growth"),
        "median_hh_income_3mile": has("median household income", "median hh income"),
        "median_home_value_3mile": has("median home value"),
        "renter_households_pct_3mile": has("renter"),
    }
    at = F.struct("src_ord", "table_index", "row_idx", "tie")
    marked = cells.select("doc_id", "value", at.alias("at"), *(hit.alias(n) for n, hit in hits.items()))
    shares = F.col("population_growth_3mile") | F.col("renter_households_pct_3mile")
    numbers = F.col("population_3mile") | F.col("median_hh_income_3mile") | F.col("median_home_value_3mile")
    parsed = marked.withColumns({"number": F.when(numbers, parse_numeric(F.col("value"))), "share": F.when(shares, parse_numeric(F.col("value"), percent=True))})
    parsed = parsed.withColumn("population_3mile", F.col("population_3mile") & (F.coalesce("number", F.lit(0.0)) > 1000))
    value = lambda n: "share" if n in ("population_growth_3mile", "renter_households_pct_3mile") else "number"
    out = parsed.groupBy("doc_id").agg(*(F.max_by(value(n), F.when(F.col(n), F.col("at"))).alias(n) for n in hits))
    return out if texts is None else renters_from_prose(out, texts)


def renters_from_prose(features: DataFrame, texts: DataFrame) -> DataFrame:
    """``features`` whose share of renters, where missing or zero, is the first that the prose names."""
    share = "renter_households_pct_3mile"
    out = features.join(joined_prose(texts), "doc_id", "full")
    told = F.coalesce(*(extracted(F.col("_text"), pattern) for pattern in RENT_SHARES)).try_cast("double") / 100
    return out.withColumn(share, F.coalesce(nonzero(F.col(share)), told, F.col(share))).drop("_text")


def with_lookups(features: DataFrame, cells: DataFrame, fallbacks: Sequence[tuple[str, str, str, bool]], markdown: bool = True) -> DataFrame:
    """``features`` whose missing or zero values are looked up: (feature, label, column, percent) in order.

    The first lookup of a feature that finds any text decides, even if the text
    is no number. All lookups are one pass over ``cells``, which have form or
    are all ``markdown``, or not; documents without features take part too.
    """
    cells = cells if "form" in cells.columns else cells.withColumn("form", F.lit(0 if markdown else 1))
    found = table_lookups(cells, {f"_found{i}": (label, column) for i, (_, label, column, _) in enumerate(fallbacks)})
    out = features.join(found, "doc_id", "full")
    for name in dict.fromkeys(f[0] for f in fallbacks):
        own = [(i, percent) for i, (feature, _, _, percent) in enumerate(fallbacks) if feature == name]
        text = F.coalesce(*(blank_to_null(F.col(f"_found{i}")) for i, _ in own))
        out = out.withColumn(name, F.when(nonzero(F.col(name)).isNull() & text.isNotNull(), parse_numeric(text, own[0][1])).otherwise(F.col(name)))
    return out.drop(*found.columns[1:])


# Where demographics are looked up when the 3-mile column has none.
DEMOGRAPHICS_LOOKUPS = [
    ("population_3mile", "2024 Population", "3 Mile", False),
    ("population_growth_3mile", "Pop Growth", "3 Mile", True),
    ("population_growth_3mile", "Population Growth", "3 Mile", True),
    ("population_growth_3mile", "Household Growth", "3 Mile", True),
    ("median_hh_income_3mile", "Median Household Income", "3 Mile", False),
    ("median_hh_income_3mile", "Median HH Income", "3 Mile", False),
    ("median_home_value_3mile", "Median Home Value", "3 Mile", False),
    ("renter_households_pct_3mile", "Renter", "3 Mile", True),
    ("renter_households_pct_3mile", "Renter Occupied", "3 Mile", True),
    ("renter_households_pct_3mile", "Renter Households", "3 Mile", True),
]


def submarket_features(cells: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, vacancy_rate, delivered_pct_of_inventory, construction_pct_of_inventory, vacancy_source).

    From tables with a column 'Current Quarter': its row 'Submarket' has units,
    vacancy and units under construction, its row 'Delivered Units' the
    delivered units. Values persist from table to table until the first table
    after which units are known. Prose goes before tables for vacancy; a column
    'Percent of Inventory' stands in for construction.
    """
    table = ["doc_id", "src_ord", "table_index"]
    value = lambda h: F.max(F.when(F.col("header") == h, F.col("value"))).alias(h)
    rows = cells.groupBy(*ROW).agg(*map(value, ("Current Quarter", "Units", "Vacancy Rate", "Under Constr Units", "Percent of Inventory")))
    name = F.lower("Current Quarter")
    total_row, delivered_row = name == "submarket", F.col("Current Quarter") == "Delivered Units"
    last = lambda test, c: F.max_by(c, F.when(test, F.col("row_idx")))
    each = rows.where(F.col("Current Quarter").isNotNull()).groupBy(*table).agg(
        last(total_row, parse_numeric(F.col("Units"))).alias("units"),
        last(total_row, parse_numeric(F.col("Under Constr Units"))).alias("building"),
        last(delivered_row, parse_numeric(F.col("Units"))).alias("delivered"),
        last(total_row, F.when(parse_numeric(F.col("Vacancy Rate"), True) != 0, parse_numeric(F.col("Vacancy Rate"), True))).alias("vacancy"),
    )
    upto = Window.partitionBy("doc_id").orderBy("src_ord", "table_index").rowsBetween(Window.unboundedPreceding, 0)
    carried = each.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("units", "building", "delivered")})
    at = F.struct("src_ord", "table_index")
    known = F.when(F.col("units") > 0, at)
    found = carried.groupBy("doc_id").agg(F.min_by("units", known).alias("units"), F.min_by(F.struct("building", "delivered"), known).alias("x"), F.min_by("vacancy", F.when(F.col("vacancy").isNotNull(), at)).alias("table_vacancy"))
    share = rows.where(blank_to_null(F.col("Percent of Inventory")).isNotNull()).groupBy("doc_id").agg(F.min_by(parse_numeric(F.col("Percent of Inventory"), True), F.struct("src_ord", "table_index", "row_idx")).alias("share"))
    out = cells.select("doc_id").distinct().join(found, "doc_id", "left").join(share, "doc_id", "left")
    prose = F.lit(None).cast("double")
    if texts is not None:
        out = out.join(joined_prose(texts), "doc_id", "full")
        prose = nonzero(extracted(F.col("_text"), VACANCY).try_cast("double") / 100)
    return out.select(
        "doc_id",
        F.coalesce(prose, "table_vacancy").alias("vacancy_rate"),
        F.try_divide(F.col("x.delivered"), "units").alias("delivered_pct_of_inventory"),
        F.coalesce(F.try_divide(F.col("x.building"), "units"), "share").alias("construction_pct_of_inventory"),
        F.when(prose.isNotNull(), "text").when(F.col("table_vacancy").isNotNull(), "table").alias("vacancy_source"),
    )


def property_metrics(texts: DataFrame) -> DataFrame:
    """(doc_id, walk_score, transit_score) from prose (doc_id, text)."""
    score = lambda word: extracted(F.col("text"), rf"(?i){word}\s*score[:\s]+(\d+)").try_cast("int")
    return texts.select("doc_id", score("walk").alias("walk_score"), score("transit").alias("transit_score"))


def state_abbr(name: Column, keep_unknown: bool = False) -> Column:
    """A state's abbreviation; else the first two letters in capitals.

    With ``keep_unknown`` what is no state, the capital's district included,
    stays as it is.
    """
    known = F.create_map(*(F.lit(x) for abbr, state in dims.STATE_NAMES.items() if not (keep_unknown and abbr == "DC") for x in (state.lower(), abbr)))
    if keep_unknown:
        return F.coalesce(F.try_element_at(known, F.lower(name)), name)
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(name))), blank_to_null(F.upper(F.left(F.trim(name), F.lit(2)))))


def extract_address(items: DataFrame) -> DataFrame:
    """(doc_id, street, name, city, state, zip, sources, state_abbr, address, confidence) from items (doc_id, kind, page_number, item_idx, text).

    Kinds are header, text, raw (lines of the raw text) and cell. Each part is
    the first that any source has: headers for streets, texts before raw lines
    for city and state, texts before cells for the zip code. ``sources`` says,
    in that order, where each part is from.
    """
    t = F.trim("text")
    kind = F.col("kind")
    head = (kind == "header") & ~t.isin("SUBJECT PROPERTY", "Subject Property", "PREPARED BY")
    named = t.rlike(STREET_AND_NAME)
    street = F.when(head & named, F.trim(F.regexp_extract(t, STREET_AND_NAME, 1))).when(head, blank_to_null(F.trim(F.regexp_extract(t, STREET, 1))))
    name = F.when(head & named, F.trim(F.regexp_extract(t, STREET_AND_NAME, 2))).when(kind == "raw", blank_to_null(F.trim(F.regexp_extract(t, NAME_UNITS, 1))))
    area, plain = t.rlike(CITY_STATE_AREA) & kind.isin("text", "raw"), t.rlike(CITY_STATE) & (kind == "text")
    place = lambda i: F.when(area, F.trim(F.regexp_extract(t, CITY_STATE_AREA, i))).when(plain, F.trim(F.regexp_extract(t, CITY_STATE, i)))
    code = F.when(((kind == "text") & ~area) | (kind == "cell"), blank_to_null(F.regexp_extract(t, ZIP, 1)))
    whole = F.when(area, F.lit(None).cast("string")).otherwise("text:city-state-simple")
    labels = {
        "street": F.when(named, "header:address-name").otherwise("header:street"),
        "name": F.when(kind == "header", "header:property-name").otherwise("raw:property-name"),
        "city": F.coalesce(whole, F.concat(kind, F.lit(":city"))),
        "state": F.coalesce(whole, F.concat(kind, F.lit(":state"))),
        "zip": F.when(kind == "cell", "table:zip").otherwise("text:zip"),
    }
    rank = F.struct(F.array_position(F.array(*map(F.lit, ("header", "text", "raw", "cell"))), kind).alias("r"), "page_number", "item_idx")
    values = {"street": street, "name": name, "city": place(1), "state": place(2), "zip": code}
    found = items.select("doc_id", rank.alias("at"), *(F.when(v.isNotNull(), F.struct(v.alias("value"), labels[n].alias("source"))).alias(n) for n, v in values.items()))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c)))).alias(c)
    # by document first, so no task sorts all that one part of the input expands to
    out = found.repartition("doc_id").groupBy("doc_id").agg(*map(first, values))
    told = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.at"), F.lit(i).alias("i"), F.col(f"{n}.{n}.source").alias("source"))) for i, n in enumerate(values))))
    out = out.select("doc_id", *(F.col(f"{n}.{n}.value").alias(n) for n in values), F.array_distinct(F.transform(F.array_sort(told), lambda x: x["source"])).alias("sources"))
    out = out.withColumn("state_abbr", state_abbr(F.col("state")))
    parts = [F.col(c) for c in ("street", "city", "state_abbr", "zip")]
    return out.withColumns({"address": full_address(*parts), "confidence": address_confidence(*parts)})


def best_address(subject: DataFrame, other: DataFrame) -> DataFrame:
    """The subject section's address if its confidence is at least 50, else the other section's if it has any."""
    cols = ["street", "name", "city", "state", "zip", "state_abbr", "address", "confidence"]
    both = subject.join(other.select("doc_id", F.struct(*cols).alias("_other")), "doc_id", "full").withColumn("_own", F.struct(*cols))
    chosen = F.when(F.col("confidence") >= 50, F.col("_own")).when(F.col("_other.confidence") > 0, F.col("_other"))
    return both.select("doc_id", chosen.alias("a")).select("doc_id", "a.*")


# Where the blocks of raw text with expenses and pet rules begin and end.
RECURRING_BLOCK = r"(?s)## RECURRING EXPENSES\s*\n(.*?)(?=\n## |\z)"
ONE_TIME_BLOCK = r"(?s)## ONE TIME EXPENSES\s*\n(.*?)(?=\n## |\nPET POLICY|\z)"
PET_BLOCK = r"(?s)PET POLICY\s*\n(.*?)(?=\n## |\n<!-- |\z)"


def expense_blocks(docs: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(doc_id, description, utilities, admin_fee, application_fee, deposit, dogs_allowed, cats_allowed, restrictions) of docs (doc_id, raw_text).

    Only the blocks of recurring expenses, one-time expenses and pets are read,
    and of ``sections`` (doc_id, item_idx, header, text) those whose header names
    either kind of expense; sections go before the raw text, whose fees replace
    theirs. The first text is the description. Without a block: no utilities, no fees, no pets.
    """
    raw = docs.select("doc_id", "raw_text")
    kinds = {"recurring": "RECURRING EXPENSES", "once": "ONE TIME EXPENSES"}
    if sections is not None:
        own = lambda name, mark: F.transform(F.array_sort(F.collect_list(F.when(F.contains(F.upper("header"), F.lit(mark)) & (F.trim("text") != ""), F.struct("item_idx", "text")))), lambda x: F.trim(x["text"])).alias(name)
        raw = raw.join(sections.groupBy("doc_id").agg(*(own(n, m) for n, m in kinds.items())), "doc_id", "left")
    else:
        raw = raw.withColumns({n: F.array().cast("array<string>") for n in kinds})
    block = lambda pattern: blank_to_null(F.regexp_replace(F.regexp_extract("raw_text", pattern, 1), r"^\s+|\s+\z", ""))
    texts = lambda n, pattern: F.array_compact(F.concat(F.coalesce(n, F.array().cast("array<string>")), F.array(block(pattern))))
    read = raw.select("doc_id", texts("recurring", RECURRING_BLOCK).alias("recurring"), F.array_join(texts("once", ONE_TIME_BLOCK), "\n").alias("once"), F.coalesce(F.regexp_extract("raw_text", PET_BLOCK, 1), F.lit("")).alias("pets"))
    named = F.array_distinct(F.flatten(F.transform("recurring", recurring_expenses)))
    fees, pets = one_time_fees(F.col("once")), pet_policy(F.col("pets"))
    return read.select("doc_id", F.get("recurring", F.lit(0)).alias("description"), named.alias("utilities"), *(fees[n].alias(n) for n in ("admin_fee", "application_fee", "deposit")), *(pets[n].alias(n) for n in ("dogs_allowed", "cats_allowed", "restrictions")))


def recurring_expenses(c: Column) -> Column:
    """The utilities named in a text, capitalised, in fixed order."""
    words = F.filter(F.array(*map(F.lit, UTILITIES)), lambda u: F.contains(F.lower(c), u))
    return F.transform(words, lambda u: F.initcap(u))


def one_time_fees(c: Column) -> Column:
    """The admin fee, application fee and deposit named in a text: of a line the first, of lines the last."""
    last = lambda word: F.regexp_replace(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(c, F.lit(rf"(?im)^.*?{word}[^\S\n]*\$?([\d,]+)"), F.lit(1))), -1), ",", "").try_cast("double")
    return F.struct(last(r"Admin[^\S\n]*Fee").alias("admin_fee"), last(r"Application[^\S\n]*Fee").alias("application_fee"), last("Deposit").alias("deposit"))


def pet_policy(c: Column) -> Column:
    """Whether dogs and cats are allowed, and the restrictions named; 'no pets' overrides."""
    t = F.lower(c)
    none = F.contains(t, F.lit("no pets"))
    allowed = lambda pet: ~none & (F.contains(t, F.lit(f"{pet} allowed")) | F.contains(t, F.lit(f"{pet}s allowed")))
    named = F.array_compact(F.array(*(blank_to_null(F.regexp_extract(t, p, 0)) for p in PET_RESTRICTIONS)))
    return F.struct(allowed("dog").alias("dogs_allowed"), allowed("cat").alias("cats_allowed"), named.alias("restrictions"))


def ordered_distinct(c: Column) -> Column:
    """A list's items of more than two characters, each once, in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: F.length(x) > 2))
