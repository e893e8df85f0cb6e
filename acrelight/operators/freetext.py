"""Facts from free text: unit rows, ordered regex banks, owner panels, amenities, first sections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelight.functions.values import blank_to_null, camel_key, extracted, normalize_value, normalize_value_text
from acrelight.operators.features import ordered_distinct, state_abbr

# A unit-mix row, and its fields in order with their types.
UNIT_ROW = r"^(\d+)\s+(\d+)\s+(\d+(?:,\d+)?)\s+(\d+)\s+([\d.]+)%\s+(\d+)\s+([\d.]+)%\s+\$?([\d,]+)\s+\$?([\d.]+)\s+\$?([\d,]+)\s+\$?([\d.]+)\s+([\d.]+)%"
UNIT_FIELDS = ["beds int", "baths int", "avg_sf double", "units int", "mix_percent double", "available int", "available_percent double", "asking_rent double", "asking_rent_sf double", "effective_rent double", "effective_rent_sf double", "concessions double"]
# Facts in prose and their patterns in the order in which they are tried.
KEY_PATTERNS = {
    "no_of_units": [r"(\d+)\s*(?:Units?|Apartments?)", r"Property\s+Size[:\s]*(\d+)"],
    "stories": [r"(\d+)\s*(?:Stor(?:y|ies)|Floor)"],
    "avg_unit_size": [r"Avg\.?\s*Unit\s*Size[:\s]*(\d+(?:,\d+)?)\s*SF", r"Average\s*(?:Unit\s*)?Size[:\s]*(\d+)"],
    "year_built": [r"Year\s*Built[:\s]*(\d{4})", r"Built\s*(?:in\s*)?(\d{4})"],
    "parking": [r"Parking[:\s]*(.+?)(?:\n|$)"],
    "name": [r"Owner[:\s]*(.+?)(?:\n|$)", r"Property\s*Manager[:\s]*(.+?)(?:\n|$)"],
    "purchase_date": [r"Purchase\s*Date[:\s]*(.+?)(?:\n|$)", r"Acquired[:\s]*(.+?)(?:\n|$)"],
    "purchase_price": [r"Purchase\s*Price[:\s]*(\$[\d,]+(?:\s*\([^)]+\))?)", r"Sale\s*Price[:\s]*(\$[\d,]+)"],
    "current": [r"Current[:\s]*([\d.]+%?\s*(?:Units?)?)"],
    "submarket_total": [r"Submarket(?:\s*Total)?[:\s]*([\d,]+\s*(?:Units?)?)"],
    "submarket_avg": [r"Submarket\s*Avg[:\s]*([\d.]+\s*(?:Units?)?)"],
}
PROPERTY_PATTERNS = {
    "property_name": [r"Property Name/Address[^\n]*\n([^\n]+)", r"^([^,\n]+)(?=\s*Apartments|\s*Property|\s*Complex)"],
    "address": [r"(\d+[^,\n]+(?:St|Rd|Pky|Blvd|Ave|Dr|Ln|Way)[^,\n]*)"],
    "city": [r"(?:St|Rd|Pky|Blvd|Ave|Dr|Ln|Way)[^,\n]*,\s*([^,\n]+)"],
    "state": [r",\s*([A-Z]{2})\s*\d{5}"],
    "zip": [r"\b(\d{5})\b"],
    "owner": [r"Owner:\s*([^\n]+)", r"Owner/Manager:\s*([^\n]+)"],
    "year_built": [r"Year Built:\s*(\d{4})", r"Built in\s*(\d{4})"],
    "number_of_units": [r"Property Size:\s*(\d+)\s*Units", r"(\d+)\s*(?:Units|Apartments)"],
    "number_of_floors": [r"(\d+)\s*(?:Floor|Story|Stories)"],
    "average_unit_size": [r"Avg\.\s*Unit\s*Size:\s*(\d+)\s*SF", r"Average\s*Size:\s*(\d+)"],
    "vacancy_rate": [r"Vacancy\s*(\d+\.?\d*%)"],
    "rent_per_sf": [r"Rent/SF\s*\$(\d+\.?\d*)"],
    "studio": [r"Studio[^\n]*?(\d+)\s*Units?"],
    "one_bed": [r"1\s*Beds?\s*[^\n]*?(\d+)\s*Units?"],
    "two_bed": [r"2\s*Beds?\s*[^\n]*?(\d+)\s*Units?"],
    "three_bed": [r"3\s*Beds?\s*[^\n]*?(\d+)\s*Units?"],
}
# Patterns of owner panels, places and amenity blocks.
PHONE = r"^\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
PURCHASED = r"(?:Purchased\s+)?([A-Za-z]+\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"
PRICED = r"^\$([\d,]+)(?:\s*\(([^)]+)\))?"
LOCATED = r"^([^,]+),\s*([A-Za-z\s]+?)(?:\s*-|\z)"
SITE_BLOCK = r"## SITE AMENITIES\s*\n([\s\S]*?)(?=\n## |\n<!-- image -->|\z)"
UNIT_BLOCK = r"## UNIT AMENITIES\s*\n([\s\S]*?)(?=\n## |\n<!-- |\z)"


def parse_unit_row(line: Column) -> Column:
    """The twelve fields of a unit-mix row as a struct, null for other lines; only a number's first comma goes."""
    # the row is matched once, and its fields are bound as one array
    fields = F.split(F.regexp_replace(line, rf"(?s){UNIT_ROW}.*", " ".join(f"${i + 1}" for i in range(len(UNIT_FIELDS)))), " ")
    part = lambda p, i: F.regexp_replace(F.get(p, F.lit(i)), r"^([^,]*),", "$1")
    typed = lambda p: F.struct(*(part(p, i).try_cast(f.split()[1]).alias(f.split()[0]) for i, f in enumerate(UNIT_FIELDS)))
    return F.when(line.rlike(UNIT_ROW), F.get(F.transform(F.array(fields), typed), F.lit(0)))


def parse_metric_row(line: Column) -> Column:
    """Values and units of a row's parts, which two or more spaces separate; null for fewer than two parts."""
    parts = F.filter(F.split(line, r"\s{2,}"), lambda p: p != "")

    def value(p: Column) -> Column:
        words = F.split(p, r"[\s$]+")
        more = F.size(words) >= 2
        return F.struct(normalize_value(F.when(more, F.get(words, F.lit(1))).otherwise(p)).alias("value"), F.when(more, blank_to_null(F.get(words, F.lit(2)))).alias("unit"))

    return F.when(F.size(parts) >= 2, F.transform(parts, value))


def bank(text: Column, patterns: Mapping[str, Sequence[str]], ignore_case: bool = False) -> list[Column]:
    """One column for each key: the first pattern that finds anything, trimmed."""
    flag = "(?i)" if ignore_case else ""
    return [F.coalesce(*(blank_to_null(F.trim(F.regexp_extract(text, flag + p, 1))) for p in found)).alias(key) for key, found in patterns.items()]


def extract_key_values(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, eleven facts) of prose."""
    return docs.select("doc_id", *bank(F.col(text_col), KEY_PATTERNS, ignore_case=True))


def extract_property_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, sixteen facts, amenities) of a report's plain text."""
    listed = F.coalesce(extracted(F.col(text_col), r"Amenities:([^\n]+)"), extracted(F.col(text_col), r"SITE AMENITIES\n([^\n]+)"))
    return docs.select("doc_id", *bank(F.col(text_col), PROPERTY_PATTERNS), F.transform(F.split(listed, ","), lambda a: F.trim(a)).alias("amenities"))


def fill_missing(found: DataFrame, more: DataFrame, key: str = "doc_id") -> DataFrame:
    """``found`` with its nulls filled from ``more``."""
    other = more.select(key, *(F.col(c).alias(f"_{c}") for c in found.columns if c != key))
    return found.join(other, key, "left").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in found.columns if c != key))


def panel_facts(panel: DataFrame) -> DataFrame:
    """(doc_id, manager_name, manager_phone, owner_name, purchase_price, purchase_price_raw, price_per_unit, purchase_date) of panel rows (doc_id, table_index, row_idx, panel, value).

    A manager's value is a phone number or a name; an owner's begins with '$', has
    a date, or is a name. The first name wins, the last of the others.
    """
    v, at = F.col("value"), F.struct("table_index", "row_idx")
    owner = F.col("panel") == "owner"
    phone = ~owner & v.rlike(PHONE)
    price = owner & F.startswith(v, F.lit("$"))
    date = owner & ~price & v.rlike(PURCHASED)
    last = lambda c, test: F.max_by(c, F.when(test, at))
    first = lambda c, test: F.min_by(c, F.when(test, at))
    return panel.groupBy("doc_id").agg(
        first(v, ~owner & ~phone).alias("manager_name"),
        last(v, phone).alias("manager_phone"),
        first(v, owner & ~price & ~date).alias("owner_name"),
        last(v, price & v.rlike(PRICED)).alias("purchase_price"),
        last(F.regexp_replace(F.regexp_extract(v, PRICED, 1), ",", ""), price & v.rlike(PRICED)).alias("purchase_price_raw"),
        last(blank_to_null(F.regexp_extract(v, PRICED, 2)), price & (F.regexp_extract(v, PRICED, 2) != "")).alias("price_per_unit"),
        last(F.when(F.contains(v, F.lit("Purchased")), v).otherwise(F.regexp_extract(v, PURCHASED, 1)), date).alias("purchase_date"),
    )


def address_from_sections(sections: DataFrame) -> DataFrame:
    """(doc_id, address, name, city, state) from each document's first section (doc_id, ord, header, content array)."""
    first = sections.groupBy("doc_id").agg(F.min_by(F.struct("header", "content"), "ord").alias("s")).select("doc_id", "s.*")
    name, place = F.get("content", F.lit(0)), F.get("content", F.lit(1))
    general = F.upper("header").rlike("^(PREPARED|SUBJECT|PROPERTY)")
    return first.select(
        "doc_id",
        F.when(~general, blank_to_null(F.trim("header"))).alias("address"),
        F.coalesce(blank_to_null(F.trim(F.regexp_extract(name, r"^(.+?)\s+\d+\s+Unit", 1))), blank_to_null(F.trim(F.regexp_extract(name, r"^([A-Za-z\s]+)", 1)))).alias("name"),
        blank_to_null(F.trim(F.regexp_extract(place, LOCATED, 1))).alias("city"),
        state_abbr(blank_to_null(F.regexp_extract(place, LOCATED, 2))).alias("state"),
    )


def amenities(text: Column) -> Column:
    """A struct of site and unit amenities, from their blocks; site amenities may stand in table rows."""
    site = F.regexp_extract(text, SITE_BLOCK, 1)
    unit = F.regexp_extract(text, UNIT_BLOCK, 1)
    rows = F.filter(F.split(site, r"[|\n]"), lambda x: ~x.rlike(r"^[\s:-]*\z"))
    return F.struct(ordered_distinct(rows).alias("site"), F.filter(ordered_distinct(F.split(unit, "\n")), lambda x: ~F.startswith(x, F.lit("#"))).alias("unit"))


def amenity_lists(texts: DataFrame, cells: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, site, unit): amenities of all places in a report, each once, in order.

    Site amenities come from the block of ``texts`` (doc_id, text), then from
    cells of tables without headers but blank ones and numbers. Unit amenities
    come from ``sections`` (doc_id, ord, header, content array) headed so, then
    from the block.
    """
    nameless = F.min(F.col("header").rlike(r"^\d*\z").cast("int")).over(Window.partitionBy("doc_id", "src_ord", "table_index")) == 1
    listed = lambda *order: F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"])
    site = cells.withColumn("_bare", nameless).where(F.col("_bare") & (F.length("value") > 2)).groupBy("doc_id").agg(listed("src_ord", "table_index", "row_idx", "col_idx").alias("_site"))
    headed = sections.where(F.contains(F.upper("header"), F.lit("UNIT AMENITIES")))
    unit = headed.select("doc_id", "ord", F.posexplode("content").alias("at", "value")).groupBy("doc_id").agg(listed("ord", "at").alias("_unit"))
    block = texts.select("doc_id", amenities(F.col("text")).alias("_block"))
    both = block.join(site, "doc_id", "full").join(unit, "doc_id", "full")
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return both.select("doc_id", F.array_distinct(F.concat(some(F.col("_block.site")), some(F.col("_site")))).alias("site"), F.array_distinct(F.concat(ordered_distinct(some(F.col("_unit"))), some(F.col("_block.unit")))).alias("unit"))


def format_unit_mix(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_idx, key, number, text): unit-mix cells under camel-case keys."""
    value = normalize_value_text(F.col("value"))
    return cells.select("doc_id", "table_index", "row_idx", camel_key(F.col("header")).alias("key"), value["number"].alias("number"), value["text"].alias("text"))


def collect_tables(*sources: DataFrame) -> DataFrame:
    """Cells of several sources as one, earlier sources first."""
    placed = [df.drop("src_ord").withColumn("src_ord", F.lit(i)) for i, df in enumerate(sources)]
    out = placed[0]
    for df in placed[1:]:
        out = out.unionByName(df)
    return out


def match_source_document(bases: DataFrame, files: DataFrame) -> DataFrame:
    """(base, file_name): the least file name that holds each base's id; ids are cut out on both sides, so it is an equal join."""
    file_id = r"(\d{6,}-[a-z0-9]+)"
    named = files.select(extracted(F.col("file_name"), file_id).alias("file_id"), "file_name").where("file_id is not null")
    first = named.groupBy("file_id").agg(F.min("file_name").alias("file_name"))
    return bases.withColumn("file_id", extracted(F.col("base"), file_id)).join(first, "file_id", "left").select("base", "file_name")


def deal_decision(score: Column, submit: float = 7.0, deeper: float = 6.0) -> Column:
    """The second scorecard's decision."""
    return F.when(score >= submit, "Submit LOI").when(score >= deeper, "Deeper Dive").otherwise("Don't")
