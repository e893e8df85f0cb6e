"""Scalar rules as column expressions: addresses, numbers, labels, text clean-up.

Casts never fail: text that is no number gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street words and their canonical form.
SUFFIXES = [("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("road", "rd"), ("lane", "ln"), ("court", "ct"), ("place", "pl"), ("apartment", "apt"), ("suite", "ste")]
# Labels of property facts with names of their own.
PROPERTY_ALIASES = {
    "no. of units": "no_of_units", "stories": "stories", "avg. unit size": "avg_unit_size", "type": "property_type", "rent type": "rent_type",
    "year built": "year_built", "parking": "parking", "distance to transit": "distance_to_transit",
}


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null if there is none."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def half_up(c: Column, digits: int) -> Column:
    """Rounded as floor(x * 10^n + 0.5) / 10^n on doubles; ties go up."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def normalize_address(c: Column) -> Column:
    """Lower case, no punctuation, single spaces, canonical street words; null gives the empty string."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[.,#-]", " "), r"\s+", " ")
    for word, short in SUFFIXES:
        out = F.regexp_replace(out, rf"\b(?:{word}|{short})\b", short)
    return F.trim(out)


def address_key(street: Column, city: Column, abbr: Column, state: Column | None = None) -> Column:
    """The matching key: street, city and state without blanks; the zip code has no part in it."""
    region = blank_to_null(abbr) if state is None else F.coalesce(blank_to_null(abbr), blank_to_null(state))
    return normalize_address(F.concat_ws(" ", blank_to_null(street), blank_to_null(city), region))


def number_in(c: Column) -> Column:
    """The leading number of a text such as '1-2' or '12.5.1'; null if it doesn't begin with one."""
    return F.regexp_extract(c, r"^(-?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def parse_numeric(c: Column, percent: bool = False) -> Column:
    """A cell's number: '$' and commas dropped, first run of digits, signs and dots; divided by 100 if a percentage."""
    bare = F.trim(F.regexp_replace(c, r"[$,]", ""))
    value = number_in(F.regexp_extract(bare, r"([-\d.]+)", 1))
    scaled = value / F.lit(100.0) if percent else F.when(F.contains(c, F.lit("%")), value / F.lit(100.0)).otherwise(value)
    return F.when((bare != "") & (bare != "-"), scaled)


def normalize_value(c: Column) -> Column:
    """A tagged struct (number, date, text): numbers with units, money, percentages, months; other text as it is."""
    t = F.trim(c)
    missing = t.isin("-", "n/a", "N/A", "")
    plain = extracted(t, r"^(\d{1,3}(?:,\d{3})?|\d+)(?:\.\d+)?(?: ?(?:Units|SF|Spaces))?$", 0)
    money = extracted(t, r"\$([\d,]+(?:\.\d+)?)")
    share = extracted(t, r"^(-?[\d.]+)%$")
    bare = lambda x: F.regexp_replace(x, r"[^\d.]", "").try_cast("double")
    month = F.try_to_date(extracted(t, r"^([A-Z][a-z]{2} \d{4})$"), "MMM yyyy")
    number = F.when(missing, None).when(plain.isNotNull(), bare(plain)).when(money.isNotNull(), bare(money)).when(share.isNotNull(), share.try_cast("double") / F.lit(100.0))
    date = F.when(missing | number.isNotNull(), None).otherwise(month)
    text = F.when(missing | number.isNotNull() | date.isNotNull(), None).otherwise(t)
    return F.struct(number.alias("number"), date.alias("date"), text.alias("text"))


def normalize_value_text(c: Column) -> Column:
    """The other reading of a cell: its leading number after commas go, percentages as they are written; else its text."""
    t = F.trim(c)
    missing = F.lower(t).isin("-", "n/a", "")
    number = number_in(F.regexp_replace(t, ",", ""))
    return F.struct(F.when(~missing, number).alias("number"), F.when(~missing & number.isNull(), t).alias("text"))


def parse_currency(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"\$?([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")


def parse_percent(c: Column) -> Column:
    """The first number, as a whole percentage."""
    return F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def parse_units(c: Column) -> Column:
    """The first whole number; negative if the cell has an opening parenthesis."""
    n = F.regexp_extract(c, r"(\d+)", 1).try_cast("long")
    return F.when(F.contains(c, F.lit("(")), -n).otherwise(n)


def camel_key(c: Column) -> Column:
    """A header as a camel-case key; words end at spaces, underscores and hyphens."""
    words = F.filter(F.split(F.lower(F.trim(c)), r"[\s_-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")


def property_key(c: Column) -> Column:
    """A property label as a snake-case key, some under names of their own."""
    bare = F.trim(F.lower(F.regexp_replace(c, r":+\z", "")))
    known = F.create_map(*(F.lit(x) for pair in PROPERTY_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, bare), F.replace(F.replace(bare, F.lit(" "), F.lit("_")), F.lit("."), F.lit("")))


def full_address(street: Column, city: Column, abbr: Column, zip_code: Column) -> Column:
    return blank_to_null(F.concat_ws(", ", *map(blank_to_null, (street, city, abbr, zip_code))))


def address_confidence(street: Column, city: Column, abbr: Column, zip_code: Column) -> Column:
    """30, 25, 25 and 20 points for the parts that are there."""
    have = lambda c, points: F.when(F.coalesce(c, F.lit("")) != "", points).otherwise(0)
    return have(street, 30) + have(city, 25) + have(abbr, 25) + have(zip_code, 20)


def valid_state(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z]{2}\z"), F.lit(False))


def valid_zip(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{5}(-\d{4})?\z"), F.lit(False))


def valid_zip5(c: Column) -> Column:
    """A zip code without its extension, as the lookup of crime pages takes it."""
    return F.coalesce(c.rlike(r"^\d{5}\z"), F.lit(False))


def extraction_id(path: Column) -> Column:
    """The extraction id that begins a storage path's last segment."""
    return extracted(F.element_at(F.split(path, "/"), -1), r"^(e_\d+-[a-z0-9]+)_")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


# The marks that converters leave, in the order in which they are rewritten.
CLEAN_UPS = [
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", ""),
    (r"(?s)\[embed\](.*?)\[/embed\]", "$1"),
    (r"(?s)\[binary content\](.*?)\[/binary content\]", "$1"),
    (r"(©[^\n\r]*?)(\r?)(?:\n|\z)(?:©[^\n\r]*?(?:\r?\n|\z))*", "$1$2\n"),
    (r"(?m)^(\d{1,2}/\d{1,2}/\d{4})\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?[^\n]*$", "$1"),
    (r"\bPage\s+(\d+)\s*(?:\r?\n|\z)", "[[Page $1]]\n"),
    (r"\[X\]|\[\s\]", "[✓]"),
    (r"[/\\]([\w\s.-]+)[/\\]", "[$1]"),
    (r"\n{4,}", "\n\n\n"),
    (r"[^\x20-\x7E\n\t]", " "),
]


def clean_text(c: Column) -> Column:
    """Text in plain ASCII without control characters, whose marks are rewritten in fixed order.

    The inside of embedded and binary marks stays, so do the first of several
    copyright lines, the date of a time stamp, page numbers as '[[Page n]]' and
    file names of paths in brackets; check boxes become one sign, which the last
    rule turns into a space as it does all that isn't ASCII.
    """
    for pattern, put in CLEAN_UPS:
        c = F.regexp_replace(c, pattern, put)
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def split_table_row(c: Column) -> Column:
    """Cells between runs of two or more spaces."""
    return F.split(F.trim(c), r"(?<=\S) {2,}(?=\S)")


def slug(c: Column, mark: str) -> Column:
    """Lower case, with runs of anything but letters and digits as ``mark``."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", mark), f"^{mark}|{mark}$", "")


def apply_transform(name: str | None, c: Column, as_of: Column) -> Column:
    """A named transform of a mapping, as text; an unknown name leaves the value as it is.

    Numbers are the text of a double: from 10^7 on, and below 10^-3, with an
    exponent, as in '2.745E7'.
    """
    if name == "divide_by_100":
        return (c.try_cast("double") / F.lit(100.0)).cast("string")
    if name == "to_number":
        return F.regexp_replace(c, r"[^\d.-]", "").try_cast("double").cast("string")
    if name == "years_since_purchase":
        return (F.year(as_of) - F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")).cast("string")
    if name == "extract_property_name":
        return F.coalesce(extracted(c, r"^(.+?)\s+\d+\s+Unit"), c)
    if name == "extract_city":
        return F.coalesce(extracted(c, r"^([^,]+),"), c)
    if name == "extract_state_abbrev":
        from acrelight.dims import STATE_NAMES

        known = F.create_map(*(F.lit(x) for abbr, state in STATE_NAMES.items() for x in (state.lower(), abbr)))
        return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.regexp_extract(c, r",\s*([A-Za-z ]+?)(?:\s*-.*)?$", 1)))), c)
    return c
