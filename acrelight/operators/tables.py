"""Document tables: markdown, label lookup, classification, unit mix, metric tables.

Tables are cells: (doc_id, src_ord, table_index, row_idx, col_idx, header,
value); src_ord ranks where a table comes from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelight.functions.values import camel_key, half_up, parse_currency, parse_percent, parse_units, property_key

ROW = ["doc_id", "src_ord", "table_index", "row_idx"]
# Words in headers that classify a table, in the order in which they are tried.
TABLE_PATTERNS = {
    "unit_breakdown": [r"beds?\s*bath", r"avg\s*sf", r"units?\s*mix", r"asking\s*rent", r"effective\s*rent"],
    "rent_roll": [r"unit\s*#", r"tenant", r"lease\s*start", r"rent\s*amount"],
    "expenses": [r"expense", r"category", r"amount", r"per\s*unit"],
}
# How merged metric tables and their rows look.
METRIC_TABLE = r"\|\s*Current:\s*\|\s*\$[\d,]+\s*\|[^|]+\|\s*Current:\s*\|[^|]+\|[^|]+\|\s*Current:\s*\|[^|]+\|"
METRIC_ROW = r"\|\s*([^|]+):\s*\|\s*([^|]+)\|\s*([^|]+)\|\s*([^|]+):\s*\|\s*([^|]+)\|\s*([^|]+)\|\s*([^|]+):\s*\|\s*([^|]+)\|"
# Labels of metric rows and absorption rows.
METRICS = {"current": "current", "last quarter": "last_quarter", "year ago": "year_ago", "competitors": "competitors", "submarket": "submarket"}
ABSORPTION = {"current": "current", "competitor total": "competitor_total", "competitor avg": "competitor_avg", "submarket total": "submarket_total", "submarket avg": "submarket_avg"}


def parse_markdown(tables: DataFrame) -> DataFrame:
    """(doc_id, src_ord, table_index, row_idx, col_idx, header, value) of markdown tables (doc_id, src_ord, table_index, markdown).

    The first line with a pipe that is no rule has the headers, of which blank
    ones are dropped; cells go by their place after the first pipe, so a blank
    first header shifts them by one.
    """
    rule = r"^\|[\s:|-]+\|\z"
    piped = F.filter(F.split("markdown", "\n"), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(rule))
    lines = tables.withColumn("_lines", piped).where(F.size("_lines") > 0)
    headers = F.filter(F.transform(F.split(F.get("_lines", F.lit(0)), r"\|"), lambda h: F.trim(h)), lambda h: (h != "") & ~h.rlike(r"^-+\z"))
    rows = lines.withColumn("_headers", headers).select("doc_id", "src_ord", "table_index", "_headers", F.posexplode(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))).alias("row_idx", "_line"))
    cells = F.slice(F.transform(F.split("_line", r"\|"), lambda c: F.trim(c)), 2, F.size("_headers"))
    each = rows.withColumn("_cells", cells).select("doc_id", "src_ord", "table_index", "row_idx", "_cells", F.posexplode("_headers").alias("col_idx", "header"))
    return each.select(*ROW, "col_idx", "header", F.coalesce(F.get("_cells", F.col("col_idx")), F.lit("")).alias("value"))


def labelled(cells: DataFrame, row: Sequence[str] = ROW) -> DataFrame:
    """``cells`` with label, the first value of their row."""
    first = Window.partitionBy(*row).orderBy("col_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cells.withColumn("label", F.first("value").over(first))


def table_lookup(cells: DataFrame, label: str, column: str | None, markdown: bool = False) -> DataFrame:
    """(doc_id, value): of the first row whose label contains ``label``, the value in ``column``.

    A column matches by its whole name, then by a part of it; else markdown gives
    the second value, other tables the first that looks like a number. A row
    without any of these passes on to the next.
    """
    here = labelled(cells).where(F.contains(F.lower("label"), F.lit(label.lower())))
    whole = F.lit(False) if not column else (F.lower(F.trim("header")) == column.lower()) if markdown else F.col("header") == column
    part = F.lit(False) if not column else F.contains(F.lower("header"), F.lit(column.lower()))
    other = (F.col("col_idx") == 1) if markdown else (F.col("col_idx") > 0) & F.col("value").rlike(r"[\d$%]")
    tier = F.when(whole, 0).when(part, 1).when(other, 2)
    ranked = here.withColumn("_tier", tier).where("_tier is not null")
    return ranked.groupBy("doc_id").agg(F.min_by("value", F.struct("src_ord", "table_index", "row_idx", "_tier", "col_idx")).alias("value"))


def table_lookups(cells: DataFrame, wanted: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """(doc_id, a column for each name): many lookups of (label, column) in one pass over ``cells``, null where nothing is found.

    Cells have form, which is 0 for a table's markdown and 1 for its rows: a
    table's markdown is looked through before its rows, and a document's tables
    in order of src_ord and table_index. Rules are those of ``table_lookup``,
    but a whole name of a column is compared in any case only in markdown. Cells
    of rows that match no label leave before the one aggregation by document.
    """
    here = cells if "label" in cells.columns else labelled(cells, [*ROW, "form"])
    label, header, markdown = F.lower("label"), F.lower("header"), F.col("form") == 0
    other = F.when(markdown, F.col("col_idx") == 1).otherwise((F.col("col_idx") > 0) & F.col("value").rlike(r"[\d$%]"))
    picks = {}
    for name, (text, column) in wanted.items():
        tier = F.lit(None).cast("int")
        if column:
            whole = F.when(markdown, F.trim(header) == column.lower()).otherwise(F.col("header") == column)
            tier = F.when(whole, 0).when(F.contains(header, F.lit(column.lower())), 1)
        tier = F.coalesce(tier, F.when(other, 2))
        at = F.struct("src_ord", "table_index", "form", "row_idx", tier.alias("tier"), "col_idx")
        picks[name] = F.min_by("value", F.when(F.contains(label, F.lit(text.lower())) & tier.isNotNull(), at)).alias(name)
    return here.where(any_of(label, sorted({text.lower() for text, _ in wanted.values()}))).groupBy("doc_id").agg(*picks.values())


def classify_tables(tables: DataFrame) -> DataFrame:
    """``tables`` (headers array, first_cells array, error) with kind; tables with an error are left out.

    A property table has 'property' in a header and at least three of its first
    five rows begin with a cell that ends in a colon.
    """
    text = F.lower(F.array_join("headers", " "))
    colons = F.size(F.filter(F.slice("first_cells", 1, 5), lambda c: F.endswith(F.trim(c), F.lit(":"))))
    kind = F.when(F.contains(text, F.lit("property")) & (colons >= 3), "property_info")
    for name, patterns in TABLE_PATTERNS.items():
        kind = kind.when(text.rlike("|".join(patterns)), name)
    return tables.where("error is null").withColumn("kind", kind.otherwise("other"))


def property_info(cells: DataFrame) -> DataFrame:
    """(doc_id, key, value): facts of a property table, whose labels end in a colon; '-' is no value, the first wins."""
    # a row's label is at its value's place or before it
    pairs = labelled(cells.where("col_idx is null or col_idx <= 1")).where((F.col("col_idx") == 1) & F.endswith(F.trim("label"), F.lit(":")) & (F.trim("value") != "-"))
    return pairs.groupBy("doc_id", property_key(F.col("label")).alias("key")).agg(F.min_by(F.trim("value"), F.struct("src_ord", "table_index", "row_idx")).alias("value"))


def split_right_panel(cells: DataFrame, column: int = 2) -> DataFrame:
    """(doc_id, table_index, row_idx, panel, value): the right column belongs to the manager until a cell 'OWNER', then to the owner."""
    right = cells.where(F.col("col_idx") == column).withColumn("_owner", (F.upper(F.trim("value")) == "OWNER").cast("int"))
    upto = Window.partitionBy("doc_id", "src_ord", "table_index").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = right.withColumn("panel", F.when(F.max("_owner").over(upto) == 1, "owner").otherwise("manager"))
    return placed.where((F.col("_owner") == 0) & (F.trim("value") != "")).select("doc_id", "table_index", "row_idx", "panel", F.trim("value").alias("value"))


def _key(names: Mapping[str, str], label: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.lower(F.trim(label)))


def extract_metrics(docs: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """(doc_id, metric, per_unit, per_sf, vacancy_rate, vacancy_units, absorption) from merged metric tables of eight columns.

    Texts without a row of current values have none; a later row of a label
    replaces an earlier one. Absorption follows its own labels.
    """
    found = docs.where(F.col(text_col).rlike(METRIC_TABLE)).select("doc_id", F.posexplode(F.regexp_extract_all(text_col, F.lit(METRIC_ROW), F.lit(0))).alias("at", "row"))
    parts = found.select("doc_id", "at", *(F.trim(F.regexp_extract("row", METRIC_ROW, i)).alias(f"c{i}") for i in range(1, 9)))
    entry = lambda key, **values: F.struct(key.alias("metric"), *(values.get(n, F.lit(None).cast("double")).cast("double").alias(n) for n in ("per_unit", "per_sf", "vacancy_rate", "vacancy_units", "absorption")))
    each = parts.select(
        "doc_id",
        "at",
        F.inline(F.array(
            entry(_key(METRICS, F.col("c1")), per_unit=parse_currency(F.col("c2")), per_sf=parse_currency(F.col("c3"))),
            entry(_key(METRICS, F.col("c4")), vacancy_rate=parse_percent(F.col("c5")), vacancy_units=parse_units(F.col("c6"))),
            entry(_key(ABSORPTION, F.col("c7")), absorption=parse_units(F.col("c8"))),
        )),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return each.where("metric is not null").groupBy("doc_id", "metric").agg(*map(last, ("per_unit", "per_sf", "vacancy_rate", "vacancy_units", "absorption")))


def drop_total_rows(units: DataFrame) -> DataFrame:
    bed = F.lower(F.coalesce("bed", F.lit("")))
    return units.where(~F.contains(bed, F.lit("total")) & ~F.contains(bed, F.lit("all")))


def unit_mix_summary(units: DataFrame) -> DataFrame:
    """Units, available units, plain means of size and asking rent, and rows, of each property."""
    return drop_total_rows(units).groupBy("property_id").agg(F.sum("units").alias("total_units"), F.sum("available").alias("total_available"), half_up(F.avg("avg_sf"), 4).alias("avg_sf"), half_up(F.avg("asking_rent"), 4).alias("avg_rent"), F.count("*").alias("rows"))


def unit_totals(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, total_units): the sum of whole parts of the numbers under headers with 'unit', from cells (doc_id, table_index, header, number)."""
    under = F.contains(F.lower(camel_key(F.col("header"))), F.lit("unit"))
    return cells.groupBy("doc_id", "table_index").agg(F.coalesce(F.sum(F.when(under, F.col("number").cast("long"))), F.lit(0)).alias("total_units"))


def classify_units(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """``units`` with the class of their bed, bath and size range; ``ranges`` (bed, bath, lo, hi, class) is configuration."""
    r = ranges.select(F.col("bed").alias("_bed"), F.col("bath").alias("_bath"), "lo", "hi", "class")
    near = (F.col("bed") == F.col("_bed")) & (F.col("bath") == F.col("_bath")) & (F.col("avg_sf") >= F.col("lo")) & (F.col("avg_sf") < F.col("hi"))
    return units.join(r, near, "left").drop("_bed", "_bath", "lo", "hi")


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))
