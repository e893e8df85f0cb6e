"""Queries of the table, feature, mapping and enrichment operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.functions import values as V
from acrelight.operators import enrich as E
from acrelight.operators import features as X
from acrelight.operators import formulas as D
from acrelight.operators import mapping as M
from acrelight.operators import tables as T
from acrelight.plans.fixtures import cte, dealt_out, view
from acrelight.plans.scoring_queries import d, half_up
from acrelight.sources.shared import stage

AS_OF = "2025-06-30"
RANGES = [(bed, bath, lo, lo + 350, f"{bed}x{bath}-{name}") for bed in "123" for bath in (1, 2) for lo, name in ((500, "classic"), (850, "renovated"))]


def cells(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The value column of the demographics cells; ``dealt`` ones meet by document, as in ``wide_cells``."""
    c = view(spark, sf_dir, "cells_fx")
    c = dealt_out(c, "doc_id") if dealt else c
    return c.select("doc_id", F.lit(0).alias("src_ord"), "table_index", "row_idx", F.lit(1).alias("col_idx"), F.lit("3 Mile").alias("header"), "value", "label", F.struct("t1", "t2", "t3").alias("tie"))


def wide_cells(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The label and value columns of the demographics cells, one table for each order line key.

    ``dealt`` cells meet by document first: least texts are found by sorting,
    which then holds a shuffled part instead of all that a file's part has, and
    what follows by table and document needs no further shuffle.
    """
    c = view(spark, sf_dir, "cells_fx")
    c = (dealt_out(c, "doc_id") if dealt else c).groupBy("doc_id", "table_index", "row_idx").agg(F.min("label").alias("label"), F.min("value").alias("value"))
    each = F.inline(F.array(F.struct(F.lit(0).alias("col_idx"), F.lit("Label").alias("header"), F.col("label").alias("cell")), F.struct(F.lit(1).alias("col_idx"), F.lit("3 Mile").alias("header"), F.col("value").alias("cell"))))
    return c.select("doc_id", F.lit(0).alias("src_ord"), "table_index", "row_idx", each).withColumnRenamed("cell", "value")


def quarter_cells(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Submarket tables: rows of orders as documents, a total row and a delivered row in each second table.

    ``dealt`` documents are shuffled before they become eight cells each, and none of these later.
    """
    o = view(spark, sf_dir, "orders")
    o = dealt_out(o.select("o_orderkey", "o_totalprice"), "o_orderkey") if dealt else o
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("long")
    row = lambda i, name, units, building, vacancy: F.struct(F.lit(i).alias("row_idx"), F.array(F.struct(F.lit("Current Quarter").alias("header"), name.alias("value")), F.struct(F.lit("Units").alias("header"), units.alias("value")), F.struct(F.lit("Under Constr Units").alias("header"), building.alias("value")), F.struct(F.lit("Vacancy Rate").alias("header"), vacancy.alias("value"))).alias("cells"))
    text = lambda c: c.cast("string")
    rows = F.array(row(0, F.lit("Submarket"), F.when(k % 7 == 0, F.lit("-")).otherwise(text(p)), text(k % 500), F.concat(text(k % 20), F.lit("%"))), row(1, F.lit("Delivered Units"), text(k % 900), F.lit("-"), F.lit("-")))
    each = o.select(k.alias("doc_id"), F.lit(0).alias("src_ord"), F.lit(0).alias("table_index"), F.explode(rows).alias("r"))
    return each.select("doc_id", "src_ord", "table_index", "r.row_idx", F.posexplode("r.cells").alias("col_idx", "c")).select("doc_id", "src_ord", "table_index", "row_idx", "col_idx", "c.header", "c.value")


def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged metric tables made from the orders."""
    k, p = F.col("o_orderkey").cast("string"), F.format_number(F.col("o_totalprice"), 0)
    line = lambda label, other: F.concat(F.lit(f"| {label}: | $"), p, F.lit(" | $1."), F.pmod("o_orderkey", F.lit(90)).cast("string"), F.lit(f" /SF | {label}: | "), F.pmod("o_orderkey", F.lit(30)).cast("string"), F.lit(".5% | "), k, F.lit(f" Units | {other}: | ("), k, F.lit(") Units |"))
    return view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", line("Current", "Current"), line("Last Quarter", "Competitor Total"), line("Year Ago", "Other")).alias("raw_text"))


def address_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, text, raw and cell items of each property, some without one or the other."""
    p = view(spark, sf_dir, "properties_fx")
    k = F.col("property_id")
    item = lambda kind, at, c: F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("page_number"), F.lit(at).alias("item_idx"), c.alias("text"))
    street = F.concat((k % 20 + 1).cast("string"), F.lit(" Main Street"))
    items = F.array(
        item("header", 0, F.lit("SUBJECT PROPERTY")),
        item("header", 1, F.when(k % 3 == 0, F.concat(street, F.lit(" - The Lofts "), k.cast("string"))).when(k % 3 == 1, street).otherwise("Overview")),
        item("text", 0, F.when(k % 4 == 0, "Phoenix, Arizona - Central").when(k % 4 == 1, "Austin, Texas").otherwise("built 1999")),
        item("text", 1, F.when(k % 5 == 0, "zip 85001 here").otherwise("none")),
        item("raw", 0, F.when(k % 4 == 2, "Boise, Idaho - North").otherwise(F.concat(F.lit("Juniper Court 183 Unit Apartment Building "), k.cast("string")))),
        item("cell", 0, F.when(k % 6 == 0, "98101-1234").otherwise("x")),
    )
    return p.select(k.alias("doc_id"), F.inline(items))


MAPPINGS = [
    M.FieldMapping("Summary", "B2", "Name", "property.name"),
    M.FieldMapping("Summary", "B3", "City", "property.location", transform="extract_city"),
    M.FieldMapping("Summary", "B4", "Vacancy", "vacancy.current.rate", transform="divide_by_100"),
    M.FieldMapping("Summary", "B5", "Price", "owner.price", transform="to_number"),
    M.FieldMapping("Units", "C1", "First unit", "unitBreakdown[0].bed"),
    M.FieldMapping("Units", "C2", "Third unit", "unitBreakdown[2].bed", fallback_path="unitBreakdown[1].bed"),
    M.FieldMapping("Loan", "D1", "Rate", None, source="external"),
]


def json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    unit = lambda n: F.struct(F.lit(n).alias("bed"))
    doc = F.struct(
        F.struct(F.when(k % 3 != 0, name).alias("name"), F.concat(segment, F.lit(", Texas")).alias("location")).alias("property"),
        F.struct(F.struct((k % 40).cast("double").alias("rate")).alias("current")).alias("vacancy"),
        F.struct(F.concat(F.lit("$"), (k * 1000).cast("string")).alias("price")).alias("owner"),
        F.when(k % 2 == 0, F.array(unit("1"), unit("2"))).otherwise(F.array(unit("1"), unit("2"), unit("3"))).alias("unitBreakdown"),
    )
    return view(spark, sf_dir, "customer").select(k.alias("doc_id"), F.to_json(doc).alias("json"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.resolve_mappings(json_docs(spark, sf_dir), MAPPINGS, F.lit(AS_OF).cast("date"))


def _parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = view(spark, sf_dir, "lineitem")  # noqa: E741
    price, q, k = F.col("l_extendedprice").cast("long").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    raw = F.when(k == 1, F.concat(F.lit("$"), price)).when(k == 2, F.concat(q, F.lit("%"))).when(k == 3, F.concat(F.lit("("), q, F.lit(") Units"))).when(k == 4, F.lit("-")).when(k == 5, F.concat(q, F.lit(",500 SF"))).when(k == 6, F.lit("n/a")).otherwise(price)
    c = F.col("raw")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw")).select("l_orderkey", "l_linenumber", "l_partkey", V.parse_numeric(c).alias("number"), V.parse_currency(c).alias("currency"), V.parse_percent(c).alias("percent"), V.parse_units(c).alias("units"), V.normalize_value_text(c)["number"].alias("leading"))


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("Admin Fee $"), (k % 500).cast("string"), F.when(k % 2 == 0, "\nDog Allowed").otherwise(""), F.when(k % 3 == 0, "\nCats allowed, weight limit").otherwise(""), F.when(k % 7 == 0, "\nNo pets").otherwise(""), F.lit("\nFree Gas, Water, Heat"))
    p = view(spark, sf_dir, "part").select(k, text.alias("t"))
    return p.select(k, X.one_time_fees(F.col("t"))["admin_fee"].alias("admin_fee"), X.pet_policy(F.col("t"))["dogs_allowed"].alias("dogs"), X.pet_policy(F.col("t"))["cats_allowed"].alias("cats"), F.size(X.pet_policy(F.col("t"))["restrictions"]).alias("restrictions"), F.array_join(X.recurring_expenses(F.col("t")), ",").alias("utilities"))


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = view(spark, sf_dir, "html_fx")
    walk = E.walk_scores(h).where("walk_score is not null")
    crime = E.crime_indices(h).where("violent_crime_index is not null or property_crime_index is not null")
    return E.combine_external(crime, E.school_ratings(E.school_cards(h)), walk).select("page_id", F.col("crime.total_crime_index").alias("crime"), F.col("schools.average_rating").alias("schools"), F.col("walkScore.walk_score").alias("walk"), F.size("errors").alias("n_errors"), "success")


def _schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned schools of pages that mark any, listed ones of the others."""
    pages = view(spark, sf_dir, "captured_fx")
    assigned = stage(E.assigned_schools(pages))
    found = E.schools_by_level(assigned.unionByName(E.listed_schools(pages).join(assigned.select("page_id").distinct(), "page_id", "left_anti")))
    return found.select("page_id", *(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("elementary", "middle", "high") for c in ("name", "rating")), "average_rating")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.extract_metrics(metric_texts(spark, sf_dir))


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("property_id"), F.trunc("o_orderdate", "month").alias("month"), F.col("o_totalprice").alias("amount"))
    sums = D.trailing_totals(ledger, F.lit("1997-12-01").cast("date"))
    return sums.select("property_id", *(V.half_up(F.col(c), 2).alias(c) for c in ("t12", "t6", "t3")))


QUERIES = {
    "unit_mix_summary": lambda s, x: T.unit_mix_summary(view(s, x, "units_fx")),
    "classify_units": lambda s, x: T.classify_units(view(s, x, "units_fx"), s.createDataFrame(RANGES, "bed string, bath int, lo int, hi int, class string")).groupBy("class").agg(F.count("*").alias("n"), F.sum("units").alias("units")),
    "array_mapping": lambda s, x: M.resolve_array_mapping(view(s, x, "units_fx").groupBy("property_id", "bed", "bath").agg(F.sum("units").alias("units"), F.sum("available").alias("available")).withColumn("k", F.concat("bed", F.col("bath").cast("string"))), 10, {"A": "bed_bath_label", "B": "units", "C": "occupied"}, "k"),
    "parse_values": _parse_values,
    "demographics_features": lambda s, x: X.demographics_features(cells(s, x)),
    "table_lookup": lambda s, x: T.table_lookup(wide_cells(s, x, dealt=True), "Median", "3 mile"),
    "demographics_lookups": lambda s, x: X.with_lookups(X.demographics_features(wide_cells(s, x, dealt=True)), wide_cells(s, x, dealt=True), X.DEMOGRAPHICS_LOOKUPS, markdown=False),
    "submarket_features": lambda s, x: X.submarket_features(quarter_cells(s, x)),
    "extract_metrics": _metrics,
    "extract_address": lambda s, x: X.extract_address(address_items(s, x)).withColumn("sources", F.array_join("sources", ",")),
    "resolve_mappings": lambda s, x: outcomes(s, x),
    "mapping_report": lambda s, x: M.mapping_report(outcomes(s, x)),
    "mapping_coverage": lambda s, x: M.coverage(outcomes(s, x)),
    "fees_and_policies": _policies,
    "walk_scores": lambda s, x: E.walk_scores(view(s, x, "html_fx")).select("page_id", "walk_score"),
    "crime_indices": lambda s, x: E.crime_indices(view(s, x, "html_fx")).drop("tier"),
    "crime_tiers": lambda s, x: E.crime_indices(view(s, x, "captured_fx")),
    "assigned_schools": lambda s, x: E.assigned_schools(view(s, x, "captured_fx")).select("page_id", "name", "rating", "level"),
    "listed_schools": lambda s, x: E.listed_schools(view(s, x, "captured_fx")).select("page_id", "name", "rating", "level", "grades"),
    "schools_by_level": _schools,
    "school_cards": lambda s, x: E.school_cards(view(s, x, "html_fx")).select("page_id", "rating", "level", "name"),
    "combine_external": _external,
    "location_slugs": lambda s, x: E.location_slug(view(s, x, "properties_fx")).select("property_id", "city_underscore", "city_hyphen", "address_slug"),
    "property_metrics": lambda s, x: X.property_metrics(view(s, x, "html_fx").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("Walk Score: "), (F.col("page_id") % 100).cast("string"), F.lit(" transit score "), (F.col("page_id") % 90).cast("string")).alias("text"))),
    "trailing_totals": _trailing,
}

TOP = lambda name, test: f"arg_max_null(CASE WHEN {test} THEN num END, (table_index, row_idx, t1, t2, t3)) FILTER (WHERE {test} AND num IS NOT NULL) AS {name}"


def number_sql(text: str) -> str:
    """The number of a cell in SQL; percentages are divided by 100."""
    return f"CASE WHEN {text} = '-' THEN NULL WHEN contains({text}, '%') THEN CAST(replace({text}, '%', '') AS DOUBLE) / {d(100.0)} ELSE CAST(replace({text}, '$', '') AS DOUBLE) END"


NUM = number_sql("value")
OUTCOMES = """outcomes AS (
  SELECT c_custkey AS doc_id, unnest(['Summary', 'Summary', 'Summary', 'Summary', 'Units', 'Units', 'Loan']) AS sheet, unnest(['B2', 'B3', 'B4', 'B5', 'C1', 'C2', 'D1']) AS cell,
    unnest(['Name', 'City', 'Vacancy', 'Price', 'First unit', 'Third unit', 'Rate']) AS label,
    unnest([CASE WHEN c_custkey % 3 = 0 THEN 'skipped' ELSE 'filled' END, 'filled', 'filled', 'filled', 'filled', 'filled', 'external']) AS status,
    unnest([CASE WHEN c_custkey % 3 <> 0 THEN c_name END, c_mktsegment, CAST(CAST(c_custkey % 40 AS DOUBLE) / CAST(100 AS DOUBLE) AS VARCHAR), 'price', '1', CASE WHEN c_custkey % 2 = 0 THEN '2' ELSE '3' END, NULL]) AS value
  FROM customer)"""
# the text of a double has an exponent from 10^7 on
_PRICE = "CAST(doc_id * 1000 AS VARCHAR)"
PRICE_TEXT = f"CASE WHEN doc_id * 1000 < 10000000 THEN concat({_PRICE}, '.0') ELSE concat(left({_PRICE}, 1), '.', coalesce(nullif(rtrim(substr({_PRICE}, 2), '0'), ''), '0'), 'E', length({_PRICE}) - 1) END"
SLUG = lambda c, m: f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '{m}', 'g'), '^{m}|{m}$', '', 'g')"
PICK = lambda way, test: f"arg_{way}_null(num, (table_index, row_idx)) FILTER (WHERE {test})"
ROWS = f"{cte('cells_fx')}, g AS (SELECT doc_id, table_index, row_idx, min(label) AS label, min(value) AS value FROM cells_fx GROUP BY 1, 2, 3), n AS (SELECT *, {NUM} AS num FROM g)"


_R = "CAST(page_id % 10 + 1 AS DOUBLE)"
LISTED = " UNION ALL ".join(
    f"SELECT page_id, {name} AS name, {rating} AS rating, {level} AS level, {grades} AS grades FROM pages WHERE page_id % 4 = {m}"
    for m, name, rating, level, grades in [
        (0, "'North School'", "CAST(NULL AS DOUBLE)", "'elementary'", "NULL"), (1, "'Hill School'", _R, "'elementary'", "NULL"), (1, "'Dale Middle'", "CAST(4 AS DOUBLE)", "'middle'", "NULL"),
        (2, "'Alpha Academy'", _R, "NULL", "'K'"), (2, "'Beta Academy'", "CAST(NULL AS DOUBLE)", "NULL", "'10-12'"), (3, "'Lake Middle'", _R, "'middle'", "NULL"),
        ("3 AND page_id % 6 = 1", "'Property crime'", "CAST(page_id % 70 + 1 AS DOUBLE)", "NULL", "NULL"), ("3 AND page_id % 6 = 1", "'Overall'", "CAST(page_id % 60 + 1 AS DOUBLE)", "NULL", "NULL"),
    ]
)


def lookups_sql() -> str:
    """The last rows' values, then what each lookup finds for those that are missing or zero."""
    own = {
        "population_3mile": "label = '2024 Population' AND num > 1000",
        "population_growth_3mile": "label IN ('Pop Growth 2024-2029', 'Household Growth')",
        "median_hh_income_3mile": "label = 'Median Household Income'",
        "median_home_value_3mile": "label = 'Median Home Value'",
        "renter_households_pct_3mile": "label = 'Renter Occupied'",
    }
    base = ", ".join(f"{PICK('max', t)} AS {n}" for n, t in own.items())
    found = ", ".join(f"arg_min(value, (table_index, row_idx)) FILTER (WHERE contains(lower(label), '{x[1].lower()}')) AS t{i}" for i, x in enumerate(X.DEMOGRAPHICS_LOOKUPS))
    text = {n: "coalesce(" + ", ".join(f"t{i}" for i, x in enumerate(X.DEMOGRAPHICS_LOOKUPS) if x[0] == n) + ")" for n in own}
    value = ", ".join(f"CASE WHEN coalesce({n}, 0) = 0 AND {t} IS NOT NULL THEN {number_sql(t)} ELSE {n} END AS {n}" for n, t in text.items())
    return f"WITH {ROWS}, b AS (SELECT doc_id, {base}, {found} FROM n GROUP BY 1) SELECT doc_id, {value} FROM b"


SQL = {
    "demographics_lookups": lookups_sql(),
    "unit_mix_summary": f"WITH {cte('units_fx')} SELECT property_id, sum(units) AS total_units, sum(available) AS total_available, {half_up('avg(avg_sf)', 4)} AS avg_sf, {half_up('avg(asking_rent)', 4)} AS avg_rent, count(*) AS rows FROM units_fx WHERE bed NOT IN ('Totals', 'All 2 Beds') GROUP BY 1",
    "classify_units": f"WITH {cte('units_fx')}, r(bed, bath, lo, hi, class) AS (VALUES {', '.join(map(str, RANGES))}) SELECT class, count(*) AS n, sum(units) AS units FROM units_fx u LEFT JOIN r ON u.bed = r.bed AND u.bath = r.bath AND avg_sf >= lo AND avg_sf < hi GROUP BY 1",
    "array_mapping": f"""WITH {cte('units_fx')}, g AS (SELECT property_id, bed, bath, sum(units) AS units, sum(available) AS available FROM units_fx GROUP BY 1, 2, 3), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY property_id ORDER BY concat(bed, bath)) + 9 AS INT) AS "row" FROM g)
        SELECT property_id, "row", unnest(['A', 'B', 'C']) AS "column", unnest([concat(bed, 'B/', bath, 'Ba'), CAST(units AS VARCHAR), CAST(units - available AS VARCHAR)]) AS value FROM p WHERE bed NOT IN ('Totals', 'All 2 Beds')""",
    "parse_values": f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS DOUBLE) AS p, CAST(CAST(floor(l_quantity) AS INT) AS DOUBLE) AS q, l_linenumber AS k FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, CASE k WHEN 1 THEN p WHEN 2 THEN q / {d(100.0)} WHEN 3 THEN q WHEN 4 THEN NULL WHEN 5 THEN q * 1000 + 500 WHEN 6 THEN NULL ELSE p END AS number,
        CASE k WHEN 1 THEN p WHEN 2 THEN q WHEN 3 THEN q WHEN 4 THEN NULL WHEN 5 THEN q * 1000 + 500 WHEN 6 THEN NULL ELSE p END AS currency,
        CASE k WHEN 1 THEN p WHEN 2 THEN q WHEN 3 THEN q WHEN 4 THEN NULL WHEN 5 THEN q WHEN 6 THEN NULL ELSE p END AS percent,
        CAST(CASE k WHEN 1 THEN p WHEN 2 THEN q WHEN 3 THEN -q WHEN 4 THEN NULL WHEN 5 THEN q WHEN 6 THEN NULL ELSE p END AS BIGINT) AS units,
        CASE k WHEN 2 THEN q WHEN 5 THEN q * 1000 + 500 WHEN 7 THEN p END AS leading FROM r""",
    "demographics_features": f"""WITH {cte('cells_fx')}, n AS (SELECT *, {NUM} AS num FROM cells_fx) SELECT doc_id, {TOP('population_3mile', "label = '2024 Population' AND num > 1000")},
        {TOP('population_growth_3mile', "label IN ('Pop Growth 2024-2029', 'Household Growth')")}, {TOP('median_hh_income_3mile', "label = 'Median Household Income'")}, {TOP('median_home_value_3mile', "label = 'Median Home Value'")},
        {TOP('renter_households_pct_3mile', "label = 'Renter Occupied'")} FROM n GROUP BY 1""".replace(" AND num IS NOT NULL)", ")"),
    "table_lookup": f"WITH {cte('cells_fx')}, g AS (SELECT doc_id, table_index, row_idx, min(value) AS value, min(label) AS label FROM cells_fx GROUP BY 1, 2, 3) SELECT doc_id, arg_min(value, (table_index, row_idx)) AS value FROM g WHERE contains(label, 'Median') GROUP BY 1",
    "submarket_features": f"""WITH o AS (SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS DOUBLE) AS units FROM orders)
        SELECT k AS doc_id, CASE WHEN k % 20 <> 0 THEN CAST(k % 20 AS DOUBLE) / {d(100.0)} END AS vacancy_rate, CAST(k % 900 AS DOUBLE) / units AS delivered_pct_of_inventory, CAST(k % 500 AS DOUBLE) / units AS construction_pct_of_inventory, CASE WHEN k % 20 <> 0 THEN 'table' END AS vacancy_source FROM o""",
    "resolve_mappings": f"WITH {OUTCOMES} SELECT doc_id, sheet, cell, label, status, CASE WHEN value = 'price' THEN {PRICE_TEXT} ELSE value END AS value FROM outcomes",
    "mapping_report": f"WITH {OUTCOMES} SELECT sheet, status, count(*) AS n FROM outcomes GROUP BY GROUPING SETS ((sheet, status), (status))",
    "mapping_coverage": f"WITH {OUTCOMES} SELECT sheet, count(*) FILTER (WHERE status = 'filled') AS filled, count(*) AS total, floor(CAST(count(*) FILTER (WHERE status = 'filled') AS DOUBLE) * 10000 / count(*) + {d(0.5)}) / 10000 AS share FROM outcomes GROUP BY 1",
    "fees_and_policies": "SELECT p_partkey, CAST(p_partkey % 500 AS DOUBLE) AS admin_fee, p_partkey % 2 = 0 AND p_partkey % 7 <> 0 AS dogs, p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AS cats, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS restrictions, 'Gas,Water,Heat' AS utilities FROM part",
    "walk_scores": "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN CAST(page_id % 101 AS INT) END AS walk_score FROM pages",
    "crime_indices": f"SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 80 AS DOUBLE) + {d(0.5)} END AS violent_crime_index, CASE WHEN page_id % 2 = 0 THEN CAST(concat(page_id % 70, '.3') AS DOUBLE) END AS property_crime_index, CASE WHEN page_id % 5 = 0 AND (page_id % 3 <> 0 OR page_id % 2 = 0) THEN CAST(concat(page_id % 60 + 1, '.1') AS DOUBLE) END AS total_crime_index FROM pages",
    "crime_tiers": f"""WITH c AS (SELECT page_id, page_id % 6 AS m, CAST(concat(page_id % 80 + 1, '.4') AS DOUBLE) AS v, CAST(concat(page_id % 70 + 1, '.5') AS DOUBLE) AS p FROM pages)
        SELECT page_id, CASE WHEN m < 5 THEN v END AS violent_crime_index, CASE WHEN m < 5 THEN p END AS property_crime_index, CASE m WHEN 0 THEN {half_up('(v + p) / 2', 1)} WHEN 1 THEN CAST(page_id % 60 + 1 AS DOUBLE) END AS total_crime_index, CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 4 END AS tier FROM c""",
    "assigned_schools": "SELECT page_id, 'North School' AS name, CAST(page_id % 10 + 1 AS DOUBLE) AS rating, 'elementary' AS level FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 'East', CAST(9 AS DOUBLE), 'high' FROM pages WHERE page_id % 4 = 0",
    "listed_schools": f"SELECT page_id, name, rating, level, grades FROM ({LISTED})",
    "schools_by_level": """WITH p AS (SELECT page_id, page_id % 4 AS m, CAST(page_id % 10 + 1 AS DOUBLE) AS r FROM pages)
        SELECT page_id, CASE m WHEN 0 THEN 'North School' WHEN 1 THEN 'Hill School' WHEN 2 THEN 'Alpha Academy' END AS elementary_name, CASE WHEN m < 3 THEN r END AS elementary_rating, CASE m WHEN 1 THEN 'Dale Middle' WHEN 3 THEN 'Lake Middle' END AS middle_name, CASE m WHEN 1 THEN CAST(4 AS DOUBLE) WHEN 3 THEN r END AS middle_rating,
          CASE m WHEN 0 THEN 'East' WHEN 2 THEN 'Beta Academy' END AS high_name, CASE WHEN m = 0 THEN CAST(9 AS DOUBLE) END AS high_rating, CASE m WHEN 0 THEN floor((r + 9) / 2 * 10 + 0.5) / 10 ELSE r END AS average_rating FROM p""",
    "school_cards": "SELECT page_id, CAST(page_id % 11 AS DOUBLE) AS rating, 'elementary' AS level, 'Elementary School' AS name FROM pages",
    "location_slugs": f"WITH {cte('properties_fx')} SELECT property_id, {SLUG('city', '_')} AS city_underscore, {SLUG('city', '-')} AS city_hyphen, {SLUG('concat_ws(chr(32), street, city, state_abbr)', '-')} AS address_slug FROM properties_fx",
    "property_metrics": "SELECT page_id AS doc_id, CAST(page_id % 100 AS INT) AS walk_score, CAST(page_id % 90 AS INT) AS transit_score FROM pages",
    "combine_external": f"""WITH c AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 80 AS DOUBLE) + {d(0.5)} END AS v, CASE WHEN page_id % 2 = 0 THEN CAST(concat(page_id % 70, '.3') AS DOUBLE) END AS p, CASE WHEN page_id % 4 <> 0 THEN CAST(page_id % 101 AS INT) END AS walk FROM pages)
        SELECT page_id, CASE WHEN page_id % 5 = 0 AND coalesce(v, p) IS NOT NULL THEN CAST(concat(page_id % 60 + 1, '.1') AS DOUBLE) END AS crime, CASE WHEN page_id % 11 > 0 THEN CAST(page_id % 11 AS DOUBLE) END AS schools, walk, CASE WHEN coalesce(v, p) IS NULL THEN 1 ELSE 0 END + CASE WHEN walk IS NULL THEN 1 ELSE 0 END AS n_errors, true AS success FROM c""",
    "extract_metrics": f"""WITH o AS (SELECT o_orderkey AS k, CAST(replace(format('{{:,.0f}}', o_totalprice), ',', '') AS DOUBLE) AS p, CAST(concat('1.', o_orderkey % 90) AS DOUBLE) AS sf, CAST(o_orderkey % 30 AS DOUBLE) + {d(0.5)} AS rate, CAST(o_orderkey AS DOUBLE) AS units FROM orders)
        SELECT k AS doc_id, 'current' AS metric, p AS per_unit, sf AS per_sf, rate AS vacancy_rate, units AS vacancy_units, 0 - units AS absorption FROM o UNION ALL SELECT k, 'last_quarter', p, sf, rate, units, NULL FROM o UNION ALL SELECT k, 'year_ago', p, sf, rate, units, NULL FROM o
        UNION ALL SELECT k, 'competitor_total', NULL, NULL, NULL, NULL, 0 - units FROM o""",
    "extract_address": """WITH a AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN concat(c_custkey % 20 + 1, ' Main Street') WHEN 1 THEN concat(c_custkey % 20 + 1, ' Main St') END AS street,
          CASE WHEN c_custkey % 3 = 0 THEN concat('The Lofts ', c_custkey) WHEN c_custkey % 4 <> 2 THEN 'Juniper Court' END AS name, ['Phoenix', 'Austin', 'Boise', NULL][c_custkey % 4 + 1] AS city, ['Arizona', 'Texas', 'Idaho', NULL][c_custkey % 4 + 1] AS state,
          ['AZ', 'TX', 'ID', NULL][c_custkey % 4 + 1] AS state_abbr, CASE WHEN c_custkey % 5 = 0 THEN '85001' WHEN c_custkey % 6 = 0 THEN '98101-1234' END AS zip FROM customer)
        SELECT k AS doc_id, street, name, city, state, zip, state_abbr, concat_ws(',', ['header:address-name,header:property-name', 'header:street', NULL][k % 3 + 1], ['text:city,text:state', 'text:city-state-simple', NULL, NULL][k % 4 + 1], CASE WHEN k % 5 = 0 THEN 'text:zip' END,
          CASE WHEN k % 4 = 2 THEN 'raw:city,raw:state' WHEN k % 3 > 0 THEN 'raw:property-name' END, CASE WHEN k % 6 = 0 AND k % 5 > 0 THEN 'table:zip' END) AS sources, nullif(concat_ws(', ', street, city, state_abbr, zip), '') AS address,
          CASE WHEN street IS NULL THEN 0 ELSE 30 END + CASE WHEN city IS NULL THEN 0 ELSE 25 END + CASE WHEN state_abbr IS NULL THEN 0 ELSE 25 END + CASE WHEN zip IS NULL THEN 0 ELSE 20 END AS confidence FROM a""",
    "trailing_totals": "SELECT o_custkey AS property_id, " + ", ".join(half_up(f"sum(o_totalprice) FILTER (WHERE date_trunc('month', o_orderdate) > DATE '1997-12-01' - INTERVAL {m} MONTH AND date_trunc('month', o_orderdate) <= DATE '1997-12-01')", 2) + f" AS t{m}" for m in (12, 6, 3)) + " FROM orders GROUP BY 1",
}
