"""Queries of smaller operators: predicates, policy blocks, statements, comparables, section documents, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.functions import values as V
from acrelight.operators import features as X
from acrelight.operators import formulas as D
from acrelight.operators import freetext as Z
from acrelight.operators import lines as N
from acrelight.operators import mapping as M
from acrelight.operators import portfolio as P
from acrelight.operators import sections as S
from acrelight.operators import tables as T
from acrelight.plans.feature_queries import MAPPINGS, OUTCOMES, outcomes
from acrelight.plans.fixtures import VIEWS, cte, view
from acrelight.plans.scoring_queries import SCORED, d, half_up, scored

# Lines of many kinds, by the number of each order.
LINES = ["RENT ROLL SUMMARY", "2.1 Units", "part four", "the vacancy is low", "Unit  Type  Total", "12  Units  900", "", "----", "plain words here", "Year: 1999"]
VIEWS["kinds_fx"] = "SELECT o_orderkey AS doc_id, element_at(array(" + ", ".join(f"'{x}'" for x in LINES) + "), CAST(o_orderkey % 10 AS INT) + 1) AS line FROM {orders}"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("line")
    return view(spark, sf_dir, "kinds_fx").select("doc_id", N.is_section_header(c).alias("header"), N.is_table_header(c).alias("table_header"), N.is_table_end(c).alias("table_end"), N.section_kind(c).alias("section_kind"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    state = F.element_at(F.array(*map(F.lit, ("AZ", "nv", "A1", "", " TX", "NEW", None))), (k % 7).cast("int") + 1)
    number = F.lpad((k * 31 % 100000).cast("string"), 5, "0")
    zip_code = F.when(k % 5 == 0, number).when(k % 5 == 1, F.concat(number, F.lit("-1234"))).when(k % 5 == 2, F.concat(number, F.lit("-12"))).when(k % 5 == 3, F.left(number, F.lit(4)))
    return view(spark, sf_dir, "customer").select(k, V.valid_state(state).alias("state"), V.valid_zip(zip_code).alias("zip"), V.valid_zip5(zip_code).alias("zip5"), V.content_hash(F.coalesce(state, F.lit("none"))).alias("hash"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose facts stand in and outside of their blocks, some fees in sections."""
    k, lit = F.col("p_partkey"), F.lit
    text = F.concat(
        lit("Dogs allowed, no pets, free cable, Deposit $9\n"),
        F.when(k % 2 == 0, lit("## RECURRING EXPENSES\n\n Free Gas, Water \n## X\n")).otherwise(""),
        F.when(k % 3 == 0, F.concat(lit("## ONE TIME EXPENSES\nAdmin Fee $"), (k % 500).cast("string"), lit("\nDeposit $1,200 or Deposit $7\nPET POLICY\nCats allowed, max 2 pets\n## Y\nPet rent"))).otherwise(""),
    )
    p = view(spark, sf_dir, "part")
    sections = p.where(k % 5 == 0).select(k.alias("doc_id"), F.inline(F.array(F.struct(lit(1).alias("item_idx"), lit("Recurring expenses").alias("header"), lit("Trash included").alias("text")), F.struct(lit(2).alias("item_idx"), lit("One time expenses").alias("header"), lit("Application Fee $50").alias("text")))))
    found = X.expense_blocks(p.select(k.alias("doc_id"), text.alias("raw_text")), sections)
    return found.select("doc_id", "description", F.array_join("utilities", ",").alias("utilities"), "admin_fee", "application_fee", "deposit", "dogs_allowed", "cats_allowed", F.array_join("restrictions", ",").alias("restrictions"))


def _statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    ledger = view(spark, sf_dir, "orders").select(k.alias("property_id"), F.trunc("o_orderdate", "month").alias("month"), F.when(F.col("o_orderkey") % 3 == 0, "expense").otherwise("revenue").alias("kind"), F.col("o_totalprice").alias("amount"))
    c = F.col("c_custkey")
    units = view(spark, sf_dir, "customer").where(c % 4 > 0).select(c.alias("property_id"), (c % 90).alias("total_units"), (c % 70).alias("occupied_units"))
    rounded = lambda n: V.half_up(F.col(n), 4).alias(n)
    return D.statement(ledger, units, F.lit("1997-12-01").cast("date")).select("property_id", "period", *map(rounded, ("revenue", "expenses", "noi", "expense_ratio", "revenue_per_unit", "noi_per_unit", "occupancy")))


def _comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(F.col("p_brand").alias("market"), F.col("p_retailprice").alias("rent_per_unit"), (k % 97).cast("double").alias("rent_per_sf"), (k % 13).cast("double").alias("vacancy"), (1970 + k % 50).alias("year_built"), F.col("p_size").alias("units"))


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = view(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select((F.col("l_linenumber") % 5).alias("star"), F.floor("l_extendedprice").alias("price"), F.col("l_quantity").cast("int").alias("units"), F.concat(F.lit("Buyer "), F.col("l_suppkey").cast("string")).alias("buyer"), F.col("l_shipdate").cast("date").alias("sold_on"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of conversations in sections, and tables on their pages and on pages that aren't there."""
    p = view(spark, sf_dir, "pages_fx")
    odd = F.col("page_number") % 2 == 1
    pages = p.select("doc_id", "page_number", F.when(odd, "demographics").otherwise("construction").alias("section"))
    tables = p.where("doc_id % 3 = 0").select("doc_id", (F.col("page_number") + F.when(F.col("doc_id") % 2 == 0, 100).otherwise(0)).alias("page_number"), F.col("page_number").alias("table_index"), F.concat(F.lit("| t"), F.col("page_number").cast("string"), F.lit(" |")).alias("markdown"))
    found = S.section_documents(pages, p.select("doc_id", "page_number", "text"), tables)
    return found.select("doc_id", "section", "first_page", "last_page", F.size("pages").alias("n_pages"), F.array_join(F.transform("tables", lambda t: t["markdown"]), ";").alias("tables"), F.length("raw_text").alias("n_chars"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("words\n| Label | | 3 Mile |\n|---|:-:|---|\n| Pop | "), k, F.lit(" | 7 |\n\n| Rent |\n"))
    return T.parse_markdown(view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("src_ord"), F.lit(0).alias("table_index"), text.alias("markdown"))).select("doc_id", "row_idx", "col_idx", "header", "value")


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    line = F.when(k % 4 == 0, F.lit("one part only")).otherwise(F.concat(F.lit("Rent $"), (k * 10).cast("string"), F.lit(" /SF  "), (k % 50).cast("string"), F.lit("%  n/a")))
    parts = view(spark, sf_dir, "supplier").select(k, F.posexplode_outer(Z.parse_metric_row(line)).alias("at", "part"))
    return parts.select(k, "at", F.col("part.value.number").alias("number"), F.col("part.value.text").alias("text"), F.col("part.unit").alias("unit"))


def _metric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Submarket", "Other", "Current", "Year Ago", "Competitors", "Last Quarter", "Else"]
    metric: Column = F.element_at(F.array(*map(F.lit, names)), (F.col("l_linenumber") % 7).cast("int") + 1)
    counts = view(spark, sf_dir, "lineitem").groupBy(metric.alias("metric")).agg(F.count("*").alias("n"))
    return N.order_metric_keys(counts)


def _breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("property_id") % 5 > 0, F.col("state_abbr"))
    p = view(spark, sf_dir, "properties_fx").select("property_id", F.when(F.col("property_id") % 2 == 0, "SOUTH").otherwise("").alias("region"), state.alias("state"), "city")
    return p.select("property_id", F.array_join(P.breadcrumb_path(F.col("region"), F.col("state"), F.col("city")), " > ").alias("path"))


def _typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = view(spark, sf_dir, "lineitem")  # noqa: E741
    header = F.element_at(F.array(*map(F.lit, ("No. of Units", "avg sf", "UNIT count", "rent"))), (F.col("l_linenumber") % 4).cast("int") + 1)
    return l.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_index"), header.alias("header"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_quantity") + 0.5).alias("number"))


QUERIES = {
    "line_predicates": _kinds,
    "valid_codes": _codes,
    "expense_blocks": _blocks,
    "statement": _statement,
    "comparable_summary": lambda s, x: D.comparable_summary(_comps(s, x)).select("market", "comparables", *(V.half_up(F.col(f"avg_{c}"), 4).alias(f"avg_{c}") for c in ("rent_per_unit", "rent_per_sf", "vacancy")), "min_year_built", "max_year_built", "min_units", "max_units"),
    "sales_by_star": lambda s, x: D.sales_by_star(_sales(s, x)).withColumn("price_per_unit", V.half_up(F.col("price_per_unit"), 4)),
    "top_buyers": lambda s, x: D.top_buyers(_sales(s, x), F.lit("1995-06-01").cast("date"), 7),
    "section_documents": _documents,
    "parse_markdown": _markdown,
    "parse_metric_row": _metric_rows,
    "order_metric_keys": _metric_order,
    "breadcrumbs": _breadcrumbs,
    "unit_totals": lambda s, x: T.unit_totals(_typed_cells(s, x)),
    "source_coverage": lambda s, x: M.coverage(M.with_source(outcomes(s, x), MAPPINGS), "source"),
    "score_list": lambda s, x: P.score_list(scored(s, x)),
}

_MARKS = [(True, False, True, "table"), (True, False, True, "text"), (True, False, True, "text"), (True, False, True, "key_value"), (False, True, False, "text"), (True, False, True, "text"), (False, False, True, "text"), (False, False, True, "text"), (False, False, False, "text"), (False, False, False, "text")]
_MARK = lambda i: "CASE CAST(o_orderkey % 10 AS INT) " + " ".join(f"WHEN {n} THEN {repr(m[i]).lower() if i < 3 else repr(m[i])}" for n, m in enumerate(_MARKS)) + " END"
_STATE_CASES = "CASE c_custkey % 7 WHEN 0 THEN 'AZ' WHEN 1 THEN 'nv' WHEN 2 THEN 'A1' WHEN 3 THEN '' WHEN 4 THEN ' TX' WHEN 5 THEN 'NEW' ELSE 'none' END"
_SUM = lambda kind, m: f"coalesce(sum(amount) FILTER (WHERE kind = '{kind}' AND month > DATE '1997-12-01' - INTERVAL {m} MONTH AND month <= DATE '1997-12-01'), 0)"
_REGION = "CASE WHEN property_id % 2 = 0 THEN (SELECT min(region_name) FROM states WHERE region = 'south') END"
SQL = {
    "line_predicates": f"SELECT o_orderkey AS doc_id, {_MARK(0)} AS header, {_MARK(1)} AS table_header, {_MARK(2)} AS table_end, {_MARK(3)} AS section_kind FROM orders",
    "valid_codes": f"SELECT c_custkey, c_custkey % 7 IN (0, 1) AS state, c_custkey % 5 IN (0, 1) AS zip, c_custkey % 5 = 0 AS zip5, sha256({_STATE_CASES}) AS hash FROM customer",
    "expense_blocks": """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 5 = 0 THEN 'Trash included' WHEN p_partkey % 2 = 0 THEN 'Free Gas, Water' END AS description,
        CASE WHEN p_partkey % 10 = 0 THEN 'Trash,Gas,Water' WHEN p_partkey % 5 = 0 THEN 'Trash' WHEN p_partkey % 2 = 0 THEN 'Gas,Water' ELSE '' END AS utilities,
        CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 500 AS DOUBLE) END AS admin_fee, CASE WHEN p_partkey % 5 = 0 THEN CAST(50 AS DOUBLE) END AS application_fee, CASE WHEN p_partkey % 3 = 0 THEN CAST(1200 AS DOUBLE) END AS deposit,
        false AS dogs_allowed, p_partkey % 3 = 0 AS cats_allowed, CASE WHEN p_partkey % 3 = 0 THEN 'max 2 pets' ELSE '' END AS restrictions FROM part""",
    "statement": f"""WITH l AS (SELECT o_custkey AS property_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CASE WHEN o_orderkey % 3 = 0 THEN 'expense' ELSE 'revenue' END AS kind, o_totalprice AS amount FROM orders),
        s AS ({' UNION ALL '.join(f"SELECT property_id, 'T{m}' AS period, {_SUM('revenue', m)} AS revenue, {_SUM('expense', m)} AS expenses FROM l GROUP BY 1" for m in (12, 6, 3))}),
        u AS (SELECT s.*, revenue - expenses AS noi, nullif(c_custkey % 90, 0) AS units, c_custkey % 70 AS occupied FROM s LEFT JOIN customer ON c_custkey = property_id AND c_custkey % 4 > 0)
        SELECT property_id, period, {half_up('revenue', 4)} AS revenue, {half_up('expenses', 4)} AS expenses, {half_up('noi', 4)} AS noi, {half_up('expenses / nullif(revenue, 0)', 4)} AS expense_ratio, {half_up('revenue / units', 4)} AS revenue_per_unit, {half_up('noi / units', 4)} AS noi_per_unit, {half_up('CAST(occupied AS DOUBLE) / units', 4)} AS occupancy FROM u""",
    "comparable_summary": f"SELECT p_brand AS market, count(*) AS comparables, {half_up('avg(p_retailprice)', 4)} AS avg_rent_per_unit, {half_up('avg(CAST(p_partkey % 97 AS DOUBLE))', 4)} AS avg_rent_per_sf, {half_up('avg(CAST(p_partkey % 13 AS DOUBLE))', 4)} AS avg_vacancy, min(1970 + p_partkey % 50) AS min_year_built, max(1970 + p_partkey % 50) AS max_year_built, min(p_size) AS min_units, max(p_size) AS max_units FROM part GROUP BY 1",
    "sales_by_star": f"SELECT l_linenumber % 5 AS star, count(*) AS sales, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS volume, {half_up('CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) / sum(CAST(l_quantity AS INT))', 4)} AS price_per_unit FROM lineitem GROUP BY 1",
    "top_buyers": "SELECT concat('Buyer ', l_suppkey) AS buyer, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS units, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS volume FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1995-06-01' GROUP BY 1 ORDER BY volume DESC, buyer LIMIT 7",
    "section_documents": """WITH p AS (SELECT conv_id AS doc_id, turn AS page_number, text, CASE WHEN turn % 2 = 1 THEN 'demographics' ELSE 'construction' END AS section FROM conversations),
        o AS (SELECT doc_id, section, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS n_pages, sum(length(text)) + count(*) - 1 AS n_chars FROM p GROUP BY 1, 2),
        t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE section END AS section, string_agg(concat('| t', page_number, ' |'), ';' ORDER BY page_number) AS tables FROM p WHERE doc_id % 3 = 0 GROUP BY 1, 2)
        SELECT coalesce(o.doc_id, t.doc_id) AS doc_id, coalesce(o.section, t.section) AS section, first_page, last_page, CAST(coalesce(n_pages, 0) AS INT) AS n_pages, coalesce(tables, '') AS tables, CAST(coalesce(n_chars, 0) AS INT) AS n_chars FROM o FULL JOIN t ON o.doc_id = t.doc_id AND o.section = t.section""",
    "parse_markdown": "SELECT s_suppkey AS doc_id, r.row_idx, c.col_idx, CASE c.col_idx WHEN 0 THEN 'Label' ELSE '3 Mile' END AS header, CASE WHEN r.row_idx = 0 AND c.col_idx = 0 THEN 'Pop' WHEN r.row_idx = 0 THEN CAST(s_suppkey AS VARCHAR) WHEN c.col_idx = 0 THEN 'Rent' ELSE '' END AS value FROM supplier, (VALUES (0), (1)) r(row_idx), (VALUES (0), (1)) c(col_idx)",
    "parse_metric_row": f"""SELECT s_suppkey, place AS "at", CASE WHEN s_suppkey % 4 > 0 AND place = 0 THEN CAST(s_suppkey * 10 AS DOUBLE) WHEN place = 1 THEN CAST(s_suppkey % 50 AS DOUBLE) / {d(100.0)} END AS number, CAST(NULL AS VARCHAR) AS text, CASE WHEN place = 0 THEN '/SF' END AS unit
        FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 4 = 0 THEN [NULL] ELSE [0, 1, 2] END) AS place FROM supplier)""",
    "order_metric_keys": "WITH m AS (SELECT CASE l_linenumber % 7 WHEN 0 THEN 'Submarket' WHEN 1 THEN 'Other' WHEN 2 THEN 'Current' WHEN 3 THEN 'Year Ago' WHEN 4 THEN 'Competitors' WHEN 5 THEN 'Last Quarter' ELSE 'Else' END AS metric FROM lineitem) SELECT metric, count(*) AS n, CASE metric WHEN 'Current' THEN 1 WHEN 'Last Quarter' THEN 2 WHEN 'Year Ago' THEN 3 WHEN 'Competitors' THEN 4 WHEN 'Submarket' THEN 5 ELSE 6 END AS metric_ord FROM m GROUP BY 1",
    "breadcrumbs": f"WITH {SCORED}, p AS (SELECT *, {_REGION} AS r FROM properties_fx) SELECT property_id, concat_ws(' > ', 'All Regions', r, CASE WHEN property_id % 5 > 0 THEN coalesce(state_name, state_abbr) END, city) AS path FROM p LEFT JOIN states ON state_key = upper(state_abbr)",
    "unit_totals": "SELECT l_orderkey AS doc_id, 0 AS table_index, CAST(coalesce(sum(CAST(floor(l_quantity + 0.5) AS BIGINT)) FILTER (WHERE l_linenumber % 2 = 0 AND l_partkey % 3 > 0), 0) AS BIGINT) AS total_units FROM lineitem GROUP BY 1",
    "source_coverage": f"WITH {OUTCOMES} SELECT CASE WHEN sheet = 'Loan' THEN 'external' ELSE 'pdf_extract' END AS source, count(*) FILTER (WHERE status = 'filled') AS filled, count(*) AS total, floor(CAST(count(*) FILTER (WHERE status = 'filled') AS DOUBLE) * 10000 / count(*) + {d(0.5)}) / 10000 AS share FROM outcomes GROUP BY 1",
    "score_list": f"WITH {SCORED} SELECT property_id, coalesce(total_score, 0) AS score, CASE WHEN coalesce(total_score, 0) >= 7 THEN 'move_forward' WHEN coalesce(total_score, 0) >= {d(5.5)} THEN 'needs_review' ELSE 'rejected' END AS bucket FROM scored",
}
