"""Queries of the free-text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.dims import DEFAULT_SCORECARD
from acrelight.operators import freetext as X
from acrelight.operators import scorecard as S
from acrelight.operators import tables as T
from acrelight.plans.fixtures import cte, view
from acrelight.plans.scoring_queries import d, records, total_sql


def _unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = view(spark, sf_dir, "lineitem")  # noqa: E741
    text = lambda c: F.col(c).cast("int").cast("string")
    line = F.concat(text("l_linenumber"), F.lit(" 2 1,"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lit(" "), text("l_quantity"), F.lit(" 12.5% 3 6.3% $1,"), F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0"), F.lit(" $1.50 $1,400 $1.45 0.5%"))
    rows = l.select("l_orderkey", "l_linenumber", "l_partkey", X.parse_unit_row(F.when(F.col("l_linenumber") < 7, line).otherwise("Totals")).alias("u"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "u.beds", "u.avg_sf", "u.units", "u.asking_rent", "u.concessions")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("Owner: "), F.col("p_name"), F.lit("\nBuilt in "), (1900 + k % 120).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("\nProperty Size: "), k.cast("string"), F.lit(" Units"))).otherwise(""), F.lit("\nSale Price: $"), k.cast("string"), F.lit(",000\nParking: garage"))
    return view(spark, sf_dir, "part").select(k.alias("doc_id"), text.alias("text"))


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-hand columns of property tables: manager, phone, OWNER, owner, price, date."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    values = F.array(F.concat(F.lit("Manager of "), name), F.lit("(602) 555-0100"), F.lit("OWNER"), name, F.concat(F.lit("$"), k.cast("string"), F.lit(",310,000 ($142,000/Unit)")), F.lit("Purchased Mar 2019"))
    each = view(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.posexplode(values).alias("row_idx", "value"))
    return each.select("doc_id", F.lit(0).alias("src_ord"), F.lit(0).alias("table_index"), "row_idx", F.lit(2).alias("col_idx"), F.lit("PROPERTY MANAGER").alias("header"), "value")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    first = F.struct(F.lit(0).alias("ord"), F.when(k % 4 == 0, "PREPARED BY").otherwise(F.concat(k.cast("string"), F.lit(" E Juniper Ave"))).alias("header"), F.array(F.concat(F.col("p_brand"), F.lit(" 92 Unit Apartment Building")), F.when(k % 2 == 0, "Tucson, Arizona - North").otherwise("Austin, Texas")).alias("content"))
    second = F.struct(F.lit(1).alias("ord"), F.lit("Later").alias("header"), F.array(F.lit("x"), F.lit("y, Z")).alias("content"))
    return view(spark, sf_dir, "part").select(k.alias("doc_id"), F.inline(F.array(second, first)))


def _amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("intro\n## SITE AMENITIES\n| 24 Hour Access | Pool |\n|---|---|\n| Gym | Pool |\n## UNIT AMENITIES\nAir Conditioning\n"), F.when(k % 2 == 0, "Balcony\nAir Conditioning\n").otherwise("ab\n"), F.lit("## END\nx"))
    a = X.amenities(text)
    return view(spark, sf_dir, "part").select(k.alias("doc_id"), F.array_join(a["site"], ";").alias("site"), F.array_join(a["unit"], ";").alias("unit"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "orders")
    ident = F.concat((F.lit(1700000000) + F.col("o_orderkey")).cast("string"), F.lit("-ab"), (F.col("o_orderkey") % 10).cast("string"))
    return X.match_source_document(o.select(F.concat(F.lit("e_"), ident).alias("base")), o.where("o_orderkey % 3 <> 0").select(F.concat(ident, F.lit("_report.pdf")).alias("file_name")))


QUERIES = {
    "parse_unit_rows": _unit_rows,
    "extract_key_values": lambda s, x: X.extract_key_values(prose(s, x)).select("doc_id", "no_of_units", "year_built", "name", "purchase_price", "parking"),
    "extract_property_text": lambda s, x: X.extract_property_text(prose(s, x)).select("doc_id", "owner", "year_built", "number_of_units"),
    "panel_facts": lambda s, x: X.panel_facts(T.split_right_panel(panels(s, x))),
    "address_from_sections": lambda s, x: X.address_from_sections(_sections(s, x)),
    "amenities": _amenities,
    "match_source_document": _sources,
    "deal_decisions": lambda s, x: S.score(records(s, x)).groupBy(X.deal_decision(F.col("total_score")).alias("deal")).agg(F.count("*").alias("n")),
}
SQL = {
    "parse_unit_rows": """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 7 THEN CAST(l_linenumber AS INT) END AS beds, CASE WHEN l_linenumber < 7 THEN CAST(1000 + l_partkey % 1000 AS DOUBLE) END AS avg_sf,
        CASE WHEN l_linenumber < 7 THEN CAST(l_quantity AS INT) END AS units, CASE WHEN l_linenumber < 7 THEN CAST(1000 + l_suppkey % 1000 AS DOUBLE) END AS asking_rent, CASE WHEN l_linenumber < 7 THEN CAST(0.5 AS DOUBLE) END AS concessions FROM lineitem""",
    "extract_key_values": "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS no_of_units, CAST(1900 + p_partkey % 120 AS VARCHAR) AS year_built, p_name AS name, concat('$', p_partkey, ',000') AS purchase_price, 'garage' AS parking FROM part",
    "extract_property_text": "SELECT p_partkey AS doc_id, p_name AS owner, CAST(1900 + p_partkey % 120 AS VARCHAR) AS year_built, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS number_of_units FROM part",
    "panel_facts": "SELECT s_suppkey AS doc_id, concat('Manager of ', s_name) AS manager_name, '(602) 555-0100' AS manager_phone, s_name AS owner_name, concat('$', s_suppkey, ',310,000 ($142,000/Unit)') AS purchase_price, concat(s_suppkey, '310000') AS purchase_price_raw, '$142,000/Unit' AS price_per_unit, 'Purchased Mar 2019' AS purchase_date FROM supplier",
    "address_from_sections": "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 <> 0 THEN concat(p_partkey, ' E Juniper Ave') END AS address, p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Tucson' ELSE 'Austin' END AS city, CASE WHEN p_partkey % 2 = 0 THEN 'AZ' ELSE 'TX' END AS state FROM part",
    "amenities": "SELECT p_partkey AS doc_id, '24 Hour Access;Pool;Gym' AS site, CASE WHEN p_partkey % 2 = 0 THEN 'Air Conditioning;Balcony' ELSE 'Air Conditioning' END AS unit FROM part",
    "match_source_document": "WITH b AS (SELECT o_orderkey AS k, concat(1700000000 + o_orderkey, '-ab', o_orderkey % 10) AS i FROM orders) SELECT concat('e_', i) AS base, CASE WHEN k % 3 <> 0 THEN concat(i, '_report.pdf') END AS file_name FROM b",
    "deal_decisions": f"WITH {cte('features_fx')}, t AS (SELECT {total_sql(DEFAULT_SCORECARD)} AS s FROM features_fx) SELECT CASE WHEN s >= 7 THEN 'Submit LOI' WHEN s >= {d(6.0)} THEN 'Deeper Dive' ELSE 'Don''t' END AS deal, count(*) AS n FROM t GROUP BY 1",
}
