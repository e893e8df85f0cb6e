"""Queries of the sources, sinks, listings, lookups and deal formulas, with their SQL.

What a source reads is written first, from the driver's tables, to a path of its
own in the shared folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.functions import values as V
from acrelight.operators import enrich as E
from acrelight.operators import features as X
from acrelight.operators import formulas as D
from acrelight.operators import freetext as R
from acrelight.operators import lines as L
from acrelight.operators import portfolio as P
from acrelight.operators import scorecard as S
from acrelight.operators import tables as T
from acrelight.plans.fixtures import cte, dealt_out, view
from acrelight.plans.scoring_queries import d, decision_sql, half_up, records, total_sql
from acrelight.sources import tables as O
from acrelight.sources.shared import fresh_path

SAVED = json.dumps({"factors": {"population": {"weight": 0.15, "thresholds": {str(i): 6000 * i for i in range(10, 0, -1)}}}, "thresholds": {"moveForward": 6.5, "quickCheck": 5.0}})
PATCH = {"factors": {"population": {"weight": 0.6}, "transitScore": {"weight": 0.4}}, "thresholds": {"forward": 6.0}}


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    padded = view(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    padded.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return O.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string")


def _json_files(df: DataFrame, key: str, text) -> str:
    """A folder with a JSON file for each key."""
    path = fresh_path(df.sparkSession)
    df.select(key, text.alias("value")).repartition(key).write.partitionBy(key).text(path)
    return path


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = view(spark, sf_dir, "nation")
    whole = F.to_json(F.struct(F.lit("demographics").alias("section"), F.col("n_name").alias("raw_text")))
    path = _json_files(nation, "n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.left(whole, F.length(whole) - 4)).otherwise(whole))
    return O.read_sections(spark, f"{path}/*").select("section", "status", F.col("document.raw_text").alias("raw_text"), F.col("bad").isNotNull().alias("bad"))


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    crime = F.struct((k * 1.5).alias("violent_crime_index"), (k * 2.5).alias("property_crime_index"))
    walk = F.struct((k * 4).cast("int").alias("walk_score"))
    path = _json_files(view(spark, sf_dir, "nation"), "n_nationkey", F.to_json(F.struct(crime.alias("crime"), F.when(k % 2 == 0, walk).alias("walkScore"))))
    return O.read_external(spark, f"{path}/*").select(F.col("crime.violent_crime_index").alias("violent"), F.col("crime.property_crime_index").alias("property_crime"), F.col("walkScore.walk_score").alias("walk_score"))


def _with_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    external = view(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("base"), F.col("n_name").alias("city"))
    rows = O.with_external(view(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("base")), external)
    return rows.select("s_suppkey", F.col("external.city").alias("city"), F.col("external").isNotNull().alias("found"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = O.load_tables(spark, sf_dir, ["customer", "orders"])
    return tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    view(spark, sf_dir, "nation").select("n_regionkey", "n_name").repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    listed = O.file_registry(spark, path)
    # a text file has each name and a line feed
    return listed.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("region"), "size", F.startswith(F.col("file_name"), F.col("display_name")).alias("named"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of users, made from the orders."""
    o = view(spark, sf_dir, "orders")
    kinds = F.array(*map(F.lit, ("pdf", "CSV", "xlsx", "png", "doc")))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("user"), (F.col("o_custkey") % 10).cast("string")).alias("user_id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("file_"), F.col("o_orderkey").cast("string"), F.lit("."), F.get(kinds, (F.col("o_orderkey") % 5).cast("int"))).alias("file_name"))


LISTING = "listing AS (SELECT o_orderkey AS id, concat('user', CAST(o_custkey % 10 AS VARCHAR)) AS user_id, o_orderdate AS created_at, concat('file_', CAST(o_orderkey AS VARCHAR), '.', ['pdf', 'CSV', 'xlsx', 'png', 'doc'][o_orderkey % 5 + 1]) AS file_name FROM orders)"


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = view(spark, sf_dir, "extracted_fx").select("id", F.concat("section", F.lit(".json")).alias("file_name"))
    both = O.union_listings(listing(spark, sf_dir), extracted)
    return both.groupBy("is_extracted").agg(F.count("*").alias("n"), F.count("user_id").alias("with_user"), F.max("file_name").alias("last_name"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.route_files(listing(spark, sf_dir)).select("id", "kind", "error")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = O.route_files(listing(spark, sf_dir))
    good, bad = O.quarantine(O.with_status(routed, F.col("error")))
    both = good.withColumn("is_good", F.lit(1)).unionByName(bad.withColumn("is_good", F.lit(0)))
    return O.batch_report(both).crossJoin(both.agg(F.coalesce(F.sum("is_good"), F.lit(0)).alias("good_rows")))  # of one row each


def _saved_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score(records(spark, sf_dir), O.load_scorecard(SAVED)).select("property_id", "total_score", "decision")


def _merged_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = S.merge_scorecard(O.load_scorecard(), PATCH)
    return S.with_snapshot(S.score(records(spark, sf_dir), card), card).select("property_id", "total_score", "decision", F.get_json_object("config_snapshot", "$.forward").cast("double").alias("forward"))


def _mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings from JSON texts that are made of the parts: a sheet for each brand, a field for each part, some without a path."""
    k = F.col("p_partkey")
    field = F.struct(F.concat(F.lit("B"), k.cast("string")).alias("cell"), F.col("p_name").alias("label"), F.when(k % 3 > 0, F.concat(F.lit("part."), F.col("p_type"))).alias("json_path"), F.when(k % 2 == 0, "to_number").alias("transform"), F.when(k % 5 == 0, "external").alias("source"))
    fields = F.array_sort(F.collect_list(F.struct(k.alias("k"), field.alias("f"))))
    sheets = view(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.transform(fields, lambda x: x["f"]).alias("fields"))).alias("json"))
    return O.read_mappings(sheets.withColumnRenamed("p_brand", "sheet")).select("sheet", "cell", "label", "json_path", "transform", "source")


def _written_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    O.write_sections(view(spark, sf_dir, "pages_fx").select(F.col("header").alias("section"), F.col("text").alias("raw_text")), path)
    return spark.read.schema("raw_text string, section string").json(path).groupBy("section").agg(F.count("*").alias("n"), F.sum(F.length("raw_text")).alias("chars"))


def _written_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark)
    O.write_scores(S.score(records(spark, sf_dir)).select("property_id", "total_score"), path)
    return spark.read.parquet(path)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar rules on cells made from the parts."""
    k, name = F.col("p_partkey"), F.col("p_name")
    n = k.cast("string")
    label = F.when(k % 3 == 0, F.concat(F.lit("Lot Size "), n, F.lit(":"))).otherwise(F.concat(F.lit("No. Floors-"), n))
    cell = F.when(k % 5 == 0, F.lit("n/a")).when(k % 5 == 1, F.concat(n, F.lit(" Units"))).when(k % 5 == 2, F.concat(F.lit("about $"), n)).when(k % 5 == 3, F.concat((k % 100).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("text "), n))
    code = F.when(k % 4 == 0, F.lpad(n, 5, "0")).when(k % 4 == 1, F.concat(F.lpad(n, 5, "0"), F.lit("-0001"))).when(k % 4 == 2, n)
    rows = view(spark, sf_dir, "part").select(k.alias("p_partkey"), label.alias("label"), cell.alias("cell"), code.alias("code"), F.concat(F.lit("  Total  "), n, F.lit("   x y  z")).alias("row"))
    v = V.normalize_value(F.col("cell"))
    return rows.select("p_partkey", V.camel_key(F.col("label")).alias("camel"), V.property_key(F.col("label")).alias("snake"), v["number"].alias("number"), v["text"].alias("text"), V.valid_zip(F.col("code")).alias("zip"), V.valid_state(F.left(F.col("code"), F.lit(2))).alias("state"), F.array_join(V.split_table_row(F.col("row")), "|").alias("cells"))


VALUES = """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS n FROM part),
c AS (SELECT *, CASE k % 4 WHEN 0 THEN CASE WHEN length(n) > 5 THEN left(n, 5) ELSE lpad(n, 5, '0') END WHEN 1 THEN concat(CASE WHEN length(n) > 5 THEN left(n, 5) ELSE lpad(n, 5, '0') END, '-0001') WHEN 2 THEN n END AS code FROM p)
SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN concat('lotSize', upper(left(n, 1)), substr(n, 2), ':') ELSE concat('no.Floors', n) END AS camel,
  CASE WHEN k % 3 = 0 THEN concat('lot_size_', n) ELSE concat('no_floors-', n) END AS snake,
  CASE k % 5 WHEN 1 THEN CASE WHEN n ~ '^\\d+$' THEN CAST(k AS DOUBLE) END WHEN 2 THEN CAST(k AS DOUBLE) WHEN 3 THEN CAST(k % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) END AS number,
  CASE WHEN k % 5 = 4 THEN concat('text ', n) END AS text,
  coalesce(regexp_full_match(code, '\\d{5}(-\\d{4})?'), false) AS zip, false AS state, concat('Total|', n, '|x y|z') AS cells FROM c"""


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, units = F.col("o_totalprice").cast("double"), (F.col("o_orderkey") % 9).cast("double")
    o = view(spark, sf_dir, "orders")
    gap = D.rent_gap(units * 10, units * 9, F.lit(20.0) * (F.col("o_custkey") % 3))
    return o.select("o_orderkey", D.implied_cap(price, price / 2, units * 1000).alias("cap"), D.price_per_unit(price, units).alias("per_unit"), gap["gap"].alias("gap"), gap["premium"].alias("premium"), gap["premium_share"].alias("premium_share"))


def _comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = view(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("market"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("rent_per_sf"))
    return D.rank_comparables(comps).select("s_suppkey", "rank", V.half_up(F.col("market_mean"), 6).alias("market_mean"))


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(F.col("l_partkey") % 100).alias("conf"))
    return E.ocr_confidence(tokens)


def _best_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda c, name: F.when(c, F.concat(F.lit(f"{name} "), k.cast("string")))

    def side(where, has_street, has_city) -> DataFrame:
        cols = [part(has_street, "street").alias("street"), F.lit(None).cast("string").alias("name"), part(has_city, "city").alias("city"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("zip"), F.lit(None).cast("string").alias("state_abbr")]
        rows = view(spark, sf_dir, "customer").where(where).select(k.alias("doc_id"), *cols)
        parts = [F.col(c) for c in ("street", "city", "state_abbr", "zip")]
        return rows.withColumns({"address": V.full_address(*parts), "confidence": V.address_confidence(*parts)})

    found = X.best_address(side(k % 5 != 0, k % 2 == 0, k % 3 == 0), side(k % 7 != 0, k % 4 == 1, k % 4 != 3))
    return found.select("doc_id", "address", "confidence")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of tables made from the orders."""
    k = F.col("o_orderkey")
    headers = F.when(k % 6 == 0, F.array(F.lit("Property"), F.lit("Manager"))).when(k % 6 == 1, F.array(F.lit("Beds Bath"), F.lit("Avg SF"))).when(k % 6 == 2, F.array(F.lit("Tenant"), F.lit("Lease"))).when(k % 6 == 3, F.array(F.lit("Expense"), F.lit("Total"))).otherwise(F.array(F.lit("Other")))
    cells = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i < k % 8, F.lit("Key: ")).otherwise("Key"))
    tables = view(spark, sf_dir, "orders").select(k.alias("doc_id"), headers.alias("headers"), cells.alias("first_cells"), F.when(k % 11 == 0, F.lit("unreadable")).alias("error"))
    return T.classify_tables(tables).select("doc_id", "kind")


def info_cells(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Property tables of three columns: labels, values and the right panel, a row for each order line; ``dealt`` lines meet by order before they are grouped."""
    l = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    l = (dealt_out(l, "l_orderkey") if dealt else l).groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_idx")).agg(F.min("l_partkey").alias("part"))  # noqa: E741
    n = F.col("part").cast("string")
    label = F.concat(F.element_at(F.array(*map(F.lit, ("Year Built", "Lot Size", "Lot Size", "Stories", "Parking", "Note", "Class"))), F.col("row_idx").cast("int")), F.when(F.col("row_idx") == 6, "").otherwise(":"))
    value = F.when(F.col("part") % 7 == 0, "-").otherwise(F.concat(F.lit(" "), n, F.lit(" ")))
    right = F.when(F.col("row_idx") == 3, "Owner").when(F.col("part") % 5 == 0, " ").otherwise(F.concat(F.lit("Person "), n))
    cell = lambda i, header, c: F.struct(F.lit(i).alias("col_idx"), F.lit(header).alias("header"), c.alias("value"))
    return l.select("doc_id", F.lit(0).alias("src_ord"), F.lit(0).alias("table_index"), "row_idx", F.inline(F.array(cell(0, "Property", label), cell(1, "Value", value), cell(2, "Manager", right))))


INFO = """i AS (SELECT l_orderkey AS doc_id, l_linenumber AS row_idx, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2)"""


def _unit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = info_cells(spark, sf_dir, dealt=True)
    both = R.collect_tables(one.where("col_idx = 1"), one.where("col_idx = 2 and row_idx = 3"))
    # a greatest text is found by sorting, so equal texts are counted first
    each = R.format_unit_mix(both).groupBy("key", "text").agg(F.count("*").alias("n"), F.count("number").alias("numbers"), F.sum("number").alias("total"))
    return each.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "numbers", "total")), F.max("text").alias("text"))


def _outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents cleaned, but for the second to third line of every other document."""
    docs = view(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    tables = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("first_line"), F.lit(2).alias("last_line"))
    out = L.clean_outside_tables(lines, tables, lambda c: F.upper(c))
    return out.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("line") == F.upper("line")).alias("upper_lines"))


def _amenity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amenities of parts: a block in two of three texts, a table that is nameless for even keys, sections for some."""
    k = F.col("p_partkey")
    p = view(spark, sf_dir, "part").select(k.alias("doc_id"))
    k = F.col("doc_id")
    texts = p.select("doc_id", F.when(k % 3 > 0, F.lit("a\n## SITE AMENITIES\n| Pool | Gym |\n|---|---|\n\n## UNIT AMENITIES\nBalcony\nok\n")).otherwise("none").alias("text"))
    cell = lambda i, header, value: F.struct(F.lit(i).alias("col_idx"), header.alias("header"), value.alias("value"))
    rows = F.array(cell(0, F.lit(""), F.lit("Gym")), cell(1, F.when(k % 2 == 0, "7").otherwise("Name"), F.concat(F.lit("Spa "), k.cast("string"))), cell(2, F.lit("2"), F.lit("no")))
    cells = p.select("doc_id", F.lit(0).alias("src_ord"), F.lit(0).alias("table_index"), F.lit(0).alias("row_idx"), F.inline(rows))
    sections = p.select("doc_id", F.lit(1).alias("ord"), F.when(k % 5 == 0, "Unit Amenities of all").otherwise("Other").alias("header"), F.array(F.lit(" Patio "), F.lit("x"), F.lit("Balcony")).alias("content"))
    found = R.amenity_lists(texts, cells, sections)
    return found.select("doc_id", F.array_join("site", ";").alias("site"), F.array_join("unit", ";").alias("unit"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table for each customer, a line for each order: words, money, shares, and numbers in some."""
    k = F.col("o_orderkey")
    cell = lambda c: F.rpad(c, 18, " ")
    line = F.concat(cell(F.col("o_orderpriority")), cell(F.concat(F.lit("$"), k.cast("string"))), cell(F.concat((k % 90).cast("string"), F.lit(".5%"))), F.when(k % 4 == 0, "").otherwise(k.cast("string")))
    rows = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("table_idx"), k.alias("line_idx"), line.alias("line"))
    return L.describe_columns(rows)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.get(F.array(*map(F.lit, ("Texas", "new york", "District of Columbia", "Ontario", "x"))), (k % 5).cast("int"))
    return view(spark, sf_dir, "supplier").select("s_suppkey", X.state_abbr(name).alias("letters"), X.state_abbr(name, keep_unknown=True).alias("kept"))


QUERIES = {
    "describe_columns": _columns,
    "state_abbreviations": _states,
    "amenity_lists": _amenity_lists,
    "source_csv": _csv,
    "source_sections": _sections,
    "source_external": _external,
    "source_with_external": _with_external,
    "source_pages": lambda s, x: O.read_pages(s, f"{x}/pages.parquet").select("page_id", "url", F.length("html").alias("chars")),
    "source_snapshot": _snapshot,
    "source_registry": _registry,
    "source_scorecard": _saved_scorecard,
    "source_mappings": _mappings,
    "sink_sections": _written_sections,
    "sink_scores": _written_scores,
    "files_by_user": lambda s, x: O.files_by_user(listing(s, x), "user3").select("id", "created_at"),
    "file_by_id": lambda s, x: O.file_by_id(listing(s, x), 7).select("id", "user_id", "file_name"),
    "union_listings": _union,
    "route_files": _routed,
    "batch_report": _batch,
    "merged_scorecard": _merged_scorecard,
    "property_by_id": lambda s, x: P.by_id(view(s, x, "properties_fx"), 11, include_deleted=True).select("property_id", "name"),
    "scalar_rules": _values,
    "deal_formulas": _deals,
    "rank_comparables": _comparables,
    "ocr_confidence": _confidence,
    "best_address": _best_address,
    "classify_tables": _tables,
    "property_info": lambda s, x: T.property_info(info_cells(s, x)),
    "right_panel": lambda s, x: T.split_right_panel(info_cells(s, x)),
    "unit_mix_cells": _unit_cells,
    "clean_outside_tables": _outside,
}

SAVED_CARD = O.load_scorecard(SAVED)
MERGED_CARD = S.merge_scorecard(O.load_scorecard(), PATCH)
PERSON = "concat('Person ', CAST(part AS VARCHAR))"
SQL = {
    "describe_columns": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
        c AS (SELECT o_custkey AS doc_id, max(o_orderpriority) FILTER (WHERE r = 1) AS p, max(o_orderkey) FILTER (WHERE r = 1) AS k, count(*) FILTER (WHERE r > 1 AND o_orderkey % 4 <> 0) AS numbers FROM o WHERE n > 1 GROUP BY 1)
        SELECT doc_id, 0 AS table_idx, 0 AS col_idx, p AS header, 'text' AS column_type FROM c
        UNION ALL SELECT doc_id, 0, 1, concat('$', CAST(k AS VARCHAR)), 'currency' FROM c
        UNION ALL SELECT doc_id, 0, 2, concat(CAST(k % 90 AS VARCHAR), '.5%'), CASE WHEN k % 4 = 0 AND numbers > 0 THEN 'text' ELSE 'percentage' END FROM c
        UNION ALL SELECT doc_id, 0, 3, CAST(k AS VARCHAR), CASE WHEN numbers > 0 THEN 'numeric' ELSE 'empty' END FROM c WHERE k % 4 <> 0""",
    "state_abbreviations": "SELECT s_suppkey, ['TX', 'NY', 'DC', 'ON', 'X'][s_suppkey % 5 + 1] AS letters, ['TX', 'NY', 'District of Columbia', 'Ontario', 'x'][s_suppkey % 5 + 1] AS kept FROM supplier",
    "amenity_lists": """SELECT p_partkey AS doc_id, concat_ws(';', CASE WHEN p_partkey % 3 > 0 THEN 'Pool;Gym' WHEN p_partkey % 2 = 0 THEN 'Gym' END, CASE WHEN p_partkey % 2 = 0 THEN concat('Spa ', CAST(p_partkey AS VARCHAR)) END) AS site,
        concat_ws(';', CASE WHEN p_partkey % 5 = 0 THEN 'Patio;Balcony' WHEN p_partkey % 3 > 0 THEN 'Balcony' END) AS unit FROM part""",
    "source_csv": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer",
    "source_sections": "SELECT 'combined' AS section, CASE WHEN n_nationkey % 3 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS raw_text, n_nationkey % 3 = 0 AS bad FROM nation",
    "source_external": f"SELECT n_nationkey * {d(1.5)} AS violent, n_nationkey * {d(2.5)} AS property_crime, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey * 4 AS INT) END AS walk_score FROM nation",
    "source_with_external": "SELECT s_suppkey, CASE WHEN s_nationkey % 4 <> 0 THEN n_name END AS city, s_nationkey % 4 <> 0 AS found FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "source_pages": "SELECT page_id, url, length(html) AS chars FROM pages",
    "source_snapshot": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "source_registry": "SELECT n_regionkey AS region, CAST(sum(length(n_name) + 1) AS BIGINT) AS size, true AS named FROM nation GROUP BY 1",
    "source_scorecard": f"WITH {cte('features_fx')}, t AS (SELECT property_id, {total_sql(SAVED_CARD)} AS total_score FROM features_fx) SELECT *, {decision_sql('total_score', SAVED_CARD)} AS decision FROM t",
    "source_mappings": "SELECT p_brand AS sheet, concat('B', p_partkey) AS cell, p_name AS label, CASE WHEN p_partkey % 3 > 0 THEN concat('part.', p_type) END AS json_path, CASE WHEN p_partkey % 2 = 0 THEN 'to_number' END AS transform, CASE WHEN p_partkey % 5 = 0 THEN 'external' ELSE 'pdf_extract' END AS source FROM part",
    "sink_sections": "SELECT role AS section, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1",
    "sink_scores": f"WITH {cte('features_fx')} SELECT property_id, {total_sql(O.DEFAULT_SCORECARD)} AS total_score FROM features_fx",
    "files_by_user": f"WITH {LISTING} SELECT id, created_at FROM listing WHERE user_id = 'user3'",
    "file_by_id": f"WITH {LISTING} SELECT id, user_id, file_name FROM listing WHERE id = 7",
    "union_listings": f"WITH {LISTING}, {cte('extracted_fx')} SELECT false AS is_extracted, count(*) AS n, count(user_id) AS with_user, max(file_name) AS last_name FROM listing UNION ALL SELECT true, count(*), 0, max(concat(section, '.json')) FROM extracted_fx",
    "route_files": f"WITH {LISTING} SELECT id, CASE id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'excel' WHEN 3 THEN 'image' END AS kind, CASE WHEN id % 5 = 4 THEN 'unsupported type: doc' END AS error FROM listing",
    "batch_report": "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 5 <> 4) AS succeeded, count(*) FILTER (WHERE o_orderkey % 5 = 4) AS failed, CAST(count(*) FILTER (WHERE o_orderkey % 5 <> 4) AS INT) AS good_rows FROM orders",
    "merged_scorecard": f"WITH {cte('features_fx')}, t AS (SELECT property_id, {total_sql(MERGED_CARD)} AS total_score FROM features_fx) SELECT *, {decision_sql('total_score', MERGED_CARD)} AS decision, {d(6.0)} AS forward FROM t",
    "property_by_id": f"WITH {cte('properties_fx')} SELECT property_id, name FROM properties_fx WHERE property_id = 11",
    "scalar_rules": VALUES,
    "deal_formulas": f"""WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p, CAST(o_orderkey % 9 AS DOUBLE) AS u, {d(20.0)} * (o_custkey % 3) AS m FROM orders)
        SELECT o_orderkey, CASE WHEN u <> 0 THEN (p - p / 2) / (u * 1000) END AS cap, CASE WHEN u <> 0 THEN p / u END AS per_unit, u * 10 - u * 9 AS gap, u * 10 - m AS premium, CASE WHEN m <> 0 THEN (u * 10 - m) / m END AS premium_share FROM o""",
    "rank_comparables": f"WITH c AS (SELECT s_suppkey, s_nationkey AS m, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS r FROM supplier) SELECT s_suppkey, CAST(rank() OVER (PARTITION BY m ORDER BY r DESC) AS INT) AS rank, {half_up('avg(r) OVER (PARTITION BY m)', 6)} AS market_mean FROM c",
    "ocr_confidence": f"SELECT l_orderkey AS doc_id, coalesce({half_up('avg(l_partkey % 100) FILTER (WHERE l_linenumber % 3 <> 0)', 2)}, 0) AS confidence FROM lineitem GROUP BY 1",
    "best_address": """WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN (CASE WHEN c_custkey % 2 = 0 THEN 30 ELSE 0 END) + (CASE WHEN c_custkey % 3 = 0 THEN 25 ELSE 0 END) END AS own,
          CASE WHEN c_custkey % 7 <> 0 THEN (CASE WHEN c_custkey % 4 = 1 THEN 30 ELSE 0 END) + (CASE WHEN c_custkey % 4 <> 3 THEN 25 ELSE 0 END) END AS other FROM customer)
        SELECT k AS doc_id, CASE WHEN own >= 50 THEN own WHEN other > 0 THEN other END AS confidence,
          CASE WHEN own >= 50 THEN concat('street ', CAST(k AS VARCHAR), ', city ', CAST(k AS VARCHAR)) WHEN other = 55 THEN concat('street ', CAST(k AS VARCHAR), ', city ', CAST(k AS VARCHAR)) WHEN other = 25 THEN concat('city ', CAST(k AS VARCHAR)) END AS address FROM s WHERE own IS NOT NULL OR other IS NOT NULL""",
    "classify_tables": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 8 >= 3 THEN 'property_info' WHEN o_orderkey % 6 = 1 THEN 'unit_breakdown' WHEN o_orderkey % 6 = 2 THEN 'rent_roll' WHEN o_orderkey % 6 = 3 THEN 'expenses' ELSE 'other' END AS kind FROM orders WHERE o_orderkey % 11 <> 0",
    "property_info": f"WITH {INFO}, p AS (SELECT *, ['year_built', 'lot_size', 'lot_size', 'stories', 'parking', NULL, 'class'][row_idx] AS key FROM i WHERE row_idx <> 6 AND part % 7 <> 0) SELECT doc_id, key, CAST(arg_min(part, row_idx) AS VARCHAR) AS value FROM p GROUP BY 1, 2",
    "right_panel": f"WITH {INFO}, o AS (SELECT *, bool_or(row_idx = 3) OVER (PARTITION BY doc_id) AS owned FROM i) SELECT doc_id, 0 AS table_index, row_idx, CASE WHEN owned AND row_idx > 3 THEN 'owner' ELSE 'manager' END AS panel, {PERSON} AS value FROM o WHERE row_idx <> 3 AND part % 5 <> 0",
    "unit_mix_cells": f"WITH {INFO} SELECT 'value' AS key, count(*) AS n, count(*) FILTER (WHERE part % 7 <> 0) AS numbers, CAST(sum(part) FILTER (WHERE part % 7 <> 0) AS DOUBLE) AS total, CAST(NULL AS VARCHAR) AS text FROM i UNION ALL SELECT 'manager', count(*), 0, NULL, 'Owner' FROM i WHERE row_idx = 3",
    "clean_outside_tables": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
        SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE (doc_id % 2 = 0 AND i IN (2, 3) AND line = upper(line)) OR NOT (doc_id % 2 = 0 AND i IN (2, 3))) AS upper_lines FROM l GROUP BY 1""",
}
