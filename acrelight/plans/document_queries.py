"""Queries of the lifecycle, profile, line and section operators, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelight.functions.values import CLEAN_UPS, address_key, clean_text
from acrelight.operators import lifecycle as L
from acrelight.operators import lines as N
from acrelight.operators import profile as R
from acrelight.operators import sections as X
from acrelight.plans.fixtures import cte, view
from acrelight.plans.scoring_queries import ADDRESS, KEYED, d

AS_OF = "2024-03-01"
#: Sections of the generated conversations, by words that are frequent in them.
PATTERNS = {"opening": ["THTION", "THANED"], "middle": ["EDING", "ONTHE"], "closing": ["ERHA", "ATST"]}
HEADER = r"^[A-ZÄÖÜÉÈÊÇÑÓÍ][^ ]* [^ ]+\.?$"


def now() -> Column:
    return F.lit(AS_OF).cast("date")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    props = view(spark, sf_dir, "properties_fx")
    gone = props.select("property_id", "deleted_at")
    documents = view(spark, sf_dir, "documents_fx").select("property_id", "id").join(gone, "property_id")
    files = view(spark, sf_dir, "extracted_fx").select("property_id", "id", "section").join(gone, "property_id")
    return {"properties": props, "documents": documents, "extracted_files": files}


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "properties_fx").where("property_id % 10 = 3").select("property_id")


def counted(found: dict[str, DataFrame]) -> DataFrame:
    """(table, deleted_at, n): a table of what each table holds."""
    each = [df.groupBy("deleted_at").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "deleted_at", "n") for name, df in found.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page items of the conversations: a header and a text for each turn."""
    p = view(spark, sf_dir, "pages_fx")
    head = p.select("doc_id", "page_number", F.lit(0).alias("item_idx"), F.lit("header").alias("kind"), F.col("header").alias("text"))
    return head.unionByName(p.select("doc_id", "page_number", F.lit(1).alias("item_idx"), F.lit("text").alias("kind"), "text"))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sticky_fill(X.detect_sections(pages(spark, sf_dir), PATTERNS))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.text_lines(view(spark, sf_dir, "documents"))


def _patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = view(spark, sf_dir, "properties_fx")
    full = props.withColumns({"address_key": address_key(F.col("street"), F.col("city"), F.col("state_abbr")), "updated_at": F.col("created_at")})
    updates = props.where("property_id % 10 = 3").select("property_id", F.lit(None).cast("string").alias("name"), F.concat(F.lit("9 Oak Avenue #"), F.col("property_id").cast("string")).alias("street"), F.lit(None).cast("string").alias("city"))
    return L.patch(full, updates, now()).select("property_id", "street", "city", "address_key", "updated_at")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cells_fx").select("table_index", "label", "value")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "extracted_fx").select(F.col("property_id").alias("base"), "section", "content")


PROFILED = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
TYPED = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")]
QUERIES = {
    "soft_delete": lambda s, x: counted(L.soft_delete(tables(s, x), chosen(s, x), now())),
    "restore": lambda s, x: counted(L.restore(tables(s, x), view(s, x, "properties_fx").where("property_id % 2 = 0"), now())),
    "purge": lambda s, x: counted(L.purge(tables(s, x), chosen(s, x))),
    "retention_purge": lambda s, x: counted(L.retention_purge(tables(s, x), now())),
    "pending_purge": lambda s, x: L.expired(view(s, x, "properties_fx"), now()).select("property_id", "deleted_at"),
    "deletion_countdown": lambda s, x: L.deletion_countdown(view(s, x, "properties_fx"), now()).select("property_id", F.col("permanent_delete_at").cast("date").alias("purge_date"), "days_remaining"),
    "patch": _patch,
    "profile": lambda s, x: R.profile(view(s, x, "lineitem")),
    "profile_typed": lambda s, x: R.profile_typed(view(s, x, "part")),
    "infer_column_types": lambda s, x: R.infer_column_types(_cells(s, x), ["table_index", "label"]),
    "categorize_columns": lambda s, x: R.categorize_columns(view(s, x, "part"), "p_partkey").select("p_partkey", "category", F.array_join(F.array_sort(F.map_keys("data")), ",").alias("columns")),
    "section_fill": lambda s, x: filled(s, x).select("doc_id", "page_number", "section"),
    "section_inventory": lambda s, x: X.section_inventory(filled(s, x)),
    "assemble_sections": lambda s, x: X.assemble_sections(filled(s, x), pages(s, x).where("kind = 'text'")).select("doc_id", "section", "first_page", "last_page", "n_pages", F.length("raw_text").alias("n_chars")),
    "clean_pages": lambda s, x: X.clean_pages(X.items_to_pages(pages(s, x))),
    "first_pages": lambda s, x: X.first_pages(X.items_to_pages(pages(s, x)), 3).select("doc_id", "page_number", F.size("text_items").alias("n_text")),
    "bundle_sections": lambda s, x: X.bundle_sections(X.with_subject(_distinct(s, x))).select("base", F.size("documents").alias("n"), F.array_join(F.array_sort(F.map_keys("documents")), ",").alias("sections")),
    "has_property_data": lambda s, x: X.has_property_data(_sections(s, x)).groupBy("section").agg(F.count("*").alias("n")),
    "segment_lines": lambda s, x: N.segment_lines(lines(s, x), F.col("line").rlike(HEADER)).groupBy("doc_id", "segment").agg(F.count("*").alias("n"), F.min("line_idx").alias("first_line")),
    "segment_text": lambda s, x: N.segment_text(lines(s, x), F.col("line").rlike(HEADER)).select("doc_id", "segment", "title", "n_lines", F.sha2("body", 256).alias("body_sha256")),
    "nest_sections": lambda s, x: N.nest_sections(N.segment_text(lines(s, x), F.col("line").rlike(HEADER)), F.length("title") % 2 == 0).select("doc_id", "segment", "main"),
    "drop_orphan_counts": lambda s, x: N.drop_orphan_counts(_counted_lines(s, x)).groupBy("doc_id").agg(F.count("*").alias("n")),
    "segment_tables": lambda s, x: N.segment_tables(lines(s, x), F.col("line").rlike(HEADER), F.length("line") > 200).groupBy("doc_id", "block").agg(F.count("*").alias("n")),
    "section_summary": lambda s, x: N.section_summary(lines(s, x)),
    "key_values": lambda s, x: N.key_values(_keyed_lines(s, x)),
    "related_lines": lambda s, x: N.related_lines(_mentions(s, x)),
    "subsection_counts": lambda s, x: N.subsection_counts(N.nest_sections(N.segment_text(lines(s, x), F.col("line").rlike(HEADER)), F.length("title") % 2 == 0)),
    "clean_text": lambda s, x: view(s, x, "documents").select("doc_id", F.sha2(clean_text(F.concat(F.lit(MARKED), "text")), 256).alias("clean_sha256")),
    "page_stats": lambda s, x: N.page_stats(N.split_pages(view(s, x, "documents"))),
    "detect_tables": lambda s, x: N.detect_tables(_wide_lines(s, x)).select("doc_id", "table_idx", "first_line", "last_line", "n_rows", F.size("positions").alias("n_positions"), F.array_join("positions", " ").alias("positions")),
}


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).groupBy("base", "section").agg(F.min("content").alias("content"))


def _counted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a lone unit count in place of every seventh."""
    return lines(spark, sf_dir).withColumn("line", F.when(F.col("line_idx") % 7 == 3, F.concat(F.col("line_idx").cast("string"), F.lit(" Units"))).otherwise(F.col("line")))


def _keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as values of five keys."""
    return lines(spark, sf_dir).withColumn("line", F.concat(F.lit("Key "), (F.col("line_idx") % 5).cast("string"), F.lit(": "), F.length("line").cast("string")))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as text: every third names a key, others mention keys in capitals."""
    l = view(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_idx")).agg(F.min("l_partkey").alias("part"))  # noqa: E741
    key = lambda n: F.concat(F.lit("Key "), n.cast("string"))
    return l.select("doc_id", "line_idx", F.when(F.col("line_idx") % 3 == 1, F.concat(key(F.col("part") % 4), F.lit(": x: y"))).otherwise(F.concat(F.lit(" see "), F.upper(key(F.col("part") % 4)), F.lit(" "))).alias("line"))


def _wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three columns, in runs, made from the orders."""
    o = view(spark, sf_dir, "orders")
    cell = F.concat(F.rpad(F.col("o_orderpriority"), 20, " "), F.rpad(F.col("o_orderstatus"), 8, " "), F.col("o_totalprice").cast("string"))
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("doc_id"), at.alias("line_idx"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("text")).otherwise(cell).alias("line"))


# a text with every mark of converters, put before each document
MARKED = " \t[embed]in\nside[/embed] [binary content]raw[/binary content] Subpage 7 \u00a9 one\n\u00a9 two\n\u00a9 three\n1/2/2024 10:30 AM printed\n12/31/2024  9:05\nsee Page 12 \n[X] yes [ ] no /var/my file.txt/ at a\\\\b\\\\\x07\n\n\n\n\nend \u00e9 "


TABLES = f"""{cte('properties_fx', 'documents_fx', 'extracted_fx')},
everything AS (SELECT 'properties' AS table_name, property_id, deleted_at FROM properties_fx
  UNION ALL SELECT 'documents', property_id, deleted_at FROM documents_fx JOIN properties_fx USING (property_id)
  UNION ALL SELECT 'extracted_files', property_id, deleted_at FROM extracted_fx JOIN properties_fx USING (property_id))"""
LINES = "lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_idx, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"
SEGMENTS = f"{LINES}, marked AS (SELECT *, regexp_matches(line, '{HEADER}') AS h FROM lines), seg AS (SELECT *, CAST(sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY line_idx) AS INT) AS segment FROM marked)"
TITLED = f"{SEGMENTS}, titled AS (SELECT doc_id, segment, max(CASE WHEN h THEN line END) AS title, count(*) FILTER (WHERE NOT h) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY line_idx) FILTER (WHERE NOT h), '') AS body FROM seg WHERE segment > 0 GROUP BY 1, 2)"
DETECT = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(upper(text), $${p}$$)'.replace('$$', chr(39)) for p in ps)} THEN '{k}'" for k, ps in PATTERNS.items()) + " END"
HEAD = DETECT.replace("upper(text)", "upper(header)")
FILLED = f"{cte('pages_fx')}, det AS (SELECT *, coalesce({HEAD}, {DETECT}) AS detected FROM pages_fx), filled AS (SELECT *, coalesce(last_value(detected IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS UNBOUNDED PRECEDING), 'unknown') AS section FROM det)"
COUNT = " GROUP BY 1, 2"
WIDE = "w AS (SELECT o_custkey AS doc_id, o_orderkey % 5 <> 0 AS cells, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS line_idx FROM orders)"


def clean_sql(text: str) -> str:
    """The clean-up rules as nested calls; groups are written another way there."""
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for pattern, put in CLEAN_UPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(re.sub(r'[$](\d)', r'\\\1', put))}, 'g')"
    return f"regexp_replace({text}, '^\\s+|\\s+\\z', '', 'g')"


SQL = {
    "related_lines": "WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_idx, min(l_partkey) % 4 AS k FROM lineitem GROUP BY 1, 2), k AS (SELECT doc_id, k, min(line_idx) AS key_at FROM l WHERE line_idx % 3 = 1 GROUP BY 1, 2) SELECT l.doc_id, l.line_idx, concat('Key ', CAST(k AS VARCHAR)) AS key, concat('see KEY ', CAST(k AS VARCHAR)) AS related FROM l JOIN k USING (doc_id, k) WHERE l.line_idx % 3 <> 1 AND key_at < l.line_idx",
    "subsection_counts": f"WITH {TITLED}, m AS (SELECT doc_id, segment, last_value(CASE WHEN length(title) % 2 = 0 THEN segment END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS main FROM titled) SELECT doc_id, main, count(*) FILTER (WHERE segment <> main) AS subsections FROM m WHERE main IS NOT NULL GROUP BY 1, 2",
    "clean_text": f"SELECT doc_id, sha256({clean_sql("(" + " || ".join(f"chr({ord(c)})" if not (c.isalnum() and c.isascii()) else f"'{c}'" for c in MARKED) + " || text)")}) AS clean_sha256 FROM documents",
    "detect_tables": f"WITH {WIDE}, r AS (SELECT doc_id, line_idx, line_idx - row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS run FROM w WHERE cells), t AS (SELECT doc_id, CAST(min(line_idx) AS INT) AS first_line, CAST(max(line_idx) AS INT) AS last_line, CAST(count(*) AS INT) AS n_rows FROM r GROUP BY doc_id, run HAVING count(*) >= 3) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS INT) AS table_idx, 3 AS n_positions, '0.0 20.0 28.0' AS positions FROM t",
    "soft_delete": f"WITH {TABLES} SELECT table_name, CASE WHEN property_id % 10 = 3 AND deleted_at IS NULL THEN DATE '{AS_OF}' ELSE deleted_at END AS deleted_at, count(*) AS n FROM everything{COUNT}",
    "restore": f"WITH {TABLES} SELECT table_name, CASE WHEN property_id % 2 = 0 THEN NULL ELSE deleted_at END AS deleted_at, count(*) AS n FROM everything{COUNT}",
    "purge": f"WITH {TABLES} SELECT table_name, deleted_at, count(*) AS n FROM everything WHERE property_id % 10 <> 3{COUNT}",
    "retention_purge": f"WITH {TABLES} SELECT table_name, deleted_at, count(*) AS n FROM everything WHERE coalesce(deleted_at >= DATE '2024-01-31', true){COUNT}",
    "pending_purge": f"WITH {cte('properties_fx')} SELECT property_id, deleted_at FROM properties_fx WHERE deleted_at < DATE '2024-01-31'",
    "deletion_countdown": f"WITH {cte('properties_fx')} SELECT property_id, CAST(deleted_at + 30 AS DATE) AS purge_date, CAST(greatest(0, date_diff('day', DATE '{AS_OF}', deleted_at + 30)) AS INT) AS days_remaining FROM properties_fx WHERE deleted_at IS NOT NULL",
    "patch": f"WITH {cte('properties_fx')}, {KEYED}, u AS (SELECT *, CASE WHEN property_id % 10 = 3 THEN concat('9 Oak Avenue #', property_id) ELSE street END AS s2 FROM keyed) SELECT property_id, s2 AS street, city, CASE WHEN property_id % 10 = 3 THEN {ADDRESS.format('concat_ws(chr(32), s2, city, state_abbr)')} ELSE address_key END AS address_key, CASE WHEN property_id % 10 = 3 THEN DATE '{AS_OF}' ELSE created_at END AS updated_at FROM u",
    "profile": " UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'empty' WHEN count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) = count({c}) THEN 'numeric' ELSE 'text' END AS dtype, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
        min(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS min, max(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS max, floor(avg(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) * {d(10000.0)} + {d(0.5)}) / {d(10000.0)} AS mean, median(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS median FROM lineitem""" for c in PROFILED),
    "profile_typed": " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_values, '{k}' AS declared FROM part""" for c, k in TYPED),
    "infer_column_types": f"""WITH {cte('cells_fx')} SELECT table_index, label, CASE WHEN bool_and(regexp_matches(trim(value), '^\\$[\\d,]+(\\.\\d+)?')) THEN 'currency' WHEN bool_and(regexp_matches(trim(value), '^-?\\d+(\\.\\d+)?%')) THEN 'percentage'
        WHEN bool_and(regexp_full_match(trim(value), '-?[\\d,]+(\\.\\d+)?') OR lower(trim(value)) IN ('-', 'n/a', '')) THEN 'numeric' ELSE 'text' END AS column_type FROM cells_fx GROUP BY 1, 2""",
    "categorize_columns": "SELECT p_partkey, unnest(['property_info', 'financial_data', 'unit_mix']) AS category, unnest(['p_brand,p_name,p_type', 'p_retailprice', 'p_size']) AS columns FROM part",
    "section_fill": f"WITH {FILLED} SELECT doc_id, page_number, section FROM filled",
    "section_inventory": f"WITH {FILLED} SELECT section, count(DISTINCT doc_id) AS documents, count(*) AS pages, min(page_number) AS first_page, max(page_number) AS last_page FROM filled GROUP BY 1",
    "assemble_sections": f"WITH {FILLED} SELECT doc_id, section, min(page_number) AS first_page, max(page_number) AS last_page, count(DISTINCT page_number) AS n_pages, CAST(sum(length(text)) + count(*) - 1 AS INT) AS n_chars FROM filled GROUP BY 1, 2",
    "clean_pages": "SELECT conv_id AS doc_id, turn AS page_number, CAST(count(text) AS INT) AS n_text, CAST(count(role) AS INT) AS n_headers, 0 AS table_count FROM conversations GROUP BY 1, 2",
    "first_pages": "SELECT conv_id AS doc_id, turn AS page_number, CAST(count(text) AS INT) AS n_text FROM conversations WHERE turn <= 3 GROUP BY 1, 2",
    "bundle_sections": f"WITH {cte('extracted_fx')} SELECT property_id AS base, CAST(count(DISTINCT section) AS INT) AS n, string_agg(DISTINCT section, ',' ORDER BY section) AS sections FROM extracted_fx GROUP BY 1 HAVING count(*) FILTER (WHERE section = 'subject_property') > 0",
    "has_property_data": f"WITH {cte('extracted_fx')} SELECT section, count(*) AS n FROM extracted_fx WHERE property_id IN (SELECT property_id FROM extracted_fx WHERE section IN ('subject_property', 'demographics', 'construction', 'combined')) GROUP BY 1",
    "segment_lines": f"WITH {SEGMENTS} SELECT doc_id, segment, count(*) AS n, min(line_idx) AS first_line FROM seg WHERE segment > 0 GROUP BY 1, 2",
    "segment_text": f"WITH {TITLED} SELECT doc_id, segment, title, n_lines, sha256(body) AS body_sha256 FROM titled",
    "nest_sections": f"WITH {TITLED} SELECT doc_id, segment, last_value(CASE WHEN length(title) % 2 = 0 THEN segment END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS main FROM titled",
    "drop_orphan_counts": f"WITH {LINES} SELECT doc_id, count(*) AS n FROM lines WHERE line_idx % 7 NOT IN (3, 4) GROUP BY 1",
    "segment_tables": f"WITH {SEGMENTS}, e AS (SELECT *, max(CASE WHEN length(line) > 200 AND NOT h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, segment ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS ended FROM seg WHERE segment > 0) SELECT doc_id, segment AS block, count(*) AS n FROM e WHERE ended = 0 GROUP BY 1, 2",
    "section_summary": f"""WITH {LINES}, k AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^\\s*$') THEN 'blank' WHEN regexp_matches(line, '\\S {{2,}}\\S.* {{2,}}\\S') OR contains(line, ' | ') THEN 'table' WHEN regexp_matches(line, '^[•\\-*]\\s+') THEN 'list' WHEN regexp_matches(line, '^([^:]{{1,60}}):\\s*(.*)$') THEN 'kv' END AS k FROM lines)
        SELECT doc_id, count(*) AS total_lines, count(*) FILTER (WHERE k = 'table') AS tables, count(*) FILTER (WHERE k = 'list') AS list_items, count(*) FILTER (WHERE k = 'kv') AS key_values FROM k GROUP BY 1""",
    "key_values": f"WITH {LINES} SELECT doc_id, concat('Key ', line_idx % 5) AS key, CAST(arg_min(length(line), line_idx) AS VARCHAR) AS value FROM lines GROUP BY 1, 2",
    "page_stats": r"WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\f|\n{3,}')) AS t FROM documents), w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS n FROM p WHERE trim(t) <> '') SELECT doc_id, count(*) AS pages, sum(n) AS words, max(n) AS longest_page FROM w GROUP BY 1",
}
