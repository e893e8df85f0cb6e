"""Queries over section documents: lookups in both forms of tables, re-scoring, incremental scoring, score upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.dims import DEFAULT_SCORECARD
from acrelight.operators.sectiondocs import build_portfolio, rescore_report, rescore_sections
from acrelight.operators.tables import table_lookups
from acrelight.plans.feature_queries import number_sql
from acrelight.plans.fixtures import VIEWS, cte, view
from acrelight.plans.scoring_queries import ADDRESS, FLAT, INCOMING, KEYED, d, decision_sql, half_up, incoming, total_sql
from acrelight.sources.shared import fresh_path
from acrelight.sources.tables import SECTION_SCHEMA
from acrelight.sources.versions import VersionedTable
from acrelight.streaming.sections import score_table, section_table, stream_sections

# What section documents say of each customer, as texts, in its first (v = 0) and its revised edition (v = 1).
K, V = "c_custkey", "v"
VIEWS["editions_fx"] = f"""
    SELECT CAST({K} AS BIGINT) AS k, v,
      CASE WHEN {K} % 5 = 0 THEN CAST(100 + {K} % 800 AS STRING) ELSE CAST(20000 + ({K} * 7919 + v * 1013) % 55000 AS STRING) END AS population,
      concat(CAST(({K} * 31 + v * 7) % 30 AS STRING), '.', CAST({K} % 10 AS STRING), '%') AS growth,
      concat('$', CAST(20000 + ({K} * 104729 + v * 9001) % 60000 AS STRING)) AS income,
      CASE WHEN {K} % 9 = 0 THEN '-' ELSE concat('$', CAST(100000 + ({K} * 211 + v * 5) % 400000 AS STRING)) END AS home,
      concat(CAST(({K} * 17 + v) % 60 + 1 AS STRING), '%') AS renter,
      CAST(200 + ({K} * 29) % 3000 AS STRING) AS units, CAST(({K} * 3 + v * 11) % 90 AS STRING) AS delivered, CAST(({K} * 5) % 70 AS STRING) AS building,
      concat(CAST(({K} * 7 + v) % 19 + 1 AS STRING), '.5%') AS vacancy,
      CAST(({K} * 13) % 800 AS DOUBLE) / CAST(10 AS DOUBLE) AS violent, CAST(({K} * 29) % 900 AS DOUBLE) / CAST(10 AS DOUBLE) AS property_crime,
      CAST(({K} * 3) % 101 AS DOUBLE) / CAST(10 AS DOUBLE) AS school, CAST(({K} * 7 + v) % 101 AS INT) AS walk, CAST(({K} * 11) % 101 AS INT) AS transit
    FROM {{customer}} CROSS JOIN (SELECT explode(array(0, 1)) AS v)"""
EDITIONS_SQL = VIEWS["editions_fx"].replace("CROSS JOIN (SELECT explode(array(0, 1)) AS v)", "CROSS JOIN (VALUES (0), (1)) t(v)").replace("{customer}", "customer")


def _texts(*items) -> list:
    return F.array(*(F.struct(F.lit(None).cast("string").alias("label"), c.alias("text")) for c in items))


def _pairs(header: str, *rows) -> list:
    """Rows of two columns, a label and ``header``; a null label is no row."""
    made = F.array(*(F.when(label.isNotNull(), F.create_map(F.lit("Label"), label, F.lit(header), value)) for label, value in rows))
    return F.filter(made, lambda r: r.isNotNull())


def edition_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(base, section, v, line): section documents as JSON texts.

    The label of every fourth share of renters is in rows, in markdown, in prose
    or nowhere; every third vacancy is in prose, in the submarket table or in
    another table, where only a lookup finds it. Customers divisible by 17 have
    no external section.
    """
    e = view(spark, sf_dir, "editions_fx")
    c, k, lit = F.col, F.col("k"), F.lit
    own = k % 4
    rows = _pairs("3 Mile", (lit("2024 Population"), c("population")), (lit("Pop Growth 2024-2029"), c("growth")), (lit("Median Household Income"), c("income")), (lit("Median Home Value"), c("home")), (F.when(own == 0, lit("Renter Occupied")), c("renter")))
    markdown = F.when(own == 1, F.concat(lit("| Label | 1 Mile | 3 Mile |\n|---|---|---|\n| Renter Occupied | 99% | "), c("renter"), lit(" |")))
    table = lambda headers, rows, markdown: F.struct(F.array(*map(lit, headers)).alias("headers"), rows.alias("rows"), markdown.cast("string").alias("markdown"))
    prose = F.when(own == 2, F.concat(F.regexp_replace("renter", "%", ""), lit("% of households now rent"))).otherwise("nothing here")
    date = F.struct(F.concat(lit("2024-0"), (c("v") + 1).cast("string"), lit("-01")).alias("extraction_date"))
    page = lambda *items: F.array(F.struct(lit(1).alias("page_number"), _texts(*items).alias("text_items")))
    demographic = F.struct(page(lit("Demographics"), prose).alias("pages"), F.array(table(["Label", "3 Mile"], rows, markdown)).alias("tables"), date.alias("metadata"))
    third = k % 3
    quarter = F.array(F.create_map(lit("Current Quarter"), lit("Submarket"), lit("Units"), c("units"), lit("Vacancy Rate"), F.when(third == 1, c("vacancy")).otherwise("-"), lit("Under Constr Units"), c("building")), F.create_map(lit("Current Quarter"), lit("Delivered Units"), lit("Units"), c("delivered"), lit("Vacancy Rate"), lit(""), lit("Under Constr Units"), lit("")))
    other = F.array(F.create_map(lit("Area"), lit("The submarket"), lit("Vacancy Rate (all)"), F.when(third == 2, c("vacancy")).otherwise("n/a")))
    told = F.when(third == 0, F.concat(lit("The submarket vacancy rate is "), c("vacancy"))).otherwise("no word of it")
    construction = F.struct(page(told).alias("pages"), F.array(table(["Area", "Vacancy Rate (all)"], other, lit(None)), table(["Current Quarter", "Units", "Vacancy Rate", "Under Constr Units"], quarter, lit(None))).alias("tables"), date.alias("metadata"))
    external = F.struct(date.alias("metadata"), F.struct(c("violent").alias("violent_crime_index"), c("property_crime").alias("property_crime_index")).alias("crime"), F.struct(c("school").alias("average_rating")).alias("schools"), F.struct(c("walk").alias("walk_score"), c("transit").alias("transit_score")).alias("walkScore"))
    section = lambda name, doc, there=None: F.struct(lit(name).alias("section"), (F.to_json(doc) if there is None else F.when(there, F.to_json(doc))).alias("line"))
    each = F.inline(F.array(section("demographics", demographic), section("construction", construction), section("external", external, k % 17 != 0)))
    return e.select(F.concat(lit("e_"), k.cast("string")).alias("base"), k, c("v"), each).where("line is not null")


def as_sections(lines: DataFrame) -> DataFrame:
    """(base, section, document, status, extracted_at) of documents as JSON texts; a text that is none is an error."""
    doc = F.from_json("line", SECTION_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    read = lines.withColumn("d", doc)
    fields = [c for c in read.select("d.*").columns if c != "_corrupt_record"]
    return read.select("base", "section", F.struct(*(F.col(f"d.{c}").alias(c) for c in fields)).alias("document"), F.when(F.col("d._corrupt_record").isNull(), "success").otherwise("error").alias("status"), F.col("d.metadata.extraction_date").alias("extracted_at"))


def _damaged(lines: DataFrame) -> DataFrame:
    """Every 13th external document cut short, and all documents of every 29th base."""
    bad = ((F.col("section") == "external") & (F.col("k") % 13 == 0)) | (F.col("k") % 29 == 0)
    return lines.withColumn("line", F.when(bad, F.lit('{"metadata": ')).otherwise(F.col("line")))


def _rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescore_sections(as_sections(_damaged(edition_documents(spark, sf_dir).where("v = 0"))))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First editions, then revisions of every third base with some first editions sent again, then late first editions and repeated revisions."""
    lines = edition_documents(spark, sf_dir)
    k, v = F.col("k"), F.col("v")
    batches = [v == 0, ((v == 1) & (k % 3 == 0)) | ((v == 0) & (k % 7 == 0)), ((v == 0) & (k % 6 == 0)) | ((v == 1) & (k % 9 == 0))]
    inbox, checkpoint = fresh_path(spark), fresh_path(spark)
    sections, scores = section_table(spark, fresh_path(spark), 8), score_table(spark, fresh_path(spark), 8)
    for i, test in enumerate(batches):
        lines.where(test).select("base", "section", "line").write.parquet(f"{inbox}/{i}")
        stream = spark.readStream.schema("base string, section string, line string").parquet(f"{inbox}/*")
        stream_sections(as_sections(stream), sections, scores, checkpoint).awaitTermination()
    return scores.read().select("base", "total_score", "decision", "coverage", "error")


def _upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two upserts of events and one that fails as it writes; readers see the second."""
    events = view(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").cast("long").alias("property_id"), "event_id", "value")
    table = VersionedTable(spark, fresh_path(spark), "property_id long, event_id long, value double", ["property_id"], 4)
    table.upsert(events.where("event_id % 3 <> 0"), ["event_id"])
    table.upsert(events.where("event_id % 3 = 0"), ["event_id"], "events", 1)
    table.upsert(events.where("event_id < 0"), ["event_id"], "events", 1)
    broken = events.withColumn("value", F.when(F.col("event_id") % 5 >= 0, F.raise_error(F.lit("cut off")).cast("double")))
    try:
        table.upsert(broken.withColumn("event_id", F.col("event_id") + 10**9), ["event_id"])
    except Exception as error:
        if "cut off" not in str(error):
            raise
    return table.read().withColumn("versions", F.lit(len(table.versions())))


def portfolio_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of reports on suppliers' properties: an address in the subject section, sometimes none; some external only, some cut short."""
    i, lit, c = incoming(spark, sf_dir), F.lit, F.col
    k = c("incoming_id")
    header = lambda *texts: F.array(*(F.struct(t.alias("text")) for t in texts))
    place = F.concat("city", lit(", "), F.element_at(F.create_map(*map(lit, ("AZ", "Arizona", "TX", "Texas", "NY", "New York"))), c("state_abbr")))
    subject = F.struct(F.array(F.struct(header(lit("SUBJECT PROPERTY"), F.regexp_replace("street", ",", "")).alias("headers"), _texts(F.regexp_replace(place, r"\d", "")).alias("text_items"))).alias("pages"))
    demographic = F.struct(F.array(F.struct(F.array(lit("Label"), lit("3 Mile")).alias("headers"), _pairs("3 Mile", (lit("2024 Population"), (k * 997 % 60000 + 2000).cast("string"))).alias("rows"))).alias("tables"))
    external = F.struct(F.struct((k % 90).cast("double").alias("violent_crime_index")).alias("crime"))
    section = lambda name, doc, there: F.struct(lit(name).alias("section"), F.when(there, F.to_json(doc)).alias("line"))
    only = k % 7 == 0
    each = F.inline(F.array(section("subject_property", subject, ~only), section("demographics", demographic, ~only & (k % 3 == 0)), section("external", external, lit(True))))
    lines = i.select(F.concat(lit("e_"), F.lpad(k.cast("string"), 7, "0"), lit("-ab")).alias("base"), k.alias("k"), each).where("line is not null")
    return as_sections(lines.withColumn("line", F.when(c("k") % 11 == 0, lit("{ cut")).otherwise(c("line"))))


def _portfolio(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    k = F.col("s_suppkey")
    number = F.lpad(k.cast("string"), 7, "0")
    files = view(spark, sf_dir, "supplier").where(k % 2 == 0).select(F.concat(number, F.lit("-ab_report.pdf")).alias("file_name"), F.concat(F.lit("store/"), (k % 8).cast("string")).alias("storage_path"))
    none = view(spark, sf_dir, "properties_fx").where("false")
    documents = none.select(F.col("property_id").cast("string").alias("id"), "property_id", F.col("name").alias("storage_path"), F.col("name").alias("file_name"))
    props = view(spark, sf_dir, "properties_fx").withColumn("city", F.when(F.col("property_id") % 2 == 0, "City").otherwise(F.col("city")))
    return build_portfolio(portfolio_sections(spark, sf_dir), files, props, documents, none.select("property_id", F.col("name").alias("section")))


def both_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables that have rows, markdown or both, with two mile columns."""
    g = view(spark, sf_dir, "forms_fx")
    cell = lambda i, h, c: F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), c.alias("cell"))
    each = F.inline(F.array(cell(0, "Label", F.col("label")), cell(1, "1 Mile", F.col("one")), cell(2, "3 Mile Radius", F.col("three"))))
    return g.select("doc_id", F.lit(0).alias("src_ord"), "table_index", "form", "row_idx", each).withColumnRenamed("cell", "value")


VIEWS["forms_fx"] = """
    SELECT l_orderkey AS doc_id, l_suppkey % 2 AS table_index, CAST(l_partkey % 2 AS INT) AS form, l_linenumber AS row_idx,
      min(CASE l_linenumber % 3 WHEN 0 THEN 'Median Income' WHEN 1 THEN 'Median Home Value' ELSE 'Population' END) AS label,
      min(CASE WHEN l_partkey % 5 = 0 THEN 'n/a' ELSE CAST(l_partkey AS STRING) END) AS one, min(CAST(l_suppkey AS STRING)) AS three
    FROM {lineitem} GROUP BY l_orderkey, l_suppkey % 2, CAST(l_partkey % 2 AS INT), l_linenumber"""

QUERIES = {
    "table_lookups": lambda s, x: table_lookups(both_forms(s, x), {"income": ("income", "3 Mile"), "anything": ("MEDIAN", "no such"), "population": ("Population", None)}),
    "rescore_sections": _rescored,
    "rescore_report": lambda s, x: rescore_report(_rescored(s, x)),
    "stream_sections": _streamed,
    "score_upserts": _upserts,
    "portfolio_bases": lambda s, x: _portfolio(s, x)["bases"],
    "portfolio_documents": lambda s, x: _portfolio(s, x)["documents"],
    "portfolio_extracted": lambda s, x: _portfolio(s, x)["extracted"],
    "portfolio_scores": lambda s, x: _portfolio(s, x)["scores"],
}


def _values(edition: str, broken: str = "FALSE", lost: str = "FALSE") -> str:
    """CTEs with the score of each base by the texts of its edition."""
    n = lambda c: number_sql(c)
    share = f"CASE WHEN k % 4 = 3 THEN NULL ELSE CAST(replace(renter, '%', '') AS DOUBLE) / {d(100.0)} END"
    outside = lambda c: f"CASE WHEN k % 17 = 0 OR {broken} THEN NULL ELSE {c} END"
    return f"""e AS ({EDITIONS_SQL}), picked AS (SELECT * FROM e WHERE {edition}),
f AS (SELECT k, {lost} AS lost, {n('population')} AS population, {n('growth')} AS growth, {n('income')} AS income, {n('home')} AS home_value, {share} AS renter,
  CAST(replace(vacancy, '%', '') AS DOUBLE) / {d(100.0)} AS vacancy, CAST(delivered AS DOUBLE) / CAST(units AS DOUBLE) AS delivered, CAST(building AS DOUBLE) / CAST(units AS DOUBLE) AS building,
  {outside('violent')} AS violent, {outside('property_crime')} AS property_crime, {outside('school')} AS school, {outside('walk')} AS walk, {outside('transit')} AS transit FROM picked),
s AS (SELECT k, lost, {total_sql(DEFAULT_SCORECARD)} AS score, {half_up(" + ".join([d(0.0), *(f"(CASE WHEN {FLAT[f.path]} IS NOT NULL THEN {d(f.weight)} ELSE {d(0.0)} END)" for f in DEFAULT_SCORECARD.factors)]), 3)} AS have FROM f),
scored AS (SELECT concat('e_', CAST(k AS VARCHAR)) AS base, CASE WHEN NOT lost THEN score END AS total_score, CASE WHEN NOT lost THEN {decision_sql('score')} END AS decision,
  CASE WHEN NOT lost THEN CASE WHEN score >= 7 THEN 'green' WHEN score >= {d(5.5)} THEN 'yellow' ELSE 'red' END END AS color, CASE WHEN NOT lost THEN have END AS coverage,
  CAST(CASE WHEN lost THEN (CASE WHEN k % 17 = 0 THEN 2 ELSE 3 END) WHEN {broken} AND k % 17 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS unreadable, CASE WHEN lost THEN 'no section could be read' END AS error FROM s)"""


# properties by the addresses that reports give: the number in a city's name is no part of it
_MATCHED = f"""{cte('properties_fx')}, pp AS (SELECT * REPLACE (CASE WHEN property_id % 2 = 0 THEN 'City' ELSE city END AS city) FROM properties_fx), {KEYED.replace('FROM properties_fx', 'FROM pp')}, i AS ({INCOMING.format(supplier='supplier')}),
b AS (SELECT incoming_id AS k, concat('e_', lpad(CAST(incoming_id AS VARCHAR), 7, '0'), '-ab') AS base, replace(street, ',', '') AS street, state_abbr, incoming_id % 11 = 0 AS cut, incoming_id % 7 = 0 AS outside FROM i),
ik AS (SELECT *, {ADDRESS.format("concat_ws(chr(32), street, 'City', state_abbr)")} AS address_key FROM b WHERE NOT cut AND NOT outside),
known AS (SELECT address_key, min(property_id) AS match_id FROM keyed WHERE deleted_at IS NULL GROUP BY 1), j AS (SELECT * FROM ik LEFT JOIN known USING (address_key)),
fresh AS (SELECT address_key, row_number() OVER (ORDER BY min(base)) + (SELECT max(property_id) FROM properties_fx) AS new_id FROM j WHERE match_id IS NULL GROUP BY 1),
m AS (SELECT k, base, coalesce(match_id, new_id) AS property_id, match_id IS NULL AS created FROM j LEFT JOIN fresh USING (address_key))"""
_PORTFOLIO_FACTORS = {"population": "CASE WHEN k % 3 = 0 THEN CAST(k * 997 % 60000 + 2000 AS DOUBLE) END", "violent": "CAST(k % 90 AS DOUBLE)"}
_SECTIONS = _values("v = 0", "k % 13 = 0", "k % 29 = 0")
_AT = "(table_index, form, row_idx)"
SQL = {
    "table_lookups": f"""WITH {cte('forms_fx')}, g AS (SELECT *, CASE WHEN form = 0 OR regexp_matches(one, '[0-9$%]') THEN one ELSE three END AS other FROM forms_fx)
SELECT doc_id, arg_min(three, {_AT}) FILTER (WHERE label = 'Median Income') AS income, arg_min(other, {_AT}) FILTER (WHERE label <> 'Population') AS anything, arg_min(other, {_AT}) FILTER (WHERE label = 'Population') AS population FROM g GROUP BY doc_id""",
    "rescore_sections": f"WITH {_SECTIONS} SELECT * FROM scored",
    "rescore_report": f"WITH {_SECTIONS} SELECT count(*) FILTER (WHERE error IS NULL) AS rescored, count(error) AS errors, CAST(sum(unreadable) AS BIGINT) AS unreadable FROM scored",
    "stream_sections": f"WITH {_values('v = CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END')} SELECT base, total_score, decision, coverage, error FROM scored",
    "portfolio_bases": f"WITH {_MATCHED} SELECT b.base, property_id, coalesce(created, false) AS created, CASE WHEN property_id IS NULL THEN 'skipped' ELSE 'processed' END AS status, CASE WHEN cut THEN 'no section could be read' WHEN outside THEN 'no property data' END AS reason FROM b LEFT JOIN m USING (base)",
    # of one property's reports the one with the least base takes a storage path; file names are all different
    "portfolio_documents": f"WITH {_MATCHED} SELECT min(base) AS base, property_id, concat('store/', k % 8) AS storage_path, arg_min(concat(lpad(CAST(k AS VARCHAR), 7, '0'), '-ab_report.pdf'), base) AS file_name FROM m WHERE k % 2 = 0 GROUP BY property_id, k % 8",
    "portfolio_extracted": f"WITH {_MATCHED}, s AS (SELECT property_id, base, unnest(['subject_property', 'external', CASE WHEN k % 3 = 0 THEN 'demographics' END]) AS section FROM m) SELECT property_id, section, min(base) AS base FROM s WHERE section IS NOT NULL GROUP BY 1, 2",
    "portfolio_scores": f"""WITH {_MATCHED}, f AS (SELECT property_id, base, {', '.join(f"{_PORTFOLIO_FACTORS.get(n, 'CAST(NULL AS DOUBLE)')} AS {n}" for n in FLAT.values())} FROM m), s AS (SELECT property_id, base, {total_sql(DEFAULT_SCORECARD)} AS score FROM f)
        SELECT property_id, arg_max(score, base) AS total_score, arg_max({decision_sql('score')}, base) AS decision, arg_max(CASE WHEN score >= 7 THEN 'green' WHEN score >= {d(5.5)} THEN 'yellow' ELSE 'red' END, base) AS color FROM s GROUP BY property_id""",
    "score_upserts": "SELECT user_id AS property_id, max(event_id) AS event_id, arg_max(value, event_id) AS value, 2 AS versions FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
}
