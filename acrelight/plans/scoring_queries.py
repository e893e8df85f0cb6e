"""Queries of the scorecard, portfolio and entity operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight import dims
from acrelight.dims import DEFAULT_SCORECARD, Scorecard
from acrelight.functions.values import extraction_id
from acrelight.operators import portfolio as P
from acrelight.operators import scorecard as S
from acrelight.plans.fixtures import cte, view

FLAT = {
    "demographics.population_3mile": "population", "demographics.population_growth_3mile": "growth", "demographics.median_hh_income_3mile": "income",
    "demographics.median_home_value_3mile": "home_value", "demographics.renter_households_pct_3mile": "renter", "external.crime.violent_crime_index": "violent",
    "external.crime.property_crime_index": "property_crime", "external.schools.average_rating": "school", "external.walkScore.walk_score": "walk",
    "external.walkScore.transit_score": "transit", "submarket.vacancy_rate": "vacancy", "submarket.delivered_pct_of_inventory": "delivered",
    "submarket.construction_pct_of_inventory": "building",
}
STRICT = DEFAULT_SCORECARD.with_factor("population", weight=0.15).with_factor("transitScore", weight=0.0)
LENIENT = Scorecard(DEFAULT_SCORECARD.factors, forward=6.0, review=4.5)
CARDS = {"default": DEFAULT_SCORECARD, "strict": STRICT, "lenient": LENIENT}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature records, nested as the scorecard's paths need them."""
    f = view(spark, sf_dir, "features_fx")
    c = lambda path: F.col(FLAT[path]).alias(path.rsplit(".", 1)[1])
    group = lambda prefix: F.struct(*(c(p) for p in FLAT if p.rsplit(".", 1)[0] == prefix))
    external = F.struct(group("external.crime").alias("crime"), group("external.schools").alias("schools"), group("external.walkScore").alias("walkScore"))
    return f.select("property_id", group("demographics").alias("demographics"), external.alias("external"), group("submarket").alias("submarket"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties with the scores that are stored for them."""
    scores = S.score(records(spark, sf_dir)).where("property_id % 17 <> 0").select("property_id", "total_score", "decision", "color")
    return P.with_scores(view(spark, sf_dir, "properties_fx"), scores)


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def score_case(f: dims.Factor) -> str:
    op, v = "<=" if f.lower_is_better else ">=", FLAT[f.path]
    return "(CASE WHEN " + v + " IS NULL THEN 0 " + " ".join(f"WHEN {v} {op} {d(float(t))} THEN {10 - i}" for i, t in enumerate(f.thresholds)) + " ELSE 0 END)"


def total_sql(card: Scorecard) -> str:
    return "floor((" + " + ".join([d(0.0), *(f"{score_case(f)} * {d(f.weight)}" for f in card.factors)]) + f") * {d(100.0)} + {d(0.5)}) / {d(100.0)}"


def decision_sql(s: str, card: Scorecard = DEFAULT_SCORECARD) -> str:
    return f"CASE WHEN {s} >= {d(card.forward)} THEN 'Move Forward' WHEN {s} >= {d(card.review)} THEN 'Needs Review' ELSE 'Rejected' END"


SCORED = f"""{cte("properties_fx", "features_fx")},
scores AS (SELECT property_id, {total_sql(DEFAULT_SCORECARD)} AS total_score FROM features_fx WHERE property_id % 17 <> 0),
scored AS (SELECT p.*, s.total_score, CASE WHEN s.total_score IS NOT NULL THEN {decision_sql("s.total_score")} END AS decision FROM properties_fx p LEFT JOIN scores s USING (property_id)),
states(state_key, state_name, region, region_name, region_ord) AS (VALUES {", ".join(f"('{s}', '{dims.STATE_NAMES[s]}', '{k}', '{n}', {i})" for i, (k, n, m) in enumerate(dims.REGIONS) for s in m)}),
placed AS (SELECT s.*, coalesce(t.state_name, upper(s.state_abbr)) AS state_name, region, region_name, region_ord FROM scored s LEFT JOIN states t ON upper(s.state_abbr) = t.state_key)"""
COUNTS = "count(*) FILTER (WHERE decision = 'Move Forward') AS green, count(*) FILTER (WHERE decision = 'Needs Review') AS yellow, count(*) FILTER (WHERE coalesce(decision, '') NOT IN ('Move Forward', 'Needs Review')) AS red, count(*) AS total"
half_up = lambda x, n: f"floor(({x}) * {d(float(10**n))} + {d(0.5)}) / {d(float(10**n))}"
ADDRESS = "trim(" + "regexp_replace(" * 10 + "regexp_replace(regexp_replace(lower({}), '[.,#-]', ' ', 'g'), '\\s+', ' ', 'g')" + "".join(f", '\\b({a}|{b})\\b', '{b}', 'g')" for a, b in [("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("road", "rd"), ("lane", "ln"), ("court", "ct"), ("place", "pl"), ("apartment", "apt"), ("suite", "ste")]) + ")"
KEYED = f"keyed AS (SELECT *, {ADDRESS.format('concat_ws($$ $$, street, city, state_abbr)'.replace('$$', chr(39)))} AS address_key FROM properties_fx)"


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses to match: those of suppliers, made like the customers', some new."""
    return spark.sql(INCOMING, supplier=view(spark, sf_dir, "supplier"))


INCOMING = """SELECT s_suppkey AS incoming_id, concat(CAST(s_suppkey % 25 + 1 AS STRING), ' Main ', CASE s_suppkey % 2 WHEN 0 THEN 'ST' ELSE 'Street,' END) AS street,
  concat('City ', CAST(s_suppkey % 9 AS STRING)) AS city, CASE s_suppkey % 3 WHEN 0 THEN 'AZ' WHEN 1 THEN 'TX' ELSE 'NY' END AS state_abbr FROM {supplier}"""


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "documents_fx").select("property_id", "id", "uploaded_at")
    files = view(spark, sf_dir, "extracted_fx").select("property_id", "section", "id")
    out = P.with_related(P.with_scores(P.live(view(spark, sf_dir, "properties_fx")), S.score(records(spark, sf_dir)).select("property_id", "total_score")), documents=docs, files=files)
    return out.select("property_id", "total_score", F.size(F.coalesce("documents", F.array())).alias("n_documents"), F.get("documents", F.lit(0))["id"].alias("first_document"), F.size(F.coalesce("files", F.array())).alias("n_files"), F.get("files", F.lit(0))["section"].alias("first_section"))


def _breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.breakdown(records(spark, sf_dir), "property_id").select("property_id", "ord", "factor", "value", "score", "weight", "weighted", "lower_is_better")


def _regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_region(P.live(scored(spark, sf_dir)))


QUERIES = {
    "score_properties": lambda s, x: S.score(records(s, x)).select("property_id", "total_score", "decision", "color"),
    "score_breakdown": _breakdown,
    "score_whatif": lambda s, x: S.score_many(records(s, x), "property_id", CARDS),
    "scorecard_validation": lambda s, x: S.score_many(records(s, x), "property_id", CARDS).groupBy("scorecard_id").agg(F.count("*").alias("n")).join(S.validate_scorecards(S.scorecard_rows(s, CARDS)), "scorecard_id"),
    "portfolio_summary": lambda s, x: P.portfolio_summary(scored(s, x)),
    "score_summary": lambda s, x: P.score_summary(scored(s, x)),
    "rollup_region": lambda s, x: P.rollup_region(_regional(s, x)),
    "rollup_state": lambda s, x: P.rollup_state(_regional(s, x)),
    "rollup_city": lambda s, x: P.rollup_city(_regional(s, x)),
    "rollup_property": lambda s, x: P.rollup_property(P.drill_filter(_regional(s, x), region="south")),
    "drilldown_cube": lambda s, x: P.drilldown_cube(_regional(s, x)),
    "filter_summary": lambda s, x: P.filter_summary(P.drill_filter(_regional(s, x), state="tx", city="city_3")),
    "property_view": lambda s, x: P.to_property_view(scored(s, x)).select("property_id", F.col("address.city").alias("city"), "score", "decision"),
    "rank_properties": lambda s, x: P.rank_properties(P.live(scored(s, x)), 100).select("property_id", "rank", "total_score"),
    "with_related": _related,
    "first_file": lambda s, x: P.first_file(view(s, x, "documents_fx").withColumn("deleted_at", F.when(F.col("id") % 5 == 0, F.col("uploaded_at")))),
    "extraction_ids": lambda s, x: view(s, x, "documents_fx").select("id", extraction_id(F.col("path")).alias("extraction_id")),
    "address_dedupe": lambda s, x: P.dedupe_addresses(view(s, x, "properties_fx")),
    "match_by_address": lambda s, x: P.match_by_address(incoming(s, x), view(s, x, "properties_fx")).select("incoming_id", "address_key", "match_id"),
    "upsert_properties": lambda s, x: P.upsert_properties(incoming(s, x), view(s, x, "properties_fx")),
    "link_new": lambda s, x: P.link_new(view(s, x, "documents_fx").select("property_id", "id"), view(s, x, "documents_fx").where("id % 3 = 0").select("property_id", "id"), ["property_id", "id"]),
    "changed_sections": lambda s, x: P.changed(_hashed(s, x, 0), _hashed(s, x, 1), ["property_id", "section"]),
    "latest_scores": lambda s, x: P.latest_per_key(view(s, x, "events").select(F.col("user_id").alias("property_id"), "ts", "event_id", "value"), "property_id", "ts", "event_id").select("property_id", "event_id", "value"),
    "enrich_keys": lambda s, x: P.enrich_key(view(s, x, "properties_fx").withColumn("zip", F.when(F.col("property_id") % 4 == 0, F.lpad(F.col("property_id").cast("string"), 5, "0")))).select("property_id", "lookup_key"),
}


def _hashed(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """One row for each property and section; the second version differs where the first content's key is a multiple of five."""
    rows = view(spark, sf_dir, "extracted_fx").groupBy("property_id", "section").agg(F.min("id").alias("id"))
    return rows.select("property_id", "section", F.sha2(F.when(F.col("id") % 5 == 0, F.col("id") + k).otherwise(F.col("id")).cast("string"), 256).alias("data_hash"))


LIVE = f"WITH {SCORED}, live AS (SELECT * FROM placed WHERE deleted_at IS NULL) "
SQL = {
    "score_properties": f"WITH {cte('features_fx')}, t AS (SELECT property_id, {total_sql(DEFAULT_SCORECARD)} AS total_score FROM features_fx) SELECT *, {decision_sql('total_score')} AS decision, CASE WHEN total_score >= 7 THEN 'green' WHEN total_score >= {d(5.5)} THEN 'yellow' ELSE 'red' END AS color FROM t",
    "score_breakdown": f"WITH {cte('features_fx')} " + " UNION ALL ".join(f"SELECT property_id, {i} AS ord, '{f.key}' AS factor, {FLAT[f.path]} AS value, {score_case(f)} AS score, {d(f.weight)} AS weight, {half_up(f'{score_case(f)} * {d(f.weight)}', 3)} AS weighted, {str(f.lower_is_better).lower()} AS lower_is_better FROM features_fx" for i, f in enumerate(DEFAULT_SCORECARD.factors)),
    "score_whatif": f"WITH {cte('features_fx')}, t AS (" + " UNION ALL ".join(f"SELECT property_id, '{n}' AS scorecard_id, {total_sql(c)} AS total_score FROM features_fx" for n, c in CARDS.items()) + ") SELECT *, CASE scorecard_id " + " ".join(f"WHEN '{n}' THEN {decision_sql('total_score', c)}" for n, c in CARDS.items()) + " END AS decision FROM t",
    "scorecard_validation": "WITH w(scorecard_id, total_weight) AS (VALUES " + ", ".join(f"('{n}', {half_up(' + '.join(d(f.weight) for f in c.factors), 6)})" for n, c in CARDS.items()) + ") SELECT scorecard_id, (SELECT count(*) FROM customer) AS n, total_weight, abs(total_weight - 1) <= 0.001 AS valid FROM w",
    "portfolio_summary": f"WITH {SCORED} SELECT count(*) FILTER (WHERE deleted_at IS NULL) AS active, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS deleted, " + ", ".join(f"count(*) FILTER (WHERE deleted_at IS NULL AND decision = '{v}') AS {n}" for n, v in (("move_forward", "Move Forward"), ("needs_review", "Needs Review"), ("rejected", "Rejected"))) + f", {half_up('avg(total_score) FILTER (WHERE deleted_at IS NULL)', 4)} AS avg_score FROM scored",
    "score_summary": f"WITH {SCORED}, t AS (SELECT coalesce(total_score, 0) AS s FROM scored) SELECT count(*) AS n, count(*) FILTER (WHERE s >= 7) AS move_forward, count(*) FILTER (WHERE s >= {d(5.5)} AND s < 7) AS needs_review, count(*) FILTER (WHERE s < {d(5.5)}) AS rejected, {half_up('avg(s)', 2)} AS mean_score, min(s) AS min_score, max(s) AS max_score FROM t",
    "rollup_region": LIVE + f"SELECT region, region_name, region_ord, {COUNTS} FROM live WHERE region IS NOT NULL GROUP BY ALL",
    "rollup_state": LIVE + f"SELECT upper(state_abbr) AS state, state_name, {COUNTS} FROM live WHERE state_abbr IS NOT NULL GROUP BY ALL",
    "rollup_city": LIVE + f"SELECT replace(lower(city), ' ', '_') AS city_key, arg_max(city, (created_at, property_id)) AS city, {COUNTS} FROM live WHERE city IS NOT NULL GROUP BY 1",
    "rollup_property": LIVE + "SELECT property_id, name, total_score AS score, " + ", ".join(f"CASE WHEN decision = '{v}' THEN 1 ELSE 0 END AS {n}" for n, v in (("green", "Move Forward"), ("yellow", "Needs Review"), ("red", "Rejected"))) + " FROM live WHERE region = 'south'",
    "drilldown_cube": LIVE + f", k AS (SELECT region, upper(state_abbr) AS state, replace(lower(city), ' ', '_') AS city_key, decision FROM live) SELECT region, state, city_key, CAST(grouping_id(region, state, city_key) AS INT) AS level, {COUNTS} FROM k GROUP BY GROUPING SETS ((), (region), (region, state), (region, state, city_key))",
    "filter_summary": LIVE + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE decision = '{v}') AS {n}" for n, v in (("green", "Move Forward"), ("yellow", "Needs Review"), ("red", "Rejected"))) + " FROM live WHERE upper(state_abbr) = 'TX' AND city = 'City 3'",
    "property_view": f"WITH {SCORED} SELECT property_id, city, total_score AS score, decision FROM scored",
    "rank_properties": LIVE + "SELECT property_id, CAST(row_number() OVER (ORDER BY coalesce(total_score, 0) DESC, created_at DESC, property_id) AS INT) AS rank, total_score FROM live QUALIFY rank <= 100",
    "with_related": f"""WITH {cte('properties_fx', 'features_fx', 'documents_fx', 'extracted_fx')},
        dd AS (SELECT property_id, count(*) AS n, min(id) AS first FROM documents_fx GROUP BY 1),
        ff AS (SELECT property_id, count(*) AS n, min(section) AS first FROM extracted_fx GROUP BY 1)
        SELECT p.property_id, {total_sql(DEFAULT_SCORECARD)} AS total_score, CAST(coalesce(dd.n, 0) AS INT) AS n_documents, dd.first AS first_document, CAST(coalesce(ff.n, 0) AS INT) AS n_files, ff.first AS first_section
        FROM properties_fx p JOIN features_fx USING (property_id) LEFT JOIN dd USING (property_id) LEFT JOIN ff USING (property_id) WHERE deleted_at IS NULL""",
    "first_file": f"WITH {cte('documents_fx')} SELECT property_id, arg_min(path, id) AS path FROM documents_fx WHERE id % 5 <> 0 GROUP BY 1",
    "extraction_ids": f"WITH {cte('documents_fx')} SELECT id, concat('e_', CAST(id AS VARCHAR), '-ab', CAST(id % 10 AS VARCHAR)) AS extraction_id FROM documents_fx",
    "address_dedupe": f"WITH {cte('properties_fx')}, {KEYED} SELECT property_id, min(property_id) OVER (PARTITION BY address_key) AS canonical_id FROM keyed",
    "match_by_address": f"WITH {cte('properties_fx')}, {KEYED}, i AS ({INCOMING.format(supplier='supplier')}), ik AS (SELECT *, {ADDRESS.format('concat_ws(chr(32), street, city, state_abbr)')} AS address_key FROM i), m AS (SELECT address_key, min(property_id) AS match_id FROM keyed WHERE deleted_at IS NULL GROUP BY 1) SELECT incoming_id, address_key, match_id FROM ik LEFT JOIN m USING (address_key)",
    "upsert_properties": f"""WITH {cte('properties_fx')}, {KEYED}, i AS ({INCOMING.format(supplier='supplier')}), ik AS (SELECT *, {ADDRESS.format('concat_ws(chr(32), street, city, state_abbr)')} AS address_key FROM i),
        m AS (SELECT address_key, min(property_id) AS match_id FROM keyed WHERE deleted_at IS NULL GROUP BY 1), j AS (SELECT * FROM ik LEFT JOIN m USING (address_key)),
        fresh AS (SELECT address_key, row_number() OVER (ORDER BY min(incoming_id)) + (SELECT max(property_id) FROM properties_fx) AS new_id FROM j WHERE match_id IS NULL GROUP BY 1)
        SELECT incoming_id, coalesce(match_id, new_id) AS property_id, match_id IS NULL AS created FROM j LEFT JOIN fresh USING (address_key)""",
    "link_new": "SELECT o_custkey AS property_id, o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0",
    "changed_sections": f"WITH {cte('extracted_fx')}, g AS (SELECT property_id, section, min(id) AS id FROM extracted_fx GROUP BY 1, 2) SELECT property_id, section, sha256(CAST(id AS VARCHAR)) AS data_hash FROM g WHERE id % 5 = 0",
    "latest_scores": "SELECT user_id AS property_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
    "enrich_keys": f"WITH {cte('properties_fx')}, z AS (SELECT *, CASE WHEN property_id % 4 = 0 THEN lpad(CAST(property_id AS VARCHAR), 5, '0') END AS zip FROM properties_fx) SELECT property_id, coalesce(zip, city) AS lookup_key FROM z WHERE state_abbr IS NOT NULL AND coalesce(zip, city) IS NOT NULL",
}
