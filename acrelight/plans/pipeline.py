"""From section cells to scored portfolio: features, entities, links, scores in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.dims import DEFAULT_SCORECARD, Scorecard
from acrelight.operators import features as X
from acrelight.operators import portfolio as P
from acrelight.operators import scorecard as S
from acrelight.plans.feature_queries import cells, quarter_cells
from acrelight.plans.feature_queries import SQL as FEATURE_SQL
from acrelight.plans.fixtures import cte, view
from acrelight.plans.scoring_queries import FLAT, SQL as SCORING_SQL, d, decision_sql, half_up, incoming, total_sql


def feature_records(demographics: DataFrame, submarket: DataFrame, external: DataFrame) -> DataFrame:
    """Records for the scorecard by doc_id; what a document lacks is null."""
    d = demographics.select("doc_id", F.struct(*[c for c in demographics.columns if c != "doc_id"]).alias("demographics"))
    m = submarket.select("doc_id", F.struct(*[c for c in submarket.columns if c != "doc_id"]).alias("submarket"))
    return d.join(m, "doc_id", "full").join(external, "doc_id", "left")


def rescore(cells: DataFrame, quarter_cells: DataFrame, external: DataFrame, card: Scorecard = DEFAULT_SCORECARD) -> DataFrame:
    """(doc_id, total_score, decision, color, coverage) of every document, rebuilt from its cells."""
    records = feature_records(X.demographics_features(cells), X.submarket_features(quarter_cells), external)
    return S.score(records, card).select("doc_id", "total_score", "decision", "color", "coverage")


def build_portfolio(addresses: DataFrame, scores: DataFrame, props: DataFrame) -> DataFrame:
    """(incoming_id, property_id, created, total_score, decision): documents matched to properties, new ones made, newest score kept."""
    matched = P.upsert_properties(addresses, props)
    return matched.join(scores.withColumnRenamed("doc_id", "incoming_id"), "incoming_id", "left").select("incoming_id", "property_id", "created", "total_score", "decision")


def portfolio_stats(built: DataFrame) -> DataFrame:
    return built.agg(F.count("*").alias("documents"), F.countDistinct("property_id").alias("properties"), F.count_if("created").alias("created"), F.count("total_score").alias("scored"))


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "features_fx")
    group = lambda **cols: F.struct(*(F.col(c).alias(n) for n, c in cols.items()))
    external = F.struct(group(violent_crime_index="violent", property_crime_index="property_crime").alias("crime"), group(average_rating="school").alias("schools"), group(walk_score="walk", transit_score="transit").alias("walkScore"))
    return f.select(F.col("property_id").alias("doc_id"), external.alias("external"))


def _rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescore(cells(spark, sf_dir, dealt=True), quarter_cells(spark, sf_dir, dealt=True), _external(spark, sf_dir))


def _backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio_stats(build_portfolio(incoming(spark, sf_dir), _rescored(spark, sf_dir), view(spark, sf_dir, "properties_fx")))


QUERIES = {"rescore": _rescored, "backfill": _backfill}


def _body(sql: str) -> str:
    return f"({sql})"


RECORDS = f"""demographic AS (SELECT * FROM {_body(FEATURE_SQL["demographics_features"])}), submarket AS (SELECT * FROM {_body(FEATURE_SQL["submarket_features"])}),
{cte("features_fx")},
records AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, population_3mile AS population, population_growth_3mile AS growth, median_hh_income_3mile AS income, median_home_value_3mile AS home_value, renter_households_pct_3mile AS renter,
  violent, property_crime, school, walk, transit, vacancy_rate AS vacancy, delivered_pct_of_inventory AS delivered, construction_pct_of_inventory AS building
  FROM demographic a FULL JOIN submarket b ON a.doc_id = b.doc_id LEFT JOIN features_fx f ON f.property_id = coalesce(a.doc_id, b.doc_id)),
rescored AS (SELECT doc_id, {total_sql(DEFAULT_SCORECARD)} AS total_score, {half_up(" + ".join([d(0.0), *(f"(CASE WHEN {FLAT[f.path]} IS NOT NULL THEN {d(f.weight)} ELSE {d(0.0)} END)" for f in DEFAULT_SCORECARD.factors)]), 3)} AS coverage FROM records)"""
SQL = {
    "rescore": f"WITH {RECORDS} SELECT *, {decision_sql('total_score')} AS decision, CASE WHEN total_score >= 7 THEN 'green' WHEN total_score >= {d(5.5)} THEN 'yellow' ELSE 'red' END AS color FROM rescored",
    "backfill": f"WITH {RECORDS}, built AS (SELECT * FROM {_body(SCORING_SQL['upsert_properties'])} u LEFT JOIN rescored r ON u.incoming_id = r.doc_id) SELECT count(*) AS documents, count(DISTINCT property_id) AS properties, count(*) FILTER (WHERE created) AS created, count(total_score) AS scored FROM built",
}
