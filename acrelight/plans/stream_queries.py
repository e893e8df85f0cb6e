"""Queries that run streams over the given tables to their end, with SQL of the same rows in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.dims import DEFAULT_SCORECARD
from acrelight.plans.scoring_queries import FLAT, decision_sql, total_sql
from acrelight.sources.shared import fresh_path
from acrelight.streaming.scores import current_scores, stream_dedupe, stream_scores

#: Expressions of the feature fixtures that need the customer alone; home values are missing here.
EXPRESSIONS = {
    "population": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(20000 + (c_custkey * 7919) % 55000 AS DOUBLE) END",
    "growth": "CAST((c_custkey * 31) % 300 - 150 AS DOUBLE) / CAST(10000 AS DOUBLE)",
    "income": "CAST(20000 + (c_custkey * 104729) % 60000 AS DOUBLE)",
    "home_value": "CAST(NULL AS DOUBLE)",
    "renter": "CAST((c_custkey * 17) % 60 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "violent": "CAST((c_custkey * 13) % 800 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "property_crime": "CAST((c_custkey * 29) % 900 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "school": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST((c_custkey * 3) % 101 AS DOUBLE) / CAST(10 AS DOUBLE) END",
    "walk": "CAST((c_custkey * 7) % 101 AS DOUBLE)",
    "transit": "CAST((c_custkey * 11) % 101 AS DOUBLE)",
    "vacancy": "CAST((c_custkey * 19) % 200 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "delivered": "CAST((c_custkey * 23) % 80 AS DOUBLE) / CAST(1000 AS DOUBLE)",
    "building": "CAST((c_custkey * 27) % 90 AS DOUBLE) / CAST(1000 AS DOUBLE)",
}


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; as a pattern, its path may be a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda path: F.expr(EXPRESSIONS[FLAT[path]]).alias(path.rsplit(".", 1)[1])
    group = lambda prefix: F.struct(*(value(p) for p in FLAT if p.rsplit(".", 1)[0] == prefix))
    external = F.struct(group("external.crime").alias("crime"), group("external.schools").alias("schools"), group("external.walkScore").alias("walkScore"))
    records = table_stream(spark, sf_dir, "customer").select(F.col("c_custkey").alias("property_id"), F.timestamp_seconds("c_custkey").alias("ts"), group("demographics").alias("demographics"), external.alias("external"), group("submarket").alias("submarket"))
    out = fresh_path(spark)
    stream_scores(records, out, fresh_path(spark)).awaitTermination()
    return current_scores(spark, out).select("property_id", "total_score", "decision")


def _dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table_stream(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = fresh_path(spark)
    unique = stream_dedupe(events, ["user_id", "event_type"], late="3650 days").select("user_id", "event_type")
    unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three months of events, each a delivery of its own: a key that comes again in the next month is a repeat, after that its state is gone and it counts again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and event_type is not null")
    month = (F.col("event_id") % 3).cast("int")
    keyed = events.select("user_id", "event_type", month.alias("month"), F.add_months(F.lit("2024-01-01").cast("date"), month).cast("timestamp").alias("ts"))
    inbox, out, checkpoint = fresh_path(spark), fresh_path(spark), fresh_path(spark)
    for i in range(3):
        keyed.where(F.col("month") == i).write.parquet(f"{inbox}/{i}")
        unique = stream_dedupe(spark.readStream.schema(keyed.schema).parquet(f"{inbox}/*"), ["user_id", "event_type"], late="10 days")
        unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type", "month")


QUERIES = {"stream_returning": _returning, "stream_scores": _scores, "stream_dedupe": _dedupe}
SQL = {
    "stream_scores": f"WITH f AS (SELECT c_custkey AS property_id, {', '.join(f'{e} AS {n}' for n, e in EXPRESSIONS.items())} FROM customer), t AS (SELECT property_id, {total_sql(DEFAULT_SCORECARD)} AS total_score FROM f) SELECT *, {decision_sql('total_score')} AS decision FROM t",
    "stream_returning": """WITH k AS (SELECT DISTINCT user_id, event_type, CAST(event_id % 3 AS INT) AS month FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
        w AS (SELECT user_id, event_type, month, bool_or(month = 0) OVER p AS zero, bool_or(month = 1) OVER p AS one FROM k WINDOW p AS (PARTITION BY user_id, event_type))
        SELECT user_id, event_type, month FROM w WHERE month = 0 OR (month = 1 AND NOT zero) OR (month = 2 AND NOT (one AND NOT zero))""",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
}
