"""Incremental scoring with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acrelight.dims import DEFAULT_SCORECARD, Scorecard
from acrelight.operators.portfolio import latest_per_key
from acrelight.operators.scorecard import score


def stream_scores(records: DataFrame, out_path: str, checkpoint: str, card: Scorecard = DEFAULT_SCORECARD) -> StreamingQuery:
    """Score a stream of records (property_id, ts, features...) and stop when all that is there has been scored.

    Each batch writes its newest score of every touched property to a folder of
    its own, named by the batch, so a batch that is run again replaces itself.
    ``current_scores`` reads the newest of all batches.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch, card).select("property_id", "ts", "total_score", "decision")
        latest_per_key(scored, "property_id", "ts", "total_score").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return records.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_scores(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest score of each property over all batches."""
    found = spark.read.option("basePath", out_path).parquet(f"{out_path}/batch=*")
    return latest_per_key(found, "property_id", "ts", "batch").drop("batch")


def stream_dedupe(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream without rows whose keys came before within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def section_hash(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("data_hash", F.sha2(content, 256))
