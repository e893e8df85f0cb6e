"""Section files arriving: stored, their bases scored anew, scores put into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acrelight.dims import DEFAULT_SCORECARD, Scorecard
from acrelight.operators.sectiondocs import rescore_sections
from acrelight.sources.shared import stage
from acrelight.sources.tables import SECTION_SCHEMA, name_parts
from acrelight.sources.versions import VersionedTable

DOCUMENT = SECTION_SCHEMA.removesuffix(", _corrupt_record string")
STORED = f"base string, section string, document struct<{DOCUMENT}>, status string, extracted_at string"
SCORED = "base string, total_score double, decision string, color string, coverage double, unreadable long, error string, batch long"


def section_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Section files under ``path`` as a stream of (base, section, document, status, extracted_at).

    A file that is no section document is a row with status 'error'. Files name
    their base and section; ``extracted_at`` is the document's own date, by which
    a late file is told from a new one.
    """
    reader = spark.readStream.schema(SECTION_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.json(path)
    fields = [c for c in raw.columns if c != "_corrupt_record"]
    status = F.when(F.col("_corrupt_record").isNull(), "success").otherwise("error")
    return raw.select(*name_parts(F.col("_metadata.file_name")), F.struct(*fields).alias("document"), status.alias("status"), F.col("metadata.extraction_date").alias("extracted_at"))


def section_table(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    """The newest document of each base and section; a base's sections share a bucket."""
    return VersionedTable(spark, path, STORED, ["base", "section"], buckets)


def score_table(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    """The score of each base."""
    return VersionedTable(spark, path, SCORED, ["base"], buckets)


def stream_sections(stream: DataFrame, sections: VersionedTable, scores: VersionedTable, checkpoint: str, card: Scorecard = DEFAULT_SCORECARD, keep: int = 3) -> StreamingQuery:
    """Keep ``sections`` and ``scores`` as the stream says, and stop when all that is there has been taken.

    Each batch puts its documents into ``sections``, where an older one never
    replaces a newer; then the bases that it touches are scored anew from all
    their sections, of which only their buckets are read. Both tables remember
    the last batch of this stream, so a batch that is run again, whole or after
    the first of the two, leaves them as if it had run once. Versions but the
    last ``keep`` are removed as it goes.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        rows = stage(batch)
        sections.upsert(rows, ["extracted_at"], checkpoint, batch_id)
        touched = rows.select("base").distinct()
        scored = rescore_sections(sections.read_beside(touched), card).withColumn("batch", F.lit(batch_id).cast("long"))
        scores.upsert(scored, ["batch"], checkpoint, batch_id)
        for table in (sections, scores):
            table.compact(keep)

    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
