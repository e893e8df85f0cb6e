"""What the training-data operators share: staged tables, input columns, text keys and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.sources.shared import stage, stage_alone

__all__ = ["components", "documents", "id_text", "stage", "stage_alone", "text_key", "text_keys"]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of ``docs``; a null text is empty.

    Other columns, whatever their names, are left behind here, so none of them
    can clash with the working columns of an operator.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256, by which equal texts meet."""
    return F.unhex(F.left(F.sha2(text, 256), F.lit(32)))


def text_keys(text: Column) -> list[Column]:
    """120 bits of a text's SHA-256 as k1 and k2, two whole numbers: lighter than ``text_key`` where a text has many rows."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for name, at in (("k1", 1), ("k2", 16))]


def components(links: DataFrame) -> DataFrame:
    """(sid, root) of every end of the staged ``links`` (a, b), root the least that it reaches.

    Each end points to the least one beside it, and pointers are followed to
    their ends. Then links join these ends instead, each once, and those within
    one are gone, so later rounds handle few rows; ends at least halve within
    two rounds. Every round's tables are staged, and only whether something is
    left reaches the driver. Both sides of each join by a root are staged
    tables, so adaptive execution can split a root that many ends share.
    """
    labels = None
    while True:
        ends = links.select(F.col("a").alias("sid"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("sid"), F.col("a").alias("to")))
        near = stage(ends.groupBy("sid").agg(F.min("to").alias("to")).select("sid", F.least("sid", "to").alias("root")))
        while True:
            jump = near.select(F.col("sid").alias("root"), F.col("root").alias("far"))
            following = stage(near.join(jump, "root").select("sid", "root", "far"))
            near = following.select("sid", F.col("far").alias("root"))
            if following.where("root <> far").isEmpty():
                break
        if labels is None:
            labels = near
        else:
            far = near.select(F.col("sid").alias("root"), F.col("root").alias("far"))
            labels = stage(labels.join(far, "root", "left").select("sid", F.coalesce("far", "root").alias("root")))
        to = lambda x: near.select(F.col("sid").alias(x), F.col("root").alias(f"root_{x}"))
        met = links.join(to("a"), "a").join(to("b"), "b").where("root_a <> root_b")
        links = stage(met.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        if links.isEmpty():
            return labels
