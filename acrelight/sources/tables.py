"""Scans and sinks: CSV, section JSON, external JSON, page snapshots, listings, snapshots of tables.

Schemas are explicit. A record that doesn't fit becomes a quarantined row with
its text, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrelight.dims import DEFAULT_SCORECARD, Factor, Scorecard
from acrelight.functions.values import blank_to_null, extracted
from acrelight.operators.mapping import FieldMapping

SECTIONS = ["subject_property", "rent_comps", "construction", "sale_comps", "demographics", "submarket_report", "market_report", "external", "unknown"]
TEXT_ITEM = "struct<text:string,label:string,level:int>"
TABLE = "struct<table_index:int,page_number:int,headers:array<string>,column_types:map<string,string>,rows:array<map<string,string>>,row_count:int,column_count:int,markdown:string,error:string>"
EXTERNAL = "crime struct<violent_crime_index:double,property_crime_index:double,total_crime_index:double>, schools struct<average_rating:double>, walkScore struct<walk_score:int,transit_score:int,bike_score:int>"
SECTION_SCHEMA = (
    "section string, section_name string, page_range struct<start:int,end:int>, "
    f"pages array<struct<page_number:int,text_items:array<{TEXT_ITEM}>,headers:array<struct<text:string,level:int>>,table_count:int,tables:array<{TABLE}>>>, "
    f"tables array<{TABLE}>, "
    "raw_text string, metadata struct<source_file:string,total_pages_in_section:int,total_tables_in_section:int,extraction_date:string,processor:string>, "
    f"{EXTERNAL}, _corrupt_record string"
)
EXTERNAL_SCHEMA = f"{EXTERNAL}, _corrupt_record string"
TABLES = ["properties", "documents", "extracted_files", "scores", "generated_files", "files"]
# File families by extension.
FAMILIES = {"pdf": "pdf", "csv": "csv", "xlsx": "excel", "xls": "excel", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "bmp": "image"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with a header, cells trimmed, blank lines skipped; types inferred only without a schema."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def name_parts(file_name: Column) -> list[Column]:
    """(base, section) of '<base>_<section>.json'; without a section the base is the stem and the section 'combined'."""
    stem = F.regexp_replace(file_name, r"\.json\z", "")
    section = extracted(stem, rf"_({'|'.join(SECTIONS)})\z")
    base = F.when(section.isNotNull(), F.regexp_replace(stem, rf"_({'|'.join(SECTIONS)})\z", "")).otherwise(stem)
    return [base.alias("base"), F.coalesce(section, F.lit("combined")).alias("section")]


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Section files as (base, section, document, status)."""
    raw = spark.read.schema(SECTION_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    fields = [c for c in raw.columns if c != "_corrupt_record"]
    return raw.select(*name_parts(F.col("_metadata.file_name")), F.struct(*fields).alias("document"), F.col("_corrupt_record").alias("bad"), F.when(F.col("_corrupt_record").isNull(), "success").otherwise("error").alias("status"))


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """External features as (base, crime, schools, walkScore)."""
    raw = spark.read.schema(EXTERNAL_SCHEMA).option("multiLine", True).json(path)
    return raw.select(name_parts(F.col("_metadata.file_name"))[0], "crime", "schools", "walkScore")


def with_external(records: DataFrame, external: DataFrame, key: str = "base") -> DataFrame:
    """``records`` with a struct of external features; a record without them stays."""
    packed = external.select(key, F.struct(*[c for c in external.columns if c != key]).alias("external"))
    return records.join(packed, key, "left")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def load_tables(spark: SparkSession, folder: str, names: list[str] = TABLES) -> dict[str, DataFrame]:
    """The relational snapshot: one Parquet table for each name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 16, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table of a database; with a whole-number ``key``, in ranges of it that as many tasks read at once.

    The key's bounds are asked first, one row. Filters and columns reach the
    database. Rows without a key are in the first range. The driver's jar must be there.
    """
    options = {"url": url, "dbtable": table, **(properties or {})}
    reader = spark.read.format("jdbc").options(**options)
    if key is None:
        return reader.load()
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = spark.read.format("jdbc").options(**{k: v for k, v in options.items() if k != "dbtable"}).option("query", f"SELECT min({name}) AS lo, max({name}) AS hi FROM {table}").load().head()
    if low is None or low == high:
        return reader.load()
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high + 1).option("numPartitions", partitions).load()


def load_jdbc_tables(spark: SparkSession, url: str, keys: Mapping[str, str], partitions: int = 16, properties: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The relational snapshot from a database: each table of ``keys`` in ranges of its key."""
    return {n: read_jdbc(spark, url, n, key, partitions, properties) for n, key in keys.items()}


def file_registry(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """(path, file_name, size, modified, display_name) of the files under ``path``, without their contents.

    ``names`` (file_name, base_filename, original_filename) gives display names;
    else a file's stem without its mark 'e_'.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    stem = F.regexp_replace(F.regexp_replace("file_name", r"\.[^.]*\z", ""), "^e_", "")
    if names is None:
        return listed.withColumn("display_name", stem)
    shown = F.coalesce(blank_to_null(F.col("base_filename")), blank_to_null(F.regexp_replace("original_filename", r"\.[^.]*\z", "")), stem)
    return listed.join(names, "file_name", "left").withColumn("display_name", shown).drop("base_filename", "original_filename")


def files_by_user(files: DataFrame, user: str) -> DataFrame:
    return files.where(F.col("user_id") == user).orderBy(F.desc("created_at"))


def file_by_id(files: DataFrame, file_id: int) -> DataFrame:
    return files.where(F.col("id") == file_id)


def union_listings(uploaded: DataFrame, extracted_files: DataFrame) -> DataFrame:
    """Both listings with a mark of where each row is from."""
    return uploaded.withColumn("is_extracted", F.lit(False)).unionByName(extracted_files.withColumn("is_extracted", F.lit(True)), allowMissingColumns=True)


def route_files(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """``files`` with the family of their extension, or an error."""
    extension = F.lower(F.regexp_extract(name_col, r"\.([^.]+)\z", 1))
    family = F.try_element_at(F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair)), extension)
    return files.withColumns({"kind": family, "error": F.when(family.isNull(), F.concat(F.lit("unsupported type: "), extension))})


def with_status(df: DataFrame, error: Column) -> DataFrame:
    return df.withColumns({"processing_status": F.when(error.isNull(), "success").otherwise("error"), "error": error})


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows of a frame with processing_status."""
    return df.where("processing_status = 'success'"), df.where("processing_status <> 'success'")


def batch_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("processing_status") == "success").alias("succeeded"), F.count_if(F.col("processing_status") != "success").alias("failed"))


def load_scorecard(text: str | None = None, base: Scorecard = DEFAULT_SCORECARD) -> Scorecard:
    """The default scorecard with the factors and cut-offs of a saved JSON text in place of its own."""
    saved: Mapping = json.loads(text) if text else {}
    factors = []
    for f in base.factors:
        own = saved.get("factors", {}).get(f.key, {})
        points = own.get("thresholds")
        factors.append(Factor(f.key, own.get("name", f.name), own.get("weight", f.weight), own.get("dataPath", f.path), own.get("lowerIsBetter", f.lower_is_better), tuple(points.get(str(i)) for i in range(10, 0, -1)) if points else f.thresholds))
    cuts = saved.get("thresholds", {})
    return Scorecard(tuple(factors), cuts.get("moveForward", base.forward), cuts.get("quickCheck", base.review))


def load_mappings(text: str) -> list[FieldMapping]:
    """Field mappings from a JSON text of sheets with lists of fields."""
    sheets = json.loads(text)["sheets"]
    return [FieldMapping(sheet, f["cell"], f.get("label", ""), f.get("json_path"), f.get("fallback_path"), f.get("transform"), f.get("fallback_transform"), f.get("source", "pdf_extract")) for sheet, found in sheets.items() for f in found.get("fields", [])]


MAPPING_SHEET = "struct<fields:array<struct<cell:string,label:string,json_path:string,fallback_path:string,transform:string,fallback_transform:string,source:string>>>"


def read_mappings(sheets: DataFrame) -> DataFrame:
    """(sheet, cell, label, json_path, fallback_path, transform, fallback_transform, source) of sheets (sheet, json); a text that is no sheet has none."""
    read = sheets.select("sheet", F.inline(F.from_json("json", MAPPING_SHEET)["fields"]))
    return read.withColumns({"label": F.coalesce("label", F.lit("")), "source": F.coalesce("source", F.lit("pdf_extract"))})


def write_sections(sections: DataFrame, path: str) -> None:
    """Section documents as JSON, a folder for each section."""
    sections.write.partitionBy("section").mode("overwrite").json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """A snapshot of scores; a reader sees the old one or the new one, as snapshots go to paths of their own."""
    scores.write.mode("errorifexists").parquet(path)


def stem(path: str) -> str:
    return PurePosixPath(path).stem
